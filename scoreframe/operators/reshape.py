"""Wide to long and back, contributions, cells to tables, lines to sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.functions import text as X


def unpivot_policies(df: DataFrame, ids: Sequence[str], fields: Sequence[str], category: str = "policy") -> DataFrame:
    """(ids, category, field, value, value_type): the non-blank fields as rows."""
    long = df.select(*ids, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(list(ids), list(fields), "field", "value")
    return long.filter(S.missing(F.col("value")).isNotNull()).select(*ids, F.lit(category).alias("category"), "field", "value", S.value_type(F.col("value")).alias("value_type"))


def contributions(df: DataFrame, keys: Sequence[str], weights: Sequence[tuple[str, str, float]], excluded: str | None = None) -> DataFrame:
    """Entity x component rows: value, weight, share of the present weight, contribution, status."""
    columns = sorted({c for _, c, _ in weights})
    long = df.select(*keys, *([excluded] if excluded else []), F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in columns])))
    table = df.sparkSession.createDataFrame(list(weights), "group string, component string, weight double")
    rows = long.join(F.broadcast(table), "component")
    w = Window.partitionBy(*keys, "group")
    present = F.sum(F.when(F.col("value").isNotNull(), F.col("weight"))).over(w)
    share = F.when(F.col("value").isNotNull(), F.col("weight") / present)
    gone = F.coalesce(F.col(excluded), F.lit(False)) if excluded else F.lit(False)
    status = F.when(gone, "excluded").when(F.col("value").isNull(), "missing").otherwise("present")
    return rows.select(*keys, "group", "component", "value", "weight", share.alias("share"), F.bround(F.col("value") * share, 4).alias("contribution"), status.alias("status"), F.when(F.col("value").isNull(), F.concat(F.lit("no value for "), "component")).otherwise("").alias("missing_reason"))


def live_contributions(components: Sequence[tuple[str, Column, Column]]) -> Column:
    """array of (component, value, weight, included, reason, effect) from (name, value, weight)."""
    def one(name: str, value: Column, weight: Column) -> Column:
        included = value.isNotNull() & (F.coalesce(weight, F.lit(0.0)) > 0)
        reason = F.when(value.isNull(), "missing data").when(F.coalesce(weight, F.lit(0.0)) <= 0, "zero weight").otherwise("")
        effect = F.when(~included, "not counted").when(value >= 7.5, "helps").when(value <= 4.5, "hurts").otherwise("neutral")
        return F.struct(F.lit(name).alias("component"), value.alias("value"), weight.alias("weight"), included.alias("included"), reason.alias("reason"), effect.alias("effect"))

    return F.array(*[one(*c) for c in components])


def unpivot_links(df: DataFrame, ids: Sequence[str], kinds: Sequence[tuple[str, str]], placeholders: Sequence[str]) -> DataFrame:
    """(ids, kind, link, placeholder) from link columns; blank links go."""
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("link")) for kind, c in kinds])
    return df.select(*ids, F.inline(rows)).filter(S.missing(F.col("link")).isNotNull()).withColumn("placeholder", F.lower(F.trim("link")).isin(*placeholders))


def pivot_labels(cells: DataFrame, key: str, label: str, value: str, pos: str, known: Sequence[str]) -> DataFrame:
    """One wide row per key: values of the known labels joined in order, the rest as "label: value" text."""
    mapped = cells.withColumn("_l", F.when(F.col(label).isin(*known), F.col(label)).otherwise("other"))
    text = F.when(F.col("_l") == "other", F.concat(label, F.lit(": "), value)).otherwise(F.col(value))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text.alias("t")))), lambda x: x["t"]), " / ")
    return mapped.groupBy(key).pivot("_l", [*known, "other"]).agg(joined)


def cells_to_rows(cells: DataFrame, page: str, columns: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Cells (page, x, y, text) as rows by rounded y, columns by ranges of x, texts of one field in (y, x) order."""
    name = None
    for n, low, high in columns:
        test = (F.col("x") >= low) & (F.col("x") < high)
        name = F.when(test, n) if name is None else name.when(test, n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda c: c["text"]), " ")
    return cells.withColumn("_c", name).filter("_c IS NOT NULL").groupBy(page, F.bround("y", 1).alias("line")).pivot("_c", [c for c, _, _ in columns]).agg(joined)


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, tab, row, col, text, links, heading): cells of tables and lists."""
    return X.parse_html(pages, id_col, html_col).select(id_col, F.inline("cells"))


def pick_table(cells: DataFrame, id_col: str, words: Sequence[str]) -> DataFrame:
    """Cells of the first table of each page whose first row has all the words."""
    head = cells.filter("row = 0").groupBy(id_col, "tab").agg(F.lower(F.concat_ws(" ", F.collect_list("text"))).alias("h"))
    fits = head.filter(F.forall(F.array(*map(F.lit, words)), lambda w: F.contains("h", F.lower(w)))).groupBy(id_col).agg(F.min("tab").alias("tab"))
    return cells.join(fits, [id_col, "tab"], "left_semi")


def lines_to_sections(docs: DataFrame, id_col: str, text_col: str, header: str) -> DataFrame:
    """(id, section, header, n_lines, body): lines that match the pattern open a section; lines before the first are section 0."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    opens = F.col("line").rlike(header)
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("section", F.sum(opens.cast("long")).over(w)).withColumn("_open", opens)
    ordered = F.array_sort(F.collect_list(F.when(~F.col("_open"), F.struct("pos", "line"))))
    return numbered.groupBy(id_col, "section").agg(F.max(F.when(F.col("_open"), F.col("line"))).alias("header"), F.count_if(~F.col("_open")).alias("n_lines"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))


def to_comparable(parts: Sequence[tuple[DataFrame, str, Column, Column, Column]], low: float, high: float) -> DataFrame:
    """(source, key, name, value, note) from (frame, source, key, name, value); values out of range are blanked with a note."""
    out = None
    for df, source, key, name, value in parts:
        ok = value.between(low, high)
        one = df.select(F.lit(source).alias("source"), key.cast("string").alias("key"), name.cast("string").alias("name"), F.when(ok, value).alias("value"), F.when(value.isNotNull() & ~ok, "value out of range").otherwise("").alias("note"))
        out = one if out is None else out.unionByName(one)
    return out
