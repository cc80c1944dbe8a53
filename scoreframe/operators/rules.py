"""Data-quality rules. Each gives issue rows (severity, file, row_id, field, message, suggested_fix)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.sources.stages import stage

ISSUE = ("severity", "file", "row_id", "field", "message", "suggested_fix")


def _issues(df: DataFrame, file: str, row: str | Column, field: str | Column, message: Column, fix: str, severity: str = "error") -> DataFrame:
    row = F.col(row) if isinstance(row, str) else row
    field = F.lit(field) if isinstance(field, str) else field
    return df.select(F.lit(severity).alias("severity"), F.lit(file).alias("file"), row.cast("string").alias("row_id"), field.alias("field"), message.alias("message"), F.lit(fix).alias("suggested_fix"))


def _cells(df: DataFrame, row: str, cols: Sequence[str]) -> DataFrame:
    return df.select(F.col(row).alias("_row"), F.inline(F.array(*[F.struct(F.lit(c).alias("_f"), F.col(c).cast("string").alias("_t"), F.col(c).cast("string").try_cast("double").alias("_v")) for c in cols])))


def rule_columns(df: DataFrame, file: str, required: Sequence[str]) -> DataFrame:
    """One issue per required column that is missing; the columns are known without reading."""
    lacking = sorted(set(required) - set(df.columns))
    rows = [("error", file, "header", c, f"missing required column {c}", "add the column") for c in lacking]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in ISSUE))


def rule_duplicate(df: DataFrame, file: str, key: str, pos: str) -> DataFrame:
    """Rows whose key stands at an earlier pos (unique; null first). The first rows of repeated keys are counted map-side
    and stored, so that the join back can split a key that most rows have; a null key is a key."""
    place = F.struct(F.col(pos).isNotNull(), F.col(pos).alias("pos"))
    first = df.groupBy(F.struct(key).alias("_key")).agg(F.count("*").alias("_n"), F.min(place).alias("_first")).filter("_n > 1")
    rows = df.withColumn("_key", F.struct(key)).join(stage(first.select("_key", "_first")), "_key").filter(place > F.col("_first"))
    return _issues(rows, file, key, key, F.concat(F.lit("duplicate of row "), F.col("_first.pos").cast("string")), "remove one of the rows")


def rule_range(df: DataFrame, file: str, row: str, cols: Sequence[str], low: float, high: float) -> DataFrame:
    bad = _cells(df, row, cols).filter(S.missing(F.col("_t")).isNotNull() & (F.col("_v").isNull() | ~F.col("_v").between(low, high)))
    return _issues(bad, file, "_row", F.col("_f"), F.lit(f"value is not a number from {low:g} to {high:g}"), "correct the value")


def rule_scores(df: DataFrame, file: str, row: str) -> DataFrame:
    cols = [c for c in df.columns if c.endswith("_score") and not c.endswith("match_score")]
    return rule_range(df, file, row, cols, 1, 10)


def rule_nonnegative(df: DataFrame, file: str, row: str, cols: Sequence[str]) -> DataFrame:
    bad = _cells(df, row, cols).filter(S.missing(F.col("_t")).isNotNull() & (F.col("_v").isNull() | (F.col("_v") < 0)))
    return _issues(bad, file, "_row", F.col("_f"), F.lit("value must not be negative"), "correct the value")


def rule_requires(df: DataFrame, file: str, row: str, when: Column, fields: Sequence[str], severity: str = "error") -> DataFrame:
    bad = _cells(df.filter(when), row, fields).filter(S.missing(F.col("_t")).isNull())
    return _issues(bad, file, "_row", F.col("_f"), F.concat(F.col("_f"), F.lit(" is required here")), "fill in the field", severity)


def rule_allowed(df: DataFrame, file: str, row: str, col: str, values: Sequence[str]) -> DataFrame:
    bad = df.filter(S.missing(F.col(col)).isNotNull() & ~F.col(col).isin(*values))
    return _issues(bad, file, row, col, F.concat(F.lit("value is not allowed: "), F.col(col)), "use an allowed value")


def rule_reference(df: DataFrame, file: str, row: str, col: str, parent: DataFrame, key: str) -> DataFrame:
    bad = df.filter(F.col(col).isNotNull()).join(parent.select(F.col(key).alias(col)), col, "left_anti")
    return _issues(bad, file, row, col, F.concat(F.lit("unknown reference "), F.col(col).cast("string")), "use a known id")


def rule_config(weights: DataFrame, file: str, column: str, columns: Sequence[str]) -> DataFrame:
    bad = weights.filter(~F.col(column).isin(*columns))
    return _issues(bad, file, column, column, F.concat(F.lit("weight of an unknown column "), F.col(column)), "name an existing column")


def rule_present(df: DataFrame, file: str, row: str, cols: Sequence[str]) -> DataFrame:
    return rule_requires(df, file, row, F.lit(True), cols, "warning")


def rule_coverage(df: DataFrame, file: str, row: str, cols: Sequence[str], least: float = 0.25) -> DataFrame:
    n = F.size(F.filter(F.array(*[F.col(c).cast("string") for c in cols]), lambda x: x.isNotNull())) / len(cols)
    bad = df.withColumn("_n", n).filter(F.col("_n") < least)
    return _issues(bad, file, row, "coverage", F.format_string("only %d%% of the scoring columns have values", F.bround(F.col("_n") * 100).cast("int")), "add inputs", "warning")


def rule_outputs(df: DataFrame, file: str, row: str, url: str, score: str, status: str, pair: tuple[str, str], evidence: str, blocked: Sequence[str]) -> DataFrame:
    """Rules of extraction outputs: unsafe urls, accepted rows below 0.9, half pairs, missing evidence."""
    from scoreframe.operators.filters import is_unsafe_url

    accepted = F.col(status) == "accepted"
    return reduce(DataFrame.unionByName, (
        _issues(df.filter(is_unsafe_url(F.col(url), blocked)), file, row, url, F.lit("unsafe url"), "remove the row"),
        _issues(df.filter(accepted & (F.coalesce(score, F.lit(0.0)) < 0.9)), file, row, score, F.lit("accepted below 0.9"), "send to review"),
        _issues(df.filter(accepted & (F.col(pair[0]).isNull() | F.col(pair[1]).isNull())), file, row, pair[0], F.lit("accepted without both values"), "send to review"),
        _issues(df.filter(accepted & S.missing(F.col(evidence)).isNull()), file, row, evidence, F.lit("accepted without evidence"), "add the evidence"),
    ))


def validate(*issues: DataFrame) -> DataFrame:
    """One issue table; a blank row label becomes "row"."""
    both = reduce(DataFrame.unionByName, issues)
    return both.withColumn("row_id", F.coalesce(S.missing(F.col("row_id")), F.lit("row")))
