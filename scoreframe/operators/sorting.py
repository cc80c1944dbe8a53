"""Sorts, limits, top-k and set merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S


def final_order(df: DataFrame, keys: Sequence[str], rank: str, name: str) -> DataFrame:
    return df.orderBy(*keys, F.col(rank).asc_nulls_last(), name)


def top_drivers(components: Sequence[tuple[str, Column]], n: int = 3, high: float = 7, low: float = 5, names_only: bool = False) -> tuple[Column, Column]:
    """(positives, negatives) as texts: the n best with value >= high, the n worst with value <= low; ties in column order."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(label).alias("l"), c.alias("v")) for i, (label, c) in enumerate(components)])
    present = F.filter(cells, lambda x: x["v"].isNotNull())
    show = lambda x: x["l"] if names_only else F.concat(x["l"], F.lit(" "), S.fmt_trimmed(x["v"], 1))

    def side(sign: int, keep) -> Column:
        ordered = F.array_sort(F.transform(present, lambda x: F.struct((x["v"] * sign).alias("k"), x["i"].alias("i"), x["l"].alias("l"), x["v"].alias("v"))))
        return F.array_join(F.transform(F.filter(F.slice(ordered, 1, n), keep), show), "; ")

    return side(-1, lambda x: x["v"] >= high), side(1, lambda x: x["v"] <= low)


def top_ids(df: DataFrame, keys: Sequence[str], rank: str, ident: str, n: int) -> DataFrame:
    """Ids of the best n by rank as an array."""
    kept = df.filter(F.col(rank) <= n)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, ident))), lambda x: x[ident]).alias("ids"))


def page(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key, with how many remain."""
    w = Window.partitionBy(*keys).orderBy(*order)
    counts = df.groupBy(*keys).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("remaining"))
    return df.withColumn("shown", F.row_number().over(w)).filter(F.col("shown") <= n).join(counts, list(keys))


def generic_sort_key(c: Column, descending: bool = False) -> list[Column]:
    """Missing last both ways, numbers by value before texts, texts without case."""
    number = S.parse_number(c)
    first = [S.missing(c).isNull(), number.isNull()]
    rest = [number, F.lower(c)]
    return [f.asc() for f in first] + [r.desc_nulls_last() if descending else r.asc_nulls_last() for r in rest]


def lowest_cost_first(costs: Sequence[Column], rank: str) -> list[Column]:
    low = F.least(*[S.positive(c) for c in costs]) if len(costs) > 1 else S.positive(costs[0])
    return [low.asc_nulls_last(), F.col(rank).asc_nulls_last()]


def queue_order(status: str, order: Sequence[str], *rest: str) -> list[Column]:
    place = F.array_position(F.array(*map(F.lit, order)), F.col(status))
    return [F.when(place == 0, len(order) + 1).otherwise(place).asc_nulls_last(), *[F.col(r).asc_nulls_last() for r in rest]]


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def replace_merge(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, then the current rows whose key isn't replaced."""
    return new.unionByName(current.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns))


def replace_tagged(current: DataFrame, new: DataFrame, tag: str, value: str) -> DataFrame:
    """Drops current rows with the tag; new rows come first."""
    old = current.filter(~F.coalesce(F.col(tag) == value, F.lit(False)))
    return new.withColumn("part", F.lit(0)).unionByName(old.withColumn("part", F.lit(1)))


def preserve_merge(new: DataFrame, prior: DataFrame, keys: Sequence[str], kept: Sequence[str], status: str, closed: Sequence[str]) -> DataFrame:
    """Regenerated rows with the human fields of prior ones; prior rows in a closed state outlive their regeneration."""
    p = prior.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in new.columns if c not in keys])
    both = new.withColumn("_new", F.lit(True)).join(p.withColumn("_old", F.lit(True)), list(keys), "full")
    both = both.filter(F.col("_new") | F.col(f"_p_{status}").isin(*closed))
    out = [F.col(k) for k in keys]
    for c in new.columns:
        if c not in keys:
            held = F.coalesce(S.missing(F.col(f"_p_{c}")), F.col(c)) if c in kept else F.coalesce(F.col(c), F.col(f"_p_{c}"))
            out.append(held.alias(c))
    return both.select(*out)


def set_ops(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of both, of a only and of b only, marked."""
    both = a.intersect(b).withColumn("side", F.lit("both"))
    return both.unionByName(a.exceptAll(b).distinct().withColumn("side", F.lit("a"))).unionByName(b.exceptAll(a).distinct().withColumn("side", F.lit("b")))


def exclusive_lists(actions: DataFrame, keys: Sequence[str], list_col: str, order: Sequence[str]) -> DataFrame:
    """Each item is only on the list of its last action."""
    last = F.struct(*order)
    return actions.groupBy(*keys).agg(F.max_by(list_col, last).alias(list_col))
