"""Ranks, best rows, queues, slugs and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.sources.stages import drop_stage, stage

PARTS = 64  # parts of a key's values that are ordered apart


def in_parts(df: DataFrame, value: Column, keys: Sequence[str]) -> DataFrame:
    """df with ``_part``: the part of its key's values that the row's value falls into, from the smallest up, nulls last.
    Bounds are approximate quantiles, combined map-side, so a key with most of the rows is split evenly; equal values
    share a part. Any bounds give right results, as the parts only follow the order."""
    bounds = df.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], 1000))).alias("_bounds"))
    rows = df.withColumn("_v", value)
    rows = rows.join(bounds, list(keys), "left") if keys else rows.crossJoin(F.broadcast(bounds))  # one row
    part = F.when(F.col("_v").isNull() | F.isnan("_v"), PARTS + 1).otherwise(F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<double>")), lambda x: x < F.col("_v"))))
    return rows.withColumn("_part", part).drop("_bounds", "_v")


def places(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[Column], ties_shared: bool, name: str) -> DataFrame:
    """Place of each row in the order within its key: order refines ``value`` (a double) ascending. Rows are ordered in
    their part of the key, and the sizes of the parts before are added, so no task orders a whole key."""
    rows = in_parts(df, value, keys)
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    # one row per key and part
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, "_part", before.alias("_before"))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    placed = rows.withColumn("_place", F.rank().over(inner) if ties_shared else F.row_number().over(inner))
    out = placed.join(offsets, [*keys, "_part"])
    return out.select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """A stage of df with ``_part``, which rises with the order inside each key. Spark samples bounds for keys and order
    together, whatever their types, so a key with most of the rows lies in many parts. Rows equal in key and order share
    a part. Stored, since bounds are sampled anew whenever a plan runs."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with the place of each row in any order within its key. Rows are numbered in the ranges of ``in_ranges``; null
    keys are a group."""
    keyed = in_ranges(df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))), ["_key"], order)
    sizes = keyed.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.withColumn("_place", F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order)))
    out = placed.join(sizes.select("_key", "_part", before.alias("_before")), ["_key", "_part"])
    return out.select(*[c for c in df.columns if c != name], (F.col("_before") + F.col("_place")).alias(name))


CELLS = 1_000_000  # distinct scores up to which a key's are summed by one task


def rank_scores(df: DataFrame, score: str, keys: Sequence[str], excluded: Column | None = None, name: str = "rank") -> DataFrame:
    """Competition rank, best first; excluded and unscored rows have none. Null keys are a group. Rows are counted per key
    and score, map-side first, so that a score which most rows have is one row; the counts are stored, summed from the best
    down, in parts of their values if there are more than ``CELLS``, and joined back."""
    fit = F.col(score).isNotNull() & (F.lit(True) if excluded is None else ~F.coalesce(excluded, F.lit(False)))
    keyed = df.withColumns({"_key": F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")), "_fit": fit})
    cells = stage(keyed.filter("_fit").groupBy("_key", F.col(score).alias("_score")).agg(F.count("*").alias("_n")))
    above = lambda over: F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if cells.count() <= CELLS:
        ranks = cells.withColumn("_rank", above(Window.partitionBy("_key").orderBy(F.col("_score").desc())) + 1)
    else:
        number = F.col("_score").cast("double")
        parts = in_parts(cells, F.when(F.isnan(number), float("-inf")).otherwise(-number), ["_key"])
        sums = parts.groupBy("_key", "_part").agg(F.sum("_n").alias("_n"))
        before = sums.select("_key", "_part", above(Window.partitionBy("_key").orderBy("_part")).alias("_before"))
        inside = parts.withColumn("_inside", above(Window.partitionBy("_key", "_part").orderBy(F.col("_score").desc())))
        ranks = inside.join(before, ["_key", "_part"]).withColumn("_rank", F.col("_before") + F.col("_inside") + 1)
    ranked = keyed.withColumn("_score", F.col(score)).join(ranks.select("_key", "_score", "_rank"), ["_key", "_score"], "left")
    return ranked.select(*[c for c in df.columns if c != name], F.when(F.col("_fit"), F.col("_rank")).cast("long").alias(name))


def rank_scenarios(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """scores (keys, scenario, score): one rank per scenario."""
    return rank_scores(scores, "score", [*keys, "scenario"])


def live_rank(df: DataFrame, score: str, keys: Sequence[str], ties: Sequence[str], name: str = "live_rank") -> DataFrame:
    """Strict places after a total order; unscored rows have none."""
    order = [F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    return _placed(df.withColumn("_fit", F.col(score).isNotNull()), score, keys, order, False, name)


def _placed(df: DataFrame, score: str, keys: Sequence[str], order: Sequence[Column], ties_shared: bool, name: str) -> DataFrame:
    """Places of the rows that are _fit; the others have none and aren't ordered. Keys stand in for themselves as structs,
    so that null keys meet."""
    columns = [c for c in df.columns if c not in ("_fit", name)]
    keyed = df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
    number = F.col(score).cast("double")
    lead = F.when(F.isnan(number), float("-inf")).otherwise(-number)  # NaN is the largest score
    ranked = places(keyed.filter("_fit"), lead, ["_key"], order, ties_shared, name)
    rest = keyed.filter("NOT _fit").withColumn(name, F.lit(None).cast("long"))
    return ranked.select(*columns, F.col(name).cast("long").alias(name)).unionByName(rest.select(*columns, name))


def adjusted_rank(df: DataFrame, score: str, override: str, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Rank over override or score, shown on overridden rows only."""
    mixed = df.withColumn("_s", F.coalesce(override, score))
    return live_rank(mixed, "_s", keys, ties, "_r").withColumn("adjusted_rank", F.when(F.col(override).isNotNull(), F.col("_r"))).drop("_s", "_r")


def rank_movement(base: DataFrame, now: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """base, now (key, rank), parts (key, component, value): movement and the component that explains it."""
    drivers = parts.groupBy(key).agg(F.max_by("component", F.struct("value", "component")).alias("strongest"), F.min_by("component", F.struct("value", "component")).alias("weakest"), F.max(F.when(F.col("value").isNull(), F.col("component"))).alias("absent"))
    out = base.withColumnRenamed("rank", "base").join(now.withColumnRenamed("rank", "now"), key).join(drivers, key, "left")
    move = F.col("base") - F.col("now")
    return out.select(key, move.alias("moved"), F.when(move > 0, F.col("strongest")).when(move < 0, F.coalesce("absent", "weakest")).otherwise("unchanged").alias("reason"))


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pos: str) -> DataFrame:
    """The row that is strictly largest by order; the first of equals."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order], pos)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def priority_queue(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place", lead: Column | None = None) -> DataFrame:
    """Places in the order within each key, which is ordered in parts: by ``lead``, a number that the order refines
    upwards, or without one by sampled ranges of the order itself, of any types."""
    if lead is None:
        return numbered(df, keys, order, name)
    columns = [c for c in df.columns if c != name]
    keyed = df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
    return places(keyed, lead.cast("double"), ["_key"], order, False, name).select(*columns, F.col(name).cast("long").alias(name))


def unique_slug(df: DataFrame, text: str, pos: str) -> DataFrame:
    """Slugs in order of pos (unique): each row gets the first of base, base-2, base-3, ... that no earlier row has.

    The n-th row of a base starts at its n-th form. Where a form is also that of another base, the latest row gives way,
    and with it the later rows of its base, by one form; until no two rows have the same. Each round settles the first
    such row of every base, and most tables need none."""
    base = numbered(df.withColumn("_base", S.slugify(F.col(text))), ["_base"], [F.col(pos)], "_nth").withColumn("_form", F.col("_nth"))
    formed = F.when(F.col("_form") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_form").cast("string")))
    rows = stage(base.withColumn("slug", formed))
    while True:
        held = rows.groupBy("slug").agg(F.count("*").alias("_n"), F.min(pos).alias("_first")).filter("_n > 1")
        behind = rows.join(held, "slug").filter(F.col(pos) > F.col("_first"))
        moved = stage(behind.groupBy("_base").agg(F.min("_nth").alias("_from")))
        if moved.isEmpty():
            drop_stage(moved)
            return rows.select(*[c for c in df.columns if c != "slug"], "slug")
        shifted = rows.join(moved, "_base", "left").withColumn("_form", F.col("_form") + F.coalesce((F.col("_nth") >= F.col("_from")).cast("int"), F.lit(0)))
        new = stage(shifted.drop("_from").withColumn("slug", formed))
        drop_stage(rows)
        drop_stage(moved)
        rows = new


def merge_candidates(df: DataFrame, keys: Sequence[str], texts: Sequence[str], status: str, order: Sequence[str], pos: str) -> DataFrame:
    """One row per key: distinct sorted texts joined, the best status (later in ``order`` is better), the first position."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(status)), F.lit(0))
    return df.groupBy(*keys).agg(*[F.array_join(F.array_sort(F.collect_set(t)), "; ").alias(t) for t in texts], F.max_by(status, rank).alias(status), F.min(pos).alias(pos), F.count("*").alias("n"))


def best_pair(a: DataFrame, b: DataFrame, key: str, year: str, score: str) -> DataFrame:
    """The two best candidates of the latest year that both sets have, else the best of each."""
    order = lambda df: df.groupBy(key, year).agg(F.max_by("value", F.struct(score, "value")).alias("value"), F.max(score).alias(score))
    x, y = order(a), order(b)
    shared = x.select(key, year, F.col("value").alias("a")).join(y.select(key, year, F.col("value").alias("b")), [key, year])
    latest = shared.groupBy(key).agg(F.max_by(F.struct("a", "b", year), year).alias("p"))
    best = lambda df, n: df.groupBy(key).agg(F.max_by("value", F.struct(score, "value")).alias(n))
    rest = best(a, "_a").join(best(b, "_b"), key, "full").join(latest, key, "left")
    return rest.select(key, F.coalesce("p.a", "_a").alias("a"), F.coalesce("p.b", "_b").alias("b"), F.col(f"p.{year}").alias(year))
