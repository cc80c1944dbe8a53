"""Scores, consensus, conflicts, coverage counts and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.functions.fixed import REFUSALS


def weighted_score(weights: Sequence[tuple[str, float]]) -> tuple[Column, Column]:
    """(score, coverage) over wide columns: mean over the present values; share of the configured weight that is present."""
    present = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), float(w)).otherwise(0.0) for c, w in weights])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * float(w), F.lit(0.0)) for c, w in weights])
    return F.when(present > 0, total / present), present / float(sum(w for _, w in weights))


def weighted_score_long(values: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same over long rows (keys, component, value) and weights (group, component, weight), for any number of groups.
    Entities without any present component of a group have a null score there. Weights are broadcast up to 100,000 rows."""
    configured = weights.groupBy("group").agg(F.sum("weight").alias("_all"))
    w = weights.filter("weight > 0").join(configured, "group")
    present = F.when(F.col("value").isNotNull(), F.col("weight")).otherwise(0.0)
    few = weights.limit(100_001).count() <= 100_000
    out = values.join(F.broadcast(w) if few else w, "component").groupBy(*keys, "group").agg(F.sum(F.col("value") * F.col("weight")).alias("_t"), F.sum(present).alias("_p"), F.first("_all").alias("_all"))
    return out.select(*keys, "group", F.when(F.col("_p") > 0, F.col("_t") / F.col("_p")).alias("score"), (F.col("_p") / F.col("_all")).alias("coverage"))


def completeness(cols: Sequence[str]) -> Column:
    """Populated columns over all, times 10."""
    return F.size(F.filter(F.array(*[F.col(c).cast("string") for c in cols]), lambda x: x.isNotNull())) / len(cols) * 10


def minmax_score(df: DataFrame, value: str, keys: Sequence[str], name: str = "score") -> DataFrame:
    """10 for the lowest of a group, 1 for the highest, one decimal; all equal gives 10. The range is a grouped
    aggregate joined back, so it is combined map-side."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = F.when(F.col("_lo") == F.col("_hi"), 10.0).otherwise(F.bround(10 - 9 * F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), 1))
    return df.join(ends, list(keys)).withColumn(name, F.when(F.col(value).isNotNull(), x)).drop("_lo", "_hi")


def applicable_amount(same: Column, own: Sequence[Column], other: Sequence[Column], allowance: Column | None = None, variant: str = "both") -> Column:
    """First positive amount of the side that applies, then of the other side (variant "own_only" has no fallback for
    outsiders); less an allowance, at least 0."""
    a, b = S.first_positive(*own, *other), S.first_positive(*other, *(own if variant == "both" else ()))
    x = F.when(same, a).otherwise(b)
    return x if allowance is None else F.when(x.isNotNull(), F.greatest(F.lit(0.0), x - F.coalesce(allowance, F.lit(0.0))))


def policy_score(home: Column, state: Column, explicit: Column, text: Column) -> Column:
    """struct (score, warning): same state 10, yes 6, no 1, refusing text 1, other text 6, none 4, no home state null."""
    refused = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(r)) for r in REFUSALS])
    score = (
        F.when(S.clean(home) == "", None).when(home == state, 10.0).when(S.is_truthy(explicit), 6.0).when(S.is_falsey(explicit), 1.0)
        .when(refused, 1.0).when(S.clean(text) != "", 6.0).otherwise(4.0)
    )
    settled = (home == state) | S.is_truthy(explicit) | S.is_falsey(explicit)
    warning = F.when(S.clean(home) == "", "missing home state").when(settled, "").when(refused, "").when(S.clean(text) != "", "policy text not normalized").otherwise("missing policy")
    return F.struct(score.alias("score"), warning.alias("warning"))


def source_consensus(rows: DataFrame, key: str, source: str, metric: str) -> DataFrame:
    """Mean per source, then the plain mean of the sources with spread and count."""
    per = rows.groupBy(key, source).agg(F.avg(metric).alias("_m"))
    return per.groupBy(key).agg(F.avg("_m").alias("value"), (F.max("_m") - F.min("_m")).alias("spread"), F.count("_m").alias("n_sources"), F.array_sort(F.collect_set(F.col(source).cast("string"))).alias("sources"))


def quality_grade(n: Column, spread_a: Column, spread_b: Column) -> Column:
    """struct (rank, band): 1 high, 2 medium, 3 low, 4 review."""
    a, b = F.coalesce(spread_a, F.lit(0.0)), F.coalesce(spread_b, F.lit(0.0))
    rank = F.when((n >= 2) & (a <= 2) & (b <= 0.10), 1).when((n >= 2) & (a <= 5) & (b <= 0.20), 2).when(n >= 1, 3).otherwise(4)
    return F.struct(rank.alias("rank"), F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "review"))), rank).alias("band"))


def conflict_label(n: Column, spread_a: Column, spread_b: Column, minor: tuple[float, float] = (1, 0.05), major: tuple[float, float] = (2, 0.10)) -> Column:
    a, b = F.coalesce(spread_a, F.lit(0.0)), F.coalesce(spread_b, F.lit(0.0))
    return F.when(n < 2, "single_source").when((a > major[0]) | (b > major[1]), "major").when((a > minor[0]) | (b > minor[1]), "minor").otherwise("close_agreement")


def compare_sources(rows: DataFrame, key: str, source: str, value: str, sources: Sequence[str]) -> DataFrame:
    """One wide row per cluster: the distinct values of each source, sorted and joined, in a fixed source order."""
    text = F.concat_ws("; ", F.array_sort(F.collect_set(F.col(value).cast("string"))))
    return rows.groupBy(key).pivot(source, list(sources)).agg(text)


def coverage_counts(entities: DataFrame, rows: DataFrame, key: str, counters: dict[str, Column], unknown: int | None = 0) -> DataFrame:
    """Conditional counters per entity; ``unknown`` for entities without rows, or whose rows leave the condition null."""
    counted = rows.groupBy(key).agg(*[F.sum(c.cast("long")).alias(n) for n, c in counters.items()])
    out = entities.select(key).join(counted, key, "left")
    return out.select(key, *[F.coalesce(n, F.lit(unknown).cast("long")).alias(n) for n in counters])


def count_by(df: DataFrame, col: str, unknown: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(S.missing(F.col(col)), F.lit(unknown)).alias("label")).agg(F.count("*").alias("n")).orderBy("label")


def metric_report(df: DataFrame, metrics: dict[str, Column], notes: dict[str, str] | None = None) -> DataFrame:
    """(metric, value, note) rows from one aggregate."""
    one = df.agg(*[c.cast("long").alias(n) for n, c in metrics.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value"), F.lit((notes or {}).get(n, "")).alias("note")) for n in metrics])
    return one.select(F.inline(rows))


def field_population(tables: Sequence[tuple[str, DataFrame, Sequence[str]]], key: str) -> DataFrame:
    """(source, field, n): distinct keys with a value, over several tables."""
    parts = []
    for name, df, fields in tables:
        cells = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), S.missing(F.col(f).cast("string")).alias("v")) for f in fields])).alias("c"))
        parts.append(cells.filter("c.v IS NOT NULL").select(F.lit(name).alias("source"), "c.field", key))
    return reduce(DataFrame.unionByName, parts).groupBy("source", "field").agg(F.countDistinct(key).alias("n"))


def list_readiness(definitions: DataFrame, population: DataFrame, total: Column) -> DataFrame:
    """definitions (list, field, core), population (field, n): missing fields, smallest ratio and a label per list."""
    joined = definitions.join(population, "field", "left").withColumn("ratio", F.coalesce("n", F.lit(0)) / total)
    out = joined.groupBy("list").agg(F.min("ratio").alias("ratio"), F.array_sort(F.collect_list(F.when(F.coalesce("n", F.lit(0)) == 0, F.col("field")))).alias("missing"), F.count_if(F.col("core") & (F.coalesce("n", F.lit(0)) == 0)).alias("core_missing"))
    return out.withColumn("label", F.when(F.col("core_missing") > 0, "provisional").when((F.size("missing") > 0) | (F.col("ratio") < 0.95), "partial").otherwise("ready"))


def source_summary(tables: Sequence[DataFrame], name: str, url: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(name, url) for t in tables]).groupBy(name, url).agg(F.count("*").alias("n")).orderBy(name, url)


def top_counts_text(df: DataFrame, key: str, col: str, pos: str, n: int = 4) -> DataFrame:
    """"a: 5; b: 3" with the n most frequent values, ties by first seen."""
    counts = df.groupBy(key, col).agg(F.count("*").alias("_n"), F.min(pos).alias("_p"))
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), "_p", F.col(col).alias("v")))), 1, n)
    return counts.groupBy(key).agg(ordered.alias("o")).select(key, F.array_join(F.transform("o", lambda x: F.concat(x["v"], F.lit(": "), (-x["m"]).cast("string"))), "; ").alias("summary"))


def issue_counts(issues: DataFrame, key: str, severities: Sequence[str] = ("error", "warning", "info")) -> DataFrame:
    return issues.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in severities])


def requirement_summary(rows: DataFrame, key: str, category: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(category)), "; ").alias("categories"), F.count("*").alias("n"))


def reconcile(contributions: DataFrame, scores: DataFrame, keys: Sequence[str], tolerance: float = 1e-3) -> DataFrame:
    """Groups whose contributions don't add up to their score; empty if all do."""
    sums = contributions.groupBy(*keys).agg(F.sum("contribution").alias("total"))
    return scores.join(sums, list(keys), "left").filter(F.col("score").isNotNull() & (F.abs(F.col("score") - F.coalesce("total", F.lit(0.0))) > tolerance)).select(*keys, "score", "total")
