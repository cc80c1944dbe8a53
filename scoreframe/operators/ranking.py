"""Ranking builds: scores per weight group, tiers, buckets, ranks, live scores under preference rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.functions.fixed import CONFIDENCE_CUTS, FUNNEL_CUTS, GROUP_WEIGHTS, RANK_CUTS, SCENARIO_WEIGHTS, TIER_CUTS
from scoreframe.operators import aggregates as A
from scoreframe.operators import joins as J
from scoreframe.operators import sorting as T
from scoreframe.sources.stages import stage

Weights = Sequence[tuple[str, float]]


def two_decimals(x: Column) -> Column:
    """Two decimals, ties to even, by the binary value (bround goes by the shortest text of the double)."""
    return F.rint(x * 100) / 100


def rank_rounded(df: DataFrame, score: str, keys: Sequence[str], excluded: Column | None = None, name: str = "rank") -> DataFrame:
    """Competition rank over scores with few distinct values (fixed decimals): rows per score are counted map-side, the
    counts are summed from the best down, and the rank is joined back. No window holds the rows of a whole key."""
    return rank_many(df, {name: score}, keys, excluded)


def rank_many(df: DataFrame, scores: dict[str, str], keys: Sequence[str], excluded: Column | None = None) -> DataFrame:
    """rank_rounded for several (rank name, score column) from one count over all of them. The ranks, one row per key and
    distinct score, are stored and broadcast if they are at most a million."""
    fit = F.lit(True) if excluded is None else ~F.coalesce(excluded, F.lit(False))
    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), F.col(c).alias("_score")) for n, c in scores.items()]))
    counts = df.filter(fit).select(*keys, cells).filter("_score IS NOT NULL").groupBy(*keys, "_name", "_score").agg(F.count("*").alias("_n"))
    better = Window.partitionBy(*keys, "_name").orderBy(F.col("_score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("_r", F.coalesce(F.sum("_n").over(better), F.lit(0)) + 1)
    wide = stage(ranks.groupBy(*keys, "_score").agg(*[F.max(F.when(F.col("_name") == n, F.col("_r"))).alias(f"_{n}") for n in scores]))
    few = wide.limit(1_000_001).count() <= 1_000_000
    out = df
    for n, c in scores.items():
        one = wide.select(*keys, F.col("_score").alias(c), f"_{n}").filter(F.col(f"_{n}").isNotNull())
        out = out.join(F.broadcast(one) if few else one, [*keys, c], "left").withColumn(n, F.when(fit, F.col(f"_{n}"))).drop(f"_{n}")
    return out


def minmax_all(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Several columns scaled to 10 (lowest) .. 1 (highest) over the whole table; the ends are one row."""
    given = df.select("*", *[c.alias(f"_x_{n}") for n, c in columns.items()])
    ends = given.agg(*[f(f"_x_{n}").alias(f"_{e}_{n}") for n in columns for e, f in (("lo", F.min), ("hi", F.max))])
    out = given.crossJoin(F.broadcast(ends))
    for n in columns:
        x, lo, hi = F.col(f"_x_{n}"), F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        out = out.withColumn(n, F.when(x.isNull(), None).when(lo == hi, 10.0).otherwise(F.bround(10 - 9 * F.try_divide(x - lo, hi - lo), 1)))
    return out.select(*df.columns, *columns)


def application_bucket(tier: Column, attendance: Column) -> Column:
    hard = tier.isin("Very High Risk", "Reach")
    return F.when(hard & (attendance >= 8), "Dream").when(tier == "Very High Risk", "Reach").otherwise(tier)


def driver_label(column: str) -> str:
    """Name of a component as drivers show it."""
    return column.removeprefix("admissions_").removeprefix("attendance_").replace("_score", "").replace("_", " ").title()


def rank_details(built: DataFrame, components: Sequence[str], rank: str, coverage: str, excluded: Column, reason: Column) -> DataFrame:
    """built with funnel, rank_band, rank_confidence and summary: bands of the rank, confidence by coverage, excluded rows
    apart, and a sentence from the two strongest and weakest drivers."""
    out = F.coalesce(excluded, F.lit(False))
    r = F.col(rank)
    funnel = S.label_by_threshold(r, FUNNEL_CUTS)
    band = F.when(out, "Excluded by hard-no").otherwise(S.label_by_threshold(r, RANK_CUTS, "Incomplete data"))
    confidence = F.when(out, "excluded").otherwise(S.label_by_threshold(F.coalesce(F.col(coverage), F.lit(0.0)), CONFIDENCE_CUTS))
    plus, minus = (F.slice(F.filter(F.split(side, "; "), lambda x: x != ""), 1, 2) for side in T.top_drivers([(driver_label(c), F.col(c)) for c in components], names_only=True))
    names = lambda side: F.array_join(side, " and ")
    parts = F.array(
        F.when(F.size(plus) > 0, F.concat(names(plus), F.when(F.size(plus) == 1, " helps").otherwise(" help"), F.lit(" this entity"))),
        F.when(F.size(minus) > 0, F.concat(names(minus), F.when(F.size(minus) == 1, " is a weaker driver").otherwise(" are weaker drivers"))),
        F.when((F.size(plus) == 0) & (F.size(minus) == 0), "The Decision Rank is driven by available scored components"),
        F.when(confidence.isin("partial", "provisional"), F.concat(F.lit("Rank confidence is "), confidence, F.lit(" because scored input coverage is limited"))),
    )
    said = F.concat(F.array_join(F.array_compact(parts), ". "), F.lit("."))
    why = F.concat(F.lit("Excluded from Decision Rank because of a hard-no flag"), F.coalesce(F.concat(F.lit(": "), S.missing(reason)), F.lit(".")))
    return built.withColumn("funnel", funnel).withColumn("rank_band", band).withColumn("rank_confidence", confidence).withColumn("summary", F.when(out, why).otherwise(said))


def low_confidence_drivers(missing: Column, warnings: Column, band: Column) -> Column:
    """What a rank lacks: missing inputs, warnings, low quality of the statistics."""
    return F.array_join(F.array_compact(F.array(F.concat(F.lit("missing: "), S.missing(missing)), F.concat(F.lit("warnings: "), S.missing(warnings)), F.when(F.lower(S.clean(band)) == "low", "low admissions stats data quality"))), "; ")


def build_rankings(projection: DataFrame, keys: Sequence[str], groups: dict[str, Weights], overall: Weights, scenarios: dict[str, Weights], excluded: Column | None = None) -> DataFrame:
    """projection (keys, components): group scores and coverage, overall score, completeness, tier, bucket, drivers, one
    rank per scenario and overall. ``admissions`` sets the tier and ``attendance`` the bucket. Scores have two decimals;
    the tier uses the exact one. Ranks are within ``keys``."""
    components = [c for w in groups.values() for c, _ in w]
    out = projection
    for name, weights in groups.items():
        score, coverage = A.weighted_score(weights)
        out = out.withColumn(f"_{name}", score).withColumn(f"{name}_score", two_decimals(F.col(f"_{name}"))).withColumn(f"{name}_coverage", F.bround(coverage * 100, 0))
    score, coverage = A.weighted_score(overall)
    out = out.withColumn("overall_score", two_decimals(score)).withColumn("overall_coverage", F.bround(coverage * 100, 0))
    out = out.withColumn("completeness", F.bround(A.completeness(components), 2)).withColumn("tier", S.label_by_threshold(F.col("_admissions"), TIER_CUTS, "Unscored"))
    positive, negative = T.top_drivers([(driver_label(c), F.col(c)) for c in components])
    out = out.withColumn("bucket", application_bucket(F.col("tier"), F.col("_attendance"))).withColumn("confidence", S.label_by_threshold(F.col("overall_coverage"), CONFIDENCE_CUTS)).withColumn("positive_drivers", positive).withColumn("negative_drivers", negative)
    for name, weights in scenarios.items():
        out = out.withColumn(f"{name}_score", two_decimals(A.weighted_score(weights)[0]))
    out = rank_many(out, {f"{n}_rank": f"{n}_score" for n in ("overall", *scenarios)}, keys, excluded)
    return out.drop(*[f"_{n}" for n in groups])


def configured(rows: Sequence[tuple[str, str, float]]) -> dict[str, list[tuple[str, float]]]:
    """Weights by name, in order, of rows (name, column, weight)."""
    out: dict[str, list[tuple[str, float]]] = {}
    for name, column, weight in rows:
        out.setdefault(name, []).append((column, weight))
    return out


def scenario_name(label: str) -> str:
    """Begins the column names of a scenario; a component may be called like its label."""
    return re.sub("[^a-z]+", "_", label.lower()) + "_scenario"


def rank_configured(projection: DataFrame, keys: Sequence[str], excluded: Column) -> DataFrame:
    """build_rankings under the prescribed group and scenario weights. Components that the projection doesn't have count as
    absent; completeness stands for the completeness component."""
    groups, scenarios = configured(GROUP_WEIGHTS), configured(SCENARIO_WEIGHTS)
    parts = {"admissions": groups["Admissions Score"], "attendance": groups["Attendance Score"]}
    components = [c for w in parts.values() for c, _ in w]
    named = {scenario_name(n): w for n, w in scenarios.items()}
    made = {"admissions_score", "attendance_score", "data_completeness_score"}
    lacking = {c for w in (*groups.values(), *named.values()) for c, _ in w} - made - set(projection.columns)
    df = projection.withColumns({c: F.lit(None).cast("double") for c in sorted(lacking)})
    df = df.withColumn("data_completeness_score", F.bround(A.completeness(components), 2))
    return build_rankings(df, keys, parts, groups["Overall School Value"], named, excluded).drop(*sorted(lacking))


def live_score(entities: DataFrame, prefs: DataFrame, pref_id: str, components: Sequence[str]) -> DataFrame:
    """Every entity under every preference row (columns w_<component>): mean over the present components, and coverage.
    Rows whose weights are all zero have no score. Preference rows are user rows and must number at most 10,000."""
    n = prefs.limit(10_001).count()
    if n > 10_000:
        raise ValueError("more than 10,000 preference rows: score them in parts")
    rows = entities.crossJoin(F.broadcast(prefs.select(pref_id, *[f"w_{c}" for c in components])))
    weight = lambda c: F.coalesce(F.col(f"w_{c}"), F.lit(0.0))
    zero = F.lit(0.0)
    present = sum((F.when(F.col(c).isNotNull(), weight(c)).otherwise(0.0) for c in components), zero)
    total = sum((F.coalesce(F.col(c) * weight(c), zero) for c in components), zero)
    every = sum((weight(c) for c in components), zero)
    return rows.withColumn("score", F.when(present > 0, total / present)).withColumn("coverage", F.when(every > 0, F.bround(present / every * 100, 0))).drop(*[f"w_{c}" for c in components])


def merge_overrides(global_weights: Column, overrides: Column, aliases: dict[str, str]) -> Column:
    """Map of weights: overrides whose number lies in 0..100 replace or add to the global ones, keys by alias first."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    named = overrides if table is None else F.map_from_entries(F.array_distinct(F.transform(F.map_entries(overrides), lambda e: F.struct(F.coalesce(F.element_at(table, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))))
    sound = F.map_filter(named, lambda k, v: v.between(0, 100))
    return F.map_zip_with(global_weights, sound, lambda k, g, o: F.coalesce(o, g))


def selector_rank(entities: DataFrame, selections: DataFrame, selection: str, fits: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Every entity under every selection of bands: the midpoint ``mid_<c>`` of a band replaces the profile's value of
    component c, and fits lists (component, spread, weight). The mean over the present components is ranked on four decimals."""
    rows = J.cross_profiles(selections, entities)
    fit = {c: S.fit_score(F.col(f"mid_{c}"), F.col(c), spread) for c, spread, _ in fits}
    present = sum((F.when(fit[c].isNotNull(), w).otherwise(0.0) for c, _, w in fits), F.lit(0.0))
    total = sum((F.coalesce(fit[c] * w, F.lit(0.0)) for c, _, w in fits), F.lit(0.0))
    scored = rows.withColumn("score", F.when(present > 0, F.rint(total / present * 10000) / 10000))
    return rank_rounded(scored, "score", [selection])
