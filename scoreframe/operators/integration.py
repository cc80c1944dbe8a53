"""Integration of matched feeds into canonical tables: score projection, costs, policies, statistics, name clusters.

Every function is one lazy plan over keyed tables. Matches come from ``joins.match_entities`` or an override join as
(row, entity, score, second, label, ignored); a match is safe if it is exact, or of high confidence with a gap.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.functions.fixed import GRADE_BANDS, RATE_CUTS, SCORE_BANDS
from scoreframe.operators import aggregates as A
from scoreframe.operators import graph as G
from scoreframe.operators import joins as J
from scoreframe.operators import matching as M
from scoreframe.operators import ranking as K
from scoreframe.sources.stages import stage

# Columns of a statistics row in the order in which they count, and ratings that replace components.
SCORE_FIELDS = ("published_mcat_average", "mcat_mean_enrolled", "mcat_median_matriculated", "mcat_median_accepted", "median_mcat")
GRADE_FIELDS = ("published_gpa_average", "overall_gpa_mean_enrolled", "overall_gpa_median_matriculated", "overall_gpa_median_accepted", "median_gpa")
RATINGS = {
    "could_live_here_4_years_score": "four_year_happiness_score", "location_fit_score": "attendance_location_score",
    "culture_fit_score": "attendance_culture_score", "regret_index_score": "regret_index_score",
}
GAP = 0.03
# Words that don't tell names apart, and the least score of near names.
STOP_WORDS = ("school", "college", "university", "medicine", "medical", "the", "of")
NEAR = 0.86


def _first(df: DataFrame, fields: Sequence[str]) -> Column:
    there = [F.col(f) for f in fields if f in df.columns]
    return F.coalesce(*there, F.lit(None)) if there else F.lit(None).cast("double")


def _costs(same: Column) -> tuple[Column, Column]:
    """(basis, basis less the scholarship) of an entity for a profile that is or isn't of its state."""
    basis = A.applicable_amount(same, [F.col("in_state")], [F.col("out_state")])
    return basis, F.when(basis.isNotNull(), F.greatest(F.lit(0.0), basis - F.coalesce("scholarship", F.lit(0.0))))


def _cost_ends(profiles: DataFrame, entities: DataFrame) -> DataFrame:
    """(home_state, _lo, _hi): the least and the most that any entity costs a profile of this home, from one row per state:
    its own entities' costs for insiders, and those of all other states for outsiders, of which the two best states are
    enough, as only one can be the home itself. The product of profiles and entities isn't needed."""
    inside, outside = _costs(F.lit(True))[1], _costs(F.lit(False))[1]
    by_state = entities.groupBy("state").agg(F.min(inside).alias("in_lo"), F.max(inside).alias("in_hi"), F.min(outside).alias("lo"), F.max(outside).alias("hi"))
    two = lambda value: F.slice(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(value.alias("v"), "state")))), 1, 2)
    most = by_state.agg(two(F.col("lo")).alias("least"), two(-F.col("hi")).alias("most"))
    homes = profiles.select("home_state").distinct().join(by_state.select(F.col("state").alias("home_state"), "in_lo", "in_hi"), "home_state", "left").crossJoin(F.broadcast(most))  # one row
    away = lambda two: F.get(F.transform(F.filter(two, lambda x: ~F.coalesce(x["state"] == F.col("home_state"), F.lit(False))), lambda x: x["v"]), 0)
    return homes.select("home_state", F.least("in_lo", away(F.col("least"))).alias("_lo"), F.greatest("in_hi", -away(F.col("most"))).alias("_hi"))


def score_projection(profiles: DataFrame, entities: DataFrame, stats: DataFrame, costs: DataFrame, policies: DataFrame, partners: DataFrame, profile_id: str, key: str) -> DataFrame:
    """Every profile against every entity: values used, fit scores, policy score, cost basis with its scaled scores,
    partner ratings, warnings and exclusion. Tables: profiles (profile_id, mcat_total, overall_gpa, home_state), entities
    (key, state, accepts_oos, manual_exclusion, median_mcat, median_gpa), stats (key, SCORE_FIELDS, GRADE_FIELDS,
    data_quality_band), costs (key, in_state, out_state, scholarship), policies (key, policy_value) about outsiders,
    partners (profile_id, key, RATINGS, hard_no). Dimensions hold one row per key; policies may hold several. Entities are
    joined with their dimensions before they meet the profiles, of which there are at most 10,000."""
    said = policies.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("policy_value")), " ").alias("policy_text"))
    wide = J.denormalize(entities, (stats, [key]), (costs, [key]), (said, [key]))
    ends = _cost_ends(profiles, wide).withColumnRenamed("home_state", "_home")
    ended = profiles.join(ends, F.col("home_state").eqNullSafe(F.col("_home")), "left").drop("_home")
    df = J.cross_profiles(ended, wide).join(partners, [profile_id, key], "left")
    score_used, grade_used = _first(df, SCORE_FIELDS), _first(df, GRADE_FIELDS)
    home, state = F.col("home_state"), F.col("state")
    same = F.coalesce(home == state, F.lit(False))
    policy = A.policy_score(home, state, F.col("accepts_oos"), F.coalesce("policy_text", F.lit("")))
    basis, adjusted = _costs(same)
    df = df.withColumn("score_used", score_used).withColumn("grade_used", grade_used).withColumn("policy", policy).withColumn("cost_basis", basis).withColumn("cost_adjusted", adjusted)
    scaled = F.when(F.col("_lo") == F.col("_hi"), F.when(F.col("cost_adjusted").isNotNull(), 10.0)).otherwise(F.bround(10 - 9 * F.try_divide(F.col("cost_adjusted") - F.col("_lo"), F.col("_hi") - F.col("_lo")), 1))
    low = F.col("data_quality_band") == "low"
    warnings = [
        (F.col("mcat_total").isNull(), "missing applicant MCAT"), (F.col("overall_gpa").isNull(), "missing applicant GPA"), (F.col("score_used").isNull(), "missing school MCAT"), (F.col("grade_used").isNull(), "missing school GPA"),
    ]
    texts = [*[F.when(t, F.lit(w)) for t, w in warnings], S.missing(F.col("policy.warning")), F.when(F.col("cost_basis").isNull(), "missing cost basis"), F.when(low, "low stats data quality")]
    excluded = F.when(S.is_truthy(F.col("hard_no")) | S.is_truthy(F.col("manual_exclusion")), True).when(S.is_falsey(F.col("hard_no")), False)
    ratings = [F.col(source).alias(target) for source, target in RATINGS.items() if source in df.columns]
    return df.select(
        profile_id, key, "score_used", "grade_used", F.bround(S.fit_score(F.col("mcat_total"), F.col("score_used"), 2), 1).alias("admissions_mcat_fit_score"),
        F.bround(S.fit_score(F.col("overall_gpa"), F.col("grade_used"), 0.08), 1).alias("admissions_gpa_fit_score"), F.col("policy.score").alias("admissions_oos_friendliness_score"),
        "cost_basis", "cost_adjusted", scaled.alias("attendance_cost_score"), scaled.alias("debt_burden_score"), *ratings, excluded.alias("excluded"),
        F.array_join(F.array_distinct(F.array_compact(F.array(*texts))), "; ").alias("warnings"),
    )


def is_safe(label: Column, score: Column, second: Column) -> Column:
    return F.coalesce((label == "exact") | ((label == "high_confidence") & (score - F.coalesce(second, F.lit(0.0)) >= GAP)), F.lit(False))


def _kept(df: DataFrame, row: str, master: DataFrame, key: str, amounts: Sequence[str]) -> DataFrame:
    paid = F.lit(False)
    for a in amounts:
        paid = paid | F.coalesce(F.col(a) > 0, F.lit(False))
    close = (F.col("label") == "high_confidence") & (F.col("score") - F.coalesce("second", F.lit(0.0)) < GAP)
    df = df.join(master.select(key, F.col("kind").alias("_kind"), F.col("active").alias("_active")), key, "left")
    active = F.coalesce((F.col("_kind") == "MD") & F.col("_active"), F.lit(False))
    df = df.withColumn("safe", paid & active & is_safe(F.col("label"), F.col("score"), F.col("second")))
    reason = F.when(~paid, "all_zero_cost_row").when(F.coalesce(close, F.lit(False)), "ambiguous_high_confidence_cost_match").when(~active, "not_active_md_cost_row").otherwise("unsafe_cost_match")
    notes = [S.missing(F.col("notes")), F.when(~paid, "all reported cost fields are zero"), F.when(F.coalesce(close, F.lit(False)), "ambiguous high-confidence match"), F.when(~active, "matched entity is not an active row of the kind")]
    return df.select(row, key, *amounts, "score", "second", "label", "safe", F.when(~F.col("safe"), reason).alias("reason"), F.array_join(F.array_compact(F.array(*notes)), "; ").alias("notes"))


def integrate_costs(joins: DataFrame, patches: DataFrame, raw: DataFrame, master: DataFrame, row: str, key: str, amounts: Sequence[str]) -> dict[str, DataFrame]:
    """Four outputs from one matched feed. joins: (row, score, second, label) of every source row; patches: (row, key,
    amounts, notes) that would be written; raw: (row, year, source); master: (key, kind, active). ``safe`` are canonical
    rows, ``candidates`` all patches with safety and notes, ``review`` unsafe patches, joined rows without a patch and
    active entities without a safe row, ``queue`` the unsafe patches with their match."""
    scored = patches.join(joins.select(row, "score", "second", "label"), row, "left")
    all_rows = _kept(scored, row, master, key, amounts)
    safe = all_rows.filter("safe").join(raw.select(row, "year", "source"), row, "left").select(key, "year", "source", *amounts, row, "score", "label")
    candidates = all_rows.select(key, row, *amounts, "score", "second", "label", F.when(F.col("safe"), "safe").otherwise("review").alias("safety"), "notes")
    unsafe = all_rows.filter("NOT safe").select(F.col(row).cast("string").alias("source_row"), F.col(key).cast("string").alias("entity"), "score", "second", F.col("reason"), "notes")
    left = J.missing_from(joins, patches, [row]).select(F.col(row).cast("string").alias("source_row"), F.lit(None).cast("string").alias("entity"), "score", "second", F.lit("join_row_not_safe_for_patch").alias("reason"), F.col("label").alias("notes"))
    wanted = master.filter(F.col("active") & F.col("kind").isin("MD", "DO"))
    lacking = J.missing_from(wanted, safe, [key]).select(
        F.lit("").alias("source_row"), F.col(key).cast("string").alias("entity"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("second"),
        F.concat(F.lower("kind"), F.lit("_missing_safe_cost_row")).alias("reason"), F.lit("no canonical cost row is safe for this active entity").alias("notes"),
    )
    queue = unsafe.select("source_row", "entity", "score", "reason", F.lit("review cost match").alias("action"))
    return {"safe": safe, "candidates": candidates, "review": unsafe.unionByName(left).unionByName(lacking), "queue": queue}


def integrate_policies(feeds: dict[str, DataFrame], matches: DataFrame, row: str, metadata: Sequence[str]) -> dict[str, DataFrame]:
    """Feeds of one table each, wide rows with value columns, to canonical (entity, category, field, value, value_type) of
    safe matches and review rows of the others. matches: (table, row, entity, score, second, label, ignored). Ignored rows
    and rows without any value give nothing."""
    long = None
    for table, feed in feeds.items():
        fields = [c for c in feed.columns if c not in metadata and c != row]
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), S.missing(F.col(c).cast("string")).alias("value")) for c in fields]))
        one = feed.select(F.lit(table).alias("table"), F.col(row).cast("string").alias("row"), cells).filter("value IS NOT NULL")
        long = one if long is None else long.unionByName(one)
    known = matches.select("table", F.col("row").cast("string").alias("row"), "entity", "label", F.col("score"), is_safe(F.col("label"), F.col("score"), F.col("second")).alias("safe"), F.coalesce("ignored", F.lit(False)).alias("ignored"))
    both = long.join(known, ["table", "row"], "left").filter(~F.coalesce("ignored", F.lit(False)))
    safe = F.coalesce("safe", F.lit(False))
    canonical = both.filter(safe).select("entity", F.col("table").alias("category"), "field", "value", S.value_type(F.col("value")).alias("value_type"), "row")
    review = both.filter(~safe).groupBy("table", "row").agg(F.first("label").alias("label"), F.first("score").alias("score"), F.count("*").alias("n_values"))
    return {"canonical": canonical, "review": review.withColumn("reason", F.coalesce("label", F.lit("unmatched"))).withColumn("action", F.lit("review source match"))}


def requirement_degree(kind: Column) -> Column:
    text = F.upper(F.coalesce(kind, F.lit("")))
    return F.when(text.startswith("DO"), "DO").when(text.startswith("MD"), "MD").otherwise("")


def integrate_links(links: DataFrame, matches: DataFrame, row: str, kind: str, url: str, placeholder: str) -> dict[str, DataFrame]:
    """Requirement links: placeholders and blank urls go, safe matches are canonical, the rest is reviewed."""
    real = links.filter(~F.coalesce(S.is_truthy(F.col(placeholder)), F.lit(False)) & S.missing(F.col(url)).isNotNull())
    both = real.withColumn("degree", requirement_degree(F.col(kind))).join(matches.select(row, "entity", "score", "second", "label", "ignored"), row, "left").filter(~F.coalesce("ignored", F.lit(False)))
    safe = is_safe(F.col("label"), F.col("score"), F.col("second"))
    columns = [row, "entity", "degree", kind, url, "score", "label"]
    return {"canonical": both.filter(safe).select(*columns), "review": both.filter(~safe).select(*columns)}


def _stats_row(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Grade, bands and the grid's rate of rows with n_sources, mcat, gpa, mcat_spread and gpa_spread."""
    grade = A.quality_grade(F.coalesce("n_sources", F.lit(0)), F.col("mcat_spread"), F.col("gpa_spread"))
    df = df.withColumn("quality", grade).withColumn("score_band", S.band_for(F.col("mcat"), SCORE_BANDS, "integer")).withColumn("grade_band", S.band_for(F.col("gpa"), GRADE_BANDS, "cents"))
    # the grid has a cell for every pair of bands: 110 rows
    df = df.join(F.broadcast(grid.select("score_band", "grade_band", "rate").limit(110)), ["score_band", "grade_band"], "left")
    return df.withColumn("rate_band", S.label_by_threshold(F.col("rate"), RATE_CUTS))


def integrate_stats(clusters: DataFrame, rows: DataFrame, cluster_matches: DataFrame, row_matches: DataFrame | None, grid: DataFrame, crowd: str) -> dict[str, DataFrame]:
    """Canonical statistics, candidates, conflicts and review rows. clusters: (cluster, n_sources, mcat, gpa, mcat_spread,
    gpa_spread, agreement) with consensus values; rows: (row, cluster, source, mcat, gpa) of single sources; matches:
    (cluster or row, entity, score, second, label); without row matches, each row carries the columns of its own, which
    spares a join of all rows. A cluster with a safe match and a published source is canonical. The
    best candidate row of an entity (both values, not only of the crowd's source, sources, grade) takes the place of a
    missing row, or of one without both values."""
    matched = clusters.join(cluster_matches, "cluster", "left").withColumn("safe", is_safe(F.col("label"), F.col("score"), F.col("second")))
    published = F.coalesce("n_sources", F.lit(0)) >= 1
    valued = F.col("mcat").isNotNull() | F.col("gpa").isNotNull()
    canonical = matched.filter(published & F.col("safe") & valued).select("entity", "n_sources", "mcat", "gpa", "mcat_spread", "gpa_spread", F.lit("published_source_average").alias("metric_type"), F.lit(True).alias("consensus"))
    no_source = matched.filter(~published).select(F.col("cluster").cast("string").alias("source_row"), F.lit("crowd_only_context").alias("reason"))
    unsafe = matched.filter(published & ~F.col("safe")).select(F.col("cluster").cast("string").alias("source_row"), F.coalesce("label", F.lit("unsafe_stats_match")).alias("reason"))
    summary = clusters.select("cluster", "n_sources", F.col("mcat").alias("_mcat"), F.col("gpa").alias("_gpa"), "mcat_spread", "gpa_spread", "agreement")
    own = rows.join(summary, "cluster", "left")
    own = (own if row_matches is None else own.join(row_matches, "row", "left")).withColumn("safe", is_safe(F.col("label"), F.col("score"), F.col("second")))
    alone = F.col("_mcat").isNull() & F.col("_gpa").isNull()
    kind = F.when(~alone, "candidate_published_average").when(F.col("source") == crowd, "candidate_crowd_median").otherwise("candidate_single_source")
    own = own.withColumn("n_sources", F.coalesce("n_sources", F.lit(0))).withColumn("crowd_only", (F.col("source") == crowd) & (F.col("n_sources") == 0))
    candidates = own.select(
        "row", "entity", "source", "cluster", F.when(alone, F.col("mcat")).otherwise(F.col("_mcat")).alias("mcat"), F.when(alone, F.col("gpa")).otherwise(F.col("_gpa")).alias("gpa"), "n_sources",
        F.when(alone, F.when(F.col("mcat").isNotNull(), 0.0)).otherwise(F.col("mcat_spread")).alias("mcat_spread"), F.when(alone, F.when(F.col("gpa").isNotNull(), 0.0)).otherwise(F.col("gpa_spread")).alias("gpa_spread"),
        kind.alias("metric_type"), "agreement", "safe", "crowd_only",
    )
    both = (F.col("mcat").isNotNull() & F.col("gpa").isNotNull()).cast("int")
    grade = -A.quality_grade(F.col("n_sources"), F.col("mcat_spread"), F.col("gpa_spread"))["rank"]
    rank = F.struct(both.alias("both"), (~F.col("crowd_only")).cast("int").alias("own"), "n_sources", grade.alias("grade"))
    found = F.struct("n_sources", "mcat", "gpa", "mcat_spread", "gpa_spread", "metric_type")
    # strictly better replaces: the first row wins among equals. The first row of each rank comes first, as aggregates of
    # plain numbers need no sort of all candidates
    ranked = candidates.filter(F.col("entity").isNotNull() & valued).withColumn("rank", rank).withColumn("_blank", F.col("row").isNull()).withColumn("_row", F.coalesce("row", F.lit(0)))
    firsts = ranked.groupBy("entity", "rank", "n_sources", "metric_type", "_blank").agg(F.min("_row").alias("_first"), *[F.min_by(c, "_row").alias(c) for c in ("mcat", "gpa", "mcat_spread", "gpa_spread")])
    best = firsts.groupBy("entity").agg(F.max_by(F.struct("rank", found.alias("found")), F.struct("rank", F.when(~F.col("_blank"), -F.col("_first")))).alias("best"))
    held = canonical.withColumn("_rank", F.struct(both.alias("both"), F.lit(1).alias("own"), "n_sources", grade.alias("grade")))
    held = held.groupBy("entity").agg(F.max_by(F.struct("_rank", found.alias("found")), F.struct("_rank", "mcat", "gpa")).alias("held"))
    merged = held.join(best, "entity", "full")
    replaced = F.col("held").isNull() | ((F.col("held._rank.both") == 0) & F.coalesce(F.col("best.rank") > F.col("held._rank"), F.lit(False)))
    rows_out = merged.select("entity", F.when(replaced, F.col("best.found")).otherwise(F.col("held.found")).alias("r"), (~replaced).alias("consensus")).select("entity", "r.*", "consensus")
    conflicts = matched.filter(F.col("agreement").isin("minor", "major")).select("cluster", F.when(F.col("safe"), F.col("entity")).alias("entity"), "agreement", "mcat_spread", "gpa_spread", F.lit("review before promoting").alias("action"))
    review = no_source.unionByName(unsafe).unionByName(conflicts.select(F.col("cluster").cast("string").alias("source_row"), F.concat(F.lit("conflict_"), "agreement").alias("reason")))
    return {"canonical": _stats_row(rows_out, grid), "candidates": candidates, "conflicts": conflicts, "review": review}


def _near(score: Column, shared: Column, fewest: Column) -> Column:
    return ((score >= 0.92) & (shared >= 1)) | ((score >= NEAR) & (shared >= 2)) | ((score >= 0.88) & (shared >= 1) & (fewest <= 1))


def _alike_by_ratio(words: DataFrame, block: int) -> DataFrame:
    """(a, b, score, shared, fewest) of names that share a distinctive word and reach NEAR. Names meet by word and by a step
    of length: a ratio of NEAR bounds the shorter form by 0.754 of the longer, so their steps are at most one apart. Plain
    and sorted forms may be of unlike lengths, so a name has the steps of both."""
    step = lambda c: F.floor(F.log(F.length(c).cast("double")) / 0.2824).cast("int")
    steps = words.withColumn("steps", F.array_distinct(F.array(step("clean"), step(F.array_join(F.array_sort("every"), " ")))))
    left = steps.select("clean", F.col("words"), F.explode("words").alias("w"), "steps").select("clean", "words", "w", F.explode("steps").alias("step"))
    reach = F.array_distinct(F.flatten(F.transform("steps", lambda s: F.array(s - 1, s, s + 1))))
    right = steps.select("clean", "words", F.explode("words").alias("w"), reach.alias("steps")).select(F.col("clean").alias("to"), F.col("words").alias("to_words"), "w", F.explode("steps").alias("step"))
    fields = {"a": pa.string(), "b": pa.string(), "score": pa.float64(), "shared": pa.int32(), "fewest": pa.int32()}

    def run(names: pa.Table, others: pa.Table) -> pa.Table:
        held, sets, rows = M.PairScores(others.column("to").to_pylist()), [set(w) for w in others.column("to_words").to_pylist()], []
        later = np.array(held.plain.names, object)
        for name, own, word in zip(*(names.column(c).to_pylist() for c in ("clean", "words", "w"))):
            alike = held.jaccard({w for w in name.split(" ") if w})
            for k in np.flatnonzero((held.bounds(name, alike) >= NEAR) & (later > name)):
                both = sets[k].intersection(own)
                if min(both) == word:  # a pair counts in the group of its first word
                    score = held.score(name, k, alike[k])
                    if score >= NEAR:
                        rows.append((name, held.plain.names[k], score, len(both), min(len(sets[k]), len(own))))
        return M.table_of(rows, fields)

    return M.paired(left, right, ["w", "step"], ("clean", "to"), run, "a string, b string, score double, shared int, fewest int", block)


def alike_by_words(words: DataFrame) -> DataFrame:
    """(a, b, score, shared, fewest) of names whose Jaccard index over all words is NEAR at least, however unlike their
    lengths. Of n words a partner must share 0.86 n, so both hold one of each other's rarest n - 0.86 n + 1 words."""
    every = words.select("clean", F.explode("every").alias("w"))
    rarity = every.groupBy("w").agg(F.count("*").alias("df"))
    held = every.join(rarity, "w").groupBy("clean").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("rare"))
    rare = F.slice("rare", F.lit(1), (F.size("rare") - F.expr("(86 * size(rare) + 99) div 100") + 1).cast("int"))
    first = words.join(held.select("clean", rare.alias("rare")), "clean").select("clean", "words", "every", F.explode("rare").alias("w"))
    other = first.select(F.col("clean").alias("b"), F.col("words").alias("to_words"), F.col("every").alias("to_every"), "w")
    both = first.join(other, "w").filter(F.col("clean") < F.col("b"))
    score = F.size(F.array_intersect("every", "to_every")) / F.size(F.array_union("every", "to_every"))
    pairs = both.filter(score >= NEAR).select(F.col("clean").alias("a"), "b", score.alias("score"), F.size(F.array_intersect("words", "to_words")).alias("shared"), F.least(F.size("words"), F.size("to_words")).alias("fewest"))
    return pairs.distinct()


def name_words(df: DataFrame, name: str, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(clean, words, every): each distinct normalised name with its distinctive words and all its words."""
    names = df.select(S.normalize_name(F.col(name)).alias("clean")).filter("clean <> ''").distinct()
    return names.select("clean", F.array_distinct(S.tokens(F.col("clean"), stop)).alias("words"), S.tokens(F.col("clean")).alias("every"))


def name_links(df: DataFrame, name: str, stop: Sequence[str] = STOP_WORDS, block: int = M.BLOCK) -> DataFrame:
    """(a, b), a before b: the near pairs of distinct normalised names, each once."""
    words = stage(name_words(df, name, stop))
    pairs = _alike_by_ratio(words, block).unionByName(alike_by_words(words))
    return pairs.filter(_near(F.col("score"), F.col("shared"), F.col("fewest"))).select("a", "b").distinct()


def cluster_names(df: DataFrame, name: str, stop: Sequence[str] = STOP_WORDS, block: int = M.BLOCK) -> DataFrame:
    """(name, cluster): names that are equal once normalised, or near enough, in one cluster, named by its smallest member.

    Near: score 0.92 with a shared distinctive word, 0.86 with two, 0.88 with one if a side has at most one. Clusters are
    connected components, so they don't depend on the order of rows. Pairs come from two joins that together miss none:
    by shared word and length for sequence ratios, by rarest words for the Jaccard index; see there."""
    names = df.select(S.normalize_name(F.col(name)).alias("clean")).filter("clean <> ''").distinct()
    label = G.connected(names, name_links(df, name, stop, block), "clean").withColumnRenamed("component", "cluster")
    return df.select(name).distinct().withColumn("clean", S.normalize_name(F.col(name))).join(label, "clean", "left").select(name, "cluster")


def representative(df: DataFrame, cluster: str, name: str, source: str, preferred: Sequence[str]) -> DataFrame:
    """(cluster, name): the name of the first preferred source, else the shortest, ties by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col(source)), F.lit(0)), F.lit(len(preferred) + 1))
    order = F.struct(place, F.when(place > len(preferred), F.length(name)).otherwise(0), F.col(name))
    return df.groupBy(cluster).agg(F.min_by(name, order).alias(name))


def private_rankings(projection: DataFrame, profiles: DataFrame, profile_id: str, private: str, path: str, **build) -> DataFrame:
    """The ranking of private profiles only, written to the private path and nowhere else; gives what was written."""
    own = projection.join(profiles.filter(S.is_truthy(F.col(private))).select(profile_id), profile_id, "left_semi")
    K.build_rankings(own, [profile_id], **build).write.mode("overwrite").parquet(path)
    return projection.sparkSession.read.parquet(path)
