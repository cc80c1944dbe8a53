"""The whole run over the given tables: feeds are integrated, projected, ranked under the prescribed weights, listed and
published; and the ranking step alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.functions.fixed import GROUP_WEIGHTS, SCENARIO_WEIGHTS
from scoreframe.operators import integration as I
from scoreframe.operators import publishing as B
from scoreframe.operators import ranking as K
from scoreframe.operators import rules as V
from scoreframe.operators import workflow as W
from scoreframe.plans import integration_queries as Q
from scoreframe.plans.job_queries import _mean
from scoreframe.plans.publishing_queries import scratch
from scoreframe.plans.registry import SQL, query, table
from scoreframe.sources.stages import spread

SCENARIOS = [K.scenario_name(n) for n in dict.fromkeys(n for n, _, _ in SCENARIO_WEIGHTS)]
#: Columns that the projection of these tables has; the others are absent, which adds nothing to a mean.
THERE = ("admissions_mcat_fit_score", "admissions_gpa_fit_score", "admissions_oos_friendliness_score", "attendance_cost_score", "debt_burden_score", "four_year_happiness_score", "admissions_score", "attendance_score", "completeness")


def _weights(rows, name: str) -> list[tuple[str, float]]:
    found = [(c.replace("data_completeness_score", "completeness"), w) for n, c, w in rows if n == name]
    return [(c, w) for c, w in found if c in THERE]


def _ranked(projection: str) -> str:
    """SQL of the ranking build under the prescribed weights over the SQL of a projection."""
    adm, att = (_mean(_weights(GROUP_WEIGHTS, n)) for n in ("Admissions Score", "Attendance Score"))
    n_components = sum(n in ("Admissions Score", "Attendance Score") for n, _, _ in GROUP_WEIGHTS)
    scored = [c for c in THERE if any(c == w for n, w, _ in GROUP_WEIGHTS if n != "Overall School Value")]
    full = f"round_even(({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in scored)}) / {n_components}.0 * 10, 2)"
    named = dict(zip(SCENARIOS, dict.fromkeys(n for n, _, _ in SCENARIO_WEIGHTS)))
    scores = {"overall": _mean(_weights(GROUP_WEIGHTS, "Overall School Value"))} | {s: _mean(_weights(SCENARIO_WEIGHTS, n)) for s, n in named.items()}
    ranks = ", ".join(f"CASE WHEN ok AND {n}_score IS NOT NULL THEN rank() OVER (PARTITION BY profile, ok AND {n}_score IS NOT NULL ORDER BY {n}_score DESC) END AS {n}_rank" for n in scores)
    return f"""SELECT *, {ranks} FROM (SELECT *, {", ".join(f"round_even({x} * 100, 0) / 100 AS {n}_score" for n, x in scores.items())} FROM (
  SELECT *, round_even({adm} * 100, 0) / 100 AS admissions_score, round_even({att} * 100, 0) / 100 AS attendance_score, {full} AS completeness, NOT coalesce(excluded, false) AS ok FROM (SELECT *, attendance_cost_score AS debt_burden_score FROM ({projection}))))"""


RANKS = [f"{n}_{what}" for n in ("overall", *SCENARIOS) for what in ("score", "rank")]


@query("d2_configured_ranks", f"SELECT profile, s_suppkey, admissions_score, attendance_score, {', '.join(RANKS)} FROM ({_ranked(SQL['d1_score_projection'])})")
def d2_configured(spark, d):
    """D1's projection through D2 with the prescribed group weights and all six named scenarios."""
    built = K.rank_configured(Q.d1(spark, d).withColumn("debt_burden_score", F.col("attendance_cost_score")), ["profile"], F.col("excluded"))
    return built.select("profile", "s_suppkey", "admissions_score", "attendance_score", *RANKS)


def _chain_projection() -> str:
    """The projection's SQL with statistics, costs and policies from the integration steps."""
    whole = SQL["d1_score_projection"]
    before, after = whole[: whole.index("st AS (")], whole[whole.index("pa AS (") :]
    return f"""{before}st AS (SELECT entity AS s_suppkey, mcat AS published_mcat_average, gpa AS published_gpa_average, CASE WHEN quality_rank = 4 THEN 'low' ELSE 'high' END AS data_quality_band FROM ({SQL["d6_canonical_stats"]})),
  co AS (SELECT c_custkey AS s_suppkey, max(amount) AS in_state, max(amount) + 500 AS out_state, NULL::DOUBLE AS scholarship FROM ({SQL["d4_safe_costs"]}) GROUP BY 1),
  po AS (SELECT DISTINCT entity AS s_suppkey, 'text' AS policy_text FROM ({SQL["d5_policies"]})), {after}"""


STATUS = "CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'Applying' WHEN 1 THEN 'interested' WHEN 2 THEN 'rejected' WHEN 3 THEN 'waitlisted' ELSE '' END"
STEPS = ("costs", "policies", "statistics", "projection", "ranking", "final_list", "publish")


def steps(spark, d, at: str) -> list[B.Step]:
    costs = lambda t: {"costs": Q._costs(spark, d)["safe"].groupBy(F.col("c_custkey").alias("s_suppkey")).agg(F.max("amount").alias("in_state"))}
    policies = lambda t: {"policies": Q._policies(spark, d)["canonical"].select(F.col("entity").alias("s_suppkey"), F.col("value_type").alias("policy_value")).distinct()}
    statistics = lambda t: {"stats": Q._stats(spark, d)["canonical"].select(F.col("entity").alias("s_suppkey"), F.col("mcat").alias("published_mcat_average"), F.col("gpa").alias("published_gpa_average"), F.when(F.col("quality.rank") == 4, "low").otherwise("high").alias("data_quality_band"))}

    def projection(t):
        paid = t["costs"].withColumn("out_state", F.col("in_state") + 500).withColumn("scholarship", F.lit(None).cast("double"))
        own = Q.d1_tables(spark, d)
        return {"projection": I.score_projection(own["profiles"], own["entities"], t["stats"], paid, t["policies"], own["partners"], "profile", "s_suppkey")}

    def ranking(t):
        return {"rankings": K.rank_configured(spread(t["projection"]), ["profile"], F.col("excluded"))}

    def final_list(t):
        rows = t["rankings"].select(F.concat_ws("|", "profile", "s_suppkey").alias("row_id"), F.expr(STATUS).alias("status"), F.lit("visible").alias("visibility"), "overall_rank")
        return {"final": W.final_list(rows, "row_id", "status", "visibility", "overall_rank")}

    def publish(t):
        names = B.publish({"rankings": t["rankings"], "final": t["final"]}, at, "public", [], ["warnings"])
        return {"published": spark.createDataFrame([(n, f"{at}/{n}") for n in names], "name string, path string")}

    return list(zip(STEPS, (costs, policies, statistics, projection, ranking, final_list, publish), (True, True, True, True, False, True, True)))


def validate(tables):
    """Amounts and scores that the steps have made so far must be sound."""
    issues = [V.rule_nonnegative(tables["supplier"].select("s_suppkey"), "supplier", "s_suppkey", ["s_suppkey"])]
    if "costs" in tables:
        issues.append(V.rule_nonnegative(tables["costs"], "costs", "s_suppkey", ["in_state"]))
    if "stats" in tables:
        issues.append(V.rule_range(tables["stats"].select("s_suppkey", "published_mcat_average"), "stats", "s_suppkey", ["published_mcat_average"], 472, 528))
    if "rankings" in tables:
        issues.append(V.rule_scores(tables["rankings"].select("s_suppkey", "overall_score"), "rankings", "s_suppkey"))
    return V.validate(*issues)


@query("d30_whole_run", f"""
WITH r AS ({_ranked(_chain_projection())}), f AS (SELECT profile, s_suppkey, {STATUS} AS status, overall_rank AS rank FROM r)
SELECT profile, r.s_suppkey, status, overall_score, overall_rank, balanced_scenario_rank, financial_maximizer_scenario_rank,
  CASE WHEN status = 'Applying' THEN CASE WHEN rank <= 40 THEN 'highest' ELSE 'high' END WHEN rank <= 25 THEN 'highest' WHEN rank <= 40 THEN 'high' WHEN rank <= 75 THEN 'medium' ELSE 'low' END AS priority
FROM r JOIN f USING (profile, s_suppkey) WHERE status NOT IN ('', 'rejected')""")
def d30_whole(spark, d):
    """All steps in order over the given tables, each written once; the result is read from what was published."""
    at = scratch(spark, "published")
    out = B.run_all({"supplier": table(spark, d, "supplier")}, validate, steps(spark, d, at), at=scratch(spark, "run"), stamp=d)
    where = {r.name: r.path for r in out["published"].collect()}  # a row per published table
    ranks = spark.read.json(where["rankings"]).withColumn("row_id", F.concat_ws("|", "profile", "s_suppkey"))
    kept = spark.read.json(where["final"]).select("row_id", "status", "priority")
    return ranks.join(kept, "row_id").select("profile", "s_suppkey", "status", "overall_score", F.col("overall_rank").cast("long").alias("overall_rank"), "balanced_scenario_rank", "financial_maximizer_scenario_rank", "priority")
