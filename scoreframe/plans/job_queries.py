"""Queries of the user-level jobs on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.operators import joins as J
from scoreframe.operators import ranking as K
from scoreframe.operators import workflow as W
from scoreframe.plans.registry import query, table
from scoreframe.sources.stages import stage

#: Group and scenario weights of the flagship query.
GROUPS = {"admissions": [("price_fit", 25.0), ("discount_score", 20.0), ("returns_score", 15.0)], "attendance": [("quantity_score", 20.0), ("balance_score", 15.0)]}
OVERALL = [("admissions_score", 45.0), ("attendance_score", 45.0), ("balance_score", 10.0)]
SCENARIOS = {"price_first": [("price_fit", 60.0), ("discount_score", 40.0)], "safe": [("returns_score", 50.0), ("balance_score", 50.0)]}


def _mean(weights) -> str:
    total = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in weights)
    there = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in weights)
    return f"(CASE WHEN ({there}) > 0 THEN (({total}) / CAST(({there}) AS DOUBLE)) END)"


def _share(weights) -> str:
    there = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in weights)
    return f"round_even(CAST(({there}) AS DOUBLE) / {sum(w for _, w in weights)} * 100, 0)"


def _minmax(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN max({x}) OVER () = min({x}) OVER () THEN 10 ELSE round_even(10 - 9 * (({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())), 1) END"


def _rank(name: str) -> str:
    return f"CASE WHEN ok AND {name}_score IS NOT NULL THEN rank() OVER (PARTITION BY profile, ok AND {name}_score IS NOT NULL ORDER BY {name}_score DESC) END AS {name}_rank"


D2_SQL = f"""
WITH li AS (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS price, CAST(sum(CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS discount,
              CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS returned FROM lineitem GROUP BY 1),
  p AS (SELECT c_mktsegment AS profile, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) / 4 AS target FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
  e AS (SELECT s_suppkey, s_acctbal, price, -discount AS nd, -quantity AS nq, returned, CASE WHEN s_acctbal > 0 THEN -s_acctbal END AS nb FROM supplier LEFT JOIN li ON s_suppkey = l_suppkey),
  m AS (SELECT s_suppkey, s_acctbal >= -900 AS ok, price, {_minmax("nd")} AS discount_score, {_minmax("nq")} AS quantity_score, {_minmax("returned")} AS returns_score, {_minmax("nb")} AS balance_score FROM e),
  c AS (SELECT *, round_even(CASE WHEN price IS NOT NULL THEN greatest(1, least(10, 7 + (target - price) / 2000)) END, 1) AS price_fit FROM p CROSS JOIN m),
  g AS (SELECT *, {_mean(GROUPS["admissions"])} AS adm, {_mean(GROUPS["attendance"])} AS att, {_share(GROUPS["admissions"])} AS admissions_coverage, {_share(GROUPS["attendance"])} AS attendance_coverage,
          round_even({_mean(SCENARIOS["price_first"])} * 100, 0) / 100 AS price_first_score, round_even({_mean(SCENARIOS["safe"])} * 100, 0) / 100 AS safe_score FROM c),
  h AS (SELECT *, round_even(adm * 100, 0) / 100 AS admissions_score, round_even(att * 100, 0) / 100 AS attendance_score, CASE WHEN adm IS NULL THEN 'Unscored' WHEN adm < 4 THEN 'Very High Risk' WHEN adm < 5.5 THEN 'Reach' WHEN adm < 7.5 THEN 'Target' ELSE 'Likely' END AS tier FROM g),
  s AS (SELECT *, round_even({_mean(OVERALL)} * 100, 0) / 100 AS overall_score, {_share(OVERALL)} AS overall_coverage FROM h)
SELECT profile, s_suppkey, admissions_score, attendance_score, overall_score, admissions_coverage, attendance_coverage, overall_coverage, tier,
  CASE WHEN tier IN ('Very High Risk', 'Reach') AND att >= 8 THEN 'Dream' WHEN tier = 'Very High Risk' THEN 'Reach' ELSE tier END AS bucket,
  price_first_score, safe_score, {_rank("overall")}, {_rank("price_first")}, {_rank("safe")} FROM s
"""


def supplier_projection(spark, d):
    """Suppliers as entities under every market segment as profile. Sums are decimal, so that a score that is computed
    twice is equal to the last bit. The aggregates of an entity and of a profile are stored once, as ranks, ends and rows
    all read them."""
    exact = lambda c, p=12: F.sum(F.col(c).cast(f"decimal({p},2)")).cast("double")
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        (exact("l_extendedprice") / F.count("*")).alias("price"), (exact("l_discount") / F.count("*")).alias("discount"), exact("l_quantity").alias("quantity"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("returned")
    )
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    profiles = orders.groupBy(F.col("c_mktsegment").alias("profile")).agg((exact("o_totalprice", 14) / F.count("*") / 4).alias("target"))
    entities, profiles = stage(table(spark, d, "supplier").join(li, "s_suppkey", "left")), stage(profiles)
    scaled = K.minmax_all(entities, {"discount_score": -F.col("discount"), "quantity_score": -F.col("quantity"), "returns_score": F.col("returned"), "balance_score": -S.positive(F.col("s_acctbal"))})
    return J.cross_profiles(profiles, scaled).withColumn("price_fit", F.bround(S.fit_score(F.col("target"), F.col("price"), 2000), 1))


@query("d2_build_rankings", D2_SQL)
def d2(spark, d):
    built = K.build_rankings(supplier_projection(spark, d), ["profile"], GROUPS, OVERALL, SCENARIOS, F.col("s_acctbal") < -900)
    return built.select("profile", "s_suppkey", *[f"{n}_score" for n in ("admissions", "attendance", "overall", "price_first", "safe")], *[f"{n}_coverage" for n in ("admissions", "attendance", "overall")], "tier", "bucket", *[f"{n}_rank" for n in ("overall", "price_first", "safe")])


_LABELS = (("price_fit", "Price Fit"), ("discount_score", "Discount"), ("returns_score", "Returns"), ("quantity_score", "Quantity"), ("balance_score", "Balance"))


def _names(sign: str, keep: str) -> str:
    cells = ", ".join(f"{{'v': {sign}{c}, 'i': {i}, 'l': '{label}'}}" for i, (c, label) in enumerate(_LABELS))
    return f"list_transform(list_filter(list_sort(list_filter([{cells}], lambda x: x.v IS NOT NULL))[:3], lambda x: {keep}), lambda x: x.l)[:2]"


@query("d2_rank_details", f"""
WITH d AS ({D2_SQL.replace("SELECT profile, s_suppkey, admissions_score", "SELECT profile, s_suppkey, ok, price_fit, discount_score, returns_score, quantity_score, balance_score, admissions_score")}),
  n AS (SELECT *, {_names("-", "x.v <= -7")} AS plus, {_names("", "x.v <= 5")} AS minus, CASE WHEN overall_coverage >= 80 THEN 'high' WHEN overall_coverage >= 60 THEN 'medium' WHEN overall_coverage >= 40 THEN 'partial' ELSE 'provisional' END AS confidence FROM d)
SELECT profile, s_suppkey, CASE WHEN overall_rank IS NULL THEN '' WHEN overall_rank <= 35 THEN '25-35 application pool' WHEN overall_rank <= 40 THEN '40 researched schools' WHEN overall_rank <= 75 THEN '75 serious candidates' ELSE 'full universe' END AS funnel,
  CASE WHEN NOT ok THEN 'Excluded by hard-no' WHEN overall_rank IS NULL THEN 'Incomplete data' WHEN overall_rank <= 35 THEN 'Top application candidate' WHEN overall_rank <= 75 THEN 'Research seriously' WHEN overall_rank <= 125 THEN 'Watchlist' ELSE 'Low priority' END AS rank_band,
  CASE WHEN NOT ok THEN 'excluded' ELSE confidence END AS rank_confidence,
  CASE WHEN NOT ok THEN 'Excluded from Decision Rank because of a hard-no flag' || CASE WHEN s_suppkey % 2 = 0 THEN ': deep in debt' ELSE '.' END ELSE concat_ws('. ', CASE WHEN len(plus) > 0 THEN array_to_string(plus, ' and ') || CASE WHEN len(plus) = 1 THEN ' helps' ELSE ' help' END || ' this entity' END,
    CASE WHEN len(minus) > 0 THEN array_to_string(minus, ' and ') || CASE WHEN len(minus) = 1 THEN ' is a weaker driver' ELSE ' are weaker drivers' END END, CASE WHEN len(plus) = 0 AND len(minus) = 0 THEN 'The Decision Rank is driven by available scored components' END,
    CASE WHEN confidence IN ('partial', 'provisional') THEN 'Rank confidence is ' || confidence || ' because scored input coverage is limited' END) || '.' END AS summary FROM n""")
def d2_details(spark, d):
    gone = F.col("s_acctbal") < -900
    built = K.build_rankings(supplier_projection(spark, d), ["profile"], GROUPS, OVERALL, SCENARIOS, gone)
    out = K.rank_details(built, [c for w in GROUPS.values() for c, _ in w], "overall_rank", "overall_coverage", gone, F.when(F.col("s_suppkey") % 2 == 0, "deep in debt"))
    return out.select("profile", "s_suppkey", "funnel", "rank_band", "rank_confidence", "summary")


@query("d2_low_confidence", """SELECT c_custkey, concat_ws('; ', CASE WHEN c_custkey % 3 = 0 THEN 'missing: mcat' END, CASE WHEN c_custkey % 4 = 0 THEN 'warnings: w' END, CASE WHEN c_custkey % 5 = 0 THEN 'low admissions stats data quality' END) AS drivers FROM customer""")
def d2_low(spark, d):
    k = F.col("c_custkey")
    drivers = K.low_confidence_drivers(F.when(k % 3 == 0, "mcat").otherwise(" "), F.when(k % 4 == 0, "w"), F.when(k % 5 == 0, "Low").otherwise("high"))
    return table(spark, d, "customer").select("c_custkey", drivers.alias("drivers"))


@query("d12_review_queue", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial pair' ELSE 'unknown status' END AS reason, CASE o_orderstatus WHEN 'O' THEN 'wait' WHEN 'P' THEN 'find the other value' ELSE 'check by hand' END AS action FROM orders")
def d12(spark, d):
    return W.review_queue(table(spark, d, "orders"), "o_orderstatus", {"O": ("open", "wait"), "P": ("partial pair", "find the other value")}, ("unknown status", "check by hand")).select("o_orderkey", "reason", "action")


@query("d15_harvest_links", """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) WHERE href <> '' GROUP BY 1, 2""")
def d15(spark, d):
    return W.harvest_links(table(spark, d, "pages"), "page_id", "html")


@query("d17_delta_report", """
WITH a AS (SELECT l_partkey, avg(l_quantity) AS qty, avg(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), b AS (SELECT l_partkey, avg(l_quantity) AS qty, avg(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
  x AS (SELECT b.l_partkey, b.qty - a.qty AS delta_a, b.tax - a.tax AS delta_b FROM b LEFT JOIN a USING (l_partkey))
SELECT l_partkey, round_even(delta_a, 6) AS delta_a, round_even(delta_b, 6) AS delta_b, CASE WHEN delta_a IS NULL THEN 'no_pair' WHEN abs(delta_a) > 2 OR abs(delta_b) > 0.025001 THEN 'large' ELSE 'aligned' END AS status FROM x""")
def d17(spark, d):
    li = table(spark, d, "lineitem")
    of = lambda r: li.filter(F.col("l_returnflag") == r).groupBy("l_partkey").agg(F.avg("l_quantity").alias("qty"), F.avg("l_tax").alias("tax"))
    out = W.delta_report(of("N"), of("R"), "l_partkey", "qty", "tax", (2, 0.025001))
    return out.withColumn("delta_a", F.bround("delta_a", 6)).withColumn("delta_b", F.bround("delta_b", 6))


@query("d19_upsert_state", """
WITH e AS (SELECT user_id, arg_max(event_type, event_id) AS state FROM events WHERE event_id % 10 <> 0 AND event_type <> '' GROUP BY 1)
SELECT coalesce(c_custkey, user_id) AS c_custkey, coalesce(e.state, c_mktsegment) AS state, CASE WHEN e.state IS NULL THEN 'kept' WHEN c_custkey IS NULL THEN 'added' ELSE 'replaced' END AS change
FROM customer FULL JOIN e ON c_custkey = user_id""")
def d19(spark, d):
    export = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("state"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 10 == 0, 1).otherwise(2).alias("version"))
    return W.upsert_state(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("state")), export, ["c_custkey"], ["state"], "pos", "version", 2)


D20 = "CASE c_custkey % 5 WHEN 0 THEN 'Applying' WHEN 1 THEN 'interested' WHEN 2 THEN 'rejected' WHEN 3 THEN 'waitlisted' ELSE '' END"


@query("d20_final_list", f"""
SELECT c_custkey, status, rank, CASE WHEN status = 'Applying' THEN CASE WHEN rank <= 40 THEN 'highest' ELSE 'high' END WHEN rank <= 25 THEN 'highest' WHEN rank <= 40 THEN 'high' WHEN rank <= 75 THEN 'medium' ELSE 'low' END AS priority
FROM (SELECT c_custkey, {D20} AS status, c_custkey % 100 AS rank FROM customer WHERE c_nationkey <> 3) WHERE status NOT IN ('', 'rejected')""")
def d20(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr(D20.replace("c_custkey % 5", "CAST(c_custkey % 5 AS INT)")).alias("status"), (F.col("c_custkey") % 100).alias("rank"), F.when(F.col("c_nationkey") == 3, "Hidden").otherwise("visible").alias("vis"))
    return W.final_list(c, "c_custkey", "status", "vis", "rank")


PRESETS = [("balanced", 25.0, 25.0), ("size", 75.0, 0.0), ("price", 10.0, 90.0), ("off", 0.0, 0.0)]


@query("d24_live_score", """
SELECT p_partkey, preset, CASE WHEN p > 0 THEN round_even(t / p, 6) END AS score, CASE WHEN w > 0 THEN round_even(p / w * 100, 0) END AS coverage FROM (
  SELECT p_partkey, preset, CASE WHEN a IS NOT NULL THEN wa ELSE 0 END + wb AS p, coalesce(a * wa, 0) + b * wb AS t, wa + wb AS w
  FROM (SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size % 10 + 1 AS DOUBLE) END AS a, CAST(p_partkey % 10 + 1 AS DOUBLE) AS b FROM part),
       (VALUES ('balanced', 25.0::DOUBLE, 25.0::DOUBLE), ('size', 75, 0), ('price', 10, 90), ('off', 0, 0)) v(preset, wa, wb))""")
def d24(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, (F.col("p_size") % 10 + 1).cast("double")).alias("a"), (F.col("p_partkey") % 10 + 1).cast("double").alias("b"))
    prefs = spark.createDataFrame(PRESETS, "preset string, w_a double, w_b double")
    return K.live_score(parts, prefs, "preset", ["a", "b"]).select("p_partkey", "preset", F.bround("score", 6).alias("score"), "coverage")


@query("d25_merge_overrides", "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 100 THEN c_acctbal ELSE 25.0 END AS fit, 20.0::DOUBLE AS cost FROM customer")
def d25(spark, d):
    base = F.create_map(F.lit("fit"), F.lit(25.0), F.lit("cost"), F.lit(20.0))
    merged = K.merge_overrides(base, F.create_map(F.lit("Fit Score"), F.col("c_acctbal")), {"Fit Score": "fit"})
    return table(spark, d, "customer").withColumn("m", merged).select("c_custkey", F.col("m")["fit"].alias("fit"), F.col("m")["cost"].alias("cost"))


@query("d27_node_status", """SELECT c_custkey, array_to_string(m, ',') AS missing, CASE WHEN len(m) = 0 THEN 'ready' WHEN list_contains(m, 'balance') THEN 'provisional' ELSE 'partial' END AS readiness
FROM (SELECT c_custkey, list_filter([CASE WHEN c_acctbal <= 0 THEN 'balance' END, CASE WHEN c_nationkey < 5 THEN 'nation' END], lambda x: x IS NOT NULL) AS m FROM customer)""")
def d27(spark, d):
    s = W.node_status([("balance", F.col("c_acctbal") <= 0), ("nation", F.col("c_nationkey") < 5)], ["balance"])
    return table(spark, d, "customer").withColumn("s", s).select("c_custkey", F.array_join("s.missing", ",").alias("missing"), "s.readiness")


@query("d31_why_bullets", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_retailprice < 1200 THEN 'cheap' END, CASE WHEN p_size % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)[:2], '; ') AS why FROM part""")
def d31(spark, d):
    why = W.why_bullets([(F.col("p_size") > 25, F.lit("large")), (F.col("p_retailprice") < 1200, F.lit("cheap")), (F.col("p_size") % 2 == 0, F.lit("even"))], 2)
    return table(spark, d, "part").select("p_partkey", F.array_join(why, "; ").alias("why"))


HOST = r"regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"


@query("d13_classify_source", rf"""
WITH h AS (SELECT page_id, url, {HOST} AS host, contains(url, 'utm_source') AS named FROM pages),
  x AS (SELECT page_id, CASE WHEN starts_with(url, 'http://') OR host = '' THEN 'unsafe' WHEN host = 'example.org' THEN 'exact_host' WHEN same AND named THEN 'same_domain_named' WHEN same THEN 'same_domain'
          WHEN ends_with(host, '.edu') AND named THEN 'edu_named' WHEN ends_with(host, '.edu') THEN 'edu' WHEN named THEN 'named' ELSE 'other' END AS label
        FROM (SELECT *, regexp_matches(host, '(^|\.)example\.org$') AS same FROM h))
SELECT page_id, label, score, score >= 0.9 AS auto FROM x JOIN (VALUES ('unsafe', 0.0::DOUBLE), ('exact_host', 1.0), ('same_domain_named', 0.95), ('same_domain', 0.9), ('edu_named', 0.9), ('edu', 0.7), ('named', 0.55), ('other', 0.25)) v(label, score) USING (label)""")
def d13(spark, d):
    found = W.classify_source(F.col("url"), F.lit("https://www.example.org/"), F.col("url").contains("utm_source"), F.col("url").startswith("http://"))
    return table(spark, d, "pages").select("page_id", found.alias("f")).select("page_id", "f.*")


@query("d16_probe_urls", r"""
SELECT DISTINCT url AS seed, o || s AS probe FROM (SELECT url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1) AS o FROM pages), (VALUES ('/admissions'), ('/class-profile'), ('/sitemap.xml')) v(s) WHERE o || s <> url""")
def d16(spark, d):
    return W.probe_urls(table(spark, d, "pages"), "url", ["/admissions", "/class-profile", "/sitemap.xml"])


@query("d21_workflow_rows", f"""
WITH c AS (SELECT c_custkey, lower({D20}) AS status, c_acctbal, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'researched' ELSE '' END AS research FROM customer),
  m AS (SELECT *, list_filter([CASE WHEN c_acctbal <= 0 THEN 'balance' END, CASE WHEN c_nationkey < 5 THEN 'nation' END], lambda x: x IS NOT NULL) AS m,
          CASE WHEN status = 'rejected' THEN '' ELSE concat_ws('; ', CASE WHEN c_acctbal > 5000 THEN 'high balance' END, CASE WHEN c_nationkey = 7 THEN 'home' END) END AS why_kept,
          CASE WHEN status = 'rejected' THEN concat_ws('; ', CASE WHEN c_acctbal < 1000 THEN 'low balance' END, CASE WHEN c_nationkey > 20 THEN 'far' END) ELSE '' END AS why_cut FROM c)
SELECT c_custkey, status, why_kept, why_cut, array_to_string(m, ',') AS missing,
  CASE WHEN status = 'rejected' THEN 'closed' WHEN len(m) > 0 THEN 'find ' || array_to_string(m, ', ') WHEN research = 'researched' THEN 'decide' ELSE 'research' END AS step FROM m""")
def d21(spark, d):
    c = table(spark, d, "customer").withColumn("status", F.expr(D20.replace("c_custkey % 5", "CAST(c_custkey % 5 AS INT)"))).withColumn("research", F.when(F.col("c_custkey") % 2 == 0, "researched").otherwise(""))
    kept = [(F.col("c_acctbal") > 5000, F.lit("high balance")), (F.col("c_nationkey") == 7, F.lit("home"))]
    cut = [(F.col("c_acctbal") < 1000, F.lit("low balance")), (F.col("c_nationkey") > 20, F.lit("far"))]
    return W.workflow_rows(c, "c_custkey", "status", "research", kept, cut, [("balance", F.col("c_acctbal") <= 0), ("nation", F.col("c_nationkey") < 5)])


@query("d28_status_node", """
SELECT c_mktsegment, label, n, round_even(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY c_mktsegment) * 100, 1) AS share
FROM (SELECT c_mktsegment, CASE WHEN c_acctbal <= 0 THEN 'provisional' ELSE 'ready' END AS label, count(*) AS n FROM customer GROUP BY 1, 2)""")
def d28(spark, d):
    return W.status_counts(table(spark, d, "customer").withColumn("label", F.when(F.col("c_acctbal") <= 0, "provisional").otherwise("ready")), "c_mktsegment", "label")


@query("d32_compare_table", """
SELECT field, max(CASE WHEN p_partkey = 1 THEN value END) AS "1", max(CASE WHEN p_partkey = 2 THEN value END) AS "2", max(CASE WHEN p_partkey = 3 THEN value END) AS "3", max(CASE WHEN p_partkey = 4 THEN value END) AS "4"
FROM (SELECT p_partkey, 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part) GROUP BY 1""")
def d32(spark, d):
    return W.compare_table(table(spark, d, "part"), "p_partkey", [1, 2, 3, 4], ["p_brand", "p_type", "p_size"])


@query("d33_export_state", """
SELECT user_id, '{"scope":"events","ids":["' || string_agg(event_type, '","' ORDER BY event_type) || '"]}' AS record FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL) GROUP BY 1""")
def d33(spark, d):
    return W.export_state(table(spark, d, "events"), "user_id", "event_type", "events")


@query("d34_assumptions", """
SELECT *, CASE WHEN value IS NULL THEN 'missing input' WHEN weight = 0 THEN 'zero weight' ELSE '' END AS note FROM (
  SELECT p_partkey, 'size' AS input, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS value, CAST(p_size % 3 * 10 AS DOUBLE) AS weight FROM part
  UNION ALL SELECT p_partkey, 'price', p_retailprice, 25.0::DOUBLE FROM part)""")
def d34(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("size"), (F.col("p_size") % 3 * 10).alias("w_size"), F.col("p_retailprice").alias("price"), F.lit(25.0).alias("w_price"))
    return W.assumptions(p, "p_partkey", [("size", "size", "w_size"), ("price", "price", "w_price")])


@query("d22_selector_rank", """
WITH s AS (SELECT p_brand AS brand, CAST(min(p_size) + max(p_size) AS DOUBLE) / 2 AS mid_p_size, (min(p_retailprice) + max(p_retailprice)) / 2 AS mid_p_retailprice FROM part GROUP BY 1),
  x AS (SELECT brand, p_partkey, CASE WHEN p_size % 4 <> 0 THEN greatest(1, least(10, 7 + (mid_p_size - p_size) / 8.0)) END AS a, greatest(1, least(10, 7 + (mid_p_retailprice - p_retailprice) / 200.0)) AS b FROM s CROSS JOIN part),
  y AS (SELECT brand, p_partkey, round_even((coalesce(a * 60.0, 0) + b * 40.0) / CAST(CASE WHEN a IS NULL THEN 40 ELSE 100 END AS DOUBLE) * 10000, 0) / 10000 AS score FROM x)
SELECT brand, p_partkey, score, rank() OVER (PARTITION BY brand ORDER BY score DESC) AS rank FROM y""")
def d22(spark, d):
    part = table(spark, d, "part")
    mid = lambda c: ((F.min(c) + F.max(c)) / 2).alias(f"mid_{c}")
    bands = part.groupBy(F.col("p_brand").alias("brand")).agg(mid("p_size"), mid("p_retailprice"))
    parts = part.select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("p_size"), "p_retailprice")
    return K.selector_rank(parts, bands, "brand", [("p_size", 8, 60.0), ("p_retailprice", 200, 40.0)]).select("brand", "p_partkey", "score", "rank")
