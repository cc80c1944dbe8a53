"""Queries of discovery, read models, the final list, guided groups, payloads, and table scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scoreframe.operators import discovery as D
from scoreframe.operators import integration as I
from scoreframe.operators import publishing as B
from scoreframe.operators import rules as V
from scoreframe.plans import job_queries as Q
from scoreframe.plans.job_queries import D2_SQL
from scoreframe.plans.registry import query, table
from scoreframe.sources import stages
from scoreframe.sources import tables as X


def scratch(spark, name: str) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{stages.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Links of a known form, added to every page: two of the page's own site, one of another, a fragment.
PLANTED = """html || '<a class=x HREF = ''/admissions/class-profile/' || page_id || '''>Class <b>profile</b></a><a href=/about>About</a><a href="https://other.example.info/class-profile/">Class profile</a><a href="facts-and-figures/?y=1&amp;z=2">Facts &amp; more</a>'"""
ORIGIN = r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1)"
FOLDER = rf"{ORIGIN} || regexp_replace(CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1) END, '[^/]*$', '')"


@query("d15_on_topic", f"""
SELECT page_id, seed, u AS url, t AS text FROM (SELECT page_id, url AS seed, unnest([{ORIGIN} || '/admissions/class-profile/' || page_id, {FOLDER} || 'facts-and-figures/?y=1&z=2']) AS u, unnest(['Class profile', 'Facts & more']) AS t FROM pages)""")
def d15_on_topic(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.expr(PLANTED).alias("html"))
    return D.on_topic(D.page_links(pages, "page_id", "url", "html").withColumn("seed", F.concat("seed", F.lit("#"), "page_id")), 5).select("page_id", F.expr("regexp_replace(seed, '#[^#]*$', '')").alias("seed"), "url", "text")


@query("d15_sitemaps", "SELECT page_id, u AS url FROM (SELECT page_id, unnest([url, 'https://example.org/a?b=' || page_id || '&c=1']) AS u FROM pages)")
def d15_sitemaps(spark, d):
    body = "'<urlset><url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url><url><s:loc><![CDATA[https://example.org/a?b=' || page_id || '&c=1]]></s:loc></url><url><loc></loc></url><url><loc>' || replace(url, '&', '&amp;') || '</loc></url></urlset>'"
    return D.harvest_sitemaps(table(spark, d, "pages").select("page_id", F.expr(body).alias("xml")), "page_id", "xml")


@query("d15_cards", """
SELECT page_id, 'https://example.edu/profiles/one-' || page_id AS url, 'College ' || page_id AS title, 'Old Town' AS city, 'ME' AS state FROM pages
UNION ALL SELECT page_id, 'https://example.edu/profiles/two-' || page_id, 'Two ' || page_id, '', '' FROM pages""")
def d15_cards(spark, d):
    card = "'<div class=\"card\" data-srch-target=\"' || base64(encode('https://www.example.edu/profiles/one-' || page_id || '/', 'UTF-8')) || '\"><h3>College <i>' || page_id || '</i></h3><p class=\"location\">Old Town, ME</p></div><div data-target=\"AAAA\">no card</div><a href=\"https://example.edu/profiles/two-' || page_id || '\">Two</a>'"
    pages = table(spark, d, "pages").select("page_id", "url", F.expr(f"html || {card}").alias("html"))
    return D.harvest_cards(pages, "page_id", "url", "html", "example.edu", "/profiles/")


PATHS = ", ".join(f"'{p}'" for p in D.KNOWN_PATHS)


@query("d16_known_paths", rf"""
WITH s AS (SELECT DISTINCT url FROM pages), b AS (SELECT url, {ORIGIN} || '/' AS b1, {FOLDER} AS b2, {ORIGIN} || CASE WHEN regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '') END AS b3 FROM s),
  p AS (SELECT url, k, i, base || path AS probe FROM (SELECT url, unnest([b1, b2, b3]) AS base, unnest([1, 2, 3]) AS k FROM b), (SELECT unnest([{PATHS}]) AS path, unnest(range({len(D.KNOWN_PATHS)})) AS i)),
  f AS (SELECT url, probe, min(k * 100 + i) AS pos FROM p WHERE probe <> trim(url) GROUP BY 1, 2)
SELECT url AS seed, probe, nth FROM (SELECT url, probe, CAST(row_number() OVER (PARTITION BY url ORDER BY pos) - 1 AS INT) AS nth FROM f) WHERE nth < 40""")
def d16_known_paths(spark, d):
    return D.known_path_probes(table(spark, d, "pages"), "url", most=40)


@query("d14_candidates", f"""
WITH h AS (SELECT page_id, regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '') AS host, k % 3 AS k, contains(url, 'utm_source') AS named FROM (SELECT *, CAST(page_id AS BIGINT) AS k FROM pages)),
  x AS (SELECT *, CASE k WHEN 0 THEN 'class_profile' WHEN 1 THEN 'pdf_report' ELSE 'unknown' END AS source_type, CASE WHEN k = 1 OR host = 'example.org' THEN 1.0 WHEN (host LIKE '%.example.org' OR host = 'example.org') AND named THEN 0.95 WHEN host LIKE '%.example.org' THEN 0.9 WHEN named THEN 0.55 ELSE 0.25 END::DOUBLE AS score FROM h)
SELECT page_id, source_type, host AS source_host, score AS official_score, CASE WHEN score >= 0.9 AND source_type <> 'unknown' THEN 'accepted_for_fetch' WHEN score >= 0.9 THEN 'official_domain_seed_needs_stats_path' ELSE 'needs_review' END AS review_status,
  CASE WHEN score >= 0.9 AND source_type = 'unknown' THEN 'not_applicable' ELSE 'not_fetched' END AS fetch_status FROM x""")
def d14(spark, d):
    k = F.col("page_id").cast("long") % 3
    pages = table(spark, d, "pages").select("page_id", "url", k.alias("k"))
    pages = pages.withColumn("link", F.when(F.col("k") == 1, F.concat(F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1), F.lit("/files/report.PDF?x"))).otherwise(F.col("url")))
    official = F.when(F.col("k") == 1, "").otherwise("https://www.example.org/")
    out = D.candidates(pages, F.col("link"), F.when(F.col("k") == 0, "Entering class").otherwise(""), official, F.col("url").contains("utm_source"), F.lit("feed"), F.lit(False))
    return out.select("page_id", "source_type", "source_host", "official_score", "review_status", "fetch_status")


STATUS = "CASE CAST(c_custkey % 8 AS INTEGER) WHEN 0 THEN 'Applying' WHEN 1 THEN 'interested' WHEN 2 THEN 'rejected' WHEN 3 THEN 'waitlisted' WHEN 4 THEN 'accepted' WHEN 5 THEN 'applied' WHEN 6 THEN 'interview' ELSE '' END"


@query("d20_application_list", f"""
WITH o AS (SELECT o_custkey, min(CAST(floor(o_totalprice) AS BIGINT) % 100) AS rank FROM orders GROUP BY 1),
  x AS (SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'DO' WHEN c_custkey % 3 = 1 THEN 'md' ELSE 'PhD' END AS kind, lower({STATUS}) AS status, rank, c_custkey % 10 = 7 AS old FROM customer LEFT JOIN o ON c_custkey = o_custkey WHERE c_nationkey <> 3)
SELECT c_custkey, name, kind, rank AS decision_rank, CASE WHEN rank IS NOT NULL THEN 'Target' END AS current_bucket, status,
  CASE WHEN status IN ('accepted', 'interview', 'applied', 'applying') THEN CASE WHEN rank <= 40 THEN 'highest' ELSE 'high' END WHEN rank <= 25 THEN 'highest' WHEN rank <= 40 THEN 'high' WHEN rank <= 75 THEN 'medium' ELSE 'low' END AS priority,
  CASE kind WHEN 'DO' THEN 'AACOMAS' WHEN 'md' THEN 'AMCAS' ELSE '' END AS service,
  CASE status WHEN 'accepted' THEN 'compare offer and revisit final fit' WHEN 'waitlisted' THEN 'track waitlist movement and update letters' WHEN 'interview' THEN 'prepare for interview' WHEN 'applied' THEN 'track secondary, interview, and decision updates'
    WHEN 'applying' THEN 'submit primary and secondary materials' ELSE CASE WHEN c_custkey % 4 = 1 THEN 'decide whether to submit application' ELSE 'research score card and decide whether to apply' END END AS next_action,
  CASE WHEN old THEN 'own words' ELSE 'Marked ' || status || ' in the score card' || coalesce('; rank ' || rank || '; rank band top; bucket Target', '') || CASE WHEN c_custkey % 5 = 0 THEN '; interest high' ELSE '' END || '.' END AS why_kept, CASE WHEN old THEN 'note ' || c_custkey ELSE '' END AS notes
FROM x WHERE status NOT IN ('', 'rejected')""")
def d20_full(spark, d):
    c = table(spark, d, "customer")
    master = c.selectExpr("c_custkey", "c_name AS name", "CASE WHEN c_custkey % 3 = 0 THEN 'DO' WHEN c_custkey % 3 = 1 THEN 'md' ELSE 'PhD' END AS kind")
    ranks = table(spark, d, "orders").selectExpr("o_custkey AS c_custkey", "CAST(floor(o_totalprice) AS BIGINT) % 100 AS decision_rank", "'top' AS rank_band", "CAST(NULL AS STRING) AS tier", "'Target' AS bucket")
    visibility = c.filter("c_nationkey IN (3, 4)").selectExpr("c_custkey", "CASE WHEN c_nationkey = 3 THEN 'Hidden' ELSE 'visible' END AS visibility")
    dossiers = c.selectExpr("c_custkey", f"{STATUS.replace('INTEGER', 'INT')} AS decision_status", "CASE WHEN c_custkey % 4 = 1 THEN 'researched' ELSE '' END AS research_status", "CASE WHEN c_custkey % 5 = 0 THEN 'high' ELSE '' END AS interest_level")
    existing = c.filter("c_custkey % 10 = 7").selectExpr("c_custkey", "'own words' AS why_kept", "concat('note ', c_custkey) AS notes")
    return B.final_application_list(master, ranks, visibility, dossiers, existing, "c_custkey")


#: Customers as wide entity rows.
WIDE = """c_custkey, c_name AS name, lower(c_name) AS slug, 'MD' AS kind, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Old Town' END AS city, c_mktsegment AS state, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 100 AS INT) END AS decision_rank, 'top' AS rank_band,
  CASE WHEN c_custkey % 4 = 0 THEN 'partial' WHEN c_custkey % 4 = 1 THEN '' ELSE 'high' END AS rank_confidence, 'Reach' AS tier, 'Target' AS bucket, CASE WHEN c_custkey % 7 <> 0 THEN CAST(500 + c_custkey % 25 AS DOUBLE) END AS mcat_average, CAST(3.5 AS DOUBLE) AS gpa_average, '25-39.9%' AS rate_band,
  CAST(40000 + c_custkey AS DOUBLE) AS cost_in, CASE WHEN c_custkey % 3 = 0 THEN CAST(50000 + c_custkey AS DOUBLE) END AS cost_out, CAST(NULL AS DOUBLE) AS cost_basis, CASE WHEN c_custkey % 9 = 0 THEN 'low' END AS quality_band, c_nationkey AS policy_count, c_custkey % 2 AS letter_count, CAST(NULL AS BOOLEAN) AS active,
  CASE WHEN c_custkey % 8 = 0 THEN 'missing cost' ELSE ' ' END AS score_warnings, c_custkey % 11 = 0 AS hard_no, CAST(7.5 AS DOUBLE) AS overall_score, CAST(7 AS DOUBLE) AS admissions_score, CAST(8 AS DOUBLE) AS attendance_score, '' AS positive_drivers, '' AS negative_drivers, CAST(NULL AS VARCHAR(9)) AS visibility, 'applying' AS decision_status"""


def entities(spark, d):
    return table(spark, d, "customer").selectExpr(*_split(WIDE.replace("VARCHAR(9)", "STRING")))


def _split(columns: str) -> list[str]:
    """A select list at its top-level commas."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


STATUS_OF = f"""WITH w AS (SELECT {WIDE} FROM customer), s AS (SELECT *, list_filter([CASE WHEN decision_rank IS NULL THEN 'decision_rank' END, CASE WHEN mcat_average IS NULL THEN 'mcat_average' END, CASE WHEN cost_out IS NULL THEN 'cost' END, CASE WHEN coalesce(policy_count, 0) = 0 THEN 'admissions_policy' END, CASE WHEN letter_count = 0 THEN 'letter_requirements' END], lambda x: x IS NOT NULL) AS m FROM w),
  r AS (SELECT *, CASE WHEN len(m) = 0 THEN 'ready' WHEN decision_rank IS NULL OR mcat_average IS NULL THEN 'provisional' ELSE 'partial' END AS readiness FROM s)"""


@query("d27_full_status", f"""{STATUS_OF} SELECT c_custkey, array_to_string(m, ',') AS missing_fields, readiness, coalesce(nullif(rank_confidence, ''), readiness) AS confidence,
  concat_ws('; ', CASE WHEN len(m) > 0 THEN len(m) || ' missing fields (warn)' END, CASE WHEN trim(score_warnings) <> '' THEN 'score warnings (warn)' END, CASE WHEN rank_confidence = 'partial' THEN 'partial confidence (warn)' END, CASE WHEN hard_no THEN 'hard no (error)' END) AS chips FROM r""")
def d27_full(spark, d):
    chips = F.array_join(F.transform("warning_chips", lambda c: F.concat(c["label"], F.lit(" ("), c["severity"], F.lit(")"))), "; ")
    return B.with_status(entities(spark, d)).select("c_custkey", F.array_join("missing_fields", ",").alias("missing_fields"), "readiness", "confidence", chips.alias("chips"))


@query("d26_card", f"""{STATUS_OF} SELECT 'card:' || c_custkey AS node_id, 'card' AS node_type, c_custkey, name, CASE WHEN city = '' THEN state ELSE city || ', ' || state END AS location, '/entities/' || slug AS route, decision_rank, mcat_average, cost_in, cost_out, readiness, len(m) AS n_missing FROM r""")
def d26_card(spark, d):
    card = B.entity_nodes(entities(spark, d), "c_custkey")["card"]
    return card.select("node_id", "node_type", "c_custkey", "identity.name", "identity.location", "identity.route", "rank_summary.decision_rank", "averages.mcat_average", "costs.cost_in", "costs.cost_out", "readiness", F.size("missing_fields").alias("n_missing"))


@query("d26_profile", f"""{STATUS_OF} SELECT c_custkey, coalesce(CAST(decision_rank AS VARCHAR), 'Unranked') || '|' || coalesce(CAST(CAST(mcat_average AS INT) AS VARCHAR), 'Missing') || '|3.5|$' || format('{{:,}}', CAST(cost_in AS BIGINT)) || '|' || coalesce('$' || format('{{:,}}', CAST(cost_out AS BIGINT)), 'Missing') || '|' || coalesce(quality_band, 'Missing') AS cards FROM r""")
def d26_profile(spark, d):
    profile = B.entity_nodes(entities(spark, d), "c_custkey", "local")["profile"]
    return profile.select("c_custkey", F.array_join(F.transform("snapshot_cards", lambda c: c["value"]), "|").alias("cards"))


@query("d26_other_nodes", f"""{STATUS_OF} SELECT node_type, count(*) AS n, sum(CASE WHEN readiness = 'ready' THEN 1 ELSE 0 END)::BIGINT AS n_ready FROM (SELECT 'ranking_card' AS node_type, readiness FROM r UNION ALL SELECT 'compare_card', readiness FROM r) GROUP BY 1 UNION ALL SELECT 'entity', count(*), 0 FROM r""")
def d26_other(spark, d):
    nodes = B.entity_nodes(entities(spark, d), "c_custkey", "local")
    count = lambda df, ready: df.groupBy("node_type").agg(F.count("*").alias("n"), ready.cast("long").alias("n_ready"))
    ready = F.sum(F.when(F.col("readiness") == "ready", 1).otherwise(0))
    return count(nodes["ranking_card"], ready).unionByName(count(nodes["compare_card"].filter("reviewer_state.visibility = 'visible'"), ready)).unionByName(count(nodes["entity"].filter("active AND source_confidence IN ('low', 'missing')"), F.sum(F.lit(0))))


@query("d26_ranking_cards", f"""{STATUS_OF} SELECT 'ranking_card:' || c_custkey AS node_id, 'ranking_card' AS node_type, c_custkey, name, decision_rank, rank_band, rank_confidence, overall_score, admissions_score, attendance_score, tier, bucket,
  positive_drivers, negative_drivers, array_to_string(m, ',') AS missing_fields, readiness FROM r""")
def d26_ranking_cards(spark, d):
    return B.entity_nodes(entities(spark, d), "c_custkey", "local")["ranking_card"].withColumn("missing_fields", F.array_join("missing_fields", ","))


@query("d26_compare_cards", f"""{STATUS_OF} SELECT 'compare_card:' || c_custkey AS node_id, name, kind, CASE WHEN city = '' THEN state ELSE city || ', ' || state END AS location, '/entities/' || slug AS route, decision_rank, rank_band, tier, bucket, mcat_average, gpa_average, rate_band,
  cost_in, cost_out, cost_basis, coalesce(policy_count, 0) AS policies, letter_count AS letters, array_to_string(m, ',') AS missing_fields, readiness, 'visible' AS visibility, decision_status FROM r""")
def d26_compare_cards(spark, d):
    card = B.entity_nodes(entities(spark, d), "c_custkey", "local")["compare_card"]
    facts = ("rank_fit.decision_rank", "rank_fit.rank_band", "rank_fit.tier", "rank_fit.bucket", "admissions_facts.*", "cost_facts.*", "requirements.*")
    return card.select("node_id", "identity.name", "identity.kind", "identity.location", "identity.route", *facts, F.array_join("missing_fields", ",").alias("missing_fields"), "readiness", "reviewer_state.*")


@query("d26_entities", f"""{STATUS_OF} SELECT 'entity:' || c_custkey AS node_id, 'entity' AS node_type, c_custkey, name, kind, city, state, '/entities/' || slug AS route, true AS active, coalesce(quality_band, 'missing') AS source_confidence FROM r""")
def d26_entities(spark, d):
    entity = B.entity_nodes(entities(spark, d), "c_custkey")["entity"]
    return entity.select("node_id", "node_type", "c_custkey", "identity.name", "identity.kind", "identity.city", "identity.state", "identity.route", "active", "source_confidence")


@query("d28_list_nodes", """
WITH t AS (SELECT list(p_partkey ORDER BY p_size, p_partkey) AS ids FROM (SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 25))
SELECT r_regionkey AS list_id, CASE WHEN r_regionkey % 3 = 2 THEN '' ELSE array_to_string(ids, ',') END AS ids, CASE WHEN r_regionkey % 3 = 2 THEN '' ELSE array_to_string(ids[:10], ',') END AS top_ids FROM region, t""")
def d28_lists(spark, d):
    lists = table(spark, d, "region").select(F.col("r_regionkey").alias("list_id"), F.when(F.col("r_regionkey") % 3 == 0, "ready").when(F.col("r_regionkey") % 3 == 1, "partial").alias("readiness"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return B.list_nodes(lists, table(spark, d, "part"), "p_partkey", "p_size").select("list_id", text("ids"), text("top_ids"))


@query("d28_methodology", """
SELECT CASE WHEN p_brand LIKE '%1' THEN 'scoring' ELSE p_brand END AS area, coalesce(arg_min(p_type, p_partkey) FILTER (p_size > 10), 'see the table') AS formula, count(*) AS n FROM part GROUP BY 1""")
def d28_methodology(spark, d):
    rows = table(spark, d, "part").select(F.when(F.col("p_brand").endswith("1"), " ").otherwise(F.col("p_brand")).alias("area"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("").alias("formula"), "p_partkey", "p_size")
    return B.methodology_nodes(rows, "area", "formula", ["p_partkey"]).select("area", "formula", F.size("components").cast("long").alias("n"))


ANSWERS = [("balanced", "BUILDING", False, ["FURNITURE"], "balanced_list", 25, "yes", "high"), ("safer", "MACHINERY", True, None, "safer_list", 30, "no", "low"), ("reach", "", False, [], "reach_heavy_list", None, None, "debt_averse"), ("other", None, None, None, "unheard_of", 5, "yes", None)]


@query("d23_guided_groups", """
WITH a(answer_id, home, hg, avoid, s, m, c, k, t, target, reach, cost) AS (VALUES ('balanced', 'BUILDING', false, 'FURNITURE', 10, 25, 35, 1, 25, 25, 'yes', 'high'), ('safer', 'MACHINERY', true, '', 10, 24, 34, 1, 30, 30, 'no', 'low'), ('reach', '', false, '', 12, 25, 45, 1, 25, 25, 'yes', 'debt_averse'), ('other', NULL, false, '', 8, 5, 15, 1, 5, 5, 'yes', NULL)),
  e AS (SELECT c_custkey, c_mktsegment AS state, c_custkey % 13 = 0 AS hidden, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 60 END AS rank, CASE WHEN c_custkey % 10 <> 9 THEN 7.0 END AS score, (c_custkey % 100) / 100.0 AS coverage, CASE WHEN c_custkey % 7 <> 0 THEN 500 END AS mcat, 3.5 AS gpa, 80000 + c_custkey % 30 * 1000 AS basis, CASE WHEN c_custkey % 9 = 0 THEN 'low' WHEN c_custkey % 9 = 1 THEN 'high' END AS quality, CASE WHEN c_custkey % 8 = 0 THEN 'w' END AS warn FROM customer),
  x AS (SELECT *, coalesce(state = home, false) AS same, score IS NULL OR coverage < 0.35 OR mcat IS NULL AS lacking, coalesce(rank, 9999) AS r FROM e CROSS JOIN a),
  g AS (SELECT *, CASE WHEN hidden OR state = avoid THEN 'lower_priority_or_hidden' WHEN lacking THEN 'need_more_data' WHEN same AND hg THEN 'home_options' WHEN r <= s THEN 'start_here' WHEN r > m AND r <= c AND reach <> 'no' THEN 'reach_to_research' WHEN r <= m THEN 'compare_next' ELSE 'lower_priority_or_hidden' END AS grp FROM x)
SELECT answer_id, c_custkey, grp AS "group", concat_ws('; ', CASE WHEN rank IS NOT NULL THEN 'Selected rank ' || rank END, CASE WHEN grp = 'home_options' THEN 'Home option' END, CASE WHEN same THEN 'In-state context' END, 'Cost context applied') AS reasons,
  concat_ws('; ', CASE WHEN hidden THEN 'Hidden' END, CASE WHEN grp = 'need_more_data' THEN 'Incomplete data' END, CASE WHEN coverage < 0.5 THEN 'Low score coverage' END, CASE WHEN basis > 90000 AND cost IN ('high', 'debt_averse') THEN 'High cost signal' END, CASE WHEN rank > target THEN 'Outside target count' END, CASE WHEN quality = 'low' THEN 'Stats quality low' END,
    CASE WHEN warn IS NOT NULL AND (CAST(hidden AS INT) + CAST(grp = 'need_more_data' AS INT) + CAST(coverage < 0.5 AS INT) + CAST(coalesce(basis > 90000 AND cost IN ('high', 'debt_averse'), false) AS INT) + CAST(coalesce(rank > target, false) AS INT) + CAST(coalesce(quality = 'low', false) AS INT)) < 6 THEN 'Score warning present' END) AS risks,
  concat_ws('; ', CASE WHEN mcat IS NULL THEN 'MCAT avg' END, CASE WHEN score IS NULL THEN 'selected rank' END) AS missing FROM g""")
def d23(spark, d):
    ranked = table(spark, d, "customer").selectExpr("c_custkey", "c_mktsegment AS state", "c_custkey % 13 = 0 AS hidden", "CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 60 END AS decision_rank", "CASE WHEN c_custkey % 10 <> 9 THEN 7.0D END AS overall_score", "(c_custkey % 100) / 100.0D AS coverage", "CASE WHEN c_custkey % 7 <> 0 THEN 500D END AS mcat_average", "3.5D AS gpa_average", "80000 + c_custkey % 30 * 1000 AS cost_basis", "CASE WHEN c_custkey % 9 = 0 THEN 'low' WHEN c_custkey % 9 = 1 THEN 'high' END AS quality_band", "CASE WHEN c_custkey % 8 = 0 THEN 'w' END AS score_warnings")
    answers = spark.createDataFrame(ANSWERS, "answer_id string, home_state string, home_group boolean, avoided array<string>, strategy string, target int, include_reach string, cost_sensitivity string")
    out = B.guided_groups(ranked, answers, "c_custkey")
    return out.select("answer_id", "c_custkey", "group", *[F.array_join(c, "; ").alias(c) for c in ("reasons", "risks", "missing")])


@query("d31_direction_texts", """
SELECT p_partkey, array_to_string(list_slice(list(c || ' ' || side || ' at ' || s ORDER BY w DESC, c), 1, 2), '; ') AS bullets FROM (
  SELECT p_partkey, 'Size' AS c, 20 AS w, p_size % 10 + 1 AS s, CASE WHEN p_size % 10 + 1 >= 7.5 THEN 'helps' WHEN p_size % 10 + 1 <= 4.5 THEN 'hurts' END AS side FROM part UNION ALL SELECT p_partkey, 'Price', 25, p_partkey % 10 + 1, CASE WHEN p_partkey % 10 + 1 >= 7.5 THEN 'helps' WHEN p_partkey % 10 + 1 <= 4.5 THEN 'hurts' END FROM part
  UNION ALL SELECT p_partkey, 'Fit', 5, 9, 'helps' FROM part WHERE p_partkey % 2 = 0) WHERE side IS NOT NULL GROUP BY 1""")
def d31_directions(spark, d):
    row = lambda c, w, s, on: F.struct(F.lit(c).alias("component"), F.lit(w).alias("weight"), s.cast("double").alias("score"), on.alias("included"))
    cells = F.inline(F.array(row("size_score", 20, F.col("p_size") % 10 + 1, F.lit(True)), row("price_score", 25, F.col("p_partkey") % 10 + 1, F.lit(True)), row("fit_score", 5, F.lit(9), F.col("p_partkey") % 2 == 0)))
    out = B.direction_texts(table(spark, d, "part").select("p_partkey", cells), ["p_partkey"], 2)
    return out.select("p_partkey", F.array_join("bullets", "; ").alias("bullets"))


@query("d33_edited_rows", "SELECT 'v1' AS schema_version, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'hidden' ELSE c_mktsegment END AS state, CASE WHEN c_custkey % 10 = 5 THEN '' ELSE 'n' END AS note FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 10 IN (5, 6)")
def d33_edited(spark, d):
    c = table(spark, d, "customer")
    stored = c.filter("c_custkey % 10 <> 6").selectExpr("c_custkey", "c_mktsegment AS state", "'n' AS note")
    now = c.selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'hidden' ELSE c_mktsegment END AS state", "CASE WHEN c_custkey % 10 <> 5 THEN 'n' END AS note")
    return B.edited_rows(now, stored, ["c_custkey"], ["state", "note"], "v1")


@query("d29_public_payload", "SELECT 'customer' AS \"table\", count(*) AS n, 0::BIGINT AS n_private FROM customer UNION ALL SELECT 'part', count(*), 0 FROM part")
def d29(spark, d):
    """Customers with a planted note and a private struct, and a table that stays private."""
    at = scratch(spark, "public")
    customer = table(spark, d, "customer").select("c_custkey", F.struct("c_name", F.lit("planted-secret").alias("note")).alias("who"), F.lit("planted-secret").alias("private_note"))
    names = B.publish({"customer": customer, "part": table(spark, d, "part"), "dossiers": customer}, at, "public", ["dossiers"], ["private_note", "note"])
    leaks = B.leak_check(spark, at, names, spark.createDataFrame([("planted-secret",)], "secret string"), "secret")
    counts = None
    for n in names:
        one = spark.read.text(f"{at}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.join(leaks.groupBy("table").agg(F.sum("n").alias("n_private")), "table", "left").withColumn("n_private", F.coalesce("n_private", F.lit(0)))


@query("d29_leaks", "SELECT 'customer' AS \"table\", 'planted-secret' AS secret, count(*) FILTER (c_custkey % 7 = 0) AS n FROM customer")
def d29_leaks(spark, d):
    at = scratch(spark, "local")
    note = F.when(F.col("c_custkey") % 7 == 0, "a planted-secret here")
    names = B.publish({"customer": table(spark, d, "customer").withColumn("private_note", note)}, at, "local", [], ["private_note"])
    return B.leak_check(spark, at, names, spark.createDataFrame([("planted-secret",), ("absent",), (None,)], "secret string"), "secret")


@query("d30_run_all", "SELECT c_mktsegment, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS n_positive FROM customer GROUP BY 1")
def d30(spark, d):
    rules = lambda t: V.validate(V.rule_nonnegative(t["customer"].select("c_custkey", "paid"), "customer", "c_custkey", ["paid"]))
    tables = {"customer": table(spark, d, "customer").withColumn("paid", F.greatest("c_acctbal", F.lit(0.0)))}
    steps = [
        ("integrate", lambda t: {"scored": t["customer"].withColumn("positive", F.col("paid") > 0)}, True),
        ("rank", lambda t: {"ranked": t["scored"].groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if("positive").alias("n_positive"))}, True),
        ("publish", lambda t: {"out": t["ranked"]}, False),
    ]
    return B.run_all(tables, rules, steps)["out"]


@query("d3_private_rankings", "SELECT c_mktsegment AS profile, count(*) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) CROSS JOIN supplier GROUP BY 1")
def d3(spark, d):
    return _private(spark, d).groupBy("profile").agg(F.count("*").alias("n"))


def _private(spark, d):
    projection = Q.supplier_projection(spark, d)
    profiles = projection.select("profile").distinct().withColumn("private", F.when(F.col("profile").isin("BUILDING", "MACHINERY"), "yes").otherwise("no"))
    return I.private_rankings(projection, profiles, "profile", "private", scratch(spark, "private"), groups=Q.GROUPS, overall=Q.OVERALL, scenarios=Q.SCENARIOS, excluded=F.col("s_acctbal") < -900)


@query("d3_private_ranks", f"SELECT profile, s_suppkey, overall_score, overall_rank, price_first_rank FROM ({D2_SQL}) WHERE profile IN ('BUILDING', 'MACHINERY')")
def d3_ranks(spark, d):
    return _private(spark, d).select("profile", "s_suppkey", "overall_score", "overall_rank", "price_first_rank")


@query("s1_s3_csv_tables", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, '' AS absent FROM customer")
def s1(spark, d):
    """Customers written in the order of their keys and read back as strings; a missing table is empty."""
    at = scratch(spark, "csv")
    X.write_table(table(spark, d, "customer").withColumn("extra", F.lit(1)), f"{at}/customer", ["c_custkey", "c_name"], ["c_custkey"])
    back = X.read_table(spark, f"{at}/customer", ["c_custkey", "c_name", "absent"])
    return back.unionByName(X.read_table(spark, f"{at}/nothing", ["c_custkey", "c_name", "absent"])).select("c_custkey", "c_name", F.coalesce("absent", F.lit("")).alias("absent"))


@query("s4_bundle", "SELECT 'card' AS node_type, 'local' AS mode, count(*) AS record_count FROM customer")
def s4(spark, d):
    at = scratch(spark, "bundle")
    X.write_bundle(B.entity_nodes(entities(spark, d), "c_custkey", "local")["card"], at, "card", "local")
    return spark.read.json(f"{at}/header").select("node_type", "mode", "record_count")


@query("s4_bundle_nodes", f"""{STATUS_OF} SELECT 'card:' || c_custkey AS node_id, c_custkey, name, CASE WHEN city = '' THEN state ELSE city || ', ' || state END AS location, decision_rank, tier, mcat_average, cost_in, cost_out, readiness, array_to_string(m, ',') AS missing_fields FROM r""")
def s4_nodes(spark, d):
    """The nodes of a bundle, read back from what was written; absent fields of a node are absent in its JSON."""
    at, nodes = scratch(spark, "bundle"), B.entity_nodes(entities(spark, d), "c_custkey", "local")["card"]
    X.write_bundle(nodes, at, "card", "local")
    back = spark.read.schema(nodes.schema).json(f"{at}/nodes")
    return back.select("node_id", "c_custkey", "identity.name", "identity.location", "rank_summary.decision_rank", "rank_summary.tier", "averages.mcat_average", "costs.cost_in", "costs.cost_out", "readiness", F.array_join("missing_fields", ",").alias("missing_fields"))
