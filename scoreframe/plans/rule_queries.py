"""Queries of filters, quality rules, sources and registries on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.functions.fixed import SCORE_BANDS
from scoreframe.operators import filters as P
from scoreframe.operators import rules as V
from scoreframe.plans.registry import query, table
from scoreframe.sources import tables as X


@query("f1_active_entities", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1 AND c_custkey % 5 <> 0 AND c_mktsegment = 'BUILDING'")
def f1(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").withColumn("active", F.when(k % 3 == 0, "").when(k % 3 == 1, "FALSE").otherwise("Yes")).withColumn("excluded", F.when(k % 5 == 0, "true").otherwise(""))
    return P.active_entities(c, "c_custkey", "active", "excluded", ("c_mktsegment", "BUILDING")).select("c_custkey")


@query("f2_default_or_all", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT c_custkey FROM customer")
def f2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "yes").otherwise("no").alias("flag"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.lit("").alias("flag"))
    return P.default_or_all(o, "flag").select("o_orderkey").union(P.default_or_all(c, "flag").select("o_orderkey"))


@query("f3_accepted_only", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def f3(spark, d):
    lab = table(spark, d, "labels").withColumn("status", F.when(F.col("quality") == 1, "accepted").otherwise("rejected")).withColumn("score", 1.0 - F.col("toxic"))
    return P.accepted_only(lab, "status", ["accepted"], score="score", any_of=["quality"]).select("doc_id")


@query("f4_filter_entities", "SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_retailprice > 0 AND p_size NOT IN (1, 2) AND contains(lower(p_name), 'e')")
def f4(spark, d):
    part = table(spark, d, "part")
    first = part.agg(F.min("p_brand").alias("kind"))
    rows = part.select("p_partkey", F.col("p_brand").alias("kind"), F.lit("r").alias("region"), F.col("p_retailprice").alias("cost"), F.col("p_size").cast("string").alias("state"), F.lit("").alias("city"), F.lit("").alias("ownership"), F.col("p_name").alias("name"))
    kept = P.filter_entities(rows, {"region": "r", "with_cost": True, "excluded_states": ["1", "2"], "ownership": "public", "query": "E"})
    return kept.join(F.broadcast(first), "kind", "left_semi").select("p_partkey")


@query("f5_facets", "SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part WHERE p_size IN (1, 5, 9) GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part WHERE p_size IN (1, 5, 9) GROUP BY 2")
def f5(spark, d):
    return P.facet_values(P.facet_filter(table(spark, d, "part"), {"p_size": [1, 5, 9], "p_brand": []}), ["p_brand", "p_size"])


@query("f6_worklist", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey <= 500 AND o_orderkey % 2 = 0")
def f6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("rank"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("hidden").alias("visibility"))
    return P.worklist_filter(o, "visible", ["O", "P"], 500, True, ["status"]).select("o_orderkey")


RANGES = "SELECT p_partkey, p_size, p_retailprice, q1, q3, r1, r3 FROM part JOIN (SELECT p_brand, avg(p_size) - 10 AS q1, avg(p_size) + 10 AS q3, avg(p_retailprice) - 200 AS r1, avg(p_retailprice) + 200 AS r3 FROM part GROUP BY 1) USING (p_brand)"


def ranges(spark, d):
    part = table(spark, d, "part")
    g = part.groupBy("p_brand").agg((F.avg("p_size") - 10).alias("q1"), (F.avg("p_size") + 10).alias("q3"), (F.avg("p_retailprice") - 200).alias("r1"), (F.avg("p_retailprice") + 200).alias("r3"))
    return part.join(g, "p_brand")


@query("f7_screen_fit", f"SELECT p_partkey, CASE WHEN b AND a THEN 'mixed' WHEN b THEN 'below' WHEN a THEN 'above' ELSE 'within' END AS fit FROM (SELECT p_partkey, p_size < q1 OR p_retailprice < r1 AS b, p_size > q3 OR p_retailprice > r3 AS a FROM ({RANGES}))")
def f7(spark, d):
    return ranges(spark, d).select("p_partkey", P.screen_fit([(F.col("p_size"), F.col("q1"), F.col("q3")), (F.col("p_retailprice"), F.col("r1"), F.col("r3"))]).alias("fit"))


@query("f8_score_fit_label", "SELECT p_partkey, CASE WHEN a IS NULL THEN CASE WHEN b >= 6.5 THEN 'good' WHEN b >= 4.2 THEN 'stretch' ELSE 'unlikely' END WHEN (a + b) / 2 >= 8.5 AND least(a, b) >= 7.5 THEN 'strong' WHEN (a + b) / 2 >= 7.2 AND least(a, b) >= 6 THEN 'good' WHEN (a + b) / 2 >= 5.8 THEN 'possible' WHEN (a + b) / 2 >= 4.2 THEN 'stretch' ELSE 'unlikely' END AS label FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size % 10 + 1 END AS a, p_partkey % 10 + 1 AS b FROM part)")
def f8(spark, d):
    a, b = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") % 10 + 1), F.col("p_partkey") % 10 + 1
    return table(spark, d, "part").select("p_partkey", P.score_fit_label(a, b).alias("label"))


@query("f9_classify_topic", "SELECT page_id, CASE WHEN contains(lower(url), '/en/') THEN 'english' WHEN contains(lower(url), '/fr/') OR contains(lower(url), '/de/') THEN 'foreign' ELSE 'other' END AS topic FROM pages")
def f9(spark, d):
    return table(spark, d, "pages").select("page_id", P.classify_topic(F.col("url"), [("english", ["/en/"]), ("foreign", ["/fr/", "/de/"])]).alias("topic"))


@query("f10_unsafe_url", "SELECT page_id, contains(regexp_extract(lower(url), '://([^/?#]*)', 1), 'casino') OR contains(regexp_extract(lower(url), '://([^/?#]*)', 1), 'spam') AS unsafe FROM pages")
def f10(spark, d):
    return table(spark, d, "pages").select("page_id", P.is_unsafe_url(F.col("url"), ["casino", "spam"]).alias("unsafe"))


@query("f11_drop_placeholders", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N' AND (l_discount > 0 OR l_tax > 0)")
def f11(spark, d):
    return P.drop_placeholders(table(spark, d, "lineitem"), "l_returnflag", ["n"], ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber")


def counted(issues):
    return issues.groupBy("severity", "file", "field").agg(F.count("*").alias("n"))


@query("v1_duplicate", "SELECT CAST(user_id AS VARCHAR) AS row_id, 'duplicate of row ' || f AS message, count(*) AS n FROM (SELECT user_id, first_value(event_id) OVER w AS f, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE rn > 1 GROUP BY 1, 2")
def v1(spark, d):
    return V.rule_duplicate(table(spark, d, "events"), "events", "user_id", "event_id").groupBy("row_id", "message").agg(F.count("*").alias("n"))


@query("v2_scores", "SELECT CAST(p_partkey AS VARCHAR) AS row_id, 'size_score' AS field FROM part WHERE p_size > 10 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'key_score' FROM part WHERE p_partkey % 20 NOT BETWEEN 1 AND 10")
def v2(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size_score"), (F.col("p_partkey") % 20).alias("key_score"), F.lit(99).alias("a_match_score"))
    return V.rule_scores(rows, "part", "p_partkey").select("row_id", "field")


@query("v3_range", "SELECT l_orderkey || '-' || l_linenumber AS row_id, 'l_discount' AS field FROM lineitem WHERE l_discount > 0.05")
def v3(spark, d):
    line = table(spark, d, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return V.rule_range(line, "lineitem", "id", ["l_discount"], 0, 0.05).select("row_id", "field")


@query("v4_nonnegative", "SELECT CAST(c_custkey AS VARCHAR) AS row_id, 'value must not be negative' AS message FROM customer WHERE c_acctbal < 0")
def v4(spark, d):
    return V.rule_nonnegative(table(spark, d, "customer"), "customer", "c_custkey", ["c_acctbal"]).select("row_id", "message")


@query("v5_requires", "SELECT CAST(o_orderkey AS VARCHAR) AS row_id, 'reason is required here' AS message FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0")
def v5(spark, d):
    o = table(spark, d, "orders").withColumn("reason", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).otherwise(" "))
    return V.rule_requires(o, "orders", "o_orderkey", F.col("o_orderstatus") == "F", ["reason"]).select("row_id", "message")


@query("v6_allowed", "SELECT CAST(o_orderkey AS VARCHAR) AS row_id, 'value is not allowed: ' || o_orderstatus AS message FROM orders WHERE o_orderstatus = 'P'")
def v6(spark, d):
    return V.rule_allowed(table(spark, d, "orders"), "orders", "o_orderkey", "o_orderstatus", ["O", "F"]).select("row_id", "message")


@query("v7_reference", "SELECT CAST(o_orderkey AS VARCHAR) AS row_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def v7(spark, d):
    return V.rule_reference(table(spark, d, "orders"), "orders", "o_orderkey", "o_custkey", table(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey").select("row_id")


@query("v8_config", "SELECT DISTINCT event_type AS row_id FROM events WHERE event_type NOT IN ('click', 'purchase')")
def v8(spark, d):
    return V.rule_config(table(spark, d, "events").select("event_type").distinct(), "weights", "event_type", ["click", "purchase"]).select("row_id")


@query("v9_present", "SELECT CAST(page_id AS VARCHAR) AS row_id, 'warning' AS severity FROM pages WHERE page_id % 7 = 0")
def v9(spark, d):
    p = table(spark, d, "pages").withColumn("link", F.when(F.col("page_id") % 7 != 0, F.col("url")))
    return V.rule_present(p, "pages", "page_id", ["link"]).select("row_id", "severity")


@query("v10_coverage", "SELECT CAST(p_partkey AS VARCHAR) AS row_id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0")
def v10(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", F.when(k % 2 != 0, k).alias("a"), F.when(k % 3 != 0, k).alias("b"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("e"))
    return V.rule_coverage(rows, "part", "p_partkey", ["a", "b", "c", "e"]).select("row_id")


@query("v11_outputs", "SELECT 'url' AS field, count(*) AS n FROM pages WHERE contains(url, 'casino') HAVING count(*) > 0 UNION ALL SELECT 'score', count(*) FROM pages WHERE page_id % 2 = 0 AND page_id % 10 < 9 HAVING count(*) > 0 UNION ALL SELECT 'a', count(*) FROM pages WHERE page_id % 2 = 0 AND page_id % 3 = 0 HAVING count(*) > 0")
def v11(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", "url", ((k % 10) / 10).alias("score"), F.when(k % 2 == 0, "accepted").otherwise("review").alias("status"), F.when(k % 3 != 0, k).alias("a"), k.alias("b"), F.col("html").alias("evidence"))
    return V.rule_outputs(p, "pages", "page_id", "url", "score", "status", ("a", "b"), "evidence", ["casino"]).groupBy("field").agg(F.count("*").alias("n"))


@query("v12_validate", "SELECT 'error' AS severity, 'customer' AS file, 'c_acctbal' AS field, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'error', 'orders', 'o_orderstatus', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'error', 'orders', 'comment', 1")
def v12(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return counted(V.validate(V.rule_nonnegative(c, "customer", "c_custkey", ["c_acctbal"]), V.rule_allowed(o, "orders", "o_orderkey", "o_orderstatus", ["O", "F"]), V.rule_columns(o, "orders", ["o_orderkey", "comment"])))


@query("a17_issue_counts", "SELECT CAST(c_custkey AS VARCHAR) AS row_id, CAST(c_acctbal < 0 AS BIGINT) AS error, CAST(c_custkey % 2 = 0 AS BIGINT) AS warning FROM customer WHERE c_acctbal < 0 OR c_custkey % 2 = 0")
def a17(spark, d):
    from scoreframe.operators.aggregates import issue_counts

    c = table(spark, d, "customer")
    odd = c.withColumn("note", F.when(F.col("c_custkey") % 2 != 0, "x"))
    return issue_counts(V.validate(V.rule_nonnegative(c, "customer", "c_custkey", ["c_acctbal"]), V.rule_present(odd, "customer", "c_custkey", ["note"])), "row_id", ("error", "warning"))


@query("s2_check_columns", "SELECT 'error' AS severity, 'orders' AS file, 'comment' AS field, count(DISTINCT 1) AS n FROM orders")
def s2(spark, d):
    return counted(X.check_columns(table(spark, d, "orders"), "orders", ["o_orderkey", "comment"]))


@query("s5_reference_grid", "SELECT 'all' AS row_band, b AS col_band, n AS acceptees, n * 2 AS applicants FROM (SELECT CASE WHEN p_size <= 10 THEN '1-10' WHEN p_size <= 30 THEN '11-30' ELSE '31 and over' END AS b, CAST(count(*) AS INTEGER) AS n FROM part GROUP BY 1)")
def s5(spark, d):
    labels = ("1-10", "11-30", "31 and over")
    one = table(spark, d, "part").agg(*[F.count_if(c).cast("int").alias(f"n{i}") for i, c in enumerate((F.col("p_size") <= 10, F.col("p_size").between(11, 30), F.col("p_size") > 30))])
    n = F.array(*[F.col(f"n{i}") for i in range(3)])
    rows = one.select(F.lit("all").alias("row_band"), n.alias("acceptees"), F.transform(n, lambda x: x * 2).alias("applicants"), F.array(*[F.lit(0.5)] * 3).alias("rates"))
    return X.reference_grid(spark, rows, labels).drop("rate")


@query("s6_document_manifest", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS n_bytes, 'other' AS kind FROM documents UNION ALL SELECT page_id, sha256(html), strlen(html), 'html' FROM pages")
def s6(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    b = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("content"))
    out = X.document_manifest(a.unionByName(b).withColumn("name", F.col("doc_id").cast("string")), "name", "content")
    return out.select(F.col("name").cast("long").alias("doc_id"), "sha256", F.col("n_bytes").cast("long").alias("n_bytes"), "kind")


NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("s7_table_inventory", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n_rows FROM {n}" for n in NAMES))
def s7(spark, d):
    return X.table_inventory({n: table(spark, d, n) for n in NAMES})


@query("s8_merge_registry", "SELECT n_name AS source_name, CAST(n_regionkey AS VARCHAR) AS source_url, 'base' AS note FROM nation UNION ALL SELECT s_name, '', 'added' FROM supplier")
def s8(spark, d):
    base = table(spark, d, "nation").select(F.col("n_name").alias("source_name"), F.col("n_regionkey").cast("string").alias("source_url"), F.lit("base").alias("note"), F.col("n_nationkey").alias("pos"))
    more = table(spark, d, "supplier").select(F.col("s_name").alias("source_name"), F.lit("").alias("source_url"), F.lit("added").alias("note"), F.col("s_suppkey").cast("int").alias("pos"))
    return X.merge_registry(base, base.withColumn("note", F.lit("late")), more, more.withColumn("source_name", F.lit(" "))).drop("pos")


@query("s9_methodology", "SELECT 'weight: ' || p_brand AS area, count(DISTINCT p_size) AS n FROM part GROUP BY 1 UNION ALL SELECT 'band', 10 UNION ALL SELECT 'rank', 1")
def s9(spark, d):
    w = table(spark, d, "part").groupBy(F.col("p_brand").alias("group"), F.col("p_size").cast("string").alias("component")).agg(F.count("*").cast("double").alias("weight"))
    return X.methodology_table(w, [("rank", "ties", "shared")], SCORE_BANDS).groupBy("area").agg(F.count("*").alias("n"))


@query("p28_public_view", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def p28(spark, d):
    return X.public_view(table(spark, d, "customer"), ["c_acctbal", "absent"])
