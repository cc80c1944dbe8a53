"""Queries of the joins on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.operators import joins as J
from scoreframe.plans.registry import query, table
from scoreframe.sources.stages import spread


@query("j1_lookup_first", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) ON o_orderkey = l_orderkey AND rn = 1")
def j1(spark, d):
    line = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.lookup_first(table(spark, d, "orders").select("o_orderkey"), line, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("o_orderkey", "l_linenumber", "l_partkey")


@query("j2_lookup_last", "SELECT user_id, event_type, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1, 2")
def j2(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return J.lookup_last(e.select("user_id", "event_type").distinct(), e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("j3_attach_many", "SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def j3(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    out = J.attach_many(table(spark, d, "orders").select("o_orderkey"), line, ["o_orderkey"], "lines", ["l_linenumber"])
    return out.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("quantity"))


@query("j4_cross_profiles", "SELECT c_mktsegment AS segment, p_partkey, p_size + length(c_mktsegment) AS fit FROM (SELECT DISTINCT c_mktsegment FROM customer), part")
def j4(spark, d):
    seg = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return J.cross_profiles(seg, table(spark, d, "part").select("p_partkey", "p_size")).select("segment", "p_partkey", (F.col("p_size") + F.length("segment")).cast("long").alias("fit"))


@query("j5_grid_lookup", "WITH b AS (SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'small' ELSE 'large' END AS a, CASE WHEN p_retailprice < 1200 THEN 'cheap' ELSE 'dear' END AS c FROM part), g AS (SELECT a, c, count(*) AS n FROM b WHERE NOT (a = 'small' AND c = 'dear') GROUP BY 1, 2) SELECT p_partkey, a, c, n FROM b LEFT JOIN g USING (a, c)")
def j5(spark, d):
    b = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("a"), F.when(F.col("p_retailprice") < 1200, "cheap").otherwise("dear").alias("c"))
    grid = b.groupBy("a", "c").agg(F.count("*").alias("n")).filter("NOT (a = 'small' AND c = 'dear')")
    return J.grid_lookup(b, grid, ["a", "c"])


@query("j6_overrides", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1000 END AS target, CASE p_partkey % 4 WHEN 0 THEN 'override_accept' WHEN 1 THEN 'override_none' WHEN 2 THEN 'ignored' ELSE 'unmatched' END AS status FROM part")
def j6(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    named = part.filter(k % 4 != 3).select("p_partkey", "p_name", F.when(k % 4 == 0, "accept").when(k % 4 == 1, "reject").otherwise("ignore").alias("action"), (k + 1000).alias("target"))
    other = part.filter(k % 4 == 0).select("p_partkey", F.lit("another").alias("p_name"), F.lit("reject").alias("action"), k.alias("target"))
    return J.apply_overrides(part, named.union(other), ["p_partkey"], "p_name").select("p_partkey", "target", "status")


@query("j7_match_entities", "SELECT p_brand || '|' || p_name AS source_id, p_brand || '|' || p_name AS best, 'exact' AS label FROM part GROUP BY ALL")
def j7(spark, d):
    m = table(spark, d, "part").select("p_brand", "p_name").distinct().withColumn("master_id", F.concat_ws("|", "p_brand", "p_name"))
    s = m.select(F.col("master_id").alias("source_id"), "p_brand", F.concat(F.lit("The "), F.upper("p_name"), F.lit("!")).alias("p_name"))
    return J.match_entities(s, m, "source_id", "master_id", "p_name", ["p_brand"]).select("source_id", "best", "label")


@query("j7_match_misspelt")
def j7m(spark, d):
    """Names with a letter doubled or without blanks; every third source has no brand, every seventh a null one."""
    m = table(spark, d, "part").select("p_brand", "p_name").distinct().withColumn("master_id", F.concat_ws("|", "p_brand", "p_name"))
    k = F.crc32("master_id")
    name = F.when(k % 2 == 0, F.regexp_replace("p_name", "^(..)(.)", "$1$2$2")).otherwise(F.regexp_replace("p_name", " ", ""))
    s = m.select(F.col("master_id").alias("source_id"), F.when(k % 3 == 0, "").when(k % 7 == 0, None).otherwise(F.col("p_brand")).alias("p_brand"), name.alias("p_name"))
    return J.match_entities(s, m, "source_id", "master_id", "p_name", ["p_brand"])


@query("j8_match_with_geo")
def j8(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.initcap("n_name").alias("city"))
    sup = spread(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")).join(n, "s_nationkey").withColumn("state", F.col("s_nationkey").cast("string"))
    src = sup.select(F.col("s_suppkey").alias("source_id"), F.concat_ws(" ", "s_name", "city").alias("s_name"), "state")
    return J.match_with_geo(src, sup, "source_id", "s_suppkey", "s_name", "state", "city")


@query("j9_match_profiles")
def j9(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    names = spread(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")).join(n, "s_nationkey").select("s_suppkey", F.concat_ws(" ", "n_name", "s_name").alias("name"), F.col("s_name").alias("alias"), F.col("s_nationkey").cast("string").alias("state"), F.lower("n_name").alias("city"))
    src = names.select(F.col("s_suppkey").alias("source_id"), F.col("alias").alias("name"), "state", "city")
    return J.match_profiles(src, names, "source_id", "s_suppkey", "name", ["name", "alias"], "state", "city", ["alias"])


@query("j10_unique_targets", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) = 1) UNION ALL SELECT o_orderkey, CAST(o_custkey AS INTEGER) FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1)")
def j10(spark, d):
    a = J.unique_targets(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", "c_nationkey")
    b = J.unique_targets(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", F.col("o_custkey").cast("int"))
    return a.union(b)


@query("j11_cluster_lookup", "WITH c AS (SELECT min(p_partkey) AS cid, p_name AS canonical FROM part GROUP BY p_name) SELECT p_partkey, least(a.cid, b.cid) AS cluster FROM part p JOIN c a ON a.canonical = p.p_name LEFT JOIN c b ON b.canonical = upper(p.p_name)")
def j11(spark, d):
    part = table(spark, d, "part")
    c = part.groupBy(F.col("p_name").alias("canonical")).agg(F.min("p_partkey").alias("cluster")).withColumn("members", F.array(F.upper("canonical")))
    return J.cluster_lookup(part.select("p_partkey", "p_name"), c, "p_name", "cluster", "canonical", "members").select("p_partkey", "cluster")


@query("j12_missing_from", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j12(spark, d):
    return J.missing_from(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("j12_orphans", "SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j12_orphans(spark, d):
    """Every seventh customer's orders are of an unknown customer instead."""
    k = F.col("o_custkey")
    orders = table(spark, d, "orders").select(F.when(k % 7 == 0, -k - 1).otherwise(k).alias("c_custkey"))
    return J.missing_from(table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"])


@query("j13_known_only", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def j13(spark, d):
    ids = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return J.known_only(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ids, ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query("j14_overlap_all", """WITH c AS (SELECT l_suppkey AS page, concat_ws('|', l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) AS cell, l_quantity AS start, l_quantity + 3 AS stop FROM lineitem),
r AS (SELECT s_suppkey AS page, CAST(k AS INTEGER) AS row_id, k * 8.0 AS top, k * 8.0 + 6 AS bottom FROM supplier, range(7) t(k)),
p AS (SELECT c.page, cell, row_id, CAST(least(stop, bottom) - greatest(start, top) AS DOUBLE) AS overlap FROM c JOIN r ON c.page = r.page AND start <= bottom AND top <= stop)
SELECT page, cell, row_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY page, cell ORDER BY overlap DESC, row_id) AS rn FROM p) WHERE rn = 1""")
def j14a(spark, d):
    """j14 over every row; order and line number alone don't tell the rows apart."""
    q = F.col("l_quantity")
    cell = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", q.cast("int"))
    cells = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), cell.alias("cell"), q.alias("start"), (q + 3).alias("stop"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("row_id")).select("page", "row_id", (F.col("row_id") * 8.0).alias("top"), (F.col("row_id") * 8.0 + 6).alias("bottom"))
    return J.overlap_join(cells, rows, "page", "cell", "row_id", 8.0)


@query("j15_nearest_column", "SELECT p_partkey, CASE WHEN least(abs(p_retailprice - 950), abs(p_retailprice - 1250), abs(p_retailprice - 1700)) <= 100 THEN CASE WHEN abs(p_retailprice - 950) <= least(abs(p_retailprice - 1250), abs(p_retailprice - 1700)) THEN 'a' WHEN abs(p_retailprice - 1250) <= abs(p_retailprice - 1700) THEN 'b' ELSE 'c' END END AS nearest FROM part")
def j15(spark, d):
    return J.nearest_column(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", (("a", 950.0), ("b", 1250.0), ("c", 1700.0)), 100.0).select("p_partkey", "nearest")


@query("j16_asof", "SELECT v.event_id, a.ts AS anchor_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') v ASOF LEFT JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup') a ON v.user_id = a.user_id AND v.ts >= a.ts")
def j16(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return J.asof_anchor(e.filter("event_type = 'purchase'").drop("event_type"), e.filter("event_type = 'signup'").select("user_id", "ts"), ["user_id"], "ts").select("event_id", "anchor_ts")


@query("j17_denormalize", "SELECT c_custkey, n_name, r_name, coalesce(n_orders, 0) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j17(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return J.denormalize(table(spark, d, "customer"), (nation, ["c_nationkey"]), (region, ["n_regionkey"]), (counts, ["c_custkey"])).select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("j18_with_route", "SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NOT NULL THEN '/part/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS route FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j18(spark, d):
    slugs = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), S.slugify(F.col("p_name")).alias("slug"))
    return J.with_route(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), slugs, "l_partkey", "/part/").select("l_orderkey", "l_linenumber", "route")


@query("j19_select_in_order", "SELECT p_partkey, p_name, CAST(CASE p_partkey WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 11 THEN 2 END AS INTEGER) AS pos FROM part WHERE p_partkey IN (7, 3, 11)")
def j19(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    ids = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in (7, 3, 11)]).alias("ids"))
    return J.select_in_order(part, "p_partkey", ids)
