"""Queries of the column functions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.functions import text as X
from scoreframe.functions.fixed import COMPONENT_CUTS, RATE_CUTS, TIER_CUTS
from scoreframe.plans.registry import query, table

PRICE_BANDS = (("under 1000", None, 999.99), ("1000-1499", 1000.0, 1499.99), ("1500 and over", 1500.0, None))
SIZE_BANDS = (("1-10", None, 10.0), ("11-30", 11.0, 30.0), ("31 and over", 31.0, None))


@query("p1_clean", "SELECT event_id, trim(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE '  ' || event_type || ' ' END, '')) AS cleaned FROM events")
def p1(spark, d):
    raw = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", S.clean(raw).alias("cleaned"))


@query("p2_parse_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS parsed FROM orders")
def p2(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    return table(spark, d, "orders").select("o_orderkey", F.round(S.parse_number(text), 2).alias("parsed"))


@query("p3_parse_positive", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive FROM customer")
def p3(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.parse_positive(F.col("c_acctbal").cast("string")).alias("positive"))


@query("p4_truthy", "SELECT event_id, w IN ('1','true','t','yes','y') AS yes, w IN ('0','false','f','no','n') AS no FROM (SELECT event_id, lower((['1','TRUE','no','F','maybe',''])[1 + event_id % 6]) AS w FROM events)")
def p4(spark, d):
    word = F.element_at(F.array(*[F.lit(x) for x in ("1", "TRUE", "no", "F", "maybe", "")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.is_truthy(word).alias("yes"), S.is_falsey(word).alias("no"))


@query("p5_state_code", "SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' WHEN 'UNITED STATES' THEN 'US' ELSE '' END AS code FROM nation")
def p5(spark, d):
    names = {"france": "FR", "germany": "DE", "united states": "US"}
    return table(spark, d, "nation").select("n_nationkey", S.state_code(F.col("n_name"), table=names).alias("code"))


@query("p6_clamp", "SELECT l_orderkey, l_linenumber, greatest(1.0::DOUBLE, least(10.0::DOUBLE, l_quantity / 4)) AS clamped FROM lineitem")
def p6(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.clamp(F.col("l_quantity") / 4).alias("clamped"))


@query("p7_fit_score", "SELECT p_partkey, round(greatest(1, least(10, 7 + (p_retailprice - m) / 50)), 9) AS fit FROM part JOIN (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1) USING (p_brand)")
def p7(spark, d):
    part = table(spark, d, "part")
    mean = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    return part.join(mean, "p_brand").select("p_partkey", F.round(S.fit_score(F.col("p_retailprice"), F.col("m"), 50), 9).alias("fit"))


@query("p8_band_for", "SELECT p_partkey, CASE WHEN p_retailprice <= 999.99 THEN 'under 1000' WHEN p_retailprice BETWEEN 1000 AND 1499.99 THEN '1000-1499' WHEN p_retailprice >= 1500 THEN '1500 and over' ELSE '' END AS price_band, CASE WHEN p_size <= 10 THEN '1-10' WHEN p_size <= 30 THEN '11-30' ELSE '31 and over' END AS size_band FROM part")
def p8(spark, d):
    return table(spark, d, "part").select("p_partkey", S.band_for(F.col("p_retailprice"), PRICE_BANDS).alias("price_band"), S.band_for(F.col("p_size").cast("double"), SIZE_BANDS, "integer").alias("size_band"))


@query("p9_band_midpoint", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 10.0::DOUBLE WHEN p_size <= 30 THEN 20.5 ELSE 33.0 END AS midpoint FROM part")
def p9(spark, d):
    band = S.band_for(F.col("p_size").cast("double"), SIZE_BANDS, "integer")
    return table(spark, d, "part").select("p_partkey", S.band_midpoint(band, SIZE_BANDS).alias("midpoint"))


@query("p10_labels", """SELECT l_orderkey, l_linenumber, CASE WHEN q < 10 THEN '<10%' WHEN q < 25 THEN '10-24.9%' WHEN q < 40 THEN '25-39.9%' WHEN q < 55 THEN '40-54.9%' WHEN q < 70 THEN '55-69.9%' ELSE '70%+' END AS rate,
 CASE WHEN q / 5 < 4 THEN 'Very High Risk' WHEN q / 5 < 5.5 THEN 'Reach' WHEN q / 5 < 7.5 THEN 'Target' ELSE 'Likely' END AS tier,
 CASE WHEN q / 5 < 5 THEN 'material concern' WHEN q / 5 < 6.5 THEN 'possible but weaker fit' WHEN q / 5 < 8 THEN 'near target' ELSE 'strong positive fit' END AS component FROM (SELECT *, l_quantity AS q FROM lineitem)""")
def p10(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.label_by_threshold(q, RATE_CUTS).alias("rate"), S.label_by_threshold(q / 5, TIER_CUTS, "Unscored").alias("tier"), S.label_by_threshold(q / 5, COMPONENT_CUTS).alias("component"))


@query("p11_render", "SELECT c_custkey, printf('%.1f', round_even(c_acctbal, 1)) AS fixed, CASE WHEN c_acctbal > 0 THEN '$' || format('{:,}', CAST(round_even(c_acctbal, 0) AS BIGINT)) ELSE '' END AS currency, printf('%.0f', round_even(c_acctbal, 0)) || '%' AS percent, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey // 2 AS VARCHAR) ELSE CAST(c_nationkey // 2 AS VARCHAR) || '.5' END AS trimmed FROM customer")
def p11(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", S.fmt(b, 1).alias("fixed"), S.fmt_currency(b).alias("currency"), S.fmt_percent(b).alias("percent"), S.fmt_trimmed(F.col("c_nationkey") / 2, 2).alias("trimmed"))


@query("p12_first_present", "SELECT event_id, coalesce(nullif(trim(props ->> '$.missing'), ''), nullif(trim(props ->> '$.k'), ''), event_type) AS first FROM events")
def p12(spark, d):
    j = lambda k: F.get_json_object("props", f"$.{k}")
    return table(spark, d, "events").select("event_id", S.first_present(j("missing"), j("k"), F.col("event_type")).alias("first"))


@query("p13_component_label", "SELECT event_type, upper(left(event_type, 1)) || lower(substr(event_type, 2)) || ' Fit' AS label, count(*) AS n FROM events GROUP BY 1, 2")
def p13(spark, d):
    name = F.concat(F.lit("admissions_"), F.col("event_type"), F.lit("_fit_score"))
    return table(spark, d, "events").groupBy("event_type", S.component_label(name).alias("label")).agg(F.count("*").alias("n"))


@query("p14_value_type", "SELECT page_id, 'url' AS a, 'number' AS b, 'text' AS c FROM pages")
def p14(spark, d):
    return table(spark, d, "pages").select("page_id", S.value_type(F.col("url")).alias("a"), S.value_type(F.concat(F.lit("$"), F.col("page_id"))).alias("b"), S.value_type(F.substring("html", 1, 20)).alias("c"))


@query("p15_split_numbers", "SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def p15(spark, d):
    cells = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("; ", F.collect_list(F.col("l_quantity").cast("string"))).alias("cell"))
    parts = S.split_numbers(F.concat(F.col("cell"), F.lit(" | n/a")))
    return cells.select("l_orderkey", F.size(parts).cast("long").alias("n"), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("p16_normalize_name", "SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), '\\b(the|of|at|and|for)\\b', ' ', 'g'), ' +', ' ', 'g')) AS normalized FROM part")
def p16(spark, d):
    return table(spark, d, "part").select("p_partkey", S.normalize_name(F.concat(F.lit("The "), F.col("p_name"), F.lit(" of"))).alias("normalized"))


@query("p17_tokens", "SELECT p_partkey, len(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: w NOT IN ('red', 'blue')))) AS n FROM part")
def p17(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(S.tokens(F.lower("p_name"), ("red", "blue"))).cast("long").alias("n"))


@query("p18_pair_scores", """SELECT a.n AS a, b.n AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) AS jaccard, 2.0 * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)) AS dice, len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) AS contained
FROM (SELECT DISTINCT p_name AS n, list_distinct(string_split(lower(p_name), ' ')) AS t, split_part(lower(p_name), ' ', 1) AS k FROM part) a JOIN (SELECT DISTINCT p_name AS n, list_distinct(string_split(lower(p_name), ' ')) AS t, split_part(lower(p_name), ' ', 1) AS k FROM part) b ON a.k = b.k AND a.n < b.n""")
def p18(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("n")).distinct().withColumn("t", S.tokens(F.lower("n"))).withColumn("k", F.split(F.lower("n"), " ")[0])
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.n") < F.col("b.n")))
    x, y = F.col("a.t"), F.col("b.t")
    return pairs.select(F.col("a.n").alias("a"), F.col("b.n").alias("b"), S.jaccard(x, y).alias("jaccard"), S.dice(x, y).alias("dice"), S.containment(x, y).alias("contained"))


@query("p18_sequence_ratio")
def p18r(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("n")).distinct().withColumn("k", F.split(F.lower("n"), " ")[0])
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.n") < F.col("b.n"))).select(F.col("a.n").alias("a"), F.col("b.n").alias("b"))
    return pairs.withColumn("ratio", X.seq_ratio("a", "b")).withColumn("score", X.pair_score(F.col("a"), F.col("b")))


@query("p19_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'part_' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || p_partkey AS key FROM part")
def p19(spark, d):
    return table(spark, d, "part").select("p_partkey", S.slugify(F.concat(F.col("p_name"), F.lit("!"))).alias("slug"), S.row_key(F.lit("part"), F.col("p_name"), F.col("p_partkey").cast("string")).alias("key"))


@query("p20_compact_all", """SELECT doc_id, trim(regexp_replace(translate(replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
 '\u2010\u2011\u2012\u2013\u2014\u2212\u00a0', '------ '), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS compact FROM documents""")
def p20a(spark, d):
    """p20 over the whole table, with the rows that have something to decode."""
    return table(spark, d, "documents").select("doc_id", S.compact_text(F.col("text")).alias("compact"))


@query("p21_html_title", "SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def p21(spark, d):
    return table(spark, d, "pages").select("page_id", S.html_title(F.col("html")).alias("title"))


@query("p21_html_lines", "SELECT page_id, (length(html) - length(replace(html, '<li>', ''))) // 4 AS n_links FROM pages")
def p21l(spark, d):
    lines = F.filter(S.html_to_lines(F.regexp_replace("html", "(?s)^.*<nav>|</nav>.*$", "")), lambda x: x != "")
    return table(spark, d, "pages").select("page_id", F.size(lines).cast("long").alias("n_links"))


@query("p21_html_all_lines")
def p21a(spark, d):
    """The lines of whole pages."""
    return table(spark, d, "pages").select("page_id", S.html_to_lines(F.col("html")).alias("lines"))


@query("p22_url_parts", """SELECT page_id, h AS host, regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AS domain, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path
FROM (SELECT page_id, url, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS h FROM pages)""")
def p22(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", S.url_host(u).alias("host"), S.url_domain(u).alias("domain"), S.url_origin(u).alias("origin"), S.url_path(u).alias("path"))


@query("p23_url_join", """SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/about' AS joined, 'https://' || regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS canonical, url AS decoded FROM pages""")
def p23(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", S.url_join(u, F.lit("/about")).alias("joined"), S.canonical_url(u).alias("canonical"), S.decode_target(F.base64(F.encode(u, "UTF-8"))).alias("decoded"))


@query("p24_number_in", "SELECT event_id, CASE WHEN CAST(props ->> '$.k' AS DOUBLE) BETWEEN 10 AND 60 THEN CAST(props ->> '$.k' AS DOUBLE) END AS bounded, CAST(props ->> '$.k' AS DOUBLE) AS labelled FROM events")
def p24(spark, d):
    return table(spark, d, "events").select("event_id", S.number_in(F.col("props"), 10, 60).alias("bounded"), S.labelled_number(F.col("props"), "k").alias("labelled"))


@query("p25_composite_cells", "SELECT p_brand, CAST(min(p_size) AS DOUBLE) AS low, CAST(max(p_size) AS DOUBLE) AS high, count(*) AS n, CAST(count(*) AS DOUBLE) AS percent FROM part GROUP BY 1")
def p25(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"), F.count("*").alias("c"))
    cell = S.parse_median_range(F.format_string("%d (%d - %d) n=%d", "a", "a", "b", "c"))
    share = S.parse_percent(F.format_string("%d%% (n=%d)", "c", "c"))
    return g.select("p_brand", cell["low"].alias("low"), cell["high"].alias("high"), share["n"].alias("n"), share["value"].alias("percent"))


@query("p26_currency", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS amount, round(l_extendedprice, 2) + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_quantity END AS total, l_linenumber % 2 = 0 AND l_linenumber % 3 = 0 AS absent FROM lineitem")
def p26(spark, d):
    amount = S.parse_currency(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
    odd, third = F.col("l_linenumber") % 2 != 0, F.col("l_linenumber") % 3 != 0
    both = S.add_optional(F.when(odd, 1.0), F.when(third, 1.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(amount, 2).alias("amount"), S.add_optional(F.round(amount, 2), F.when(odd, F.col("l_quantity"))).alias("total"), both.isNull().alias("absent"))


@query("p27_location", "SELECT c_custkey, c_mktsegment AS city, substr(upper(n_name), 1, 2) AS state, r_name AS region, '2024-2025' AS year FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def p27(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = S.parse_location(F.concat("c_mktsegment", F.lit(", "), F.upper(F.substring("n_name", 1, 2)), F.lit(" 1")))
    return rows.select("c_custkey", place["city"].alias("city"), place["state"].alias("state"), F.col("r_name").alias("region"), S.academic_year(F.lit("entering 2024-25")).alias("year"))


@query("p29_search_text", "SELECT p_partkey, contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand') AS found, md5(lower(p_name || ' ' || p_brand)) AS fingerprint FROM part")
def p29(spark, d):
    return table(spark, d, "part").select("p_partkey", S.search_text(F.col("p_name"), F.col("p_brand"), F.col("p_type")).contains("brand").alias("found"), F.md5(S.search_text(F.col("p_name"), F.col("p_brand"))).alias("fingerprint"))


@query("p30_range_notes", "SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_discount > 0.07 THEN 'discount high' END, CASE WHEN l_tax > 0.06 THEN 'tax high' END) AS notes FROM lineitem")
def p30(spark, d):
    rules = [(F.col("l_discount") > 0.07, "discount high"), (F.col("l_tax") > 0.06, "tax high")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.range_notes(rules).alias("notes"))


@query("p31_infer_cell", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' WHEN 2 THEN 'text' ELSE 'number' END AS kind, CASE WHEN event_id % 4 = 1 THEN CAST(props ->> '$.k' AS BIGINT) END AS whole, CASE WHEN event_id % 4 = 2 THEN '0' || (10 + CAST(props ->> '$.k' AS BIGINT)) END AS txt FROM events")
def p31(spark, d):
    k = F.get_json_object("props", "$.k")
    cell = F.when(F.col("event_id") % 4 == 0, "TRUE").when(F.col("event_id") % 4 == 1, k).when(F.col("event_id") % 4 == 2, F.concat(F.lit("0"), (k.cast("long") + 10).cast("string"))).otherwise(F.concat(k, F.lit(".5")))
    c = S.infer_cell(cell)
    return table(spark, d, "events").select("event_id", c["kind"].alias("kind"), c["whole"].alias("whole"), c["text"].alias("txt"))
