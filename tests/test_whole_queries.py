"""Queries over whole tables, on planted rows that a smaller job leaves out."""

import re
from html import unescape

import compare
from pyspark.sql import functions as F

from scoreframe.plans import catalog
from scoreframe.plans import chain_queries as C
from scoreframe.plans import integration_queries as Q


def planted(spark, path, rows, columns, name):
    """The rows as the table ``name`` of an input folder, and a DuckDB view of it."""
    import duckdb

    spark.createDataFrame(rows, columns).write.parquet(f"{path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    return con


def test_compact_text_decodes_entities_on_every_row(spark, tmp_path):
    texts = ["a &lt;b&gt; &amp;amp; &quot;c&quot;", "&#39;d&#39;&nbsp;\u2014 e\u00a0\u2212", None, "plain \n\t text", "AT&T", ""]
    con = planted(spark, tmp_path, list(enumerate(texts)), "doc_id long, text string", "documents")
    df = catalog.QUERIES["p20_compact_all"](spark, str(tmp_path))
    assert {r["doc_id"]: r["compact"] for r in df.collect()} == {0: 'a <b> &amp; "c"', 1: "'d' - e -", 2: "", 3: "plain text", 4: "AT&T", 5: ""}
    assert compare.difference(df, con, catalog.SQL["p20_compact_all"]) == ""


def test_overlaps_of_every_line_item(spark, tmp_path):
    lines = [(1, 1, 7, 3, 4.0), (1, 2, 7, 3, 17.0), (1, 2, 8, 3, 33.0), (2, 3, 7, 4, 50.0)]
    planted(spark, tmp_path, lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double", "lineitem")
    planted(spark, tmp_path, [(3,), (4,)], "s_suppkey long", "supplier")
    got = {(r["page"], r["cell"]): (r["row_id"], r["overlap"]) for r in catalog.QUERIES["j14_overlap_all"](spark, str(tmp_path)).collect()}
    assert got == {(3, "1|1|7|4"): (0, 2.0), (3, "1|2|7|17"): (2, 3.0), (3, "1|2|8|33"): (4, 3.0), (4, "2|3|7|50"): (6, 3.0)}


def test_sets_of_events_of_any_value(spark, tmp_path):
    rows = [(1, "purchase", 5.0), (1, "click", 90.0), (2, "purchase", 60.0), (3, "click", None), (4, "view", 70.0)]
    con = planted(spark, tmp_path, rows, "user_id long, event_type string, value double", "events")
    df = catalog.QUERIES["u5_set_ops_all"](spark, str(tmp_path))
    assert {r["user_id"]: r["side"] for r in df.collect()} == {1: "both", 2: "a", 3: "b"}
    assert compare.difference(df, con, catalog.SQL["u5_set_ops_all"]) == ""


def lines_by_brute_force(page):
    text = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ", page)
    text = re.sub(r"(?i)<br\s*/?>|</(?:h[1-6]|p|div|li|tr|td|title|ul|table)>", "\n", text)
    found = [" ".join(unescape(x).translate(dict.fromkeys(map(ord, "‐‑‒–—−"), "-")).split()) for x in re.sub(r"<[^>]+>", " ", text).split("\n")]
    return [x for x in found if x]


def test_lines_of_whole_pages(spark, sf_dir):
    from scoreframe.plans.registry import table

    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").select("page_id", "html").collect()}
    got = {r["page_id"]: list(r["lines"]) for r in catalog.QUERIES["p21_html_all_lines"](spark, sf_dir).collect()}
    assert got == {k: lines_by_brute_force(v) for k, v in pages.items()}
    assert max(map(len, got.values())) > 8


def test_ranking_step_is_shared_by_all_cores(spark, tmp_path):
    """A projection of few bytes lies in one file, but ranking it is much work."""
    d = "/root/testdata/sf0.001"
    path = str(tmp_path / "projection")
    Q.d1(spark, d).withColumn("debt_burden_score", F.col("attendance_cost_score")).coalesce(1).write.parquet(path)
    ranking = dict((name, step) for name, step, _ in C.steps(spark, d, str(tmp_path)))["ranking"]
    ranked = ranking({"projection": spark.read.parquet(path)})["rankings"]
    assert ranked.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 2
    plan = Q._stats(spark, d)["candidates"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1  # with the clusters; a row's match is its own
