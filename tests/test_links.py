"""Link harvest on the ways to write an attribute."""

from scoreframe.operators import workflow as W


def test_links_in_any_quotes(spark):
    page = """<a href="/a">A</a><a href='/b'>B</a><a href=/c>C</a><A HREF = "/d?x='1'">D</A><a href="/a">A</a><a data-href="/e">E</a><a href="">F</a>"""
    rows = W.harvest_links(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"), "page_id", "html").collect()
    assert {(r["page_id"], r["href"]): r["n"] for r in rows} == {(1, "/a"): 2, (1, "/b"): 1, (1, "/c"): 1, (1, "/d?x='1'"): 1}
