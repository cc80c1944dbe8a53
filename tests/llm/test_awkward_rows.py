"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names: chat formatting,
quality, HTML extraction and near duplicates. The other operators have theirs in their own test files."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from scoreframe.llm import chat, html_extract, hyperminhash, quality

DOCS = "doc_id long, text string"
LONG = "several plain words, and more of them. " * 20_000
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "one text"), (5, "one text"), (6, "one text"), (7, "one other text"), (7, "quite different words here"), (None, "one text"), (None, None)]


def with_clashes(df, names):
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


def test_quality(spark):
    docs = with_clashes(spark.createDataFrame(ROWS, DOCS), ("y", "t", "w", "n_words", "score", "predicted", "_row", "quality"))
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 0), (1, None), (None, 1), (8, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (5, 6)}) == 1
    kept = quality.keep_good(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.train(docs.limit(0), labels).rules == [] and quality.train(docs, labels.limit(0)).rules == []
    assert quality.train(spark.createDataFrame([(4, f"text {i}") for i in range(50)], DOCS), labels, max_rows=10).fitted_rows <= 10


def test_quality_ties_get_one_score(spark):
    docs = spark.createDataFrame([(i, "good words in a row, and some more" if i % 2 else "!!!! ????") for i in range(1, 200)], DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len({r["score"] for r in got}) == 2 and all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, None, None, "tie"), (None, 0, "assistant", "</s>"), (None, 0, "assistant", "again"), (3, 0, "assistant", LONG), (4, 0, "", "")]
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ("ids", "mask", "pos", "p", "n_turns"))
    turns = chat.format_turns(df)
    out = {r["conv_id"]: r for r in chat.digests(turns).collect()}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 4, None: 2, 3: 1, 4: 1}
    assert out[3]["loss_chars"] == len(LONG) and out[3]["loss_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert out[None]["loss_chars"] == len("</s>again") and out[4]["loss_chars"] == 0
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0
    whole = {r["conv_id"]: len(r["ids"]) for r in chat.assemble(turns).collect()}
    last = {r["conv_id"]: r["end"] for r in chat.with_offsets(turns).groupBy("conv_id").agg(F.max(F.col("pos") + F.size("ids")).alias("end")).collect()}
    assert whole == last


@pytest.mark.parametrize("broken", ["<a " * 60_000, '<a b="' * 40_000, "<li><ul>" + "<i>" * 20_000 + "<li></li>" * 20_000, "<p><td>" + "<div>" * 50_000, "<script>" * 50_000, "<!--" * 50_000, "<" * 200_000, "&" * 200_000])
def test_broken_pages_take_linear_time(broken):
    began = time.time()
    html_extract.extract(f"<html><body><p>{broken}")
    assert time.time() - began < 10


def test_pages(spark):
    body = "<p>" + "Words of an article, with commas, and more. " * 5 + "</p>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "  "), (4, None, f"<body><div class='content widget-area'>{body}</div><div><p>Short</p></div>"), (5, "u", body * 3_000), (6, "u", body), (6, "u", body), (None, "u", "plain &amp; simple")]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"), ("id", "text", "n_chars"))
    got = html_extract.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = [(r["page_id"], r["text"]) for r in got.collect()]
    assert len(texts) == len(rows) and all(t is not None for _, t in texts)
    by_id = dict(texts)
    assert by_id[1] == by_id[2] == by_id[3] == "" and by_id[None] == "plain & simple" and by_id[4].startswith("Words of an article")
    assert len(by_id[5].split("\n")) == 3_000 and got.filter("n_chars <> length(text)").count() == 0
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_marked_words_inside_an_article():
    body = "".join(f"<p{' class=side-note' if i == 2 else ''}>Paragraph {i}, with enough words, commas, and sense to count as prose.</p>" for i in range(5))
    assert html_extract.extract(f"<body><article>{body}</article>").count("\n") == 4
    assert "Cookies" not in html_extract.extract(f"<body><article>{body}</article><div class='cookie-banner'><p>Cookies, and more cookies, and more.</p></div>")


def test_near_duplicates(spark):
    docs = with_clashes(spark.createDataFrame(ROWS, DOCS), ("a", "b", "n", "key", "rep", "component", "low", "high"))
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(docs, n_words=2).collect()), key=str)
    assert got == sorted([(0, 0, None, True), (0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 7, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 2, 7, True)], key=str)
    assert hyperminhash.near_duplicates(docs.limit(0)).count() == 0
    for wrong in ({"percent": 0}, {"percent": 101}, {"n_words": 0}):
        with pytest.raises(ValueError):
            hyperminhash.near_duplicates(docs, **wrong)


def test_near_duplicates_at_low_similarity(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 10 : i * 10 + 200])) for i in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, DOCS), n_words=1, percent=50).collect()}
    assert set(got.values()) == {0}
