"""Decontamination against a plain search, short items, both ways of sending the benchmark, awkward rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scoreframe.llm import decontam as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain(docs, items, window=13, share=0.8, least=5):
    """Pairs with any alignment that passes, whether or not a seed hits it."""
    found = set()
    for d, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for i, item in items:
            t = re.findall(r"\w+", (item or "").lower())
            if len(t) < least:
                continue
            width = min(window, len(t))
            for at in range(-len(t) + 1, len(words)):
                same = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(t)]
                lo, hi = max(0, -at), min(len(t), len(words) - at)
                if hi - lo >= width and max(sum(same[k : k + width]) for k in range(lo, hi - width + 1)) >= share * width:
                    found.add((d, i))
                    break
    return found


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 6, 7, 8, 8, 9, 10, 13, 20, 40, 63])]
    docs = []
    for d in range(60):
        parts = [word() for _ in range(rng.randint(0, 60))]
        for _, item in rng.sample(items, rng.randint(0, 2)):
            t = item.split()
            if rng.random() < 0.7 and len(t) > 4:
                t[rng.randrange(len(t))] = "other"
            at = rng.randint(0, len(parts))
            parts[at:at] = t
        docs.append((d, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("block_chars", [D.BLOCK_CHARS, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_single_substitutions_equal_a_plain_search(spark, seed, block_chars):
    docs, items = corpus(seed)
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = D.overlaps(df, bench, block_chars=block_chars).collect()
    want = plain(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert {r["doc_id"] for r in D.clean(df, bench, block_chars=block_chars).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_both_ways_give_the_same_rows(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole, joined = (sorted(map(tuple, D.overlaps(docs, bench, block_chars=n).collect())) for n in (D.BLOCK_CHARS, 100))
    assert whole == joined and whole
    kept, again = (sorted(r["doc_id"] for r in D.clean(docs, bench, block_chars=n).collect()) for n in (D.BLOCK_CHARS, 100))
    assert kept == again and set(kept) == {r["doc_id"] for r in docs.collect()} - {r[0] for r in whole}


@pytest.mark.parametrize("block_chars", [D.BLOCK_CHARS, 0])
def test_awkward_rows(spark, block_chars):
    passage = " ".join(f"Tokén{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "\n"), (None, passage), (5, passage), (5, passage), (6, "w " * 300_000 + passage), (7, "quite another text")]
    docs = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(i).alias(c) for i, c in enumerate(("item_id", "key", "h", "shared", "t", "row", "n_matched"))))
    bench = spark.createDataFrame([(1, passage), (2, passage), (3, None), (4, ""), (None, "one two three")], ITEMS)
    got = D.overlaps(docs, bench, block_chars=block_chars).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == sorted((d, i) for d in (0, 5, 5, 6) for i in (1, 2))
    left = D.clean(docs, bench, block_chars=block_chars)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 7]
    assert D.overlaps(docs.limit(0), bench, block_chars=block_chars).count() == 0
    assert D.overlaps(docs, bench.limit(0), block_chars=-1).count() == 0 and D.clean(docs, bench.limit(0), block_chars=-1).count() == 8


def test_combining_marks_count_alike_in_both_ways(spark):
    marked = "éab éac éad éaf"
    items = [(7, marked), (8, "İstanbul İzmir İznik"), (9, "one two three four five six")]
    docs = [(1, f"before {marked} after"), (2, "İstanbul İzmir İznik"), (3, "one two three four five six"), (4, "e ab")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    small, large = (sorted(tuple(r) for r in D.overlaps(d, i, block_chars=n).collect()) for n in (D.BLOCK_CHARS, 0))
    assert small == large and {r[:2] for r in small} == plain(docs, items) >= {(1, 7), (3, 9)}
