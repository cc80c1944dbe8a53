"""Lexical search against scoring every document, bounds that are never too low, and awkward rows."""

import math
import random
from collections import Counter

import numpy as np

from scoreframe.llm import lexical_search as L


def counts(text):
    out, word = Counter(), ""
    for c in [*(text or ""), " "]:
        if ord(c) > 127 or c.isascii() and c.isalnum():
            word += c.lower() if c.isascii() else c
        elif word:
            out[word] += 1
            word = ""
    return out


def plain(docs, queries, k=10):
    held = [(d, counts(t)) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in {q for q, _ in queries}:
        terms = {t for q, text in queries if q == item for t in counts(text)}
        scored = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(spark, docs, queries, **kw):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item int, score long").repartition(4)
    q = spark.createDataFrame([(*r, "z") for r in queries], "item_id string, text string, term string")
    return sorted((tuple(r) for r in L.search(d, q, **kw).collect()), key=repr)


def random_docs(rng, n):
    words = [f"w{i}" for i in range(400)] + ["É", "naïve", "é", "K", "7"]
    return [(i, " ".join(rng.choice(words[: rng.choice([5, 50, 405])]).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(int(rng.paretovariate(0.8)) % 3000))) for i in range(n)]


def test_awkward_rows(spark):
    docs = [(1, "a b c"), (2, "A-b;C"), (2, "A-b;C"), (3, None), (4, ""), (5, "?!"), (None, "a b c"), (6, "a " * 5000 + "b"), (7, "É é É"), (8, "b " * 33 + "x" * 9000), (9, "0 a1"), (10, "K"), (2, "a")]
    queries = [("p", "a B b"), ("q", None), ("r", "nothing known"), ("s", "é k"), ("t", "É a1 0"), ("p", "c x"), ("u", "?")]
    for k in (1, 2, 10):
        assert found(spark, docs, queries, k=k) == plain(docs, queries, k)
    assert found(spark, [], queries) == [] and found(spark, docs, []) == []


def test_random_documents(spark):
    rng = random.Random(5)
    docs = random_docs(rng, 300)
    queries = [(f"q{i}", " ".join(rng.choice(docs)[1].split()[:30])) for i in range(25)]
    want = plain(docs, queries)
    assert found(spark, docs, queries) == want
    kept, L.TERMS = L.TERMS, 40  # many blocks of queries
    try:
        assert found(spark, docs, queries) == want
    finally:
        L.TERMS = kept


def test_bounds_are_never_too_low(spark):
    rng = random.Random(7)
    docs = random_docs(rng, 200)
    blocks = [r.asDict() for r in L.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()]
    held = {d: counts(t) for d, t in docs}
    assert sorted(d for b in blocks for d in b["ids"]) == sorted(d for d, c in held.items() if c)
    terms = [f"w{i}" for i in range(40)] + ["é"]
    hashes, uses = [L._hashes(terms, j) for j in range(L.LEVELS)], [[(k % 7, 1000 + k)] for k in range(len(terms))]
    n_docs, total = sum(bool(c) for c in held.values()), sum(sum(c.values()) for c in held.values())
    loose, exact = 0, 0
    for b in blocks:
        bounds = L._bounds(b, hashes, uses, 7, total, n_docs)
        for d, doc in enumerate(b["ids"]):
            m = 10 + 90 * sum(held[doc].values()) * n_docs // total
            score = np.zeros(7, np.int64)
            for k, t in enumerate(terms):
                if held[doc][t]:
                    score[k % 7] += (1000 + k) * (1000000000 * held[doc][t] // (1000 * held[doc][t] + 8 * m))
            assert (bounds[:, d] >= score).all()
            loose, exact = loose + int(bounds[:, d].sum()), exact + int(score.sum())
    assert loose < 1.3 * exact


def test_only_asked_terms_are_counted(spark):
    docs = spark.createDataFrame([(1, "A a É é İ \u212a K x"), (2, "k É y"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([("p", "a K é \u212a"), ("q", "İ É none")], "item_id string, text string")
    blocks = L.index(docs)
    few = L.weighted_queries(docs, blocks, queries, "item_id", "text")
    kept, L.TERMS = L.TERMS, 3
    try:
        many = L.weighted_queries(docs, blocks, queries, "item_id", "text")
    finally:
        L.TERMS = kept
    plans = [x[0]._jdf.queryExecution().toString() for x in (few, many)]
    assert "LeftSemi" in plans[0] and "LeftSemi" not in plans[1]
    w = {1: math.floor(1000 * math.log(6 / 3)), 2: math.floor(1000 * math.log(6 / 5))}
    for out, n_docs, total in (few, many):
        assert (n_docs, total) == (2, 11)
        got = {(r["item"], t["term"]): t["w"] for r in out.collect() for t in r["terms"]}
        assert got == {("p", "a"): w[1], ("p", "k"): w[2], ("p", "é"): w[1], ("p", "\u212a"): w[1], ("q", "İ"): w[1], ("q", "É"): w[2]}


def test_query(spark, sf_dir):
    import compare

    from scoreframe.llm.queries import QUERIES

    assert compare.difference(QUERIES["op12_bloom_search"](spark, sf_dir), compare.duck(sf_dir), L.SQL) == ""
