"""Collocations against a plain count of all n-grams, and awkward rows."""

import random
import re
from collections import Counter

from scoreframe.llm import collocations as C

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=4, first=2000, share=80):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                count.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    held = {x: a for x, a in count.items() if len(x[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in held.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside.get((lang, p[i : i + k]), 0), a)
    out = {}
    for (lang, p), a in held.items():
        if 100 * inside.get((lang, p), 0) >= share * a and (lang, p) in inside:
            continue
        cuts = [(2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:first]))


def found(spark, rows, **kw):
    df = spark.createDataFrame([(t, g, 1, "y") for t, g in rows], "text string, lang string, f int, phrase string").repartition(4)
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


def test_awkward_rows(spark):
    rows = [
        ("New York city. new  york\tcity, NEW YORK CITY", "en"), ("the new york city", "en"), (None, "en"), ("", None), (" \t ", "en"), ("...;;", "xx"), ("a a a a a a", "en"), ("É é É é\x0bÉ é", "fr"),
        ("new york", None), ("new york", "und"), ("a b\nc d a b\r\nc d", None), ("ü" * 50_000 + " b " * 9, "de"), ("x y z w " * 40, "en"), ("x y", "en"), ("x y", "en"), ("İ i̇ İ i̇", "tr"),
    ]
    for kw in ({"least": 2}, {"least": 1}, {"least": 3, "first": 2}, {"least": 2, "longest": 3}, {"least": 2, "longest": 2, "share": 10}):
        want = plain(rows, **kw)
        assert want and found(spark, rows, **kw) == want, kw
    assert found(spark, [], least=1) == []


def test_random_words(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcdE") + rng.choice([" ", " ", "  ", ". ", "\n"]) for _ in range(rng.randrange(200))), rng.choice(["en", "de", None])) for _ in range(60)]
    for bits in (C.BITS, 7):  # a crowded bitmap changes nothing
        kept, C.BITS = C.BITS, bits
        try:
            assert found(spark, rows, least=12) == plain(rows, 12)
        finally:
            C.BITS = kept


def test_query(spark, sf_dir):
    import compare

    from scoreframe.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").collect()]
    df = QUERIES["op13_collocations"](spark, sf_dir)
    assert sorted(tuple(r) for r in df.collect()) == plain(rows, 30)
    assert compare.difference(df, compare.duck(sf_dir), C.SQL) == ""


def test_windows_end_where_no_phrase_is_frequent(spark):
    rng = random.Random(11)
    rows = [(" ".join(rng.choice("abcdefghijkl") for _ in range(1500)), "en") for _ in range(4)]
    df = spark.createDataFrame([(t.encode(), g.encode()) for t, g in rows], "t binary, lang binary").coalesce(1)
    kept, C.CHUNK = C.CHUNK, 1000  # many chunks in the one task
    try:
        held = [tuple(r) for r in C.windows(df, 22, 4).collect()]
    finally:
        C.CHUNK = kept
    assert held and all(r[4] == "" for r in held)  # pairs reach the floor, triples don't
    assert len(held) == len({r[:-1] for r in held}) <= 12 * 12 + 12 + 1  # each once
    assert sum(r[-1] for r in held) == 6000
    for n in ("ROWS", "WORDS"):  # tasks that start anew change nothing
        kept = getattr(C, n)
        setattr(C, n, 8)
        try:
            assert found(spark, rows, least=4) == plain(rows, 4)
        finally:
            setattr(C, n, kept)
