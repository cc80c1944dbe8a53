"""Suffix-array dedup against brute force: long texts, frequent anchors, split blocks, null and repeated ids."""

import hashlib
import random
import re

import pytest

from scoreframe.llm import suffix_dedup as S

DOCS = "doc_id long, text string"


def by_brute_force(rows, least):
    """rows: (id, text) in their order, each a document of its own."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            gram = data[i : i + least]
            if gram in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(gram)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((-1 if key is None else key, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removed(df, least=100):
    rows = S.remove_repeats(df, least=least).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows)


def corpus(n, seed=7):
    """Documents of common lines of 60 to 300 bytes between words of their own, some of them copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 7)))
    lines = [" ".join(word() for _ in range(k)) for k in (12, 14, 16, 18, 20, 25, 60)]
    rows = []
    for key in range(n):
        parts = [rng.choice(lines) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 9))]
        rows.append((key, rng.choice(rows)[1] if rows and rng.random() < 0.2 else " ".join(parts)))
    return rows


@pytest.mark.parametrize("patched", [{}, {"FREQUENT": 2, "SAMPLE": 1}, {"BLOCK": 2000}, {"BLOCK": 300, "SEEN": 3, "COMBINE": 50}, {"FREQUENT": 2, "SAMPLE": 1, "BLOCK": 100, "COMBINE": 1}])
def test_equals_brute_force(spark, monkeypatch, patched):
    for name, value in patched.items():
        monkeypatch.setattr(S, name, value)
    rows = corpus(300)
    assert removed(spark.createDataFrame(rows, DOCS).repartition(5)) == by_brute_force(rows, 100)


@pytest.mark.parametrize("least", [34, 77, 256])
def test_other_lengths(spark, least):
    rows = corpus(200, seed=least)
    assert removed(spark.createDataFrame(rows, DOCS), least) == by_brute_force(rows, least)


def test_lengths_that_cannot_be_packed(spark):
    for least in (33, 257):
        with pytest.raises(ValueError):
            S.remove_repeats(spark.createDataFrame([(1, "a")], DOCS), least=least)


def test_text_beyond_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1 << 16)
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefghij ", k=200_000))
    rows = [(1, long), (2, "head " + long[65_400:65_700] + " tail"), (3, long[:70_000]), (4, "x" * 70_000)]
    assert removed(spark.createDataFrame(rows, DOCS)) == by_brute_force(rows, 100)


def test_five_megabytes(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=5_000_000))
    cut = S.CHUNK - 50
    got = removed(spark.createDataFrame([(1, long), (2, "<" * 30 + long[cut : cut + 300] + ">" * 30)], DOCS))
    assert [r[:4] for r in got] == [(1, 5_000_000, 0, 0), (2, 360, 300, 1)]


def test_null_and_repeated_ids(spark):
    rng = random.Random(3)
    a, b, c = ("".join(rng.choices("abcdefghij ", k=229)) for _ in range(3))
    got = removed(spark.createDataFrame([(1, a), (2, a), (2, c), (3, c), (None, b), (None, None), (4, b), (5, "y" * 40)], DOCS))
    gone = [(r[0], r[1], r[2]) for r in got]
    assert gone == [(-1, 0, 0), (-1, 229, 0), (1, 229, 0), (2, 229, 0), (2, 229, 229), (3, 229, 229), (4, 229, 229), (5, 40, 0)]


def test_ids_beyond_a_double_and_ids_that_are_words(spark):
    rng = random.Random(4)
    a = "".join(rng.choices("abcdefghij ", k=150))
    big = 2**60
    assert [r[:3] for r in removed(spark.createDataFrame([(big + 1, a), (big, a), (big + 2, None)], DOCS))] == [(big, 150, 0), (big + 1, 150, 150), (big + 2, 0, 0)]
    words = S.remove_repeats(spark.createDataFrame([("b", a), ("a", a)], "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in words} == {"a": 0, "b": 150}


def test_cut_texts_keeps_columns_and_rows(spark):
    rng = random.Random(5)
    a = "".join(rng.choices("abcdefghijé ", k=300))
    df = spark.createDataFrame([(1, a, 300, "s"), (2, a, 300, "s"), (3, "b" + a[:150] + "ö", 152, None), (4, None, None, "s")], "doc_id long, text string, n_chars long, found string")
    got = {r["doc_id"]: r for r in S.cut_texts(df).collect()}
    assert set(got) == {1, 3, 4} and got[1]["text"] == a and got[4]["text"] in (None, "")
    assert got[3]["text"] == "bö" and got[3]["n_chars"] == 2 and got[3]["found"] is None
    assert S.cut_texts(df.limit(0)).count() == 0
