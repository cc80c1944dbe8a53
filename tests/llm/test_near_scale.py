"""Near duplicates: chance pairs of short texts, recall against all rows, and tables left behind."""

import os
import random

import numpy as np

from scoreframe.llm import hyperminhash as H
from scoreframe.llm.common import shared_dir


def test_short_unlike_sets_share_no_band():
    rng, n, size = np.random.default_rng(1), 20_000, 5
    hashes = rng.integers(0, 1 << 63, n * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rows, bands = H.banding(80)
    keys = H.band_keys(hashes, np.repeat(np.arange(n), size), n, rows, bands).ravel()
    _, times = np.unique(keys[keys != 0], return_counts=True)
    assert (times * (times - 1) // 2).sum() < 100


def test_recall_of_ids_divisible_by_20(spark, sf_dir):
    """Every link of such a document with any other is inside one component."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(H.shingle_hashes((r.text or "").encode(), 2).tolist()) for r in docs.collect()}
    component = {r.doc_id: r.component_id for r in H.near_duplicates(docs, n_words=2, percent=80).collect()}
    links = 0
    for a in (x for x in sets if x % 20 == 0):
        for b, other in sets.items():
            common = len(sets[a] & other) if a != b and min(len(sets[a]), len(other)) * 100 >= 80 * max(len(sets[a]), len(other)) else 0
            if common and 100 * common >= 80 * (len(sets[a]) + len(other) - common):
                links += 1
                assert component[a] == component[b]
    assert links


def test_stored_tables_are_deleted(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choices("abcdefghijklmnop", k=40)) for _ in range(30)]
    rows = [(i, base[i % 30] if i % 3 else base[i % 30].replace("a", "b", 1)) for i in range(200)]
    at = f"{shared_dir(spark).removeprefix('file://')}/scoreframe"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    assert H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n_words=2).count() == 200
    assert sorted(x.split("-")[0] for x in set(os.listdir(at)) - before) == ["components", "members"]


def test_groups_that_stay_apart_are_compared_in_blocks(spark, monkeypatch):
    """Texts near one another but mostly below the threshold share bands; links among them are those of brute force."""
    rng, passed = random.Random(6), []
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(60), rng.choice([2, 4, 6])):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    kept = H._confirm_blocks
    monkeypatch.setattr(H, "_confirm_blocks", lambda *a: passed.append(1) or kept(*a))
    monkeypatch.setattr(H, "BLOCK", 32)
    got = {r.doc_id: r.component_id for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n_words=2).collect()}
    sets = {i: set(H.shingle_hashes(t.encode(), 2).tolist()) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label and len(set(label.values())) > 20 and passed
