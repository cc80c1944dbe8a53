"""Entity matching against brute force, with names that share no token and rows without a block or place."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scoreframe.operators import joins as J
from scoreframe.plans import catalog
from scoreframe.plans.registry import table


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def name_score(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    return max(ratio(a, b), ratio(" ".join(sorted(x)), " ".join(sorted(y))), len(x & y) / len(x | y))


def by_brute_force(source, master):
    """source, master: (id, block, name); names are normal already."""
    out = {}
    for key, block, name in source:
        found = sorted((-name_score(name, n), i, n) for i, b, n in master if not block or b == block)
        top, second = (found + [(0.0, None, None)] * 2)[:2]
        a, b = -top[0], -second[0]
        label = "no_match" if a < 0.75 else "exact" if top[2] == name and b < 1 else "high_confidence" if a >= 0.92 and a - b >= 0.03 else "review"
        out[key] = (top[1], second[1], pytest.approx(a), pytest.approx(b), label)
    return out


def got(df):
    return {r[0]: (r["best"], r["second"], r["best_score"] or 0.0, r["second_score"] or 0.0, r["label"]) for r in df.collect()}


MASTER = [(1, "NY", "hofstra"), (2, "NY", "cornell"), (3, "CA", "stanford"), (4, "CA", "western pacific"), (5, "CA", "pacific western"), (6, None, "albany"), (7, "TX", "baylor"), (8, "TX", "baylor")]
SOURCE = [(1, "NY", "hoffstra"), (2, "", "stanfford"), (3, None, "cornell"), (4, "CA", "western pacific"), (5, "CA", "westernpacific"), (6, "WY", "baylor"), (7, None, "albanny"), (8, "TX", "baylor"), (9, "NY", "quite another")]


def test_entities_without_common_token_or_block(spark):
    make = lambda rows, key: spark.createDataFrame(rows, f"{key} int, state string, name string")
    found = got(J.match_entities(make(SOURCE, "source_id"), make(MASTER, "master_id"), "source_id", "master_id", "name", ["state"]))
    assert found == by_brute_force(SOURCE, MASTER)
    assert found[1][0] == 1 and found[1][4] == "high_confidence" and found[3][4] == "exact" and found[6][0] is None


def test_entities_with_two_blocks(spark):
    rows = [(1, "NY", "MD", "hofstra"), (2, "NY", "DO", "hofstra"), (3, "CA", "DO", "touro")]
    m = spark.createDataFrame(rows, "master_id int, state string, degree string, name string")
    s = spark.createDataFrame([(1, "NY", "", "hoffstra"), (2, None, "DO", "hofstra"), (3, "", None, "tourro"), (4, "CA", "MD", "touro")], "source_id int, state string, degree string, name string")
    found = got(J.match_entities(s, m, "source_id", "master_id", "name", ["state", "degree"]))
    assert {k: v[:2] for k, v in found.items()} == {1: (1, 2), 2: (2, 3), 3: (3, 1), 4: (None, None)}


def test_misspelt_query_equals_brute_force(spark, sf_dir):
    master = [(f"{r[0]}|{r[1]}", r[0], r[1].lower()) for r in table(spark, sf_dir, "part").select("p_brand", "p_name").distinct().collect()]
    k, part = F.crc32("id"), spark.createDataFrame([(m[0], *m[0].split("|")) for m in master], "id string, brand string, name string")
    name = F.when(k % 2 == 0, F.regexp_replace("name", "^(..)(.)", "$1$2$2")).otherwise(F.regexp_replace("name", " ", ""))
    rows = part.select("id", F.when((k % 3 == 0) | (k % 7 == 0), "").otherwise(F.col("brand")), F.lower(name)).collect()
    assert got(catalog.QUERIES["j7_match_misspelt"](spark, sf_dir)) == by_brute_force([tuple(r) for r in rows], master)


def test_geo_scores_every_row_of_the_state(spark):
    s = spark.createDataFrame([(1, "hoffstra", "NY"), (2, "hofstra", None)], "source_id int, name string, state string")
    m = spark.createDataFrame([(1, "hofstra", "NY", "hempstead"), (2, "cornell", "NY", "ithaca"), (3, "hofstra", "CA", "")], "master_id int, name string, state string, city string")
    found = {r["source_id"]: (r["best"], r["second"]) for r in J.match_with_geo(s, m, "source_id", "master_id", "name", "state", "city").collect()}
    assert found == {1: (1, 2), 2: (None, None)}


def test_profiles_follow_place_alias_and_fallback(spark):
    master = [(1, "hofstra", "hu", "NY", "Hempstead"), (2, "touro", "tu", "CA", "Vallejo"), (3, "touro", "tu nevada", "NV", "Henderson")]
    m = spark.createDataFrame(master, "master_id int, name string, alias string, state string, city string")
    source = [(1, "hoffstra", "NY", None), (2, "touro", None, None), (3, "touro tu nevada", None, ""), (4, "hofstra", "WY", "Hempstead"), (5, "hoffstra", "ca", "x")]
    s = spark.createDataFrame(source, "source_id int, name string, state string, city string")
    found = {r["source_id"]: r for r in J.match_profiles(s, m, "source_id", "master_id", "name", ["name"], "state", "city", ["alias"]).collect()}
    want = {}
    for key, name, state, city in source:
        inside = [x for x in master if state and x[3] == state.upper()] or master
        scored = []
        for i, n, alias, st, ci in inside:
            bonus = 0.04 + 0.04 * len(alias.split()) if set(alias.split()) <= set(name.split()) else 0.0
            place = (0.0 if not state else 0.14 if st == state.upper() else -0.35) + (0.0 if not city else 0.28 if ci.lower() == city.lower() else -0.10)
            scored.append((-max(0.0, name_score(name, n) + place + bonus), i))
        scored.sort()
        want[key] = (scored[0][1], pytest.approx(-scored[0][0]))
    assert {k: (r["best"], r["best_score"]) for k, r in found.items()} == want
    assert (found[3]["best"], found[4]["best"], found[5]["best"]) == (3, 1, 2)


def test_geo_query_equals_brute_force(spark, sf_dir):
    nations = {r["n_nationkey"]: r["n_name"].title() for r in table(spark, sf_dir, "nation").collect()}
    suppliers = [(r["s_suppkey"], r["s_name"], r["s_nationkey"]) for r in table(spark, sf_dir, "supplier").collect()]
    normal = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {}
    for key, name, nation in suppliers:
        source, scored = normal(f"{name} {nations[nation]}"), []
        for other, n, k in suppliers:
            if k == nation:
                city, m = nations[k].lower(), normal(n)
                x, y = set(source.split()), set(m.split())
                base = (2 * len(x & y) / (len(x) + len(y)) + ratio(source, m)) / 2 + (0.25 if city in source else 0.0)
                scored.append((-min(1.0, base if x & y - set(city.split()) else min(0.87, base)), other))
        scored.sort()
        want[key] = (scored[0][1], pytest.approx(-scored[0][0]), scored[1][1] if len(scored) > 1 else None)
    found = {r["source_id"]: (r["best"], r["best_score"], r["second"]) for r in catalog.QUERIES["j8_match_with_geo"](spark, sf_dir).collect()}
    assert found == want


def test_profile_query_equals_brute_force(spark, sf_dir):
    nations = {r["n_nationkey"]: r["n_name"] for r in table(spark, sf_dir, "nation").collect()}
    normal = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    rows = [(r["s_suppkey"], normal(r["s_name"]), normal(f"{nations[r['s_nationkey']]} {r['s_name']}"), r["s_nationkey"]) for r in table(spark, sf_dir, "supplier").collect()]
    want = {}
    for key, name, _, nation in rows:
        scored = []
        for other, alias, full, k in rows:
            if k == nation:
                bonus = 0.04 + 0.04 * min(4, len(alias.split())) if set(alias.split()) <= set(name.split()) else 0.0
                scored.append((-(max(name_score(name, full), name_score(name, alias)) + 0.14 + 0.28 + bonus), other))
        scored.sort()
        want[key] = (scored[0][1], pytest.approx(-scored[0][0]))
    found = {r["source_id"]: (r["best"], r["best_score"]) for r in catalog.QUERIES["j9_match_profiles"](spark, sf_dir).collect()}
    assert found == want


def test_sequence_ratio_query_equals_difflib(spark, sf_dir):
    rows = catalog.QUERIES["p18_sequence_ratio"](spark, sf_dir).collect()
    names = sorted({r["p_name"] for r in table(spark, sf_dir, "part").collect()})
    assert {(r["a"], r["b"]) for r in rows} == {(a, b) for a in names for b in names if a < b and a.lower().split()[0] == b.lower().split()[0]}
    assert all(r["ratio"] == pytest.approx(ratio(r["a"], r["b"])) and r["score"] == pytest.approx(name_score(r["a"], r["b"])) for r in rows)


def test_bounds_spare_pairs_and_lose_none():
    """Names of the same few words in other orders, whose signs alone say little: the two best are those of scoring all."""
    import random

    import numpy as np

    from scoreframe.operators import matching as M

    rng = random.Random(2)
    words = ["amber", "lemon", "metallic", "navy", "olive", "plum", "rose", "salmon", "steel", "violet"]
    names = sorted({" ".join(rng.choices(words, k=rng.choice([2, 4, 5]))) for _ in range(2500)} | {"", "a", "aa", "ab" * 130})
    held, called = M.PairScores(names), []
    place = np.array(rng.sample(range(len(names)), len(names)))
    for name in ["ammber lemon navy", "x", "aa", "", "rose steel rose steel", *rng.sample(names, 12)]:
        alike = held.jaccard({w for w in name.split(" ") if w})
        bounds = held.bounds(name, alike)
        true = np.array([name_score(name, n) for n in names])
        assert (bounds >= true - 1e-12).all()
        found = M.two_best(bounds, place, lambda k: called.append(k) or held.score(name, k, alike[k]))
        want = np.lexsort((place, -true))[:2]
        assert [k for _, k in found] == want.tolist() and [s for s, _ in found] == true[want].tolist()
    assert len(called) < 0.1 * 17 * len(names)
    assert M.two_best(np.zeros(0), np.zeros(0, int), None) == []


def test_blocks_of_one_key_are_dealt_over_tasks(spark):
    """Few bytes and many pairs: every pair in one block, and the blocks in several tasks."""
    import pyarrow as pa

    from scoreframe.operators import matching as M

    left, right = spark.range(1024).selectExpr("0 AS k", "id AS a"), spark.range(512).selectExpr("0 AS k", "id AS b")

    def run(a, b):
        n = [len(b)] * len(a)
        return pa.table({"a": a.column("a"), "n": pa.array(n, pa.int64())})

    got = M.paired(left, right, ["k"], ("a", "b"), run, "a long, n long", 64).withColumn("task", F.spark_partition_id())
    assert {(r["a"], r["s"]) for r in got.groupBy("a").agg(F.sum("n").alias("s")).collect()} == {(a, 512) for a in range(1024)}
    assert got.select("task").distinct().count() > 2


def test_places_as_numbers():
    from scoreframe.operators import matching as M

    found, at = M.numbered(["NY", None, "CA", "NY"])
    assert at.tolist() == [0, 1, 2, 0] and found == {"NY": 0, None: 1, "CA": 2} and (at == found.get("WY", -1)).sum() == 0


def test_rows_alike_but_for_their_ids_are_paired_once(spark, monkeypatch):
    """Many rows of few names and places, some of them null: blocks hold each once, and every source row gets its best two."""
    from scoreframe.operators import matching as M

    names, states = ["hofstra", "hoffstra", "touro", None], ["NY", "CA", None]
    rows = [(i, names[i % 4], states[i // 4 % 3], "x" if i % 2 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, name string, state string, city string")
    s, m = df.withColumnRenamed("id", "source_id"), df.withColumnRenamed("id", "master_id")
    sides, paired = [], M.paired
    monkeypatch.setattr(M, "paired", lambda left, right, *more: sides.append((left.count(), right.count())) or paired(left, right, *more))
    profiles = J.match_profiles(s, m, "source_id", "master_id", "name", ["name"], "state", "city").collect()
    geo = J.match_with_geo(s, m, "source_id", "master_id", "name", "state", "city").collect()
    assert len(sides) == 3 and max(n for side in sides for n in side) <= 24
    by_profile, by_geo = {}, {}
    for i, name, state, city in rows:
        scored = []
        for j, other, at, town in rows:
            place = (0.0 if state is None else 0.14 if at == state else -0.35) + (0.0 if city is None else 0.28 if town == city else -0.10)
            if state is None or at == state:
                scored.append((-max(0.0, name_score(name or "", other or "") + place), j))
        (a, best), (b, second) = sorted(scored)[:2]
        by_profile[i] = (best, pytest.approx(-a), second, pytest.approx(-b))
        scored = []
        for j, other, at, town in rows:
            if state is not None and at == state:
                x, y = set((name or "").split()), set((other or "").split())
                base = (2 * len(x & y) / max(len(x) + len(y), 1) + ratio(name or "", other or "")) / 2 + (0.25 if town and town in (name or "") else 0.0)
                scored.append((-min(1.0, base if x & y - {town} else min(0.87, base)), j))
        found = sorted(scored)[:2]
        by_geo[i] = (found[0][1], pytest.approx(-found[0][0]), found[1][1]) if found else (None, None, None)
    assert {r["source_id"]: (r["best"], r["best_score"], r["second"], r["second_score"]) for r in profiles} == by_profile
    assert {r["source_id"]: (r["best"], r["best_score"], r["second"]) for r in geo} == by_geo
