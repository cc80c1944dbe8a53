"""Name clusters against brute force, the run order's gate, public payloads and parts of a ranking."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scoreframe.operators import integration as I
from scoreframe.operators import publishing as B
from scoreframe.operators import windows as W

NAMES = [
    "Hofstra University", "Hoffstra University", "University of Hofstra", "Ohio State College of Medicine", "Ohio State Colege of Medicine", "The Ohio State", "Northwestern Feinberg", "Feinberg Northwestern",
    "Saint Louis", "St Louis", "Alpha Beta Gamma", "Alpha Beta Gama", "Alpha Beta", "Medical College", "Medical Colege", "X", "", None,
]


def near(a, b, stop=("school", "college", "university", "medicine", "medical", "the", "of")):
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    x, y = set(a.split()), set(b.split())
    score = 1.0 if a == b else max(ratio(a, b), ratio(" ".join(sorted(x)), " ".join(sorted(y))), len(x & y) / len(x | y))
    dx, dy = x - set(stop), y - set(stop)
    shared = len(dx & dy)
    return (score >= 0.92 and shared >= 1) or (score >= 0.86 and shared >= 2) or (score >= 0.88 and shared >= 1 and min(len(dx), len(dy)) <= 1)


def test_clusters_equal_brute_force(spark):
    from scoreframe.functions import scalar as S

    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    clean = {r["name"]: r["c"] for r in df.select("name", S.normalize_name(F.col("name")).alias("c")).collect() if r["c"]}
    label = {c: c for c in clean.values()}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if near(min(a, b), max(a, b)) and label[b] < label[a]:
                    label[a], changed = label[b], True
    got = {r["name"]: r["cluster"] for r in I.cluster_names(df, "name").collect()}
    assert {n: got[n] for n in clean} == {n: label[c] for n, c in clean.items()}
    assert got[""] is None and got[None] is None


def test_links_equal_brute_force_on_unlike_lengths(spark):
    """Names with very long and repeated words, in blocks of a few names, and one whose partner is of another length."""
    import random

    rng = random.Random(11)
    short, long = ["aa", "bb", "cc", "dd", "state", "of", "the", "college"], ["x" * 38, "y" * 25, "northwestern", "hofstra", "feinberg"]
    names = {"aa bb cc dd ee ff gg", "aa bb cc dd ee ff gg " + "z" * 38, "hofstra hofstra hofstra", "hofstra", "state hofstra hofstra"}
    while len(names) < 500:
        words = rng.choices(short, k=rng.randint(0, 6)) + rng.choices(long, k=rng.randint(0, 2))
        rng.shuffle(words)
        name = " ".join(words)
        if name and rng.random() < 0.5:
            k = rng.randrange(len(name))
            name = name[:k] + rng.choice("abxy") + name[k:]
        names.add(" ".join(name.split()))
    names.discard("")
    df = spark.createDataFrame([(n,) for n in names], "name string")
    clean = sorted({r[0] for r in I.name_words(df, "name").select("clean").collect()})
    want = {(a, b) for a in clean for b in clean if a < b and near(a, b)}
    for block in (I.M.BLOCK, 40):
        got = [tuple(r) for r in I.name_links(df, "name", block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert ("aa bb cc dd ee ff gg", "aa bb cc dd ee ff gg " + "z" * 38) in want and len(want) > 100


def test_components_of_a_chain(spark):
    from scoreframe.operators import graph as G

    links = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in G.connected(spark.range(110), links, "id").collect()}
    assert got == {i: 0 if i < 65 else 100 if i in (100, 101) else i for i in range(110)}


def test_representative(spark):
    df = spark.createDataFrame([(1, "Long Name Here", "b"), (1, "Short", "c"), (1, "Other", "a"), (2, "Same", "x"), (2, "Tiny", "y"), (2, "Longer", "z")], "cluster long, name string, source string")
    assert {r["cluster"]: r["name"] for r in I.representative(df, "cluster", "name", "source", ["a", "b"]).collect()} == {1: "Other", 2: "Same"}


def test_an_error_stops_the_run(spark):
    ran = []
    issues = lambda t: t["x"].select(F.when(F.col("id") > 1, "error").otherwise("warning").alias("severity"))
    steps = [("one", lambda t: ran.append("one") or {"y": t["x"]}, True), ("two", lambda t: ran.append("two") or {"x": t["x"].withColumn("id", F.col("id") + 5)}, False), ("three", lambda t: ran.append("three") or {}, True)]
    with pytest.raises(B.ValidationError, match="three"):
        B.run_all({"x": spark.range(2)}, issues, steps)
    assert ran == ["one", "two"]
    with pytest.raises(B.ValidationError, match="one"):
        B.run_all({"x": spark.range(9)}, issues, steps)


def test_public_payload_hides_private_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, ("a", "secret-1"), "secret-2")], "id long, who struct<name:string,note:string>, note string")
    secrets = spark.createDataFrame([("secret-1",), ("secret-2",)], "s string")
    for mode, leaks in (("public", 0), ("local", 2)):
        names = B.publish({"t": df, "private": df}, str(tmp_path / mode), mode, ["private"], ["note"])
        assert names == (["t"] if mode == "public" else ["t", "private"])
        assert B.leak_check(spark, str(tmp_path / mode), ["t"], secrets, "s").count() == leaks
    with pytest.raises(ValueError):
        B.publish({"t": df}, str(tmp_path / "x"), "secret", [], [])


def test_reviewer_state_is_local_only(spark):
    from scoreframe.plans import publishing_queries as Q

    wide = Q.entities(spark, "/root/testdata/sf0.001")
    assert "reviewer_state" not in B.entity_nodes(wide, "c_custkey")["compare_card"].columns
    assert "reviewer_state" in B.entity_nodes(wide, "c_custkey", "local")["compare_card"].columns


def test_ranks_in_parts_equal_a_window(spark):
    from pyspark.sql import Window

    df = spark.range(3_000).select("id", F.when(F.col("id") % 7 < 6, "hot").when(F.col("id") % 2 == 0, None).otherwise("cold").alias("k"), F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 == 0, None).otherwise((F.col("id") * 37 % 101).cast("double")).alias("s"))
    w = Window.partitionBy("k").orderBy(F.col("s").desc_nulls_last(), "id")
    want = {r["id"]: (r["a"], r["b"]) for r in df.select("id", F.when(F.col("s").isNotNull(), F.row_number().over(w)).alias("a"), F.when(F.col("s").isNotNull(), F.rank().over(Window.partitionBy("k", F.col("s").isNull()).orderBy(F.col("s").desc()))).alias("b")).collect()}
    got = {r["id"]: (r["a"], r["b"]) for r in W.rank_scores(W.live_rank(df, "s", ["k"], ["id"], "a"), "s", ["k"], name="b").collect()}
    assert got == want


def test_a_run_takes_up_after_its_last_good_step(spark, tmp_path):
    """Each step is computed once; a run that broke off resumes; another stamp or another schema starts anew."""
    ran = []

    def made(name, fail=False):
        def step(t):
            ran.append(name)
            if fail:
                raise RuntimeError(name)
            return {name: t["x"].withColumn(name, F.lit(len(t)).cast("long"))}

        return step

    none = lambda t: t["x"].filter("id < 0").select(F.lit("error").alias("severity"))
    steps = lambda fail: [("a", made("a"), True), ("b", made("b"), False), ("c", made("c", fail), True)]
    at = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        B.run_all({"x": spark.range(3)}, none, steps(True), at=at, stamp="1")
    out = B.run_all({"x": spark.range(3)}, none, steps(False), at=at, stamp="1")
    assert ran == ["a", "b", "c", "c"] and sorted(tuple(r) for r in out["c"].collect()) == [(i, 3) for i in range(3)]
    assert sorted(out) == ["a", "b", "c", "x"] and out["a"].count() == 3
    B.run_all({"x": spark.range(3)}, none, steps(False), at=at, stamp="1")
    assert len(ran) == 4
    B.run_all({"x": spark.range(3)}, none, steps(False), at=at, stamp="2")
    B.run_all({"x": spark.range(3).withColumn("y", F.lit(1))}, none, steps(False), at=at, stamp="2")
    assert ran[4:] == ["a", "b", "c"] * 2


def test_first_candidate_of_a_rank_wins_and_rows_may_carry_their_match(spark):
    """The best candidate of an entity against a plain search, for matches beside the rows and in them, in any order."""
    import random

    rng = random.Random(5)
    clusters = spark.createDataFrame([(k, k % 3, None, None, None, None, "close_agreement") for k in range(6)], "cluster long, n_sources int, mcat double, gpa double, mcat_spread double, gpa_spread double, agreement string")
    plain = [(i, rng.choice([*range(6), None]), rng.choice(["crowd", "table", None]), rng.choice([500.0, 510.0, None]), rng.choice([3.1, 3.9, None]), i % 4 if i % 9 else None) for i in range(120)]
    rng.shuffle(plain)
    whole = spark.createDataFrame([(*r, 0.9, 0.5, "review") for r in plain], "row long, cluster long, source string, mcat double, gpa double, entity long, score double, second double, label string").repartition(7)
    of_clusters = spark.createDataFrame([], "cluster long, entity long, score double, second double, label string")
    grid = spark.createDataFrame([], "score_band string, grade_band string, rate double")
    want = {}
    for row, cluster, source, mcat, gpa, entity in plain:
        if entity is None or (mcat is None and gpa is None):
            continue
        n = 0 if cluster is None else cluster % 3
        crowd_only = False if n else None if source is None else source == "crowd"
        own = -1 if crowd_only is None else int(not crowd_only)
        # one row's spreads are 0 where it has a value
        grade = 1 if n >= 2 else 3 if n else 4
        rank = (int(mcat is not None and gpa is not None), own, n, -grade, -row)
        if entity not in want or rank > want[entity][0]:
            want[entity] = (rank, (n, mcat, gpa, "candidate_crowd_median" if source == "crowd" else "candidate_single_source"))
    beside = whole.select("row", "entity", "score", "second", "label")
    for rows, matches in ((whole, None), (whole.drop("entity", "score", "second", "label"), beside)):
        found = I.integrate_stats(clusters, rows, of_clusters, matches, grid, "crowd")["canonical"]
        assert {r["entity"]: (r["n_sources"], r["mcat"], r["gpa"], r["metric_type"]) for r in found.collect()} == {k: v[1] for k, v in want.items()}
