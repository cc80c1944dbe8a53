"""Small cases of operators with the values that the model prescribes."""

from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.operators import ranking as K
from scoreframe.operators import workflow as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fit_score(spark):
    assert one(spark, S.fit_score(F.lit(509.0), F.lit(505.0), 2)) == 9.0
    assert one(spark, S.fit_score(F.lit(None).cast("double"), F.lit(505.0), 2)) is None


def test_ranks_with_ties_nulls_and_exclusions(spark):
    rows = [("a", 9.0, False), ("b", 9.0, None), ("c", 8.0, False), ("d", None, False), ("e", 9.5, True)]
    df = spark.createDataFrame([("p", *r) for r in rows], "profile string, id string, score double, out boolean")
    got = {r["id"]: r["rank"] for r in K.rank_rounded(df, "score", ["profile"], F.col("out")).collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": None, "e": None}
    assert K.rank_rounded(df.limit(0), "score", ["profile"]).count() == 0


def test_minmax_with_nulls_and_equal_values(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (2, None, 2.0), (3, 7.0, 2.0)], "id int, x double, y double")
    got = {r["id"]: (r["a"], r["b"]) for r in K.minmax_all(df, {"a": F.col("x"), "b": F.col("y")}).collect()}
    assert got == {1: (10.0, 10.0), 2: (None, 10.0), 3: (1.0, 10.0)}


def test_tier_and_bucket(spark):
    cases = [("Reach", 8.0, "Dream"), ("Very High Risk", 7.9, "Reach"), ("Target", 9.0, "Target"), ("Very High Risk", None, "Reach")]
    df = spark.createDataFrame(cases, "tier string, att double, want string")
    assert df.filter(K.application_bucket(F.col("tier"), F.col("att")) != F.col("want")).count() == 0


def test_all_zero_weights_disable_live_scores(spark):
    parts = spark.createDataFrame([(1, 3.0)], "id int, a double")
    prefs = spark.createDataFrame([("none", 0.0), ("all", 5.0)], "p string, w_a double")
    assert {r["p"]: r["score"] for r in K.live_score(parts, prefs, "p", ["a"]).collect()} == {"none": None, "all": 3.0}


def test_classify_source(spark):
    rows = [
        ("https://www.a.edu/x", True, False, "exact_host", 1.0), ("https://med.a.edu/x", False, False, "same_domain", 0.9), ("https://b.edu/x", True, False, "edu_named", 0.9),
        ("https://b.com/x", False, False, "other", 0.25), ("https://www.a.edu/x", True, True, "unsafe", 0.0),
    ]
    df = spark.createDataFrame(rows, "url string, named boolean, bad boolean, label string, score double")
    got = df.select("label", "score", W.classify_source(F.col("url"), F.lit("https://www.a.edu"), F.col("named"), F.col("bad")).alias("c"))
    assert [(r["c"]["label"], r["c"]["score"]) for r in got.collect()] == [(r[3], r[4]) for r in rows]


def test_upsert_skips_blank_and_foreign_rows(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    export = spark.createDataFrame([(1, "x", 1, 2), (1, "y", 2, 2), (2, " ", 3, 2), (3, "z", 4, 1), (4, "n", 5, 2)], "id int, s string, pos int, v int")
    got = {r["id"]: (r["s"], r["change"]) for r in W.upsert_state(stored, export, ["id"], ["s"], "pos", "v", 2).collect()}
    assert got == {1: ("y", "replaced"), 2: ("b", "kept"), 4: ("n", "added")}


def test_workflow_tables_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, None), (2, "b", "x")], "id int, area string, label string")
    counts = {(r["area"], r["label"]): (r["n"], r["share"]) for r in W.status_counts(df, "area", "label").collect()}
    assert counts == {("unknown", "x"): (1, 50.0), ("unknown", "unknown"): (1, 50.0), ("b", "x"): (1, 100.0)}
    assert {r["id"]: r["record"] for r in W.export_state(df, "id", "label", "all").collect()} == {1: '{"scope":"all","ids":["x"]}', 2: '{"scope":"all","ids":["x"]}'}
    notes = W.assumptions(spark.createDataFrame([(1, None, 5.0, 2.0, None)], "id int, a double, wa double, b double, wb double"), "id", [("a", "a", "wa"), ("b", "b", "wb")])
    assert [r["note"] for r in notes.orderBy("input").collect()] == ["missing input", "zero weight"]
    assert W.status_counts(df.limit(0), "area", "label").count() == 0
