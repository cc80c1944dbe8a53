"""Orders, as-of anchors, slugs and duplicates that are cut into ranges, against plain versions."""

import random

from pyspark.sql import functions as F

from scoreframe.operators import joins as J
from scoreframe.operators import rules as V
from scoreframe.operators import windows as W


def test_places_by_text_in_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 8 + ["cold", None]), rng.choice(["b", "a", None, "ab"]), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, key string, word string, x double").repartition(7)
    got = {r["id"]: r["place"] for r in W.priority_queue(df, ["key"], [F.col("word").desc_nulls_first(), F.col("x")]).collect()}
    want = {}
    for key in ("hot", "cold", None):
        order = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, [-ord(c) for c in (r[2] or "")] + [1], r[3]))
        want |= {r[0]: n + 1 for n, r in enumerate(order)}
    assert got == want


def test_slugs_like_assigning_one_by_one(spark):
    rng = random.Random(4)
    names = [rng.choice(["x", "X!", "x 2", "x-2", "x 2 2", "x 3", "y", "y-2", ""]) for _ in range(120)] + ["item", "item 2", "z", "z-2", "z", "z"]
    used, want = set(), {}
    for i, name in enumerate(names):
        base = "-".join(w for w in "".join(c if c.isalnum() else " " for c in name.lower()).split()) or "item"
        slug, n = base, 2
        while slug in used:
            slug, n = f"{base}-{n}", n + 1
        used.add(slug)
        want[i] = slug
    df = spark.createDataFrame(list(enumerate(names)), "pos long, name string").repartition(5)
    got = {r["pos"]: r["slug"] for r in W.unique_slug(df, "name", "pos").collect()}
    assert got == want and len(set(got.values())) == len(names)


def test_anchors_reach_over_ranges(spark):
    rng = random.Random(9)
    anchors = [("hot", 5, "first"), ("cold", 900, "late"), ("hot", 700, "second"), ("hot", 700, "twin")]
    values = [(i, rng.choice(["hot", "hot", "cold", "none"]), rng.randrange(1000)) for i in range(3000)]
    a = spark.createDataFrame(anchors[:3], "key string, at long, name string")
    v = spark.createDataFrame(values, "id long, key string, at long").repartition(6)
    for most in (None, 250):
        got = {r["id"]: r["anchor_at"] for r in J.asof_anchor(v, a, ["key"], "at", None if most is None else F.lit(most)).collect()}
        want = {}
        for i, key, at in values:
            last = max((x for k, x, _ in anchors if k == key and x <= at), default=None)
            want[i] = last if last is not None and (most is None or at - last <= most) else None
        assert got == want


def test_duplicates_name_their_first_row(spark):
    rows = [(1, "a"), (2, None), (3, "a"), (4, "b"), (5, None), (6, "a")]
    df = spark.createDataFrame(rows, "pos long, key string")
    got = sorted(((r["row_id"], r["message"]) for r in V.rule_duplicate(df, "t", "key", "pos").collect()), key=str)
    assert got == sorted([("a", "duplicate of row 1"), ("a", "duplicate of row 1"), (None, "duplicate of row 2")], key=str)
