"""Pfair mixing: exact weights over long runs, zero weights, clashing names, empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from scoreframe.llm import mixing

DOCS = "doc_id long, source string"


def slots_of(spark, weights):
    sizes = spark.createDataFrame([(k, 1000) for k in weights], "source string, n long")
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    rows = mixing.schedule(mixing.quotas(sizes, table, 1000)).collect()
    return [r["source"] for r in sorted(rows, key=lambda r: r["slot"])]


@pytest.mark.parametrize("weights", [{"a": 0.6004, "b": 0.3996}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 3.0, "b": 2.0, "c": 1.0, "d": 1.0}, {"a": 0.123, "b": 0.0007, "c": 0.8763}])
def test_deviation_stays_below_a_block(spark, weights):
    order, whole = slots_of(spark, weights), sum(weights.values())
    seen = dict.fromkeys(weights, 0)
    for t in range(100_000):
        seen[order[t % len(order)]] += 1
        if t % 7 == 0 or t > 99_000:
            assert all(abs(seen[s] - w / whole * (t + 1)) < 1 for s, w in weights.items())


def test_weights_without_a_short_period(spark):
    weights = {"a": math.pi, "b": math.e, "c": 1.0}
    rows = mixing.quotas(spark.createDataFrame([(k, 5) for k in weights], "source string, n long"), spark.createDataFrame(list(weights.items()), "source string, weight double"), 1000).collect()
    assert sum(r["p"] for r in rows) == mixing.UNIT
    assert all(abs(r["p"] - mixing.UNIT * weights[r["source"]] / sum(weights.values())) < 1 for r in rows)


def test_sources_without_weight_come_last(spark):
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(["a"] * 40 + ["b"] * 40 + ["c"] * 3 + [None] * 2 + ["d"])] + [(None, "a"), (7, "a")], DOCS)
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0), ("d", None), ("zz", 4.0)], "source string, weight double")
    rows = mixing.mix(docs, weights, block=4, ordered=True).collect()
    assert len(rows) == docs.count() and not any(r["in_target"] for r in rows if r["source"] not in ("a", "b"))
    assert [r["source"] for r in rows[:16]] == ["a"] * 4 + ["b"] * 4 + ["a"] * 4 + ["b"] * 4
    assert all((r["slot"] is None) == (r["source"] not in ("a", "b")) for r in rows)
    assert all(r["slot"] is None for r in rows[-6:])


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(64)], DOCS)
    names = ("_k", "_before", "before", "row", "key", "bucket", "p", "k", "at", "nth", "horizon", "slot")
    wide = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    got = mixing.mix(wide, ordered=True)
    assert got.columns == ["doc_id", "source", *names[:-1], "block", "slot", "place", "in_target"]
    rows = got.collect()
    assert len(rows) == 64 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names[:-1])
    assert mixing.mix(docs.limit(0)).count() == 0


def earliest_deadline_first(quota):
    """Slot by slot: the released block of the earliest deadline, ties by source."""
    period, done, out = sum(quota.values()), dict.fromkeys(quota, 0), []
    for t in range(period):
        held = [(-(-(done[s] + 1) * period // p), s) for s, p in sorted(quota.items()) if done[s] < p and done[s] * period // p <= t]
        s = min(held)[1]
        out.append((t, s, done[s]))
        done[s] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_schedule_equals_earliest_deadline_first(spark, seed):
    import random

    rng = random.Random(seed)
    quota = {f"s{i:02}": rng.choice([1, 1, 2, 3, 7, 50]) for i in range(rng.choice([1, 2, 5, 60]))}
    rows = mixing.schedule(spark.createDataFrame([(s, 1, p) for s, p in quota.items()], "source string, n long, p long")).collect()
    assert sorted((r["slot"], r["source"], r["k"]) for r in rows) == earliest_deadline_first(quota)


def test_many_sources(spark):
    """A thousand sources, a period of a million slots: every block inside its window, so each deviation is below one."""
    sizes = spark.range(1000).select(F.concat(F.lit("s"), F.format_string("%04d", "id")).alias("source"), F.lit(10).cast("long").alias("n"), (F.col("id") * 2 + 1).alias("p"))
    rows = mixing.schedule(sizes)
    late = rows.filter("slot < k * period div p OR slot >= ((k + 1) * period + p - 1) div p").count()
    assert late == 0 and rows.agg(F.count("*"), F.countDistinct("slot"), F.max("slot")).first()[0:3] == (1_000_000, 1_000_000, 999_999)
