"""Mixing sources to target weights by proportionate-fair scheduling, in DataFrame operations only.

A source of quota p in a period of Q slots has the weight p / Q. It gets its k-th block (from 0) released at slot
floor(k Q / p) and due by ceil((k + 1) Q / p); in every slot the released block with the earliest deadline is taken. The
quotas of a period add up to Q, so some block is always released, no deadline is missed, and at any slot each source is
within less than one block of its share. A period repeats for ever, so a document's slot follows from its place in its
source alone.

One period is scheduled by halving priorities instead of stepping through slots. Deadlines are fixed, so the blocks up to
any priority keep the same slots busy whatever comes after them, and which slots those are follows from running sums: a
slot is busy if more of the blocks are released by then than slots were busy before. Three bits of the priority split
blocks and slots into eight parts, each a problem of its own, until a part is one block and its slot.
 Given weights are exact to a millionth: 0.6004 and 0.3996
have quotas of 1501 and 999. Weights that need a longer period are rounded to millionths of their sum, which shifts a
source by at most one block in a million slots.

Places come from a fixed pseudo-random order (md5 of the id) in buckets: sizes of (source, bucket) are aggregated first,
their running sums give each bucket's offset, and rows are only numbered inside their bucket. A source with a third of
all rows is spread over all buckets. Every document is kept: when a source runs out its slots stay empty, and rows
before the first such slot have ``in_target`` set.

Defined cases: a null source is the source ""; null ids sort first; repeated rows take places of their own; an empty
table gives no rows. A source without a weight, or with one that is null, not above 0 or not finite, gets no slot: its
documents have a null slot and come last. Without weights a period holds at least one block of every source, so Q grows
if there are more sources than ``slots``. The first splits of a period are one task's work, of ``UNIT`` rows at most unless
there are more sources than that. Extra columns pass through; columns named like the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm.common import stored

FEW = 10_000  # slots of a period up to which its table is sent to all tasks
NEW = ("block", "slot", "place", "in_target")
UNIT = 1_000_000  # parts of one in which given weights are counted, and the longest period


def quotas(sizes: DataFrame, weights: DataFrame | None, slots: int) -> DataFrame:
    """(source, n, p): blocks of each source in a period; sources of weight 0 are left out. Weights (source, weight) are
    counted in ``UNIT`` parts of one and divided by their greatest common divisor; without weights the target is the
    square root of a source's size in whole parts of ``slots``, one at least."""
    whole = Window.partitionBy(F.lit(1))
    if weights is None:
        share = F.lit(slots) * F.sqrt("n") / F.sum(F.sqrt("n")).over(whole)
        return sizes.select("source", "n", F.greatest(F.lit(1), F.floor(share)).cast("long").alias("p"))
    weight = F.col("weight").cast("double")
    given = weights.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.when((weight > 0) & (weight < float("inf")), weight)).alias("w"))
    parts = F.round(F.col("w") * UNIT).cast("long")
    found = sizes.join(given, "source").withColumn("u", parts).filter("u > 0")
    # weights whose sum exceeds one, or that add up to no round number, are parts of their sum: the largest remainders get
    # the parts that rounding down leaves over
    parts_of_all = found.agg(F.sum("u").alias("all"), F.aggregate(F.collect_list("u"), F.lit(0).cast("long"), _divisor).alias("g"))
    every = found.crossJoin(F.broadcast(parts_of_all))  # one row
    exact = F.col("all") / F.col("g") <= UNIT
    down = every.withColumn("q", F.floor(F.col("u").cast("decimal(20,0)") * UNIT / F.col("all")).cast("long")).withColumn("r", F.row_number().over(whole.orderBy(F.desc(F.col("u") / F.col("all") * UNIT - F.col("q")), "source")))
    scaled = F.col("q") + (F.col("r") <= UNIT - F.sum("q").over(whole)).cast("long")
    return down.select("source", "n", F.when(exact, F.col("u") / F.col("g")).otherwise(scaled).cast("long").alias("p")).filter("p > 0")


def _divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs by Euclid's steps, 90 at most."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b"))))
    return pair["a"]


SPLIT = 3  # bits of the priority that one step tells apart


def schedule(quota: DataFrame, period: int | None = None) -> DataFrame:
    """(source, n, p, period, k, slot): the slot of every block of one period, the sum of p."""
    spark = quota.sparkSession
    period = period or quota.agg(F.sum("p")).first()[0] or 1
    jobs = quota.select("source", "n", "p", F.lit(period).cast("long").alias("period"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)).alias("k"))
    release, due = F.expr("k * period div p"), F.expr("((k + 1) * period + p - 1) div p")
    jobs = jobs.withColumn("release", release).withColumn("node", F.row_number().over(Window.orderBy(due, "source")).cast("long") - 1)
    steps = -(-max(1, (period - 1).bit_length()) // SPLIT)
    held = jobs.select(F.lit(0).cast("long").alias("part"), F.col("release").alias("at"), F.lit(0).alias("is_slot"), F.col("node").alias("priority"))
    held = held.unionByName(spark.range(period).select(F.lit(0).cast("long").alias("part"), F.col("id").alias("at"), F.lit(1).alias("is_slot"), F.lit(None).cast("long").alias("priority")))
    order = Window.partitionBy("part").orderBy("at", "is_slot")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    cuts = range(1, 1 << SPLIT)
    for step in reversed(range(steps)):
        held = held.withColumn("digit", F.shiftright("priority", step * SPLIT).bitwiseAND((1 << SPLIT) - 1))
        # blocks released less slots passed, for the blocks below each cut
        held = held.withColumns({f"s{c}": F.sum(F.when(F.col("is_slot") == 1, -1).when(F.col("digit") < c, 1).otherwise(0)).over(so_far) for c in cuts})
        held = held.withColumns({f"m{c}": F.least(F.lit(0), F.coalesce(F.min(F.when(F.col("is_slot") == 1, F.col(f"s{c}"))).over(before), F.lit(0))) for c in cuts})
        free = sum((F.col(f"s{c}") + 1 <= F.col(f"m{c}")).cast("long") for c in cuts)
        digit = F.when(F.col("is_slot") == 1, free).otherwise(F.col("digit"))
        held = held.select((F.col("part") * (1 << SPLIT) + digit).alias("part"), "at", "is_slot", "priority")
    slots = held.filter("is_slot = 1").select(F.col("part").alias("node"), F.col("at").alias("slot"))
    return jobs.join(slots, "node").select("source", "n", "p", "period", "k", "slot")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = 16, slots: int = 1000, id_col: str = "doc_id", source_col: str = "source", ordered: bool = False) -> DataFrame:
    """docs with block, slot, place and in_target; the mixture is their order by (slot, place)."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    kept = [c for c in docs.columns if c.lower() not in NEW]
    # the caller's columns travel in one struct, so that no name of theirs can clash
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), key.alias("key"))
    base = base.withColumn("bucket", F.substring("key", 1, 3))
    counts = stored(base.groupBy("source", "bucket").agg(F.count("*").alias("n")), "source-sizes")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    quota = stored(quotas(counts.groupBy("source").agg(F.sum("n").alias("n")), weights, slots), "quotas")
    period = quota.agg(F.sum("p")).first()[0] or 1  # one number
    table = stored(schedule(quota, period), "schedule")
    few = F.broadcast if period <= FEW else lambda df: df  # Spark's own choice beyond, and split hot keys
    # the slot of the first block that a source lacks; the smallest ends the part that is on target
    blocks = F.ceil(F.col("n") / block)
    lacks = F.when(blocks % F.col("p") == F.col("k"), F.floor(blocks / F.col("p")) * F.col("period") + F.col("slot"))
    table = table.withColumn("horizon", F.min(lacks).over(Window.partitionBy("period"))).select("source", "k", F.col("slot").alias("at"), "p", "period", "horizon")
    ranked = base.withColumn("rank", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "id")))
    sized = quota.select("source", "p")
    placed = ranked.join(offsets.join(few(sized), "source", "left"), ["source", "bucket"]).withColumn("nth", F.col("before") + F.col("rank") - 1)
    placed = placed.select("row", "source", F.floor(F.col("nth") / block).alias("block"), (F.col("nth") % block).alias("place"), (F.floor(F.col("nth") / block) % F.col("p")).alias("k"))
    placed = placed.join(few(table), ["source", "k"], "left")
    slot = F.floor(F.col("block") / F.col("p")) * F.col("period") + F.col("at")
    out = placed.select(*(F.col("row").getField(c).alias(c) for c in kept), "block", slot.alias("slot"), "place", F.coalesce(slot < F.col("horizon"), F.lit(False)).alias("in_target"))
    return out.orderBy(F.asc_nulls_last("slot"), "place") if ordered else out


#: DuckDB SQL for mix(documents)'s doc_id, source and new columns.
SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT s, count(*) AS n FROM d GROUP BY s),
q AS (SELECT s, n, row_number() OVER (ORDER BY s) - 1 AS i,
             greatest(1, CAST(floor(1000 * sqrt(n) / (SELECT sum(sqrt(n)) FROM n)) AS BIGINT)) AS p FROM n),
g AS (SELECT list(p ORDER BY i) AS ps, CAST(sum(p) AS BIGINT) AS period, CAST(count(*) AS BIGINT) AS m FROM q),
e(t, c, i) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ps, lambda x: CAST(0 AS BIGINT)), CAST(-1 AS BIGINT) FROM g
  UNION ALL
  SELECT t, list_transform(range(m), lambda j: c[j + 1] + CASE WHEN j = i THEN 1 ELSE 0 END), i FROM (
    SELECT e.t + 1 AS t, e.c, g.m, list_min(list_transform(range(g.m), lambda j:
      CASE WHEN (e.c[j + 1] * g.period) // g.ps[j + 1] <= e.t + 1
           THEN (((e.c[j + 1] + 1) * g.period + g.ps[j + 1] - 1) // g.ps[j + 1]) * g.m + j
           ELSE 1000000000000000 END)) % g.m AS i
    FROM e, g WHERE e.t + 1 < g.period)),
b AS (SELECT e.t AS slot, q.s, q.n, q.p, row_number() OVER (PARTITION BY q.s ORDER BY e.t) - 1 AS k FROM e JOIN q ON e.i = q.i),
hz AS (SELECT min(((n + 15) // 16) // p * (SELECT period FROM g) + slot) AS horizon FROM b WHERE ((n + 15) // 16) % p = k),
r AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS place FROM d),
x AS (SELECT r.doc_id, r.source, r.place // 16 AS block, ((r.place // 16) // q.p) * (SELECT period FROM g) + b.slot AS slot, r.place % 16 AS place
      FROM r JOIN q USING (s) JOIN b ON b.s = r.s AND b.k = (r.place // 16) % q.p)
SELECT doc_id, source, block, slot, place, slot < (SELECT horizon FROM hz) AS in_target FROM x
"""
