"""Joins: lookups by first or last row, fuzzy entity matching (see ``matching``), interval, nearest and as-of joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from scoreframe.functions import scalar as S
from scoreframe.operators import matching as M
from scoreframe.operators import windows as W


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def lookup_first(df: DataFrame, dim: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Left lookup; of several rows of a key the first wins."""
    return df.join(first_per_key(dim, keys, order), list(keys), "left")


def lookup_last(df: DataFrame, dim: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left lookup; of several rows of a key the last wins."""
    return lookup_first(df, dim, keys, [F.col(c).desc() for c in order])


def attach_many(df: DataFrame, child: DataFrame, keys: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """Left join that keeps the children of a key as an ordered array of structs; empty if there are none."""
    fields = [c for c in [*order, *child.columns] if c not in keys]
    fields = list(dict.fromkeys(fields))
    many = child.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return df.join(many, list(keys), "left").withColumn(name, F.coalesce(name, F.array()))


def cross_profiles(profiles: DataFrame, entities: DataFrame, most: int = 10_000) -> DataFrame:
    """Every entity for every profile; the product is the feature. Profiles are user rows: they are broadcast if there
    are at most ``most``, else the plain product is left to Spark."""
    few = profiles.limit(most + 1).count() <= most
    return entities.crossJoin(F.broadcast(profiles) if few else profiles)


def grid_lookup(df: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(grid, list(keys), "left")


def apply_overrides(src: DataFrame, overrides: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Overrides (keys, name, action, target): of several for a key the one whose name equals the row's wins, then the
    first by action and target. accept sets the target, reject and none clear it, ignore flags the row."""
    o = overrides.withColumnRenamed(name, "_named")
    joined = src.join(o, list(keys), "left")
    w = Window.partitionBy(*keys).orderBy((F.col("_named") == F.col(name)).desc_nulls_last(), F.col("action").asc_nulls_last(), F.col("target").asc_nulls_last())
    one = joined.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_named")
    status = F.when(F.col("action") == "accept", "override_accept").when(F.col("action").isin("reject", "none"), "override_none").when(F.col("action") == "ignore", "ignored").otherwise("unmatched")
    return one.select(*src.columns, F.when(F.col("action") == "accept", F.col("target")).alias("target"), status.alias("status"))


def top2(scored: DataFrame, key: Sequence[str], score: str, ident: str) -> DataFrame:
    """(key, best, best_score, second, second_score, gap) with ties by ident."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc_nulls_last(), F.col(ident))
    ranked = scored.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    one = lambda c, k: F.max(F.when(F.col("_rn") == k, F.col(c)))
    out = ranked.groupBy(*key).agg(one(ident, 1).alias("best"), one(score, 1).alias("best_score"), one(ident, 2).alias("second"), one(score, 2).alias("second_score"))
    return out.withColumn("gap", F.col("best_score") - F.coalesce("second_score", F.lit(0.0)))


def _best_by_name(src: DataFrame, named: DataFrame, keys: Sequence[str], on: Sequence[str], block: int) -> DataFrame:
    """(keys, _s, _m, _ids, score): the two best names of each block for each source name."""
    kind = named.schema["_ids"].dataType.elementType
    fields = {k: pa.string() for k in (*keys, "_s", "_m")} | {"_ids": pa.list_(to_arrow_type(kind)), "score": pa.float64()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        others, lists = M.PairScores(right.column("_m").to_pylist()), right.column("_ids").to_pylist()
        place, rows = M.places([x[0] for x in lists]), []
        for *at, name in zip(*(left.column(c).to_pylist() for c in (*keys, "_s"))):
            alike = others.jaccard({w for w in name.split(" ") if w})
            for score, k in M.two_best(others.bounds(name, alike), place, lambda k: others.score(name, k, alike[k])):
                rows.append((*at, name, others.plain.names[k], lists[k], score))
        return M.table_of(rows, fields)

    kept = [c for c in named.columns if c not in (*on, "_m", "_ids")]
    schema = ", ".join([*(f"{k} string" for k in (*keys, "_s", "_m")), f"_ids array<{kind.simpleString()}>", "score double"])
    return M.paired(src, named.drop(*kept), on, ("_s", "_m"), run, schema, block)


def match_entities(src: DataFrame, master: DataFrame, src_id: str, master_id: str, name: str, blocks: Sequence[str], high: float = 0.92, gap: float = 0.03, low: float = 0.75, block: int = M.BLOCK) -> DataFrame:
    """Best and second master row for each source row by pair score, as if every master row of the source's blocks were
    scored, whether or not a token is shared; a block that is blank in the source holds every master row. Names are
    normalised and paired once however often they occur, and only pairs whose bound can reach the best two are scored.

    Labels: exact (equal names, second below 1), high_confidence, review, no_match."""
    keys = [f"_b{i}" for i in range(len(blocks))]
    of = [S.clean(F.col(b).cast("string")).alias(k) for b, k in zip(blocks, keys, strict=True)]
    s = src.select(src_id, *of, S.normalize_name(F.col(name)).alias("_s"))
    m = master.select(F.col(master_id).alias("_id"), *of, S.normalize_name(F.col(name)).alias("_m"))
    wanted, scored = s.select(*keys, "_s").distinct(), None
    for given in product((True, False), repeat=len(keys)):
        on = [f"_on{i}" for i, g in enumerate(given) if g] or ["_all"]
        part, held = wanted.withColumn("_all", F.lit(0)), m.withColumn("_all", F.lit(0))
        for i, (k, g) in enumerate(zip(keys, given, strict=True)):
            part = part.filter((F.col(k) != "") == g).withColumn(f"_on{i}", F.col(k))
            held = held.withColumn(f"_on{i}", F.col(k))
        first = Window.partitionBy(*on, "_m").orderBy("_id")  # of the rows of one name two can be best and second
        named = held.withColumn("_rn", F.row_number().over(first)).filter("_rn <= 2").groupBy(*on, "_m").agg(F.array_sort(F.collect_list("_id")).alias("_ids"))
        found = _best_by_name(part.select(*keys, "_s", *on), named, keys, on, block)
        scored = found if scored is None else scored.unionByName(found)
    scored = scored.withColumn("_id", F.explode("_ids")).withColumn("_row", F.struct("_id", "_m"))
    best = top2(scored, [*keys, "_s"], "score", "_row")
    out = s.join(best, [*keys, "_s"], "left")
    exact = (F.col("best._m") == F.col("_s")) & (F.coalesce("second_score", F.lit(0.0)) < 1.0)
    label = F.when(F.coalesce("best_score", F.lit(0.0)) < low, "no_match").when(exact, "exact").when((F.col("best_score") >= high) & (F.col("gap") >= gap), "high_confidence").otherwise("review")
    return out.select(src_id, F.col("best._id").alias("best"), "best_score", F.col("second._id").alias("second"), "second_score", "gap", label.alias("label"))


def _best_rows(src: DataFrame, master: DataFrame, on: Sequence[str], src_id: str, master_id: str, scores: Callable[[pa.Table], Callable[[dict], tuple]], block: int) -> DataFrame:
    """(src_id, master_id, score): the two best master rows for each source row. scores takes a block of the master and
    gives, for a source row, the bounds of all scores and the score of one. Rows that differ in their identifier alone are
    paired once, however many there are: of equal rows of the master two can be best and second."""
    said = lambda df, ident: df.withColumn("_text", F.struct(*[c for c in df.columns if c != ident]))
    s, m = said(src, src_id), said(master, master_id)
    first = Window.partitionBy(*on, "_text").orderBy(master_id)
    named = m.withColumn("_rn", F.row_number().over(first)).filter("_rn <= 2").groupBy(*on, "_text").agg(F.array_sort(F.collect_list(F.struct(master_id))).alias("_ids"))
    text = StructType([StructField(f.name, f.dataType) for f in s.schema["_text"].dataType])  # every field may be null
    types = {"_text": to_arrow_type(text), master_id: to_arrow_type(master.schema[master_id].dataType), "score": pa.float64()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of, lists, rows = scores(pa.Table.from_struct_array(right.column("_text"))), right.column("_ids").to_pylist(), []
        place = M.places([x[0][master_id] for x in lists])
        for row in left.column("_text").to_pylist():
            bounds, score = of(row)
            rows += [(row, x[master_id], found) for found, k in M.two_best(bounds, place, score) for x in lists[k]]
        return M.table_of(rows, types)

    schema = f"_text {text.simpleString()}, {master_id} {master.schema[master_id].dataType.simpleString()}, score double"
    scored = M.paired(s.select(*on, "_text").distinct(), named, on, ("_text", "_text"), run, schema, block)
    best = Window.partitionBy("_text").orderBy(F.col("score").desc_nulls_last(), master_id)
    two = scored.withColumn("_rn", F.row_number().over(best)).filter("_rn <= 2").drop("_rn")
    return s.select(src_id, "_text").join(two, "_text").select(src_id, master_id, "score")


def match_with_geo(src: DataFrame, master: DataFrame, src_id: str, master_id: str, name: str, state: str, city: str, high: float = 0.88, low: float = 0.72, block: int = M.BLOCK) -> DataFrame:
    """Best two rows of the state by the mean of token Dice and sequence ratio, +0.25 if the master's city occurs in the
    source name, at most 0.87 if only geography words are shared; the ratio is computed where its bound leaves a chance."""
    s = src.select(src_id, F.col(state).alias("_at"), S.normalize_name(F.col(name)).alias("_s")).filter("_at IS NOT NULL")
    m = master.select(master_id, F.col(state).alias("_at"), S.normalize_name(F.col(name)).alias("_m"), F.lower(city).alias("_city"))

    def scores(rows: pa.Table) -> Callable[[dict], tuple]:
        others, cities = M.Names(rows.column("_m").to_pylist()), [c or "" for c in rows.column("_city").to_pylist()]
        (named, at), local = M.numbered(cities), [set(c.split(" ")) for c in cities]

        def of(row: dict) -> tuple:
            words = {w for w in row["_s"].split(" ") if w}
            dice = 2.0 * others.shared(words) / np.maximum(others.size + len(words), 1)
            more = np.array([0.25 if c and c in row["_s"] else 0.0 for c in named])[at] if named else np.zeros(0)
            general = others.shared_beside(words, local) > 0

            def moved(ratio, k=slice(None)):
                base = (dice[k] + ratio) / 2 + more[k]
                return np.minimum(1.0, np.where(general[k], base, np.minimum(0.87, base)))

            return moved(others.ratio_bound(row["_s"])), lambda k: float(moved(others.ratio(row["_s"], k), k))

        return of

    best = top2(_best_rows(s, m, ["_at"], src_id, master_id, scores, block), [src_id], "score", master_id)
    label = F.when(F.coalesce("best_score", F.lit(0.0)) < low, "no_match").when(F.col("best_score") >= high, "high_confidence").otherwise("review")
    return src.select(src_id).join(best, src_id, "left").withColumn("label", label)


def match_profiles(src: DataFrame, master: DataFrame, src_id: str, master_id: str, name: str, master_names: Sequence[str], state: str, city: str, aliases: Sequence[str] = (), block: int = M.BLOCK) -> DataFrame:
    """Best two of several name columns among the master rows of the source's state, or among all if it has none there.
    Moved by location: state +0.14 or -0.35, city +0.28 or -0.10, nothing where the source names none; an alias column
    whose tokens all occur in the name adds 0.04 and 0.04 a token, four at most. Labels by cuts and gap: 0.92/0.02
    matched, 0.80/0.08 likely, 0.70 review. Place and alias count in the bounds by which pairs are scored."""
    place_of = (F.upper(S.missing(F.col(state))), F.nullif(S.normalize_name(F.col(city)), F.lit("")))
    s = src.select(src_id, place_of[0].alias("_ss"), place_of[1].alias("_sc"), S.normalize_name(F.col(name)).alias("_s"))
    m = master.select(master_id, place_of[0].alias("_ms"), place_of[1].alias("_mc"), *[S.normalize_name(F.col(c)).alias(f"_m{i}") for i, c in enumerate(master_names)], *[S.normalize_name(F.col(c)).alias(f"_a{i}") for i, c in enumerate(aliases)])

    def scores(rows: pa.Table) -> Callable[[dict], tuple]:
        forms = [M.PairScores(rows.column(f"_m{i}").to_pylist()) for i in range(len(master_names))]
        short = [M.Names(rows.column(f"_a{i}").to_pylist()) for i in range(len(aliases))]
        counts = [np.array([min(len(n.split(" ")), 4) for n in a.names]) for a in short]
        states, cities = (M.numbered(rows.column(c).to_pylist()) for c in ("_ms", "_mc"))

        def of(row: dict) -> tuple:
            words = {w for w in row["_s"].split(" ") if w}
            moved = lambda own, other, up, down: np.zeros(len(other[1])) if own is None else np.where(other[1] == other[0].get(own, -1), up, down)
            place = moved(row["_ss"], states, 0.14, -0.35) + moved(row["_sc"], cities, 0.28, -0.10)
            alias = np.zeros(rows.num_rows)
            for a, n in zip(short, counts):
                alias = np.maximum(alias, np.where((a.size > 0) & (a.shared(words) == a.size), 0.04 + n * 0.04, 0.0))
            alike = [f.jaccard(words) for f in forms]
            bound = np.maximum.reduce([f.bounds(row["_s"], j) for f, j in zip(forms, alike)])

            def score(k: int) -> float:
                return float(max(0.0, max(f.score(row["_s"], k, j[k]) for f, j in zip(forms, alike)) + place[k] + alias[k]))

            return np.maximum(0.0, bound + place + alias), score

        return of

    known = m.select(F.col("_ms").alias("_ss")).filter("_ss IS NOT NULL").distinct()
    inside = _best_rows(s.withColumn("_at", F.col("_ss")).filter("_at IS NOT NULL"), m.withColumn("_at", F.col("_ms")).filter("_at IS NOT NULL"), ["_at"], src_id, master_id, scores, block)
    others = _best_rows(s.join(known, "_ss", "left_anti").withColumn("_at", F.lit(0)), m.withColumn("_at", F.lit(0)), ["_at"], src_id, master_id, scores, block)
    best = top2(inside.unionByName(others), [src_id], "score", master_id)
    b = F.coalesce("best_score", F.lit(0.0))
    label = F.when((b >= 0.92) & (F.col("gap") >= 0.02), "matched").when((b >= 0.80) & (F.col("gap") >= 0.08), "likely").when(b >= 0.70, "review").otherwise("no_match")
    return src.select(src_id).join(best, src_id, "left").withColumn("label", label)


def unique_targets(matches: DataFrame, target: str) -> DataFrame:
    """Pairs whose target is hit by exactly one source row."""
    hits = matches.groupBy(target).agg(F.count("*").alias("_hits")).filter("_hits = 1").select(target)
    return matches.join(hits, target, "left_semi")


def cluster_lookup(df: DataFrame, clusters: DataFrame, name: str, cluster_id: str, canonical: str, members: str) -> DataFrame:
    """Cluster of a name by its canonical or any member name; the first cluster wins."""
    names = clusters.select(cluster_id, F.explode(F.array_distinct(F.concat(F.array(canonical), members))).alias(name))
    return df.join(names.groupBy(name).agg(F.min(cluster_id).alias(cluster_id)), name, "left")


def missing_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def known_only(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*keys), list(keys), "left_semi")


def overlap_join(cells: DataFrame, rows: DataFrame, page: str, cell_id: str, row_id: str, step: float, tolerance: float = 0.0) -> DataFrame:
    """Each cell (page, cell_id, start, stop) gets the row (page, row_id, top, bottom) of largest overlap, ties by row.
    Both sides are cut into buckets of ``step``, so a large page isn't a nested loop."""
    bucket = lambda a, b: F.explode(F.sequence(F.floor((a - tolerance) / step), F.floor((b + tolerance) / step)))
    c = cells.withColumn("_b", bucket(F.col("start"), F.col("stop")))
    r = rows.withColumn("_b", bucket(F.col("top"), F.col("bottom")))
    hit = (F.col("start") <= F.col("bottom") + tolerance) & (F.col("top") <= F.col("stop") + tolerance)
    overlap = F.least("stop", "bottom") - F.greatest("start", "top")
    pairs = c.join(r, [page, "_b"]).filter(hit).select(page, cell_id, row_id, overlap.alias("overlap")).distinct()
    best = pairs.groupBy(page, cell_id).agg(F.min_by(F.struct(row_id, "overlap"), F.struct(-F.col("overlap"), row_id)).alias("b"))
    return best.select(page, cell_id, f"b.{row_id}", "b.overlap")


def nearest_column(df: DataFrame, value: str, columns: Sequence[tuple[str, float]], most: float) -> DataFrame:
    """Name of the nearest of a fixed list of positions within a distance; ties to the first by name. An expression."""
    near = F.array_sort(F.array(*[F.struct(F.abs(F.col(value) - x).alias("d"), F.lit(n).alias("n")) for n, x in columns]))
    first = F.get(near, 0)
    return df.withColumn("nearest", F.when(first["d"] <= most, first["n"])).withColumn("distance", F.when(first["d"] <= most, first["d"]))


def asof_anchor(values: DataFrame, anchors: DataFrame, keys: Sequence[str], at: str, most: Column | None = None) -> DataFrame:
    """The last anchor at or before each value's position; anchors come first on ties. The union is cut into sampled ranges
    of (keys, position), each searched by itself; the last anchor of a key in a range is carried to the ranges after it by
    a table of one row per key and range. So a key with most of the rows is no task of its own."""
    a = anchors.select(*keys, at, F.lit(0).alias("_kind"), F.struct(*anchors.columns).alias("_a")).withColumn("_v", F.lit(None).cast(values.select(F.struct(*values.columns)).schema[0].dataType))
    v = values.select(*keys, at, F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_a"].dataType).alias("_a"), F.struct(*values.columns).alias("_v"))
    both = W.in_ranges(a.unionByName(v).select(F.struct(*keys).alias("_key"), F.col(at).alias("_at"), "_kind", "_a", "_v"), ["_key"], [F.col("_at"), F.col("_kind")])
    inside = Window.partitionBy("_key", "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_a", ignorenulls=True).over(inside)).filter("_kind = 1")
    ends = both.groupBy("_key", "_part").agg(F.max_by("_a", F.when(F.col("_kind") == 0, F.struct("_at", F.lit(0)))).alias("_end"))
    earlier = F.last("_end", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("_key", "_part", earlier.alias("_carried")).filter("_carried IS NOT NULL")
    out = found.join(carried, ["_key", "_part"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    place = F.col(f"_last.{at}")
    if most is not None:
        place = F.when(F.col(f"_v.{at}") - place <= most, place)
    return out.select("_v.*", place.alias(f"anchor_{at}"), "_last")


def denormalize(master: DataFrame, *dims: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    for dim, keys in dims:
        master = master.join(dim, list(keys), "left")
    return master


def with_route(df: DataFrame, slugs: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.join(slugs.select(key, "slug"), key, "left").withColumn("route", F.when(F.col("slug").isNotNull(), F.concat(F.lit(prefix), "slug")))


def select_in_order(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of listed ids (list column ``ids``) with their place in the list."""
    return ids.select(F.posexplode("ids").alias("pos", key)).join(df, key)
