"""Best pairs of names under scores made of sequence ratios, without scoring every pair.

Two sides meet in blocks of at most about ``BLOCK`` rows of the right and a quarter of the left, split by hash where a key
holds more, and blocks are dealt over as many tasks, so no task gets a whole key. Within a block all upper bounds of a name against the other side are a few array operations; the matcher runs in the
order of the bounds and stops once no bound reaches what has been found. Results are those of scoring all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.sources.stages import stage

BLOCK = 8192
PAIRS = 4_000_000  # pairs of names for which a task is planned


def _held_by(held: dict[str, np.ndarray], words: Sequence[str], n: int) -> np.ndarray:
    """How many of these distinct words each of n rows holds; held: word -> rows."""
    out = np.zeros(n, np.int64)
    for w in words:
        if w in held:
            out[held[w]] += 1
    return out


def numbered(values: Sequence) -> tuple[dict, np.ndarray]:
    """Distinct values with their numbers, and the number of each value."""
    found: dict = {}
    return found, np.array([found.setdefault(v, len(found)) for v in values], np.int64)


class Names:
    """Names, and what bounds the sequence ratio of another name with each of them."""

    def __init__(self, names: Sequence[str]):
        self.names = [n or "" for n in names]
        self.length = np.array([len(n) for n in self.names], np.int64)
        codes = np.frombuffer("".join(self.names).encode("utf-32-le"), np.uint32).astype(np.int64) & 63
        row = np.repeat(np.arange(len(self.names)), self.length)
        self._signs = np.zeros((64, max(len(self.names), 1)), np.int32)
        np.add.at(self._signs, (codes, row), 1)
        inside = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
        grams, times = np.unique((codes[:-1] << 6 | codes[1:])[inside] * len(self.names) + row[1:][inside] if len(row) else np.zeros(0, np.int64), return_counts=True)
        self._gram_rows, self._gram_times = grams % max(len(self.names), 1), times
        self._gram_at = np.searchsorted(grams // max(len(self.names), 1), np.arange(4097))
        held: dict[str, list[int]] = {}
        self.size = np.zeros(len(self.names), np.int64)
        for k, n in enumerate(self.names):
            words = {w for w in n.split(" ") if w}
            self.size[k] = len(words)
            for w in words:
                held.setdefault(w, []).append(k)
        self._held = {w: np.array(ks) for w, ks in held.items()}
        self._beside: tuple | None = None
        self._matchers: dict[int, SequenceMatcher] = {}

    def shared(self, words: Sequence[str]) -> np.ndarray:
        """How many of these distinct words each name holds."""
        return _held_by(self._held, words, len(self.names))

    def shared_beside(self, words: Sequence[str], apart: Sequence[set[str]]) -> np.ndarray:
        """As ``shared``, without the words that are set apart for each name."""
        if self._beside is None or self._beside[0] is not apart:
            kept = {w: np.array([k for k in ks.tolist() if w not in apart[k]], np.int64) for w, ks in self._held.items()}
            self._beside = (apart, kept)
        return _held_by(self._beside[1], words, len(self.names))

    def ratio_bound(self, name: str) -> np.ndarray:
        """No less than the ratio of ``name`` with each. Of T signs in both, the M that match are no more than the signs in
        common. They stand in blocks, with a sign between any two; so k blocks make T >= 2M + k - 1, and the blocks hold
        M - k pairs of neighbours, no more than the G in common: 3M <= G + T + 1."""
        if not name or not self.names:
            return np.zeros(len(self.names))
        codes = np.frombuffer(name.encode("utf-32-le"), np.uint32).astype(np.int64) & 63
        own = np.bincount(codes, minlength=64)
        there = np.flatnonzero(own)
        most = np.minimum(self._signs[there], own[there, None].astype(np.int32)).sum(axis=0, dtype=np.int64)
        common = np.zeros(len(self.names), np.int64)
        for gram, times in zip(*np.unique(codes[:-1] << 6 | codes[1:], return_counts=True)):
            a, b = self._gram_at[gram], self._gram_at[gram + 1]
            common[self._gram_rows[a:b]] += np.minimum(self._gram_times[a:b], times)
        total = self.length + len(name)
        return np.where(self.length > 0, 2.0 * np.minimum(most, (common + total + 1) // 3) / total, 0.0)

    def ratio(self, name: str, k: int) -> float:
        """The sequence ratio of ``name`` with the k-th; 0 if a side is empty."""
        if not name or not self.names[k]:
            return 0.0
        m = self._matchers.get(k)
        if m is None:
            m = self._matchers[k] = SequenceMatcher(None, "", self.names[k])
        m.set_seq1(name)
        return m.ratio()


def in_order(name: str) -> str:
    return " ".join(sorted({w for w in name.split(" ") if w}))


class PairScores:
    """The pair score (largest of sequence ratio, ratio of the sorted words and Jaccard index) of names with others."""

    def __init__(self, names: Sequence[str]):
        self.plain = Names(names)
        self.ordered = Names([in_order(n) for n in self.plain.names])

    def jaccard(self, words: set[str]) -> np.ndarray:
        both = self.plain.shared(words)
        return both / np.maximum(self.plain.size + len(words) - both, 1)

    def bounds(self, name: str, jaccard: np.ndarray) -> np.ndarray:
        """Sorted words have their own neighbours, so each form has its own bound."""
        out = np.maximum(np.maximum(self.plain.ratio_bound(name), self.ordered.ratio_bound(in_order(name))), jaccard)
        return np.where(self.plain.length > 0, out, 0.0)

    def score(self, name: str, k: int, jaccard: float) -> float:
        other = self.plain.names[k]
        if not name or not other:
            return 0.0
        return 1.0 if name == other else max(self.plain.ratio(name, k), self.ordered.ratio(in_order(name), k), float(jaccard))


def two_best(bounds: np.ndarray, place: np.ndarray, score: Callable[[int], float]) -> list[tuple[float, int]]:
    """The two best (score, k), ties by place. Scored in order of the bounds, while one can still be among the two."""
    found: list[tuple[float, int, int]] = []
    few = min(len(bounds), 64)
    first = np.argpartition(-bounds, few - 1)[:few] if few else np.zeros(0, np.int64)
    first = first[bounds[first] > (bounds[first].min() if few < len(bounds) else -1.0)]  # ties at the edge come by place later
    for part in (first, None):
        order = np.lexsort((place, -bounds)) if part is None else part[np.lexsort((place[part], -bounds[part]))]
        for k in order[len(first) :] if part is None else order:
            if len(found) == 2 and (-bounds[k], place[k]) > found[1][:2]:
                return [(-s, k) for s, _, k in found]
            found = sorted([*found, (-score(k), int(place[k]), int(k))])[:2]
    return [(-s, k) for s, _, k in found]


def paired(left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: tuple[str, str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = BLOCK) -> DataFrame:
    """``run`` over all blocks of both sides that share the keys ``on``: every row of the left meets every row of the right
    of its keys in exactly one block. spread_by: the columns whose hashes split a key. The blocks are few rows and much
    work, so their tasks are planned by pairs: adaptive execution, which goes by bytes, would join them in one task."""
    on = list(on)
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    counts = left.groupBy(*on).agg(F.count("*").alias("_nl")).join(right.groupBy(*on).agg(F.count("*").alias("_nr")), on)
    counts = stage(counts.select(*on, parts("_nl", max(1, block // 4)).alias("_kl"), parts("_nr", block).alias("_kr"), (F.col("_nl").cast("double") * F.col("_nr")).alias("_pairs")))
    blocks, pairs = counts.agg(F.sum(F.col("_kl").cast("double") * F.col("_kr")), F.sum("_pairs")).first()
    tasks = max(1, int(min(blocks or 1, (pairs or 0) / PAIRS + left.sparkSession.sparkContext.defaultParallelism)))
    counts = counts.drop("_pairs")
    own = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    a = left.join(counts, on).withColumn("_i", own(spread_by[0], "_kl")).withColumn("_j", every("_kr")).drop("_kl", "_kr")
    b = right.join(counts, on).withColumn("_j", own(spread_by[1], "_kr")).withColumn("_i", every("_kl")).drop("_kl", "_kr")
    keys = [*on, "_i", "_j"]
    return a.repartition(tasks, *keys).groupBy(*keys).cogroup(b.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, schema)


def places(idents: Sequence) -> np.ndarray:
    """The place of each identifier in their order, nulls first."""
    out = np.empty(len(idents), np.int64)
    out[sorted(range(len(idents)), key=lambda k: (idents[k] is not None, idents[k]))] = np.arange(len(idents))
    return out


def table_of(rows: Iterator[tuple], like: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(like)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(like.items(), columns, strict=True)})
