"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased words. A seed hashes the tokens at the kept positions of a fixed mask, so substitutions at the
ignored positions do not break it; items of up to eight tokens have masks that leave out each single position. Training
texts are scanned once against the seeds of the test items; every hit fixes an alignment, and an alignment is verified
token by token: some ``window`` of consecutive aligned tokens (the whole item if it is shorter) must agree in ``share``
of its places.

Test items of at most ``block_chars`` characters go to the executors whole, and no training text is shuffled or cut.
Beyond that the seeds stay on Spark: training texts are scanned against a bit table of the test seeds (16 MB at most),
the hits that it lets through are joined with the test seeds, and each training text is verified against the items that
it shares a seed with. Both ways give the same rows.

Defined cases: null texts are empty and match nothing; items of fewer than ``least`` tokens match nothing; repeated rows
give repeated results, equal items one row each; empty tables give no rows. Other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import stored

#: Kept positions are 1. Six of eight or nine.
MASKS = ("11101101", "110101011", "101110011", "111010011")
BLOCK_CHARS = 2_000_000
CHUNK_CHARS = 2_000_000
TABLE_BITS = 27  # of the bit table, at most
_WORD = re.compile(r"\w+")


def masks(sizes: set[int]) -> tuple[list[np.ndarray], list[int]]:
    """(kept positions, span) of every mask; for items shorter than a mask the whole sequence, and all but one position."""
    kept, spans = [np.flatnonzero([c == "1" for c in m]) for m in MASKS], [len(m) for m in MASKS]
    for n in sorted(n for n in sizes if n < max(map(len, MASKS))):
        for left_out in (n, *range(n)):
            kept.append(np.array([j for j in range(n) if j != left_out]))
            spans.append(n)
    return kept, spans


class Seeds:
    """The seeds of one block of items, as sorted arrays."""

    def __init__(self, items: list[tuple[int, str]], least: int, window: int, share: float):
        texts = defaultdict(list)
        for key, text in items:
            words = tuple(_WORD.findall((text or "").lower()))
            if len(words) >= least:
                texts[words].append(key)
        self.keys = list(texts.values())
        self.words: dict[str, int] = {}
        self.items = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in t], np.int64) for t in texts]
        self.window, self.share = window, share
        self.masks, spans = masks({len(t) for t in self.items})
        self.span = max(spans)
        rng = np.random.default_rng(20)
        self.mix = rng.integers(1, 1 << 63, self.span + 1, dtype=np.uint64) | np.uint64(1)
        self.tables = []
        for k, (mask, span) in enumerate(zip(self.masks, spans, strict=True)):
            found = []
            for i, t in enumerate(self.items):
                if (k < len(MASKS) and len(t) >= span) or (k >= len(MASKS) and len(t) == span):
                    h = self.hashes(t, mask, len(t) - span + 1)
                    found.append(np.rec.fromarrays([h, np.full(len(h), i), np.arange(len(h))], names="h,i,q"))
            table = np.concatenate(found) if found else np.rec.fromarrays([np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)], names="h,i,q")
            table = table[np.argsort(table["h"], kind="stable")]
            bloom = np.zeros(1 << 20, bool)
            bloom[table["h"] >> np.uint64(44)] = True
            self.tables.append((span, bloom, np.ascontiguousarray(table["h"]), np.ascontiguousarray(table["i"]), np.ascontiguousarray(table["q"])))

    def hashes(self, ids: np.ndarray, mask: np.ndarray, n: int) -> np.ndarray:
        total = np.full(n, len(mask), np.uint64)
        for j in mask:
            total += ids[j : j + n].astype(np.uint64) * self.mix[j]
            total ^= total >> np.uint64(29)
            total *= np.uint64(0x9E3779B97F4A7C15)
        return total

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, matched tokens, aligned tokens, first aligned token) of every verified pair, best alignment."""
        parts, starts, at = [], [], 0
        gap = np.zeros(self.span, np.int64)
        get = self.words.get
        for text in texts:
            words = _WORD.findall(text.lower())
            starts.append(at)
            parts += [np.fromiter((get(w, 0) for w in words), np.int64, len(words)), gap]
            at += len(words) + self.span
        ids, starts = np.concatenate(parts) if parts else gap, np.array(starts)
        sizes = np.diff(np.append(starts, at)) - self.span
        aligned = []
        for mask, (span, bloom, h, i, q) in zip(self.masks, self.tables, strict=True):
            n = len(ids) - span + 1
            if n <= 0 or not len(h):
                continue
            seed = self.hashes(ids, mask, n)
            p = np.flatnonzero(bloom[seed >> np.uint64(44)])
            lo = np.searchsorted(h, seed[p], "left")
            count = np.searchsorted(h, seed[p], "right") - lo
            p, lo, count = p[count > 0], lo[count > 0], count[count > 0]
            if not len(p):
                continue
            at_seed = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            p = np.repeat(p, count)
            text = np.searchsorted(starts, p, "right") - 1
            aligned.append(np.stack([text, i[at_seed], p - q[at_seed] - starts[text]], axis=1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if aligned:
            for text, item, d in np.unique(np.concatenate(aligned), axis=0).tolist():
                t = self.items[item]
                a, b = max(0, d), min(int(sizes[text]), d + len(t))
                same = ids[starts[text] + a : starts[text] + b] == t[a - d : b - d]
                width = min(self.window, len(t))
                if len(same) < width:
                    continue
                run = np.convolve(same, np.ones(width, int), "valid")
                if run.max() >= self.share * width and (int(same.sum()), -a) > (best.get((text, item), (0, 0, 0))[0], -best.get((text, item), (0, 0, 0))[2]):
                    best[text, item] = (int(same.sum()), len(same), a)
        return [(text, item, *found) for (text, item), found in sorted(best.items())]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13, share: float = 0.8, least: int = 5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_matched, n_aligned, first_token, similarity) of each contaminated document and its item."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, n_matched long, n_aligned long, first_token long, similarity double"
    names = ["doc_id", "item_id", "n_matched", "n_aligned", "first_token", "similarity"]
    items = _items(benchmark, item_col)

    def batch_of(out: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), pa.array(cols[1]), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.float64())], names)

    if _fits(items, block_chars):
        s = Seeds([(r.i, r.t) for r in items.collect()], least, window, share)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0)
                out: list[tuple] = []
                for first, part in _parts(batch.column(1)):
                    for text, item, matched, n, start in s.matches(part):
                        out += [(keys[first + text].as_py(), key, matched, n, start, matched / n) for key in s.keys[item]]
                if out:
                    yield batch_of(out, keys.type)

        return docs.select(id_col, F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(scan, schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = Seeds([(x["i"], x["t"]) for x in shared], least, window, share)
                out += [(key, k, matched, n, start, matched / n) for _, item, matched, n, start in s.matches([text]) for k in s.keys[item]]
            if out:
                yield batch_of(out, batch.schema.field(0).type)

    return _sharing(docs, items, id_col, text_col, least).select("id", "t", "shared").mapInArrow(verify, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = 13, share: float = 0.8, least: int = 5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark; without a shuffle where the benchmark fits."""
    at = docs.columns.index(text_col)
    items = _items(benchmark, item_col)
    if _fits(items, block_chars):
        s = Seeds([(r.i, r.t) for r in items.collect()], least, window, share)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, part in _parts(batch.column(at)):
                    keep[[first + m[0] for m in s.matches(part)]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    # rows of one text share their fate
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    bad = overlaps(keyed.select("key", F.col(f"row.{text_col}").alias("t")), benchmark, "key", "t", item_col, window, share, least, block_chars)
    return keyed.join(bad.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _items(benchmark: DataFrame, item_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t"))


def _fits(items: DataFrame, block_chars: int) -> bool:
    return items.agg(F.coalesce(F.sum(F.length("t") + 16), F.lit(0))).first()[0] <= block_chars


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of about CHUNK_CHARS characters each; null is the empty text."""
    at = 0
    while at < len(column):
        part, size, first = [], 0, at
        while at < len(column) and (not part or size < CHUNK_CHARS):
            part.append(column[at].as_py() or "")
            size += len(part[-1])
            at += 1
        yield first, part


def _text_key(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


class _Seeder:
    """Seeds of any texts, from hashes of their tokens: for masks that must not know the items' words."""

    def __init__(self, sizes: set[int]):
        self.masks, self.spans = masks(sizes)
        self.mix = np.random.default_rng(20).integers(1, 1 << 63, max(self.spans) + 1, dtype=np.uint64) | np.uint64(1)
        self.known: dict[str, int] = {}

    def tokens(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        words = _WORD.findall(text.lower())
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter((known[w] for w in words), np.uint64, len(words))

    def seeds(self, ids: np.ndarray, only: int | None = None) -> Iterator[np.ndarray]:
        """The hashes of each mask; with the item's size only of masks that apply to it."""
        for k, (mask, span) in enumerate(zip(self.masks, self.spans, strict=True)):
            n = len(ids) - span + 1
            if n <= 0 or (only is not None and k >= len(MASKS) and span != only):
                continue
            total = np.full(n, k + 1, np.uint64)
            for j in mask:
                total += ids[j : j + n] * self.mix[j]
                total ^= total >> np.uint64(29)
                total *= np.uint64(0x9E3779B97F4A7C15)
            yield total.view(np.int64)


def _counted(items: DataFrame) -> DataFrame:
    """items with their number of tokens n, by the one rule of what a token is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(_WORD.findall(t.as_py().lower())) for t in batch.column("t")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, "n"])

    return items.mapInArrow(run, f"i {items.schema['i'].dataType.simpleString()}, t string, n long")


def _sharing(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, t, shared): documents with the items, as structs (i, t), that share a seed with them."""
    items = _counted(items).filter(F.col("n") >= least).withColumn("item", _text_key(F.col("t")))
    longest = max(map(len, MASKS))
    # sizes below the longest mask's: a handful
    seeder = _Seeder({r.n for r in items.filter(F.col("n") < longest).select("n").distinct().collect()})

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = seeder.tokens(text)
                h = np.unique(np.concatenate([np.zeros(0, np.int64), *seeder.seeds(ids, len(ids))]))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([key] * len(h), pa.string())], ["h", "item"])

    seeds = stored(items.select("item", "t").distinct().mapInArrow(of_items, "h long, item string"), "seeds")
    bits = int(min(TABLE_BITS, max(16, np.ceil(np.log2(32 * max(1, seeds.count()))))))
    mask = (1 << bits) - 1
    places = F.explode(F.array(*[F.shiftrightunsigned("h", n).bitwiseAND(F.lit(mask)) for n in (0, 64 - bits)]))
    words = seeds.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b"))
    found = words.toArrow()  # two numbers for 64 bits of the table: 32 MB at most
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found.column("w").to_numpy()] = found.column("b").to_numpy()
    table = table.view(np.uint8)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = []
                for h in seeder.seeds(seeder.tokens(text)):
                    low, high = h & mask, (h.view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)
                    found.append(h[((table[low >> 3] >> (low & 7)) & (table[high >> 3] >> (high & 7)) & 1).astype(bool)])
                h = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([key] * len(h), pa.string())], ["h", "key"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = texts.withColumn("key", _text_key(F.col("t")))
    pairs = texts.select("key", "t").mapInArrow(hits, "h long, key string").join(seeds, "h").select("key", "item").distinct()
    shared = pairs.join(items.select("item", "i", "t"), "item").groupBy("key").agg(F.collect_list(F.struct("i", "t")).alias("shared"))
    return texts.join(shared, "key")
