"""MinHash near-dedup with HyperMinHash signatures.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text's set holds its distinct n-word shingles
as 64-bit hashes. A HyperMinHash register of a bucket keeps the leading-zero count of the bucket's smallest hash and the
first mantissa bits after the leading one: 4 and 4 bits in the registers of the estimate, 6 and 26 in the folded ones,
which are banded to find candidates. The collision-corrected Jaccard estimate drops the hopeless ones, and the rest are
confirmed on the full sets.

At a similarity of exactly 0.80, by the binomial law with all registers occupied, the bands miss a pair once in seven
million and the estimate drops one once in 85 million; more alike pairs are safer. So about 1.5 in ten million such
pairs are lost, unless another path links them. Other similarities get bands and a slack of the same safety (``banding``).

Groups of equal sets are collapsed before banding (with map-side combining), so a large group of copies is one row. Of a
band's members each is first paired with the group's smallest and largest id only. Once those links have merged, the
rows outside a group's largest component are paired with those of other components: at once if at most ``FEW`` are
outside, else in blocks, with one link per row and component. So groups of near copies stay linear.

Defined cases: null and empty texts have an empty set and are linked with nothing; a text with fewer than n words has
its whole sequence as one shingle; rows that repeat a doc_id are one document, which is linked through each of its texts,
has the smallest of their set sizes and gives one row; rows with a null doc_id are linked with nothing and kept, one row
each; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import discard, spread, stored

FINE = 256  # registers of the estimate
ROWS = 3  # registers of a band at a similarity of 0.80
BANDS = 22
MANTISSA = 4  # bits of a register of the estimate
FOLDED_MANTISSA = 26  # so that sets which share nothing hardly ever share a band, even with one register of it occupied
SLACK = 0.155  # of the estimate, six standard deviations at 256 registers and a similarity of 0.80
FEW = 2  # rows of a group that are paired with all others at once
BLOCK = 1024  # rows of a block of a band's group
BITS = 27  # of the bitmap of the documents whose sets are compared, 16 MB
CHUNK = 1 << 20  # bytes of texts that are hashed at once

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _PRIME, np.uint64))


def banding(percent: int) -> tuple[int, int]:
    """(registers of a band, bands) that miss a pair of this similarity once in seven million; bands of ``ROWS`` registers,
    or the longest that need no more than 64 keys, or single registers."""
    share = percent / 100
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(1.5e-7) / math.log1p(-(share**rows))) if share < 1 else 1
        if bands <= 64 or rows == 1:
            return rows, bands
    raise AssertionError


def shingle_sets(texts: list[bytes], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted distinct 64-bit shingle hashes of each text, one text after the other. Each word is
    hashed as a polynomial over its bytes, each shingle as a mix of its words' hashes in order. No Python step per word."""
    raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    word = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([0], word.view(np.int8))))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # a word's hash: sum of its bytes' codes times the powers of the prime by place in the word
    length = end - begin
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    h = np.add.reduceat(_BYTE[raw[word]] * _powers(int(length.max()))[place], first)
    h = _mix(h ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    stops = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))  # words up to each text's end
    words = np.diff(stops, prepend=0)
    sizes = np.minimum(words, n_words)
    counts = words - sizes + (words > 0)
    ends = np.cumsum(counts)
    at = np.arange(int(ends[-1])) + np.repeat(stops - words - ends + counts, counts)
    size = np.repeat(sizes, counts)
    total = np.zeros(len(at), np.uint64)
    for k in range(int(sizes.max())):
        there = k < size
        total = np.where(there, _mix(total * _PRIME + h[np.where(there, at + k, 0)]), total)
    total += size.astype(np.uint64)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        total[a:b].sort()
    new = np.append(True, total[1:] != total[:-1])
    new[(ends - counts)[counts > 0]] = True
    return total[new], np.concatenate(([0], np.cumsum(new)))[ends]


def shingle_hashes(text: bytes, n_words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of one text's shingles."""
    return shingle_sets([text], n_words)[0]


def _values(rest: np.ndarray, mantissa: int, most: int) -> np.ndarray:
    """Leading zeros + 1 (``most`` at most), then the mantissa bits, inverted so that the smallest hash has the largest value."""
    exponent = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64))[1]  # floor(log2) + 1, at most one off when rounding, alike for equal hashes
    zeros = (64 - exponent).clip(0, most - 1).astype(np.uint64)
    tail = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - mantissa)
    return ((zeros + np.uint64(1)) << np.uint64(mantissa)) | (np.uint64((1 << mantissa) - 1) - tail)


def registers(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A row of FINE registers of one byte per owner, 0 in empty buckets."""
    out = np.zeros(n * FINE, np.uint8)
    bits = FINE.bit_length() - 1
    mixed = _mix(hashes)
    np.maximum.at(out, owner * FINE + (mixed >> np.uint64(64 - bits)).astype(np.int64), _values(mixed << np.uint64(bits), MANTISSA, 15).astype(np.uint8))
    return out.reshape(n, FINE)


def band_keys(hashes: np.ndarray, owner: np.ndarray, n: int, rows: int, bands: int) -> np.ndarray:
    """A row of band keys of folded registers per owner; 0 where all registers of the band are empty. Folded buckets come
    from other bits than the fine ones, the registers from the same law."""
    out = np.zeros(n * bands * rows, np.uint32)
    other = _mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    bucket = ((other >> np.uint64(40)) % np.uint64(bands * rows)).astype(np.int64)
    np.maximum.at(out, owner * (bands * rows) + bucket, _values(_mix(other), FOLDED_MANTISSA, 37).astype(np.uint32))
    held = out.reshape(n, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
    for k in range(rows):
        key = _mix(key * _PRIME + held[:, :, k])
    return np.where(held.any(axis=2), key.view(np.int64), 0)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows: equal registers over occupied ones, less the share that
    equal by chance. Two unlike registers equal with probability near (1/3) / 2**mantissa (equal zeros, equal mantissa)."""
    occupied = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    chance = 1 / 3 / (1 << MANTISSA)
    raw = same / np.maximum(occupied, 1)
    return np.clip((raw - chance) / (1 - chance), 0, 1)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, texts) of about CHUNK bytes each."""
    ids, column, at = batch.column(0), batch.column(1), 0
    while at < len(column):
        part, size, first = [], 0, at
        while at < len(column) and (not part or size < CHUNK):
            part.append(column[at].as_py())
            size += len(part[-1])
            at += 1
        yield ids.slice(first, at - first), part


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes that lie one after the other; a chunk is far below 2 GB."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def signatures(docs: DataFrame, n_words: int, id_col: str, text_col: str, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n, d1, d2, regs, bands): set size, digest of the set, fine registers, band keys (0 for an empty band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                h, ends = shingle_sets(texts, n_words)
                sizes = np.diff(ends, prepend=0)
                owner = np.repeat(np.arange(len(texts)), sizes)
                x = _mix(h)
                digests = [np.diff(np.concatenate(([np.uint64(0)], np.cumsum(d)))[ends], prepend=np.uint64(0)).view(np.int64) for d in (x, _mix(x ^ _PRIME))]
                regs = _binary(registers(h, owner, len(texts)), np.arange(1, len(texts) + 1) * FINE)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(band_keys(h, owner, len(texts), rows, bands).ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *map(pa.array, digests), regs, keys], ["doc_id", "n", "d1", "d2", "regs", "bands"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    return texts.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, regs binary, bands array<long>")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the hashes of ids, for a first cut without shuffling texts: 2**BITS bits, of which the driver gets at most
    2**BITS / 64 numbers. A crowded one only lets more documents pass."""
    bit = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << BITS) - 1))
    slots = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy()
    return out.view(np.uint8)


def _sets(docs: DataFrame, n_words: int, wanted: DataFrame) -> DataFrame:
    """(doc_id, hashes) of the wanted documents, and of a few others."""
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            held = (sent.value[bit >> 3] >> (bit & 7) & 1).astype(bool)
            for ids, texts in _chunks(batch.select(["doc_id", "t"]).filter(pa.array(held))):
                h, ends = shingle_sets(texts, n_words)
                yield pa.RecordBatch.from_arrays([ids, _binary(h, ends * 8)], ["doc_id", "hashes"])

    bit = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << BITS) - 1))
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t"), bit.alias("bit"))
    return texts.mapInArrow(run, "doc_id long, hashes binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.withColumnsRenamed({"doc_id": "a", "hashes": "ha"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "hashes": "hb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) * 100 >= percent * max(len(p), len(q)) else 0
                keep.append(100 * common >= percent * (len(p) + len(q) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _alike_in_size(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose set sizes cannot reach the similarity. sizes: (doc_id, n)."""
    sizes = sizes.distinct()
    both = pairs.join(sizes.withColumnsRenamed({"doc_id": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"doc_id": "b", "n": "nb"}), "b")
    return both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()


def _plausible(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Drops pairs that their sizes or the estimate rule out. sig: (doc_id, n, regs)."""
    sig = sig.select("doc_id", "n", "regs")
    both = pairs.join(sig.withColumnsRenamed({"doc_id": "a", "n": "na", "regs": "ra"}), "a").join(sig.withColumnsRenamed({"doc_id": "b", "n": "nb", "regs": "rb"}), "b")
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_register_rows(batch.column(k)) for k in (3, 5))
            keep = estimate(a, b) >= percent / 100 - _slack(a, b, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(run, "a long, b long")


def _register_rows(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, f"u{len(data) // (FINE * len(column))}").reshape(-1, FINE)


def _slack(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Wider where few registers are occupied: small sets."""
    occupied = ((a > 0) | (b > 0)).sum(axis=1)
    share = percent / 100
    return SLACK * np.sqrt(share * (1 - share) / 0.16) * np.sqrt(FINE / np.maximum(occupied, 1))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, component), a stored table: the smallest reachable id, by label passing with pointer jumps. Each round is
    a stored table that the next one's replaces."""
    links = links.filter("a <> b")
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    last = stored(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        now = last.select("doc_id", "component")
        near = both.join(now.withColumnsRenamed({"doc_id": "b", "component": "c"}), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("c").alias("c"))
        step = now.join(near, "doc_id").select("doc_id", "component", F.least("component", "c").alias("low"))
        jump = now.select(F.col("doc_id").alias("low"), F.col("component").alias("far"))
        new = stored(step.join(jump, "low").select("doc_id", F.col("component").alias("old"), F.least("low", "far").alias("component")), "labels")
        discard(last)
        last = new
        if new.filter("old <> component").isEmpty():
            break
    out = stored(nodes.select("doc_id").join(last.select("doc_id", "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")), "components")
    discard(both)
    discard(last)
    return out


def _apart(groups: DataFrame, label: DataFrame) -> DataFrame:
    """(key, doc_id, component, main, size, askers) of the rows of a band's groups that hold several components: the
    largest one, the rows in all, and the rows outside the largest, which ask."""
    held = groups.join(label, "doc_id")
    sizes = held.groupBy("key", "component").agg(F.count("*").alias("c"))
    parts = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most")).filter("size > most")
    return held.join(parts.select("key", "main", "size", (F.col("size") - F.col("most")).alias("askers")), "key")


def _few(apart: DataFrame) -> DataFrame:
    """(a, b), once each: every asking row with every row of another component, in groups of at most FEW asking rows, so
    that no row meets more than FEW others in a group."""
    rows = apart.filter(F.col("askers") <= FEW)
    asking = rows.filter("component <> main").select("key", F.col("doc_id").alias("x"), F.col("component").alias("of_x"))
    both = asking.join(rows.select("key", "doc_id", "component"), "key").filter("component <> of_x")
    return both.select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()


def _blocks(apart: DataFrame, regs: DataFrame) -> DataFrame:
    """Blocks (key, p, q) of groups with more asking rows: askers of part p meet answerers of part q, about BLOCK rows
    each, so no group meets in one task. regs: (doc_id, n, regs, bands)."""
    rows = apart.filter(F.col("askers") > FEW).join(regs, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    part = lambda n: (F.floor((F.col(n) - 1) / BLOCK) + 1).cast("int")
    rows = rows.withColumn("k", part("size")).withColumn("kl", part("askers"))
    kept = ["doc_id", "component", "n", "regs", "bands"]
    answers = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("kl") - 1)).alias("p"), F.pmod("h", "k").cast("int").alias("q"), F.lit(False).alias("asks"), *kept)
    asking = rows.filter("component <> main").select("key", F.pmod("h", "kl").cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("q"), F.lit(True).alias("asks"), *kept)
    return answers.unionByName(asking)


def _candidates(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(asking row, rows it may be linked with, their estimates) in one block; a pair counts in its first shared band only."""
    ids, comp, n, asks = (table.column(c).to_numpy() for c in ("doc_id", "component", "n", "asks"))
    regs = _register_rows(table.column("regs").combine_chunks())
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    key = np.int64(table.column("key")[0].as_py()).astype(np.int32)
    there = np.flatnonzero(~asks)
    for x in np.flatnonzero(asks):
        rest = there[(comp[there] != comp[x]) & (100 * np.minimum(n[there], n[x]) >= percent * np.maximum(n[there], n[x]))]
        if len(rest):
            shared = (bands[rest] == bands[x]) & (bands[x] != 0)
            rest = rest[bands[x][shared.argmax(axis=1)] == key]
        if len(rest):
            a = np.broadcast_to(regs[x], (len(rest), FINE))
            likely = estimate(a, regs[rest])
            hit = likely >= percent / 100 - _slack(a, regs[rest], percent)
            if hit.any():
                yield x, rest[hit], likely[hit]


def _confirm_blocks(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components among all candidates of the blocks. Candidates stay packed, one list per asking
    row; the sets of a block's rows come to it once, and it gives one link per asking row and component."""

    def listed(table: pa.Table) -> pa.Table:
        ids, comp = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        askers, partners = [], []
        for x, rest, _ in _candidates(table, percent):
            askers.append(x)
            partners.append(rest.astype(np.int32))
        rest = np.concatenate([np.zeros(0, np.int32), *partners])
        docs = np.unique(np.concatenate([ids[askers], ids[rest]])) if askers else np.zeros(0, np.int64)
        n, block = len(docs) + len(askers), [table.column(c)[0].as_py() for c in ("key", "p", "q")] if table.num_rows else [0, 0, 0]
        # rows of documents have no list, rows of asking documents one each
        ends = np.concatenate((np.zeros(len(docs) + 1, np.int32), np.cumsum([len(x) for x in partners], dtype=np.int32)))
        absent = pa.array(np.arange(n + 1) < len(docs), pa.bool_())
        offsets = pa.array(ends, pa.int32(), mask=absent.to_numpy(zero_copy_only=False))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[rest])) for x in (ids, comp)]
        cols = [pa.array(np.full(n, block[0], np.int64)), *(pa.array(np.full(n, b, np.int32)) for b in block[1:]), pa.array(np.concatenate((docs, ids[askers])).astype(np.int64)), *lists]
        return pa.table(dict(zip(("key", "p", "q", "doc_id", "to", "of"), cols)))

    packed = stored(blocks.groupBy("key", "p", "q").applyInArrow(listed, "key long, p int, q int, doc_id long, to array<long>, of array<long>"), "candidates")
    rows = packed.filter("to IS NULL").join(sets, "doc_id").select("key", "p", "q", "doc_id", "to", "of", "hashes")
    rows = rows.unionByName(packed.filter("to IS NOT NULL").withColumn("hashes", F.lit(None).cast("binary")).select(*rows.columns))

    def check(table: pa.Table) -> pa.Table:
        held, lists, out = {}, [], []
        for doc, to, of, hashes in zip(*(table.column(c) for c in ("doc_id", "to", "of", "hashes")), strict=True):
            if hashes.is_valid:
                held[doc.as_py()] = np.frombuffer(hashes.as_buffer(), np.uint64)
            else:
                lists.append((doc.as_py(), to.values.to_numpy(), of.values.to_numpy()))
        for x, to, of in lists:
            p, linked = held[x], set()
            for y, component in zip(to, of, strict=True):
                if component not in linked:
                    q = held[y]
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * common >= percent * (len(p) + len(q) - common):
                        linked.add(component)
                        out.append((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})

    links = stored(rows.groupBy("key", "p", "q").applyInArrow(check, "a long, b long").distinct(), "links")
    discard(packed)
    return links


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document."""
    if not 1 <= percent <= 100 or n_words < 1:
        raise ValueError("percent must lie between 1 and 100 and n_words be positive")
    docs = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    rows, bands_of = banding(percent)
    sig = stored(signatures(docs, n_words, "doc_id", "text", rows, bands_of), "signatures")
    heads = sig.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    members = stored(sig.select("doc_id", "n", "d1", "d2").join(heads, ["d1", "d2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "members")
    reps = members.filter("n > 0 AND rep = doc_id").select("doc_id")
    bands = sig.select("doc_id", "bands").join(reps, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key")).filter("key <> 0")
    # ends are combined map-side, and a join with a hot key can be split by adaptive execution, which a window can't
    ends = bands.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("c")).filter("low < high")
    grouped = stored(bands.join(ends, "key"), "bands")
    star = grouped.select(F.col("low").alias("a"), F.col("doc_id").alias("b")).union(grouped.select(F.col("doc_id").alias("a"), F.col("high").alias("b"))).filter("a < b").distinct()
    # sizes alone rule out many pairs before any registers are sent
    star = stored(_alike_in_size(star, members.select("doc_id", "n"), percent), "star")
    # registers and sets are fetched only for documents that share a band, and only once
    near = grouped.select("doc_id").distinct()
    # four bytes of a band key tell bands of two rows apart
    regs = stored(sig.select("doc_id", "n", "regs", F.transform("bands", lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int")).alias("bands")).join(near, "doc_id", "left_semi"), "registers")
    discard(sig)
    pairs = stored(_plausible(star, regs, percent), "pairs")
    # a group of up to three is settled by its star, and so are all pairs with the smallest and largest id of a group
    big = stored(grouped.filter("c > 3 AND doc_id <> low AND doc_id <> high").select("key", "doc_id"), "groups")
    discard(grouped)
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(big.select("doc_id")).distinct()
    sets = stored(_sets(docs, n_words, wanted), "sets")
    links = stored(_confirm(pairs, sets, percent), "links")
    discard(pairs)
    nodes = members.filter("n > 0 AND rep = doc_id").select("doc_id")
    label, done = components(nodes, links), [star, regs, big, sets, links]

    def linked(fresh: list[DataFrame]) -> None:
        """Labels anew, if there are new links: components of components, so only links between them are passed on."""
        nonlocal label
        done.extend(fresh)
        new = reduce(DataFrame.union, fresh)
        ends = [label.select(F.col("doc_id").alias(c), F.col("component").alias(f"{c}_of")) for c in "ab"]
        across = stored(new.join(ends[0], "a").join(ends[1], "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).filter("a <> b").distinct(), "across")
        if not across.isEmpty():
            old = label
            top = components(across.select(F.col("a").alias("doc_id")).union(across.select("b")).distinct(), across)
            merged = old.join(top.select(F.col("doc_id").alias("component"), F.col("component").alias("top")), "component", "left")
            label = stored(merged.select("doc_id", F.coalesce("top", "component").alias("component")), "components")
            discard(old)
            discard(top)
        discard(across)

    # pairs across what the stars left apart: where few rows of a group are apart, all of theirs; else all in blocks
    apart = stored(_apart(big, label), "apart")
    done.append(apart)
    few = _alike_in_size(_few(apart).join(star, ["a", "b"], "left_anti"), members.select("doc_id", "n"), percent)
    fresh = [stored(_confirm(_plausible(few, regs, percent), sets, percent), "links")]
    if not apart.filter(F.col("askers") > FEW).isEmpty():
        fresh.append(_confirm_blocks(_blocks(apart, regs), sets, percent))
    linked(fresh)
    for table in done:
        discard(table)
    label = label.withColumnRenamed("doc_id", "rep")
    out = members.filter("doc_id IS NOT NULL").join(label, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    # the smallest id of the class: representatives are the smallest of their copies already
    out = out.groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    unnamed = members.filter("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(unnamed)
