"""Suffix-array dedup: removes every byte covered by a ``least``-byte string that also starts earlier.

Candidates. In each window of ``least`` bytes the smallest hash of its ``GRAM``-byte grams is the window's anchor
(leftmost on ties). Equal windows have equal anchors at equal places, so only windows whose anchor's hash occurs more
than once can repeat; they are cut out as fragments around their anchors and meet by that hash. Each task combines its
own rows first: of an anchor that it sees several times it sends one row to the others, and of equal fragments the
earliest, so no key receives more rows than there are tasks, however common a line is. Fragments of an anchor that is
frequent in a sample of documents (at most ``HEAVY`` of them) are dealt out by the bytes that ``STEP`` neighbouring
windows have in common. That only chooses where fragments meet; all are decided alike.

Decision. Fragments are first trimmed to what they share with another one on either side of their anchor, and those too
short for a window go. Equal ones become one string with its owners. The Burrows-Wheeler transform of a block of these
strings is taken, and breadth-first backward extension over its intervals finds the longest common prefixes of
neighbouring suffixes by increasing value; it stops at ``least``, so boundaries still unset then separate nothing: the
suffixes between two set boundaries begin with the same ``least`` bytes. All of their owners but the earliest repeat.

Defined cases: null is the empty text; texts shorter than ``least`` bytes stay whole; an empty table gives no rows. Rows
with a null doc_id, or a doc_id that other rows have, are documents of their own: nulls come first, rows of one id in
the order of a hash of their texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from scoreframe.llm.common import spread, stored

GRAM = 24
STEP = 10  # windows that are dealt out together where an anchor is frequent
HEAVY = 1 << 16  # frequent anchors that are told apart, at most: 512 KB in every task
FREQUENT = 512  # times that such an anchor occurs in the sample
SAMPLE = 32  # one document in so many is in the sample
BLOCK = 1 << 20  # bytes of fragments that are decided together
CHUNK = 1 << 20  # bytes that are hashed at once; below 2**24, as places have 24 bits
COMBINE = 1 << 19  # anchors that a task combines at once
SEEN = 1 << 18  # fragments that a task remembers
ROWS = 1 << 13  # fragments of a batch
APPLIED = 1 << 22  # bytes of texts of a batch of results

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def anchors(texts: list[bytes], least: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(text, place, hash, first window, last window) of each anchor: runs of windows with one smallest gram."""
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw) - GRAM + 1
    span = least - GRAM + 1
    if n < span:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    up, down = powers
    if len(up) <= len(raw):
        up, down = _powers(_BASE, len(raw) + 1), _powers(_INVERSE, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = _mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])
    low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)  # by window start
    ends = np.cumsum(sizes)
    starts = ends - sizes
    valid = np.zeros(len(place) + 1, np.int32)
    has = sizes >= least
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, np.minimum(ends[has] - least + 1, len(place)), -1)
    windows = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(windows):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = place[windows]
    text = np.searchsorted(ends, windows, "right")
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    text, at, a, b = text[first], at[first], windows[first], windows[last]
    off = starts[text]
    return text, at - off, h[at].view(np.int64), a - off, b - off


def _pieces(part: list[bytes], least: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts as (index, offset, bytes), those beyond a chunk in pieces that overlap by one window less a byte."""
    if sum(map(len, part)) <= CHUNK:
        yield [(i, 0, t) for i, t in enumerate(part)]
        return
    for i, t in enumerate(part):
        for at in range(0, max(1, len(t) - least + 1), CHUNK - least + 1):
            yield [(i, at, t[at : at + CHUNK])]


def _anchor_columns(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(h, doc_id, at) of the anchors in batches of (doc_id, bytes); at packs the place, the distance back to the first
    window and the number of windows less one."""
    powers = _powers(_BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)
    for batch in batches:
        ids, column, k = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), 0
        while k < len(column):
            part, size, first = [], 0, k
            while k < len(column) and (not part or size < CHUNK // 2):
                part.append(column[k].as_py())
                size += len(part[-1])
                k += 1
            for piece in _pieces(part, least):
                text, place, h, a, b = anchors([t for _, _, t in piece], least, powers)
                if len(text):
                    shift = np.array([s for _, s, _ in piece], np.int64)
                    owner = np.array([i for i, _, _ in piece], np.int64)
                    yield h, ids[first + owner[text]].astype(np.int64), ((place + shift[text]) << 16) | ((place - a) << 8) | (b - a)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _frequent(texts: DataFrame, least: int) -> np.ndarray:
    """Sorted hashes of the anchors that occur ``FREQUENT`` times in the sample, the ``HEAVY`` most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _, _ in _anchor_columns(batches, least):
            yield _batch({"h": h})

    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    found = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= FREQUENT)
    return np.sort(np.array([r["h"] for r in found.orderBy(F.desc("c"), "h").limit(HEAVY).collect()], np.int64))


def _shared_spots(texts: DataFrame, least: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, at) of the anchors whose hash occurs more than once; at is doubled, plus 1 for a frequent anchor."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State 0: alone here; 1: the first of several here; 2: another of these, which asks nobody."""

        def combined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            h, doc, at = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            state = np.empty(len(h), np.int8)  # rows stay in their documents' order, which packs better
            state[order] = np.where(np.append(False, same), 2, np.where(np.append(same, False), 1, 0))
            at = (at << 1) | np.isin(h, frequent)
            elsewhere = _mix((doc ^ (at << 20)).view(np.uint64)).view(np.int64)
            return _batch({"h": np.where(state == 2, elsewhere, h), "doc_id": doc, "at": at, "state": state})

        held, n = [], 0
        for columns in _anchor_columns(batches, least):
            held.append(columns)
            n += len(columns[0])
            if n >= COMBINE:
                yield combined(held)
                held, n = [], 0
        if held:
            yield combined(held)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int8)]  # rows of the last hash
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            known = columns[3] == 2
            yield _batch({"doc_id": columns[1][known], "at": columns[2][known]})
            h, doc, at, state = (np.concatenate((x, c[~known])) for x, c in zip(left, columns, strict=True))
            last = int(np.searchsorted(h, h[-1])) if len(h) else 0
            left = [c[last:] for c in (h, doc, at, state)]
            yield _several(h[:last], doc[:last], at[:last], state[:last])
        yield _several(*left)

    spots = texts.mapInArrow(send, "h long, doc_id long, at long, state byte")
    return spots.repartition("h").sortWithinPartitions("h").mapInArrow(shared, "doc_id long, at long")


def _several(h: np.ndarray, doc: np.ndarray, at: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    same = h[1:] == h[:-1]
    keep = (state == 1) | np.concatenate(([False], same))[: len(h)] | np.append(same, False)[: len(h)]
    return _batch({"doc_id": doc[keep], "at": at[keep]})


def _key(piece: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)


def _fragments(joined: DataFrame, least: int) -> DataFrame:
    """(key, doc_id, start, core, fragment) from (doc_id, bytes, spots), in which rows come by doc_id. core packs the place
    and the size of the bytes that fragments of one key have in common. A null fragment is a span of core bytes that
    equals an earlier fragment of its task, which stands for it."""

    def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], ["key", "doc_id", "start", "core", "fragment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        rows: list[tuple] = []
        for batch in batches:
            for doc, text, spots in zip(*(batch.column(k) for k in range(3)), strict=True):
                if not spots.is_valid:
                    continue
                doc, text = doc.as_py(), text.as_py()
                packed = np.unique(spots.values.to_numpy(zero_copy_only=False))
                at = packed >> 1
                places = at >> 16
                starts = places - ((at >> 8) & 255)
                lasts = starts + (at & 255)
                known: list[list[int]] = []  # merged spans of this text that repeat

                def repeats(a: int, b: int) -> bool:
                    if text[a:b] not in seen:
                        return False
                    if known and a <= known[-1][1]:
                        known[-1][:] = min(known[-1][0], a), max(known[-1][1], b)
                    else:
                        known.append([a, b])
                    return True

                for often, place, start, last in zip((packed & 1).tolist(), places.tolist(), starts.tolist(), lasts.tolist(), strict=True):
                    if repeats(start, last + least):
                        continue
                    if not often:
                        seen.add(text[start : last + least])
                        rows.append((_key(text[place : place + GRAM]), doc, start, (place - start) << 9 | GRAM, text[start : last + least]))
                        continue
                    for back in range((place - last) // STEP * STEP, place - start + 1, STEP):
                        # windows that start back to back + STEP - 1 bytes before the anchor share what lies between
                        a, b = max(start, place - back - STEP + 1), min(last, place - back)
                        core = text[place - back : place - back - STEP + 1 + least]
                        if len(core) == least - STEP + 1 and not repeats(a, b + least):
                            rows.append((_key(core), doc, a, (place - back - a) << 9 | len(core), text[a : b + least]))
                            seen.add(text[a : b + least])
                    seen.add(text[start : last + least])
                rows += [(hash((doc, a)), doc, a, b - a, None) for a, b in known]
                if len(seen) > SEEN:
                    seen.clear()
                if len(rows) >= ROWS:
                    yield packed_rows(rows)
                    rows = []
        yield packed_rows(rows)

    return joined.mapInArrow(run, "key long, doc_id long, start long, core int, fragment binary")


def shared_extents(key: np.ndarray, raw: np.ndarray, off: np.ndarray, size: np.ndarray, back: np.ndarray, core: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most bytes before and after its core that a fragment shares with another one of its key, -1 if it has none."""
    out = []
    for room, at, way in ((back, off + back - 1, -1), (size - back - core, off + back + core, 1)):
        room = np.minimum(room, width)
        place = np.clip(at[:, None] + way * np.arange(width), 0, len(raw) - 1)
        side = np.where(np.arange(width) < room[:, None], raw[place], 0).astype(np.uint8)
        order = np.argsort(np.concatenate([key.astype(">i8").view(np.uint8).reshape(-1, 8), side], axis=1).view(f"S{8 + width}").ravel())
        side, room, by = side[order], room[order], key[order]
        unlike = side[1:] != side[:-1]
        common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
        common = np.where(by[1:] == by[:-1], np.minimum(common, np.minimum(room[1:], room[:-1])), -1)
        best = np.maximum(np.append(-1, common), np.append(common, -1))
        found = np.empty(len(key), np.int64)
        found[order] = best
        out.append(found)
    return out[0], out[1]


def _gather(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pieces' bytes one after the other, each plus 1 and followed by a 0; where each piece begins in them)."""
    to = np.cumsum(size + 1) - size - 1
    out = np.zeros(int((size + 1).sum()), np.int64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + inside] = raw[np.repeat(begin, size) + inside].astype(np.int64) + 1
    return out, to


def sorted_rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the cyclic suffixes, sorted by at least ``depth`` symbols (below 512) by prefix doubling."""
    n, width = len(text), 7
    bits = n.bit_length()
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << 9) | np.roll(text, -k)
    order = np.argsort(key)
    ranked = key[order]
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if width >= depth or rank[order[-1]] == n - 1:
            return order
        key = (rank << bits) | np.roll(rank, -width)
        if bits <= 21:  # ranks and place fit in one number
            key = np.sort((key << bits) | np.arange(n))
            order, ranked = key & ((1 << bits) - 1), key >> bits
        else:
            order = np.argsort(key)
            ranked = key[order]
        width *= 2


def equal_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, boundary before each place of it): suffixes without a boundary between them begin with the same
    ``least`` symbols. Intervals of the Burrows-Wheeler transform are extended backward, breadth first: at level l all
    intervals of strings of l symbols whose end was new at that level give those of l + 1 symbols, and the place after
    such an interval has a longest common prefix of l, if no smaller one was found before."""
    n = len(text)
    order = sorted_rotations(text, least)
    bwt = text[order - 1].astype(np.uint16)
    by_char = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # last-to-first mapping
    step[by_char] = np.arange(n)
    first = bwt[by_char]
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for level in range(least):
        size = high - low + 1
        total = int(size.sum())
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(total)
        owner = np.repeat(np.arange(len(low)), size)
        to = step[at]
        if total * 16 > n:
            held = np.full(n, -1, np.int64)
            held[to] = owner
            there = np.flatnonzero(held >= 0)
            owner = held[there]
            to = there
        else:
            by = np.argsort(to)
            to, owner = to[by], owner[by]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (to[1:] != to[:-1] + 1) | (first[to[1:]] != first[to[:-1]])))
        start = np.flatnonzero(new)
        left, right = to[start], to[np.append(start[1:], len(to)) - 1]
        fresh = ~cut[right + 1]
        if level == 0:  # the last interval's end is the text's, but its strings go on
            fresh |= right + 1 == n
        cut[right[fresh] + 1] = True
        low, high = left[fresh], right[fresh]
        if not len(low):
            break
    return order, cut[:n]


Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def _runs(doc: np.ndarray, start: np.ndarray, least: int) -> Spans:
    """Windows (doc, start) as merged spans (doc, start, stop)."""
    if not len(doc):
        return doc, start, start
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    at = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)))[: len(doc)])
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], start[last] + least


def _later(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, least: int) -> Spans:
    """Spans of these distinct strings' windows that begin with the same bytes as an earlier window."""
    if not len(begin):
        return begin, begin, begin
    text, to = _gather(raw, begin, size)
    order, cut = equal_prefixes(text, least)
    piece = np.searchsorted(to, order, "right") - 1
    inside = order + least <= (to + size)[piece]
    group = np.cumsum(cut)[inside]
    piece, order = piece[inside], order[inside]
    where, place = doc[piece], order - to[piece] + start[piece]
    by = np.lexsort((place, where, group))
    again = np.concatenate(([False], group[by][1:] == group[by][:-1]))[: len(by)]
    return _runs(where[by][again], place[by][again], least)


def _by_window(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The strings' windows as (string, offset) in parts by the windows' hashes: equal ones are in one part."""
    string = np.repeat(np.arange(len(size)), size - least + 1)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(size - least + 1) - size + least - 1, size - least + 1)
    h = np.zeros(len(string), np.uint64)
    for k in range(least):
        h = _mix(h + raw[begin[string] + offset + k].astype(np.uint64) + np.uint64(_BASE))
    part = (h % np.uint64(parts)).astype(np.int64)
    for p in range(parts):
        yield string[part == p], offset[part == p]


def repeats(key: np.ndarray, doc: np.ndarray, start: np.ndarray, back: np.ndarray, core: np.ndarray, size: np.ndarray, raw: np.ndarray, least: int) -> Iterator[Spans]:
    """Spans (doc, start, stop) of the windows of these fragments that begin with the same bytes as an earlier window.
    Fragments lie one after the other in raw; back and core tell what those of one key have in common."""
    off = np.cumsum(size) - size
    left, right = shared_extents(key, raw, off, size, back, core, least - GRAM)
    keep = (left >= 0) & (left + core + right >= least)
    key, doc = key[keep], doc[keep]
    begin, start, size = (off + back - left)[keep], (start + back - left)[keep], (left + core + right)[keep]
    if not len(key):
        return
    # equal strings of a key become one, with its owners
    width = int(size.max())
    inside = np.arange(width) < size[:, None]
    wide = np.where(inside, raw[np.minimum(begin[:, None] + np.arange(width), len(raw) - 1)], 0).astype(np.uint8)
    wide = np.concatenate([key.astype(">i8").view(np.uint8).reshape(-1, 8), size.astype(">i4").view(np.uint8).reshape(-1, 4), wide], axis=1)
    order = np.argsort(wide.view(f"S{12 + width}").ravel())
    string = np.empty(len(key), np.int64)
    string[order] = np.cumsum(np.concatenate(([False], (wide[order][1:] != wide[order][:-1]).any(axis=1))))
    by = np.lexsort((start, doc, string))
    first = np.concatenate(([True], string[by][1:] != string[by][:-1]))
    others = by[~first]
    yield doc[others], start[others], (start + size)[others]
    lead = by[first]
    begin, size, doc, start = begin[lead], size[lead], doc[lead], start[lead]
    if size.sum() <= 4 * BLOCK:
        yield _later(raw, begin, size, doc, start, least)
        return
    for s, o in _by_window(raw, begin, size, least, int((size - least + 1).sum()) * least // BLOCK + 1):
        yield _later(raw, begin[s] + o, np.full(len(s), least), doc[s], start[s] + o, least)


def _decide(fragments: DataFrame, least: int) -> DataFrame:
    """(doc_id, start, stop) spans that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def decided(last: bool) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = len(columns[0]) if last else int(np.searchsorted(columns[0], columns[0][-1]))
            ends = int(columns[5][:cut].sum())
            held.clear()
            if cut < len(columns[0]):
                held.append((*(c[cut:] for c in columns[:6]), columns[6][ends:]))
            if cut:
                for spans in repeats(*(c[:cut] for c in columns[:6]), columns[6][:ends], least):
                    yield _batch(dict(zip(("doc_id", "start", "stop"), spans, strict=True)))

        for batch in batches:
            known = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            key, doc, start, core = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            yield _batch({"doc_id": doc[known], "start": start[known], "stop": (start + core)[known]})
            pieces = batch.column(4).drop_null().to_pylist()
            raw = np.frombuffer(b"".join(pieces), np.uint8)
            sizes = np.array([len(x) for x in pieces], np.int64)
            held.append((key[~known], doc[~known], start[~known], (core >> 9)[~known].astype(np.int64), (core & 511)[~known].astype(np.int64), sizes, raw))
            size += len(raw)
            if size >= BLOCK:
                yield from decided(False)
                size = sum(len(h[6]) for h in held)
                size = size if size < BLOCK else 0  # a key beyond a block is looked at again after another block
        if held:
            yield from decided(True)

    return fragments.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, start long, stop long")


def _rows(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(doc_id, bytes, id, carried columns): doc_id is the row's number in order where ids are null, not unique or no integers."""
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("c"))
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("bytes")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text, F.col(id_col).alias("id"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    if isinstance(docs.schema[id_col].dataType, IntegralType) and ids.filter("c > 1 OR id IS NULL").isEmpty():
        return rows
    ordered = rows.orderBy(F.asc_nulls_first("id"), F.xxhash64("bytes"), F.length("bytes"))
    return stored(ordered.withColumn("doc_id", F.monotonically_increasing_id()), "numbered")


def remove_repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row; kept are the remaining bytes, with ``whole`` without characters
    that were cut in half. Carried columns follow."""
    if not GRAM + STEP <= least <= 256:
        raise ValueError(f"least must lie between {GRAM + STEP} and 256")
    rows = spread(_rows(docs, id_col, text_col, carry))
    more = [c for c in rows.columns if c not in ("doc_id", "bytes")]
    texts = rows.select("doc_id", "bytes")
    by_doc = rows.repartition("doc_id")
    shared = _shared_spots(texts, least, _frequent(texts, least))
    # dealt out as plain rows: lists made before the shuffle would be several times as large
    shared = shared.repartition("doc_id").groupBy("doc_id").agg(F.collect_list("at").alias("spots"))
    # left joins on all uses of by_doc: an inner one would filter its keys first and deal the texts out again
    joined = by_doc.join(shared, "doc_id", "left").select("doc_id", "bytes", "spots", *more).sortWithinPartitions("doc_id")
    found = _decide(_fragments(joined, least), least).repartition("doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    both = by_doc.join(found, "doc_id", "left").select("doc_id", "bytes", "found", *more)
    names = ["n_bytes", "n_removed", "n_spans", "kept", *more]

    def packed(out: list[tuple], batch: pa.RecordBatch, done: int) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), *(c.slice(done, len(out)) for c in batch.columns[3:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size, done = [], 0, 0
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                text, merged = text.as_py(), []
                for s in sorted((x["start"], x["stop"]) for x in found.as_py() or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, at = [], 0
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join((*kept, text[at:]))
                gone = len(text) - len(kept)
                out.append((len(text), gone, len(merged), kept.decode("utf-8", "ignore").encode() if whole and gone else kept))
                size += len(text)
                if size >= APPLIED:
                    yield packed(out, batch, done)
                    done, out, size = done + len(out), [], 0
            yield packed(out, batch, done)

    types = dict(rows.dtypes)
    schema = ", ".join(["n_bytes long, n_removed long, n_spans long, kept binary", *(f"{c} {types[c]}" for c in more)])
    out = both.mapInArrow(run, schema)
    return out.select(F.col("id").alias("doc_id"), *names[:4], *(F.col(f"_{k}").alias(f"carried_{c}") for k, c in enumerate(carry)))


def cut_texts(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeats cut out of the text (characters cut in half go as well) and n_chars, if it is there, set
    anew. Rows of which nothing is left go; rows without text stay."""
    carry = tuple(c for c in docs.columns if c != text_col)
    out = remove_repeats(docs, least, id_col, text_col, carry, whole=True).filter("n_bytes = 0 OR n_removed < n_bytes")
    out = out.select(*(F.col(f"`carried_{c}`").alias(c) for c in carry), F.decode("kept", "UTF-8").alias(text_col))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
