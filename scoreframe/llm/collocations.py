"""Phrase collocation mining by top-order marginalisation.

A text's words get lead columns: each word with the up to three that follow it in its piece, padded where the piece ends.
Only these longest windows are counted; Spark's ROLLUP then sums their successively shorter prefixes, so counts of all
lengths, and each language's number of words, come from one grouping and no other n-grams are exploded.

A floor keeps the windows few, without changing a count that is reported: a phrase that is frequent holds frequent words,
pairs and triples only. Words and pairs are counted by hashes of 40 bits first, then the triples of frequent pairs, and
those that reach the floor set bits of a bitmap of fixed size (``BITS``), which goes to the tasks. A window is padded from
its first pair or triple whose bit is not set; a word that is in no pair of those is counted for its language only. Unlike
hashes that share a bit only keep a window longer than needed, so a crowded bitmap costs shuffled bytes and never a count.
Padded windows are mostly frequent phrases, so they are added up in each task, by numbers that it gives to their words.

Windows are dealt by their first two words, so that the prefixes which ROLLUP sums combine in one task before they are
shuffled. A pair with more than one in ``HOT`` of the counts is dealt by its third word as well. Cuts, containment and
ranks are joins and windows over the frequent phrases: the joins on parts of phrases are between stored tables, so that
adaptive execution can split a part that very many phrases share; ranks are cut in each task first by Spark's group limit.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they
stand; blanks and separators are ASCII only; a language without frequent phrases gives no rows; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scoreframe.llm.common import discard, spread, stored, text_of

BITS = 27  # the bitmap has 2**BITS bits, 16 MB
HOT = 1024
CHUNK = 2 << 20  # bytes of texts that are cut into windows at once
ROWS = 1 << 20  # counted windows that wait in a task to be added up
WORDS = 1 << 20  # words that a task numbers before it starts anew

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t")] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_COUNTED = np.uint64((1 << 40) - 1)  # the bits of a hash by which it is counted


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words: polynomials over their bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    length = np.diff(offsets)
    first = (offsets[:-1] - offsets[0]).astype(np.int64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()), _PRIME, np.uint64))
        place = np.arange(len(data)) - np.repeat(first, length)
        return _mix(np.add.reduceat(_mix(data + np.uint64(1)) * powers[place], first) ^ length.astype(np.uint64))


class _Words:
    """The words of a chunk of texts: ids into its distinct words, languages, and whether the next word is of the same piece."""

    def __init__(self, texts: list[bytes], langs: list[bytes]):
        raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        ends = _ENDS[raw]
        word = ~(ends | _BLANK[raw])
        edge = np.diff(np.concatenate(([0], word.view(np.int8))))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
        flat = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])]).dictionary_encode()
        self.ids, self.words = flat.indices.to_numpy(), flat.dictionary
        self.langs, of_text = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = of_text[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")]
        piece = np.cumsum(ends, dtype=np.int32)[begin]
        self.follows = np.append(piece[1:] == piece[:-1], False) if len(begin) else np.zeros(0, bool)

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word, of it and of each pair with the next word (0 at the end of a piece) with the language."""
        if not len(self.ids):
            return (np.zeros(0, np.uint64),) * 3
        with np.errstate(over="ignore"):
            own = _hashes(self.words)[self.ids]
            one = _mix(own * _PRIME + _hashes(pa.array([x + b"\0" for x in self.langs], pa.binary()))[self.lang])
            two = _mix(one * _PRIME + np.append(own[1:], np.uint64(0)))
        return own, one, np.where(self.follows, two, np.uint64(0))


def _triples(own: np.ndarray, two: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Of each word, the hash of the triple that it begins, where that is of two marked pairs; else 0."""
    with np.errstate(over="ignore"):
        three = _mix(two * _PRIME + np.concatenate((own[2:], np.zeros(min(2, len(own)), np.uint64))))
    return np.where(pair & np.append(pair[1:], False), three, np.uint64(0)) if len(own) else two


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """Chunks of about CHUNK bytes, across batches; a longer text is a chunk of its own."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            texts.append(text.as_py())
            langs.append(lang.as_py())
            size += len(texts[-1])
            if size >= CHUNK:
                yield _Words(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield _Words(texts, langs)


def _part(one: np.ndarray) -> np.ndarray:
    """The hash by which a word is marked as part of a frequent pair."""
    with np.errstate(over="ignore"):
        return _mix(one + _PRIME)


def _reached(texts: DataFrame, hashes, least: int) -> DataFrame:
    """(h, c): the hashes of chunks, by their counted bits, that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            h, c = np.unique(hashes(chunk) & _COUNTED, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return stored(texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least), "frequent")


def _bits(counted: DataFrame) -> np.ndarray:
    """The bitmap of hashes. The driver gets at most 2**BITS / 64 numbers."""
    slots = counted.groupBy(F.shiftright(F.expr(f"h & {(1 << BITS) - 1}"), 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & {(1 << BITS) - 1} & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return out


def _frequent(texts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of the hashes of words, pairs and triples that occur ``least`` times and of the words of those pairs, and
    the sorted hashes of hot pairs, at most HOT."""

    def words_and_pairs(chunk: _Words) -> np.ndarray:
        _, one, two = chunk.hashes()
        return np.concatenate((one, two[two != 0]))

    counted = _reached(texts, words_and_pairs, least)
    total = counted.agg(F.sum("c")).first()[0] or 0
    hot = counted.filter(F.col("c") > total / HOT).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    bitmap = _bits(counted)
    discard(counted)
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def triples_and_parts(chunk: _Words) -> np.ndarray:
        own, one, two = chunk.hashes()
        pair = _held(sent.value, two) & (two != 0)
        three = _triples(own, two, pair)
        return np.concatenate((three[three != 0], _part(one[pair | np.append(False, pair)[: len(pair)]])))

    counted = _reached(texts, triples_and_parts, least)
    bitmap = bitmap | _bits(counted)
    discard(counted)
    return bitmap, np.sort(hot)


def _held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def windows(texts: DataFrame, least: int, longest: int) -> DataFrame:
    """(deal, lang, w1 .. w{longest}, c): the padded longest windows, counted within each task as far as ``ROWS`` and ``WORDS``
    allow."""
    sent = texts.sparkSession.sparkContext.broadcast(_frequent(texts, least))
    names = [f"w{k + 1}" for k in range(longest)]

    def counted(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
        """(a row of each distinct combination, how often it occurs), by dense ranks of ever longer prefixes."""
        key = columns[0].astype(np.int64)
        for column in columns[1:]:
            key = np.unique(key * base + column, return_inverse=True)[1]
        c = np.bincount(key)
        at = np.empty(len(c), np.int64)
        at[key] = np.arange(len(key))
        return at, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {b"": 0}  # the padding is 0
        tongues: dict[bytes, int] = {}
        held, rows, keys = [], 0, ["lang", *names]

        def added() -> pa.Table:
            return pa.Table.from_batches(held).group_by(keys).aggregate([("deal", "min"), ("c", "sum")]).rename_columns([*keys, "deal", "c"])

        def named(table: pa.Table) -> Iterator[pa.RecordBatch]:
            words, langs = pa.array(list(numbers), pa.binary()).cast(pa.string()), pa.array(list(tongues), pa.binary()).cast(pa.string())
            for batch in table.to_batches(max_chunksize=20_000):
                yield pa.RecordBatch.from_arrays([batch["deal"], langs.take(batch["lang"]), *(words.take(batch[name]) for name in names), batch["c"]], ["deal", "lang", *names, "c"])

        for batch in found(batches, numbers, tongues):
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= ROWS or len(numbers) >= WORDS:
                table = added()
                if table.num_rows > 3 * ROWS // 4 or len(numbers) >= WORDS:
                    yield from named(table)
                    table = table.slice(0, 0)
                    numbers.clear()
                    numbers[b""] = 0
                    tongues.clear()
                held, rows = table.combine_chunks().to_batches(), table.num_rows
        if held:
            yield from named(added())

    def found(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int], tongues: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        """Windows of each chunk: words and languages are places in the two tables, which grow with what a window holds."""
        bitmap, hot = sent.value
        for chunk in _chunks(batches):
            own, one, two = chunk.hashes()
            if not len(one):
                continue
            n, size = np.int32(len(chunk.words)), len(one)  # n: the id of the padding
            pair = _held(bitmap, two) & (two != 0)
            triple = _triples(own, two, pair)
            triple = _held(bitmap, triple) & (triple != 0)

            def batch(where: np.ndarray, lead: list[np.ndarray], deal: np.ndarray) -> pa.RecordBatch:
                at, c = counted([chunk.lang[where], *lead], int(n) + 1)
                lang, lead = chunk.lang[where][at], [x[at] for x in lead]
                number = np.zeros(int(n) + 1, np.int32)
                used = np.unique(np.concatenate(lead))
                used = used[used != n]
                number[used] = [numbers.setdefault(w, len(numbers)) for w in chunk.words.take(pa.array(used)).to_pylist()]
                tongue = np.array([tongues.setdefault(x, len(tongues)) for x in chunk.langs], np.int32)
                words = [number[x] for x in lead] + [np.zeros(len(at), np.int32)] * (longest - len(lead))
                return pa.RecordBatch.from_arrays([pa.array(tongue[lang]), *map(pa.array, words), pa.array((deal[at] >> np.uint64(48)).astype(np.int32)), pa.array(c.astype(np.int64))], ["lang", *names, "deal", "c"])

            alone = np.flatnonzero(~pair)
            if len(alone):
                yield batch(alone, [np.where(_held(bitmap, _part(one[alone])), chunk.ids[alone], n)], one[alone])
            begin = np.flatnonzero(pair)
            if not len(begin):
                continue
            pad = np.zeros(longest, np.int32)
            ids, joined, hashes = np.append(chunk.ids, pad), np.append(triple, pad.astype(bool)), np.append(own, pad.astype(np.uint64))
            lead, on = [chunk.ids[begin]], np.ones(len(begin), bool)
            for k in range(1, longest):
                if k > 1:
                    on &= joined[begin + k - 2]
                lead.append(np.where(on, ids[begin + k], n))
            third = np.isin(two[begin] & _COUNTED, hot) & joined[begin] & (longest > 2)
            yield batch(begin, lead, _mix(two[begin] ^ np.where(third, hashes[begin + 2], np.uint64(0))))

    # up to four splits a task, if two tasks a core remain: the more of them share a task, the fewer rows are shuffled
    n = texts.rdd.getNumPartitions()
    texts = texts.coalesce(max(min(n, 2 * texts.sparkSession.sparkContext.defaultParallelism), n // 4))
    return texts.mapInArrow(run, f"deal int, lang string, {', '.join(f'{n} string' for n in names)}, c long")


def phrase_counts(docs: DataFrame, least: int, longest: int = 4, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, k, words, phrase, f): phrases of k words that occur at least ``least`` times, single words if a frequent pair
    holds them; k = 0 is the language itself, with all its words in f."""
    texts = spread(docs.select(F.encode(text_of(text_col), "UTF-8").alias("t"), F.encode(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), "UTF-8").alias("lang")))
    names = [f"w{k + 1}" for k in range(longest)]
    top = windows(texts, least, longest).repartition("deal").groupBy("deal", "lang", *names).agg(F.sum("c").alias("f"))
    k = longest - 1 - F.expr("bit_count(gid)").cast("int")  # a bit of the rollup for each column that is summed over
    rolled = top.rollup("lang", *names[:-1]).agg(F.sum("f").alias("f"), F.grouping_id().alias("gid")).withColumn("k", k).filter("k >= 0")
    held = rolled.select("lang", "k", F.slice(F.array(*names[:-1]), 1, F.col("k")).alias("words"), "f")
    held = held.filter((F.col("k") == 0) | (F.get("words", F.col("k") - 1) != ""))
    # on the sum, so that it can't move below the exchange, which both sides share
    full = top.filter(F.when(F.col("f") >= least, F.col(names[-1])) != "").select("lang", F.lit(longest).alias("k"), F.array(*names).alias("words"), "f")
    return held.unionByName(full).filter((F.col("k") == 0) | (F.col("f") >= least)).select("lang", "k", "words", F.array_join("words", " ").alias("phrase"), "f")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, first: int = 2000, share: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by score. A phrase with a occurrences whose
    parts have l and r scores 2,000,000 a div (l + r) at its worst cut; phrases that stand inside a longer one which has at
    least ``share`` hundredths of their occurrences are dropped."""
    counts = stored(phrase_counts(docs, least, longest, text_col, lang_col), "phrases")
    phrases = counts.filter("k >= 2").withColumnRenamed("f", "a")
    part = counts.filter("k >= 1").select("lang", "phrase", "f")
    cuts = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("left"), F.expr("array_join(slice(words, cut + 1, size(words)), ' ')").alias("right"))
    cuts = cuts.join(part.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"]).join(part.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div cast(l + r as decimal(20, 0))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"), F.first("a").alias("a"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), b -> array_join(slice(words, b, s), ' '))))")
    longer = phrases.filter("k >= 3").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    free = best.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    flat = free.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = flat.withColumn("rank", nth).filter(F.col("rank") <= first)
    n = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
e AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(k)),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM e),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (SELECT c.*, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score FROM c
      JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.cut], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND 100 * f.f >= 80 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' '))),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT q.lang, q.rank, phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""
