"""Ranked lexical search over bit-sliced Bloom signatures, with exact scores.

``index`` packs documents of about equal numbers of distinct terms into blocks. A block is a table of bits: a row (slice)
for each signature bit, a column for each document. A document sets ``PROBES`` bits for each term and level, level j if
the term occurs at least 2**j times in it; so the AND of a term's slices is a bitmap of the documents that may hold it
that often, never too few. The bounds of a query's terms, weighted and summed over the slices of all levels, are no less
than the scores.

``search`` takes the best bounds of each query first, scores those documents exactly and so has a floor under the query's
k-th score; then every document whose bound reaches the floor is scored exactly from its text. None is left out that is
not provably below, so the result is that of scoring everything.

Queries are taken in blocks of at most ``TERMS`` terms (a longer query is a block of its own), each sent to all tasks;
per task and query k rows at most are kept before any shuffle. Document frequencies are counted of the queries' terms only,
if those are at most ``TERMS``; else of all, with map-side combining, before they meet the queries' terms.

Defined cases: null and empty texts have no terms and score nothing; repeated rows of a doc_id are documents of their own,
counted and ranked as often as they stand; a null doc_id comes last among equal scores; a query without terms, or whose
terms no document holds, has no rows; rows of one query id are one query with
the terms of all;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm.common import discard, spread, stored, text_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROBES = 3
PER_TERM = 10  # bits of a signature for each term and level of its longest document
LEVELS = 6  # a term counts as occurring once, twice, 4, 8, 16 or 32 times
BLOCK = 1024  # documents of a block at most
BLOCK_BITS = 1 << 25  # bits of a block at most, unless eight documents have more
HELD = 4 << 20  # terms that wait in a task for their block to fill
TERMS = 200_000  # terms of a block of queries
SLAB = 4096  # terms whose bounds are held at once
_TERM = re.compile(TERM)


def terms_of(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower() if text.isascii() else text.translate(FOLD)))


def _hashes(terms: list[str], level: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(t.encode(), level) for t in terms), np.uint64, len(terms))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """The slices of each hash: PROBES numbers below ``bits``, a power of two, from its two halves."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int32)


def _level(times: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(times.astype(np.float64))[1] - 1, LEVELS - 1)


_BLOCKS = "bits int, ids array<long>, marks array<long>, n array<long>, most array<long>, slices binary"


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block: signature bits, the documents' ids and text hashes, their numbers of terms, the occurrences of
    their most frequent term, and the slices, one after the other. Documents without terms are in no block."""

    def block(bits: int, held: list) -> pa.RecordBatch:
        slices = np.zeros((bits, 8 * ((len(held) + 7) // 8)), bool)
        for d, x in enumerate(held):
            slices[x[4], d] = True
        columns = [pa.array([[x[k] for x in held]], pa.list_(pa.int64())) for k in range(4)]
        packed = np.packbits(slices, axis=1, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([bits], pa.int32()), *columns, pa.array([packed], pa.binary())], ["bits", "ids", "marks", "n", "most", "slices"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = {}, Counter()
        for batch in batches:
            for doc, mark, text in zip(*(batch.column(k) for k in range(3))):
                counts = terms_of(text.as_py())
                if not counts:
                    continue
                terms, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                level = _level(times)
                entries = int((level + 1).sum())
                bits = 64 << (max(0, PER_TERM * entries - 1) // 64).bit_length()
                h = [_hashes(terms if j == 0 else [terms[k] for k in np.flatnonzero(level >= j)], j) for j in range(int(level.max()) + 1)]
                waiting.setdefault(bits, []).append((doc.as_py(), mark.as_py(), int(times.sum()), int(times.max()), _places(np.concatenate(h), bits).ravel()))
                size[bits] += entries
                if len(waiting[bits]) >= min(BLOCK, max(8, BLOCK_BITS // bits)):
                    yield block(bits, waiting.pop(bits))
                    del size[bits]
                elif size.total() > HELD:
                    most = size.most_common(1)[0][0]
                    yield block(most, waiting.pop(most))
                    del size[most]
        for bits, held in sorted(waiting.items()):
            yield block(bits, held)

    return _marked(docs, id_col, text_col).mapInArrow(run, _BLOCKS)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text): the mark tells rows with the same id apart, unless they have the same text as well."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))


def _tokens(text_col: str):
    """The distinct terms of a text, on the JVM side. Case is folded once per distinct term: ``lower`` where all is ASCII, else
    ``translate``, which is slow and lower-cases A-Z only."""
    found = F.array_distinct(F.regexp_extract_all(text_of(text_col), F.lit(TERM), F.lit(0)))
    fold = lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_distinct(F.transform(found, fold))


def weighted_queries(docs: DataFrame, blocks: DataFrame, queries: DataFrame, query_id: str, query_text: str, text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(item, terms: array of (term, w)), and the documents with terms and all their terms. Document frequencies are exact."""
    total = blocks.agg(F.sum(F.size("ids")).alias("N"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("L")).first()
    asked = queries.select(F.col(query_id).alias("item"), F.explode(_tokens(query_text)).alias("term")).distinct()
    held, wanted = docs.select(F.explode(_tokens(text_col)).alias("term")), asked.select("term").distinct()
    if wanted.limit(TERMS + 1).count() <= TERMS:  # other terms are left out before they are counted
        held = held.join(F.broadcast(wanted), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    known = asked.join(df, "term")
    w = F.floor(1000 * F.log(F.lit(2.0 * (total.N or 0) + 2) / (2 * F.col("df") + 1)))
    out = known.groupBy("item").agg(F.collect_list(F.struct("term", w.cast("long").alias("w"))).alias("terms"))
    return out, total.N or 0, total.L or 0


def _query_blocks(weighted: DataFrame) -> Iterator[list]:
    """Blocks of (item, [(term, w)]) of at most TERMS terms, or one query: the driver holds one block at a time."""
    held, size = [], 0
    for row in weighted.orderBy("item").toLocalIterator():
        if held and size + len(row.terms) > TERMS:
            yield held
            held, size = [], 0
        held.append((row.item, [(t.term, t.w) for t in row.terms]))
        size += len(row.terms)
    if held:
        yield held


def _share(times, m):
    """A term's share of its weight: grows with its occurrences."""
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def _bounds(row: dict, hashes: list[np.ndarray], uses: list[list], n_items: int, total_terms: int, n_docs: int) -> np.ndarray:
    """Upper bounds of the scores, items by documents of a block: weighted sums of the slices of each term and level."""
    n, most, bits = np.array(row["n"], np.int64), np.array(row["most"], np.int64), row["bits"]
    m = 10 + (90 * n * n_docs) // total_terms
    slices = np.frombuffer(row["slices"], np.uint8).reshape(bits, -1)
    reach = [_share(np.minimum(most, (1 << (j + 1)) - 1) if j < LEVELS - 1 else most, m) for j in range(LEVELS)]
    steps = [reach[0], *(b - a for a, b in zip(reach, reach[1:]))]  # never negative: a share grows with its occurrences
    out = np.zeros((n_items, len(n)), np.int64)
    for low in range(0, len(uses), SLAB):
        alive = np.arange(low, min(low + SLAB, len(uses)))
        shares = np.zeros((len(alive), len(n)), np.int64)
        for j in range(LEVELS):
            maps = np.bitwise_and.reduce(slices[_places(hashes[j][alive], bits)], axis=1)
            some = maps.any(axis=1)
            alive = alive[some]
            if not len(alive):
                break
            shares[alive - low] += np.unpackbits(maps[some], axis=1, bitorder="little")[:, : len(n)] * steps[j]
        for k in np.flatnonzero(shares.any(axis=1)):
            for item, w in uses[low + k]:
                out[item] += w * shares[k]
    return out


def _candidates(blocks: DataFrame, sent, k: int, floors=None) -> DataFrame:
    """(item, doc_id, mark, bound): with floors all documents that reach them, else the k best bounds of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term, n_items, total, n_docs = sent.value
        hashes, uses = [_hashes(list(by_term), j) for j in range(LEVELS)], list(by_term.values())
        best: list[list] = [[] for _ in range(n_items)]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["item", "doc_id", "mark", "bound"])
        for batch in batches:
            for row in batch.to_pylist():
                bounds = _bounds(row, hashes, uses, n_items, total, n_docs)
                if floors is not None:
                    items, at = np.nonzero(bounds >= floors.value[:, None])
                    if len(items):
                        yield give([(int(i), row["ids"][d], row["marks"][d], int(bounds[i, d])) for i, d in zip(items, at)])
                    continue
                for i in range(n_items):
                    at = np.argpartition(-bounds[i], k - 1)[:k] if bounds.shape[1] > k else np.arange(bounds.shape[1])
                    new = [(int(bounds[i, d]), row["marks"][d], row["ids"][d]) for d in at if bounds[i, d] > 0]
                    best[i] = sorted(best[i] + new, key=lambda x: -x[0])[:k]
        if floors is None and any(best):
            yield give([(i, d, mark, bound) for i, rows in enumerate(best) for bound, mark, d in rows])

    return blocks.mapInArrow(run, "item int, doc_id long, mark long, bound long")


def _scored(candidates: DataFrame, marked: DataFrame, sent) -> DataFrame:
    """(item, doc_id, score) of candidates, from the whole texts, in whole numbers. A document's items are one row: at
    most as many as a block of queries holds."""
    asked = candidates.groupBy("doc_id", "mark").agg(F.collect_set("item").alias("items")).withColumnsRenamed({"doc_id": "d", "mark": "m"})
    both = marked.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term, n_items, total, n_docs = sent.value
        of_item: list[dict] = [{} for _ in range(n_items)]
        for term, uses in by_term.items():
            for item, w in uses:
                of_item[item][term] = w
        for batch in batches:
            rows = []
            for doc, text, items in zip(*(batch.column(k) for k in range(3))):
                counts = terms_of(text.as_py())
                m = 10 + 90 * sum(counts.values()) * n_docs // total
                for item in items.as_py():
                    weights = of_item[item]
                    score = sum(w * _share(counts[t], m) for t, w in weights.items() if t in counts)
                    rows.append((item, doc.as_py(), score))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return both.mapInArrow(run, "item int, doc_id long, score long").filter("score > 0")


def _best(scored: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return scored.withColumn("rank", nth).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k highest-scoring documents of each query with a score above 0."""
    spark = docs.sparkSession
    docs = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    blocks = stored(index(docs), "bloom-blocks")
    weighted, n_docs, total = weighted_queries(docs, blocks, queries, query_id, query_text)
    weighted = stored(weighted, "weighted-queries")
    marked, out = _marked(docs, "doc_id", "text"), None
    for held in _query_blocks(weighted):
        by_term: dict[str, list] = {}
        for i, (_, terms) in enumerate(held):
            for term, w in terms:
                by_term.setdefault(term, []).append((i, w))
        sent = spark.sparkContext.broadcast((by_term, len(held), max(total, 1), n_docs))
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id"))
        likely = _candidates(blocks, sent, k).withColumn("nth", nth).filter(F.col("nth") <= k)
        lowest = _best(_scored(likely, marked, sent), k).filter(F.col("rank") == k).select("item", "score").collect()
        floors = np.ones(len(held), np.int64)  # a score of 1 at least, where fewer than k documents are known
        for row in lowest:
            floors[row["item"]] = row["score"]
        found = _best(_scored(_candidates(blocks, sent, k, spark.sparkContext.broadcast(floors)), marked, sent), k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(held)], f"item int, q {queries.schema[query_id].dataType.simpleString()}")
        part = stored(found.join(F.broadcast(names), "item").select(F.col("q").alias(query_id), "rank", "doc_id", "score"), "found")
        out = part if out is None else out.unionByName(part)
    discard(weighted)
    discard(blocks)
    if out is None:
        out = spark.createDataFrame([], f"{query_id} {queries.schema[query_id].dataType.simpleString()}, rank int, doc_id long, score long")
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS nd, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l)))) AS BIGINT) AS score
      FROM tf JOIN w USING (term) JOIN q USING (term), c GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
