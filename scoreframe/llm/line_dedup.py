"""Line dedup: lines that many documents share are dropped everywhere.

Lines are exploded by their normalised key, hashed to 128 bits and counted with map-side combining, one count per document
that holds a key; keys of enough documents are the frequent ones. The positions of frequent lines come from a semi-join of
hashes, without the lines' texts, and each text is reassembled from the positions that stay. All of it is DataFrame code.

A line that a third of all documents hold is one row per task in the count; in the semi-join its partition is split by
adaptive execution (spark.sql.adaptive.skewJoin.enabled), as the frequent keys are a stored table and what stands above the
join deals its rows anew. Texts are shuffled once, by a key of document and text.

Defined cases: a null or empty text is one empty line; a key shorter than ``min_chars`` never drops; repeated rows of a
doc_id are documents of their own, counted and returned as often as they stand; a null doc_id is a document as any other;
a line that stands several times in one document counts once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import stored, text_of

BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that where all characters are ASCII, and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    """The key of each line, in order."""
    return F.transform(F.split(text, "\n"), lambda line: lower_ascii(F.btrim(line, F.lit(BLANKS))))


def _digest(*columns: Column | str) -> list[Column]:
    """128 bits: two hashes of unlike seeds."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")]


def frequent_keys(docs: DataFrame, least: int, min_chars: int, text_col: str = "text") -> DataFrame:
    """(h1, h2, n_docs) of the keys that at least ``least`` documents hold."""
    held = docs.select(F.explode(F.array_distinct(line_keys(text_of(text_col)))).alias("key")).filter(F.char_length("key") >= min_chars)
    return held.select(*_digest("key")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least)


def drop_frequent_lines(docs: DataFrame, least: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) per row: lines before dropping, lines dropped, and the text of the others."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    texts = texts.withColumns(dict(zip(("k1", "k2"), _digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("text")))))
    frequent = stored(frequent_keys(texts, least, min_chars), "frequent-lines").select("h1", "h2")
    lines = texts.select("k1", "k2", F.posexplode(line_keys(F.col("text"))).alias("pos", "key")).filter(F.char_length("key") >= min_chars)
    hits = lines.select("k1", "k2", "pos", *_digest("key")).join(frequent, ["h1", "h2"], "left_semi")
    dropped = hits.groupBy("k1", "k2").agg(F.collect_set("pos").alias("dropped"))
    both = texts.join(dropped, ["k1", "k2"], "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))

    def reassembled(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias("kept"))

    # an array of one array binds the split lines, which would else be split anew for each position
    whole = both.select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), F.explode(F.transform(F.array(F.split("text", "\n")), reassembled)).alias("x"))
    return whole.select("doc_id", "x.n_lines", "n_dropped", "x.kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN k.line END, chr(10) ORDER BY k.pos), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.r, k.doc_id
"""
