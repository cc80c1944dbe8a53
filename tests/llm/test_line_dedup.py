"""Line dedup against a plain version, awkward rows, and no Python in the plan."""

import hashlib
from collections import Counter

from scoreframe.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def plain(rows, least, min_chars=1):
    keys = [[line.strip(BLANKS).translate(FOLD) for line in (text or "").split("\n")] for _, text in rows]
    held = Counter(k for ks in keys for k in set(ks) if len(k) >= min_chars)
    out = []
    for (doc, text), ks in zip(rows, keys):
        stay = [line for line, k in zip((text or "").split("\n"), ks) if held[k] < least]
        out.append((doc, len(ks), len(ks) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, kept string, pos int").repartition(5)
    return sorted((tuple(r) for r in line_dedup.drop_frequent_lines(docs, **kw).collect()), key=repr)


def test_awkward_rows(spark):
    rows = [
        (1, "Head\nown a\n"), (2, "  HEAD\t\nown b"), (3, "head\r\n\n\nhead"), (4, None), (5, ""), (6, "\n\n"), (None, "head"), (None, "head"), (7, "É\né"), (8, "É"), (8, "É"),
        (8, "É"), (9, " head"), (10, "K\nk"), (11, "K"), (12, "x\n" * 5), (13, "ü" * 70_000 + "\nhead"), (14, "tail \x0b\nİ"), (15, "tail\nİ"), (16, "TAIL\ni̇"),
    ]
    for least, chars in ((3, 1), (2, 1), (2, 4), (1, 1), (1, 0)):
        assert found(spark, rows, least=least, min_chars=chars) == plain(rows, least, chars)
    assert found(spark, []) == []


def test_all_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows, least=10) == plain(rows, 10)
    assert any(r[2] for r in plain(rows, 10))


def test_query(spark, sf_dir):
    import compare

    from scoreframe.llm.queries import QUERIES

    df = QUERIES["op11_line_dedup"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert compare.difference(df, compare.duck(sf_dir), line_dedup.SQL) == ""
    assert max(len(r.kept_sha256) for r in df.collect()) == len(hashlib.sha256(b"").hexdigest())
