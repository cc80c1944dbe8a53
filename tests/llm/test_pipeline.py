"""Every stage of the pipeline against a plain version of it on what the stage before kept."""

import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_operators import groups_by_brute_force, repeats_by_brute_force

import corpus_pipeline as P
from scoreframe.llm import mixing, quality
from scoreframe.llm.common import read, stored

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before each stage and after the last."""
    tables = [read(spark, AT, "documents")]
    for name, stage in P.STAGES:
        tables.append(stored(stage(spark, tables[-1], AT), f"test-{name}"))
    return tables


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontaminate", "mix"]
    assert all(t.columns == stages[0].columns for t in stages[:-1]) and set(stages[0].columns) < set(stages[-1].columns)


def test_quality_drops_what_scores_low(spark, stages):
    model = quality.train(stages[0], read(spark, AT, "labels"))
    good = {r["doc_id"] for r in quality.score(stages[0], model).collect() if r["score"] >= 0.3}
    assert set(rows(stages[1])) == good and all(rows(stages[1])[k] == rows(stages[0])[k] for k in good)
    bad = {r["doc_id"] for r in read(spark, AT, "labels").filter("quality = 0").collect()}
    assert len(bad & good) <= 0.1 * len(bad)


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    groups = groups_by_brute_force({k: r["text"] or "" for k, r in before.items()}, 5, 80)
    assert set(after) == {k for k, (_, _, kept) in groups.items() if kept} and all(after[k] == before[k] for k in after)


def test_repeated_passages_go(stages):
    before, after = rows(stages[2]), rows(stages[3])
    texts = {k: r["text"] or "" for k, r in before.items()}
    cut = repeats_by_brute_force(texts, 100)
    assert set(after) == {k for k, (n, gone, _, _) in cut.items() if not n or gone < n}
    for k, r in after.items():
        n, gone, spans, _ = cut[k]
        kept = len((r["text"] or "").encode())
        assert r["text"] == before[k]["text"] if not gone else n - gone - 6 * spans <= kept <= n - gone
        assert r["n_chars"] == len(r["text"] or "")


def contaminated(texts, items, window=13, share=0.8, least=5):
    found = set()
    for key, text in texts.items():
        words = re.findall(r"\w+", (text or "").lower())
        places = defaultdict(list)
        for p, w in enumerate(words):
            places[w].append(p)
        for item in items:
            t = re.findall(r"\w+", (item or "").lower())
            width = min(window, len(t))
            starts = defaultdict(int)
            for q, w in enumerate(t):
                for p in places.get(w, ()):
                    starts[p - q] += 1
            for at, n in starts.items():
                if len(t) >= least and n >= share * width:
                    same = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(t)]
                    lo, hi = max(0, -at), min(len(t), len(words) - at)
                    if hi - lo >= width and max(sum(same[k : k + width]) for k in range(lo, hi - width + 1)) >= share * width:
                        found.add(key)
                        break
    return found


def test_benchmark_passages_go(spark, stages):
    before, after = rows(stages[3]), rows(stages[4])
    bad = contaminated({k: r["text"] for k, r in before.items()}, [r["text"] for r in read(spark, AT, "benchmark").collect()])
    assert set(after) == set(before) - bad and all(after[k] == before[k] for k in after)


def test_mixture_equals_sql(stages):
    con = duckdb.connect()
    table = stages[4].select("doc_id", "source").toPandas()
    con.register("documents", table)
    want = {r[0]: r[1:] for r in con.execute(mixing.SQL).fetchall()}
    got = {r["doc_id"]: (r["source"], r["block"], r["slot"], r["place"], r["in_target"]) for r in stages[5].collect()}
    assert got == want


def test_empty_tables(spark):
    docs = read(spark, AT, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, AT)
        assert docs.count() == 0
        docs = docs.select(*read(spark, AT, "documents").columns)


def test_awkward_rows(spark):
    schema = read(spark, AT, "documents").schema
    long = " ".join(f"word{i % 9973} of a long, plain text that goes on" for i in range(12_000))
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "web", 0), (3, long, "en", "web", len(long)), (4, long, None, None, None), (None, "x " * 300, "en", "web", 600), (5, "y", "en", "web", 1), (5, "y", "en", "web", 1)], schema)
    docs = docs.select("*", F.lit(7).alias("key"), F.lit("z").alias("slot"))
    for name, stage in P.STAGES[1:]:
        docs = stored(stage(spark, docs, AT), "awkward")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert 3 in ids and 4 not in ids and None in ids, name
