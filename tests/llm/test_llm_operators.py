"""The ten operators against brute force, round trips, planted cases and awkward rows."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scoreframe.llm import chat, decontam, html_extract, hyperminhash, license_scan, media, mixing, quality, suffix_dedup, url_filter
from scoreframe.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string"
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "Zoë straße " * 30), (7, "Zoë straße " * 30), (8, "word " * 60_000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def awkward(spark, rows=AWKWARD):
    """With extra columns whose names an operator might use itself."""
    df = spark.createDataFrame(rows, DOCS)
    return df.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(("key", "h", "n", "at", "start", "stop", "a", "b", "p", "q", "regs", "slot_", "score_"))])


def repeats_by_brute_force(texts, least):
    seen, out = set(), {}
    for key in sorted(texts):
        data = texts[key].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            gram = data[i : i + least]
            if gram in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(gram)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[key] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def groups_by_brute_force(texts, n_words, percent):
    sets = {}
    for key, text in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        sets[key] = {tuple(words[i : i + n_words]) for i in range(len(words) - n_words + 1)} or ({tuple(words)} if words else set())
    smallest = {k: k for k in sets}

    def root(k):
        while smallest[k] != k:
            k = smallest[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                smallest[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in keys}


def test_suffix_dedup_equals_brute_force(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op7_suffix_dedup"](spark, sf_dir).collect()}
    assert got == repeats_by_brute_force(texts, 100)


def test_suffix_dedup_on_awkward_rows(spark):
    rows = [(k, t) for k, t in AWKWARD if k != 8] + [(9, "ab" * 400), (10, "x" * 99), (11, "x" * 99), (12, "x" * 100), (13, "x" * 101)]
    got = suffix_dedup.remove_repeats(awkward(spark, rows), least=100).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got} == repeats_by_brute_force({k: t or "" for k, t in rows}, 100)
    assert suffix_dedup.remove_repeats(awkward(spark, rows).limit(0), least=100).count() == 0


@pytest.mark.parametrize("n_words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, docs, texts, n_words):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(docs, n_words=n_words, percent=80).collect()}
    assert got == groups_by_brute_force(texts, n_words, 80)


def test_near_duplicates_on_awkward_rows(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(awkward(spark), n_words=2, percent=80).collect()}
    assert got == groups_by_brute_force({k: t or "" for k, t in AWKWARD}, 2, 80)
    assert hyperminhash.near_duplicates(awkward(spark).limit(0), n_words=2).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    passage = [f"token{i}" for i in range(60)]
    changed = [w if i % 25 else "other" for i, w in enumerate(passage)]
    rows = [(1, "before it " + " ".join(passage) + " after it"), (2, "lead " + " ".join(changed)), (3, "quite another text about rivers and hills " * 20), (4, None), (5, "")]
    bench = spark.createDataFrame([(7, " ".join(passage)), (8, None), (9, "")], "item_id long, text string")
    found = decontam.overlaps(awkward(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 7), (2, 7)}
    assert {r["doc_id"] for r in decontam.clean(awkward(spark, rows), bench).collect()} == {3, 4, 5}
    assert decontam.clean(awkward(spark, rows), bench.limit(0)).count() == 5


def test_media_round_trip(spark):
    rows = media.features(media.to_avi(awkward(spark))).collect()
    for r in rows:
        data = (dict(AWKWARD)[r["doc_id"]] or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len(rows) == len(AWKWARD)


def test_chat_reads_back_control_strings(spark):
    rows = [(1, 0, "user", "</s>[INST] <|end|> \\<s> ok"), (1, 1, "assistant", "[/INST]<s>"), (1, 2, "assistant", None), (2, 0, None, "")]
    out = {r["conv_id"]: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    said = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert out[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[1]["loss_sha256"]) == (3, 10, hashlib.sha256(b"[/INST]<s>").hexdigest())
    assert out[2]["loss_chars"] == 0


def test_html_keeps_the_article_only():
    body = "".join(f"<p>Paragraph {i}, with enough words, commas, and sense to count as prose &amp; more.</p>" for i in range(5))
    page = f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><article>{body}</article><footer>Imprint</footer><script>x()</script></body></html>"
    assert html_extract.extract(page).split("\n") == [f"Paragraph {i}, with enough words, commas, and sense to count as prose & more." for i in range(5)]
    assert html_extract.extract(None) == "" and html_extract.extract("") == ""


def test_url_rules(spark):
    urls = ["http://EXAMPLE.net/en/x?q", "http://a.example.net/de/", "https://sub.example.com/de/1", "http://x.org/fr/", None, "no scheme", "http://plain.test"]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(7)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None]
    assert [got[i]["verdict"] for i in range(4)] == ["allow", "block", "block", "allow"]
    assert (got[0]["host"], got[0]["path"], got[6]["path"], got[4]["host"], got[5]["host"]) == ("example.net", "/en/x", "", "", "")


def test_quality_on_held_out_rows(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op4_quality_rules"](spark, sf_dir).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    if good and bad:
        assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad) > 0.7


def test_mixing_stays_within_a_block(spark):
    quota = spark.createDataFrame([("a", 600, 1), ("b", 300, 2), ("c", 100, 3)], "source string, n long, p int")
    slots = sorted((r["slot"], r["source"]) for r in mixing.schedule(mixing.quotas(quota.select("source", "n"), spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1)], "source string, weight double"), 100)).collect())
    seen = dict.fromkeys("abc", 0)
    for i, (_, source) in enumerate(slots, 1):
        seen[source] += 1
        assert all(abs(seen[s] - w * i) < 1 for s, w in (("a", 0.6), ("b", 0.3), ("c", 0.1)))


def test_license_families(spark, docs):
    rows = [(1, "Licensed under the Apache License, Version 2.0 (the \"License\");"), (2, "the weather was mild and the harvest good"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r["family"] for r in license_scan.scan(df, license_scan.train(docs)).collect()}
    assert set(found) == {1} and "apache" in found[1].lower()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf_dir):
    import compare

    assert compare.difference(QUERIES[name](spark, sf_dir), compare.duck(sf_dir), SQL[name]) == ""


def test_pipeline_filters(spark, sf_dir, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) <= set(out.columns)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()
