"""The URL filter: held-out accuracy by site, awkward rows, split and rules against a plain version."""

import numpy as np
from pyspark.sql import functions as F

from scoreframe.llm import url_filter as U


def test_held_out_urls_are_told_apart():
    rows = U.labelled_urls()
    scores, labels = [], []
    for fold in range(5):
        held = [r for i, r in enumerate(rows) if i // 2 % 5 == fold]
        w, b = U.train([r for i, r in enumerate(rows) if i // 2 % 5 != fold])
        for host, path, label in held:
            f = U.grams(host, path)
            scores.append(w[f].sum() / np.sqrt(len(f)) + b)
            labels.append(label)
    good, bad = np.array([s for s, y in zip(scores, labels) if not y]), np.array([s for s, y in zip(scores, labels) if y])
    assert (bad[:, None] > good).mean() > 0.85
    assert (good < 0).mean() > 0.8


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path.split("?")[0].split("#")[0]
    best = None
    for action, rule in U.RULES:
        at, _, prefix = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best and best[1], best and best[0]


def test_split_and_rules_equal_the_plain_version(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    odd = ["http://EXÄMPLE.Net/en", "x://a.net", "://net/", "http://net?x=/", "ftp://u:p@sub.org/fr/x#y?z", "http://org/frx", "a://b://c/d", "http://ORG/fr/", "", None, "nothing", "http://", "http://my-net/x"] + ["http://" + "a" * 50_000 + ".net/"]
    more = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(odd)], "page_id long, url string")
    clash = pages.unionByName(more).select("*", *(F.lit("mine").alias(c) for c in ("host", "path", "rule", "verdict", "score", "_ruled")))
    urls = {r["page_id"]: r["url"] for r in clash.collect()}
    got = U.judge(clash).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert U.judge(clash.limit(0)).count() == 0
    assert U.judge(clash.limit(5).unionByName(clash.limit(5))).count() == 10
