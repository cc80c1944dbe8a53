"""The licence scan: window scores against a plain version, wrapped and short notices, the unknown class, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe.llm import license_scan as L

DOCS = "doc_id long, text string"
PLAIN = [f"The {a} of the {b} was {c} for most of the year, and nobody in the town spoke of it." for a in ("harvest", "bridge", "market", "school", "weather") for b in ("village", "river", "county", "harbour") for c in ("good", "closed", "open", "late")]


@pytest.fixture(scope="module")
def model():
    return L.Model(PLAIN)


def families(model, text):
    return [(f, ok) for _, _, _, _, f, _, ok in model.notices([text.encode()])]


def test_held_out_examples(model):
    assert model.held_out > 0.8


def test_window_scores_equal_a_plain_sum(model):
    texts = [t.encode() for t in (PLAIN[3] + "\n\n" + " ".join(PLAIN[5:12]), "", "one", "Licensed under the MIT License.\n" + " ".join(PLAIN[:9]))]
    raw, begin, end, paragraph, text = L.words_of(texts)
    words = [raw[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
    assert words == [w for t in texts for w in __import__("re").findall(rb"[a-z0-9]+(?:[.+-][a-z0-9]+)*", t.lower())]
    grams = L.grams_of(raw, begin, end)
    for a, b in zip(*L.windows_of(paragraph), strict=True):
        assert paragraph[a] == paragraph[b - 1] and text[a] == text[b - 1] and 0 < b - a <= L.WINDOWS[-1]
        own_raw, own_begin, own_end, _, _ = L.words_of([b" ".join(words[a:b])])
        assert (L.grams_of(own_raw, own_begin, own_end)[0] == grams[0, a:b]).all()
    covered = np.zeros(len(words), bool)
    for a, b in zip(*L.windows_of(paragraph), strict=True):
        covered[a:b] = True
    assert covered.all()


@pytest.mark.parametrize("wrapped, family", [
    ("Permission is hereby granted, free of charge,\nto any person obtaining a copy of this\nsoftware and associated documentation files", "mit"),
    ("Licensed under the Apache License,\nVersion 2.0", "apache"),
    ("This file is available under CC BY-SA 4.0", "cc-by"), ("Distributed under GPL-3.0-or-later", "gpl"), ("Dedicated under CC0 1.0", "public-domain"), ("Licensing: MPL 2.0", "mpl"),
])
def test_notices_are_found_alone_and_inside_a_long_paragraph(model, wrapped, family):
    assert families(model, wrapped) == [(family, True)]
    inside = " ".join(PLAIN[:20]) + "\n" + wrapped + "\n" + " ".join(PLAIN[20:40])
    assert (family, True) in families(model, inside)
    where = [(a, b) for _, _, a, b, f, _, ok in model.notices([inside.encode()]) if ok]
    assert all(inside.encode().index(wrapped.encode()) - 60 <= a < b <= inside.encode().index(wrapped.encode()) + len(wrapped) + 60 for a, b in where)


def test_ordinary_text_is_unknown(model):
    for text in ["She renewed her driving license at the office in town.", *PLAIN[::7]]:
        assert not any(ok for _, ok in families(model, text))


def test_awkward_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " \n\n\t"), (4, "é" * 3), (5, "Released under the MIT License."), (5, "All rights reserved. No part of this publication may be reproduced without written permission."), (None, "Licensed under the Mozilla Public License, version 2.0"), (7, "word " * 200_000 + "released under the MIT license"), (8, "x" * 300_000)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(i).alias(c) for i, c in enumerate(("family", "paragraph", "id", "probability", "confirmed"))))
    got = L.scan(docs, model)
    assert {(r["doc_id"], r["family"]) for r in got.filter("confirmed").collect()} == {(5, "mit"), (5, "proprietary"), (None, "mpl"), (7, "mit")}
    out = {(r["doc_id"], r["families"]) for r in L.by_document(got, docs).collect()}
    assert {(1, ""), (2, ""), (5, "mit;proprietary"), (7, "mit"), (8, "")} <= out
    assert L.by_document(got, docs).count() == len(rows)
    assert L.scan(docs.limit(0), model).count() == 0 and L.train(docs.limit(0)).threshold > 0


def test_common_words_confirm_nothing(model):
    for text in ("The museum is free and open to the public on the first day of the month.", "He was granted the right to use the road, and to copy the map of it, by the owner of the land.", "All rights of the village are without any kind of limit in this part of the county."):
        assert not any(ok for _, ok in families(model, text))
