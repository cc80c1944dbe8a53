"""The estimate keeps pairs at the threshold."""

from math import comb

import numpy as np

from scoreframe.llm import hyperminhash as H


def test_estimate_keeps_pairs_six_deviations_low(spark):
    a = np.arange(1, H.FINE + 1, dtype=np.uint16)
    rows = []
    for key, same in ((1, 170), (2, 150)):
        b = a.copy()
        b[same:] += 1000
        rows += [(10 * key, 500, bytearray(a.tobytes())), (10 * key + 1, 500, bytearray(b.tobytes()))]
    sig = spark.createDataFrame(rows, "doc_id long, n long, regs binary")
    pairs = spark.createDataFrame([(10, 11), (20, 21)], "a long, b long")
    assert [tuple(r) for r in H._plausible(pairs, sig, 80).collect()] == [(10, 11)]


def test_loss_at_the_threshold():
    low = sum(comb(H.FINE, i) * 0.8**i * 0.2 ** (H.FINE - i) for i in range(H.FINE) if i / H.FINE < 0.8 - H.SLACK)
    assert low + (1 - 0.8**H.ROWS) ** H.BANDS < 1e-6
