"""Media columns: pixels against the textbook transform, shots and timed clips, foreign Huffman tables, awkward rows."""

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from scoreframe.llm import media as M

DOCS = "doc_id long, text string"


def textbook_pixels(block):
    """Inverse DCT by its definition, from 64 coefficients in zigzag order."""
    grid = np.zeros((8, 8))
    for k, at in enumerate(M.ZIGZAG):
        grid[at // 8, at % 8] = block[k]
    c = lambda k: math.sqrt(0.125) if k == 0 else 0.5
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            out[y, x] = sum(c(u) * c(v) * grid[u, v] * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for u in range(8) for v in range(8))
    return np.clip(np.floor(out + 128.5), 0, 255)


def frames_of(*parts):
    """A payload of whole frames; every part is (frames, low, high) of its random bytes."""
    rng = np.random.default_rng(1)
    return b"".join(rng.integers(low, high, n * M.BLOCKS * M.PER_BLOCK, dtype=np.uint8).tobytes() for n, low, high in parts)


def still(*parts):
    """A payload of shots whose frames are alike but for a few bytes; every part is (frames, low, high)."""
    rng, out = np.random.default_rng(3), []
    for n, low, high in parts:
        frame = rng.integers(low, high, M.BLOCKS * M.PER_BLOCK, dtype=np.uint8)
        for _ in range(n):
            frame[rng.integers(0, len(frame), 3)] = rng.integers(low, high, 3, dtype=np.uint8)
            out.append(frame.tobytes())
    return b"".join(out)


def test_zigzag_is_the_usual_one():
    assert M.ZIGZAG[:11].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32] and sorted(M.ZIGZAG) == list(range(64))


def test_pixels_equal_the_definition():
    blocks = np.random.default_rng(2).integers(-40, 40, (6, 64))
    ours = M.pixels(blocks.astype(np.int32)).reshape(-1, 8, 8).astype(int)
    for block, got in zip(blocks, ours, strict=True):
        assert np.abs(got - textbook_pixels(block)).max() <= 1


def test_timed_clips_at_planted_cuts(spark):
    cuts = spark.createDataFrame([(1, bytearray(M.write_avi(still((30, 126, 130), (20, 0, 255), (25, 126, 130))))), (2, bytearray(M.write_avi(frames_of((12, 0, 255))))), (3, None), (4, bytearray(b"no video"))], "doc_id long, media binary")
    rows = sorted(map(tuple, M.clips(cuts).collect()))
    assert [(r[0], r[1], r[4]) for r in rows] == [(1, 0, 30), (1, 1, 20), (1, 2, 25), (2, 0, 12)]
    assert [(r[2], r[3]) for r in rows[:3]] == [(0.0, 1.2), (1.2, 2.0), (2.0, 3.0)]
    assert M.clips(cuts.limit(0)).count() == 0


def bits_of(blocks):
    """A scan with other codes: DC category 0 is 0; AC 08 is 10, end is 0, four lengths in all."""
    out = ""
    for block in blocks:
        out += "0"
        values = [int(v) for v in block[1:] if v]
        for v in values:
            out += "10" + format(v if v > 0 else v + 255, "08b")
        out += "0"
    out += "1" * (-len(out) % 8)
    return bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8))


def test_foreign_huffman_tables():
    jpeg = M._jpeg(np.frombuffer(frames_of((1, 0, 255))[: 10 * M.PER_BLOCK], np.uint8))
    blocks = M.coefficients(jpeg)
    assert (M._by_bits(jpeg[len(M.HEAD) : -2].replace(b"\xff\x00", b"\xff"), M._tables(jpeg)[0], M.BLOCKS) == blocks).all()
    head = M.HEAD[: M.HEAD.index(b"\xff\xc4")] + M._segment(0xC4, b"\x00" + bytes([1] + [0] * 15) + b"\x00") + M._segment(0xC4, b"\x10" + bytes([1, 1] + [0] * 14) + b"\x00\x08") + M.HEAD[M.HEAD.index(b"\xff\xda") :]
    other = head + bits_of(blocks).replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
    assert (M.coefficients(other) == blocks).all()
    assert M.payload_of(M.coefficients(other)) == M.payload_of(blocks)


def test_riff_index_gives_the_frames():
    payload = frames_of((3, 0, 255))
    fps, frames = M.read_frames(M.write_avi(payload))
    assert fps == M.FPS and len(frames) == 3 and all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in frames)
    assert b"".join(M.payload_of(M.coefficients(f)) for f in frames) == payload


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "ÿ" * 100), (None, "a"), (5, "same"), (5, "same"), (6, "\x00" * 192), (7, "long é " * 100_000)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(i).alias(c) for i, c in enumerate(("id", "media", "n_bytes", "feature"))))
    got = M.features(M.to_avi(docs)).collect()
    assert len(got) == len(rows) and M.features(M.to_avi(docs.limit(0))).count() == 0
    texts = dict(rows)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({tuple(r) for r in got if r["doc_id"] == 5}) == 1
