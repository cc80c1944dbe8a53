"""Media columns: AVI files with motion-JPEG frames.

``write_avi`` stores bytes losslessly as quantised DCT coefficients: a byte is one AC coefficient of magnitude category
8 (its 256 values are -255..-128 and 128..255), 48 of them in each 8x8 block, with quantiser 1. All Huffman codes have
8 bits, so a scan is byte-aligned. ``read_frames`` walks the RIFF index and decodes the intra frames; ``payload_of``
reads the bytes back; ``shots`` cuts where the luminance histogram moves further than an adaptive threshold.

Defined cases: null is the empty text; an empty payload is padded to one unit of 192 bytes; equal texts give equal
bytes and features; repeated rows stay; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192  # bytes of a payload unit: four blocks
PER_BLOCK = 48
SIDE = 64  # pixels of a frame's side
BLOCKS = (SIDE // 8) ** 2
FPS = 25

#: The zigzag order of a JPEG block.
ZIGZAG = np.array([i * 8 + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])


def _basis() -> np.ndarray:
    """Rows: zigzag coefficients; columns: pixels. Integers, scaled by 2**13, so that sums are exact in any order."""
    k = np.arange(8)
    c = np.where(k == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    both = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(both[ZIGZAG] * (1 << 13))


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    lengths = lambda n: bytes([0] * 7 + [n] + [0] * 8)  # noqa: E731  n codes of 8 bits
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + lengths(1) + b"\x00"),
        _segment(0xC4, b"\x10" + lengths(2) + b"\x08\x00"),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


HEAD = _jpeg_head()


def _jpeg(payload: np.ndarray) -> bytes:
    """One frame; blocks beyond the payload hold no coefficient."""
    full = payload.reshape(-1, PER_BLOCK)
    coded = np.zeros((len(full), 2 * PER_BLOCK + 2), np.uint8)
    coded[:, 2:-1:2] = full
    coded[:, -1] = 1
    scan = coded.tobytes() + b"\x00\x01" * (BLOCKS - len(full))
    return HEAD + scan.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """payload: a positive multiple of 192 bytes."""
    data, room = np.frombuffer(payload, np.uint8), BLOCKS * PER_BLOCK
    frames = [_jpeg(data[i : i + room]) for i in range(0, len(data), room)]
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movi.append(_chunk(b"00dc", frame))
        at += len(movi[-1])
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, 0, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    body = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def read_frames(avi: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, the JPEG frames in the order of the index). ValueError if it isn't an AVI file."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, fps = 12, None, b"", float(FPS)
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        kind = avi[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"hdrl":
            fps = 1e6 / max(1, struct.unpack_from("<I", avi, at + 20)[0])
        elif name == b"idx1":
            index = avi[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    for tag, _, offset, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
        if tag[2:] in (b"dc", b"db"):
            frames.append(avi[movi + offset + 8 : movi + offset + 8 + size])
    return fps, frames


def _tables(jpeg: bytes) -> tuple[dict, int, int, int, np.ndarray]:
    """(Huffman codes by class, height, width, where the scan begins, quantiser in zigzag order) of a grey baseline frame."""
    at, codes, height, width, quant = 2, {}, 0, 0, np.ones(64)
    while at < len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xDB:
            quant = np.frombuffer(body[1:65], np.uint8).astype(float)
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("only grey frames are read")
        elif marker == 0xC4:
            while body:
                counts, symbols, code, table = body[1:17], iter(body[17:]), 0, {}
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[length, code] = next(symbols)
                        code += 1
                    code <<= 1
                codes[body[0] >> 4], body = table, body[17 + sum(counts) :]
        elif marker == 0xDA:
            return codes, height, width, at + 2 + size, quant
        at += 2 + size
    raise ValueError("no scan")


def _by_bits(scan: bytes, codes: dict, n_blocks: int) -> np.ndarray:
    """Any Huffman tables, bit by bit."""
    out, bits, at, dc = np.zeros((n_blocks, 64), np.int32), np.unpackbits(np.frombuffer(scan, np.uint8)), 0, 0

    def take(n: int) -> int:
        nonlocal at
        value = 0
        for b in bits[at : at + n]:
            value = value << 1 | int(b)
        at += n
        return value

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad code")

    def signed(size: int) -> int:
        value = take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1

    for block in out:
        dc += signed(symbol(codes[0]))
        block[0], k = dc, 1
        while k < 64 and (run := symbol(codes[1])):
            k += run >> 4
            if run != 0xF0:
                block[k] = signed(run & 15)
            k += 1
    return out


def coefficients(jpeg: bytes) -> np.ndarray:
    """Quantised coefficients, one row of 64 in zigzag order for each block."""
    aligned = jpeg.startswith(HEAD)
    codes, height, width, start, _ = (None, SIDE, SIDE, len(HEAD), None) if aligned else _tables(jpeg)
    n_blocks = ((height + 7) // 8) * ((width + 7) // 8)
    scan = jpeg[start : jpeg.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    if not aligned:
        return _by_bits(scan, codes, n_blocks)
    step = 2 * PER_BLOCK + 2
    full = (len(scan) - 2 * n_blocks) // (step - 2)
    rows = np.frombuffer(scan, np.uint8, full * step).reshape(full, step)
    if rows[:, 0].any() or rows[:, 1:-1:2].any() or (rows[:, -1] != 1).any() or scan[full * step :] != b"\x00\x01" * (n_blocks - full):
        return _by_bits(scan, _tables(jpeg)[0], n_blocks)
    out = np.zeros((n_blocks, 64), np.int32)
    value = rows[:, 2:-1:2].astype(np.int32)
    out[:full, 1 : PER_BLOCK + 1] = np.where(value >= 128, value, value - 255)
    return out


def payload_of(blocks: np.ndarray) -> bytes:
    """The stored bytes of blocks that write_avi made; blocks without coefficients are padding."""
    held = blocks[blocks[:, 1] != 0, 1 : PER_BLOCK + 1]
    return np.where(held >= 128, held, held + 255).astype(np.uint8).tobytes()


def pixels(blocks: np.ndarray, quant: np.ndarray | None = None) -> np.ndarray:
    """8-bit samples of each block, decoded by the inverse DCT."""
    scaled = blocks if quant is None else blocks * quant
    last = int(np.flatnonzero(scaled.any(axis=0))[-1]) + 1 if scaled.any() else 1
    grey = np.floor((scaled[:, :last].astype(float) @ BASIS[:last] + (1 << 12)) / (1 << 13)) + 128
    return np.clip(grey, 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray, window: int = 12, factor: float = 3.0, least: float = 0.05) -> list[int]:
    """First frames of the shots. A cut: the histogram distance exceeds ``least`` and the mean of the ``window``
    distances before it in the shot by ``factor`` standard deviations."""
    share = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    moved = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    starts, since = [0], 0
    for i, d in enumerate(moved):
        before = moved[max(since, i - window) : i]
        bound = max(least, before.mean() + factor * before.std()) if len(before) else max(least, 0.25)
        if d > bound:
            starts.append(i + 1)
            since = i + 1
    return starts


def _decoded(avi: bytes) -> tuple[float, list[np.ndarray], np.ndarray]:
    fps, frames = read_frames(avi)
    blocks = [coefficients(x) for x in frames]
    stacked = np.concatenate(blocks)
    # blocks without coefficients are flat grey: they need no transform
    quant = None if all(x.startswith(HEAD) for x in frames) else np.concatenate([np.tile(_tables(x)[4], (len(b), 1)) for x, b in zip(frames, blocks, strict=True)])
    held = stacked.any(axis=1)
    frame = np.repeat(np.arange(len(frames)), [len(x) for x in blocks])
    grey = pixels(stacked[held], None if quant is None else quant[held])
    key = (frame[held][:, None] * 32 + (grey >> 3)).ravel()
    histograms = np.bincount(key, minlength=32 * len(frames)).reshape(-1, 32).astype(float)
    histograms[:, 16] += 64.0 * np.bincount(frame[~held], minlength=len(frames))
    return fps, blocks, histograms


def _clips(fps: float, histograms: np.ndarray) -> list[tuple[int, int]]:
    starts = shots(histograms)
    return list(zip(starts, [*starts[1:], len(histograms)], strict=True))


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of AVI columns: (id, clip, start_s, end_s, n_frames). Null or unreadable media give no rows."""
    kind = media.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, avi in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    fps, _, histograms = _decoded(avi.as_py() or b"")
                except (ValueError, KeyError, struct.error, IndexError):
                    continue
                rows += [(key, k, a / fps, b / fps, b - a) for k, (a, b) in enumerate(_clips(fps, histograms))]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("id", batch.schema.field(0).type), ("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int32())))})

    return media.select(id_col, media_col).mapInArrow(decode, f"id {kind}, clip int, start_s double, end_s double, n_frames int").withColumnRenamed("id", id_col)


def to_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as an AVI file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media, first = [], [], 0
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or b""
                sizes.append(len(text))
                media.append(write_avi(padded(text)))
                if len(media) == 256 or len(media[-1]) > 1 << 20 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(media)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
                    sizes, media, first = [], [], k + 1

    return docs.select(id_col, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).mapInArrow(encode, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def padded(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored files back: digests of payload and file, and a feature string of frames, shots and brightness."""
    kind = media.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, avi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                avi = avi.as_py()  # one file at a time
                fps, blocks, histograms = _decoded(avi)
                payload = b"".join(payload_of(x) for x in blocks)
                spans = _clips(fps, histograms)
                mean = histograms.sum(axis=0) @ np.arange(32) / histograms.sum()
                text = f"frames={len(histograms)};shots={len(spans)};longest={max(b - a for a, b in spans)};grey={mean:.4f}"
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(avi), hashlib.sha256(avi).hexdigest(), text))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(id_col, "n_bytes", "media").mapInArrow(measure, schema).withColumnRenamed("id", id_col)
