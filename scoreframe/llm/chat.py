"""Chat formatting by token-level assembly.

Each segment (role, text) is encoded by itself and the reserved ids of the template are spliced between the encoded
segments, so no text can yield a control token. Control strings that occur in a text are escaped reversibly before
encoding, so the decoded rendering is unambiguous as well. The loss mask comes from prefix sums over +1/-1 marks at the
borders of the assistant texts.

The formatted form is kept as one row per turn (``conv_id, turn, pos, ids, mask``); a conversation is the concatenation
by ``pos``, the token offset, which is a prefix sum as well. So no conversation has to fit into one row; ``assemble``
gives one row per conversation where that is wanted.

Defined cases: null texts and roles are empty; rows of one turn number are ordered by role, then text, and repeated rows
are repeated turns; a null conv_id is a conversation of its own; an empty table gives no rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pattern, a fixed value of that tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MARKS = ("<|role|>", "<|text|>", "<|end|>")
CONTROL = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile(r"([<\[])(\\*)(?=" + "|".join(re.escape(x[1:]) for x in CONTROL) + ")")


def escape(text: str) -> str:
    r"""A control string gets one more backslash after its first character: ``</s>`` becomes ``<\/s>``."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:], text)


def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 2


def splice(segments: list[tuple[list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of encoded segments, each with whether the loss covers it."""
    sizes = np.array([len(ids) for ids, _ in segments])
    ends = np.cumsum(sizes)
    marks = np.zeros(int(sizes.sum()) + 1, np.int8)
    on = np.array([m for _, m in segments], np.int8)
    np.add.at(marks, ends - sizes, on)
    np.subtract.at(marks, ends, on)
    return np.fromiter((i for ids, _ in segments for i in ids), np.int32, int(sizes.sum())), np.cumsum(marks[:-1])


def format_turns(conversations: DataFrame, path: str = TOKENIZER, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text, ids, mask) per turn; role and text only order the rows of one turn."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, first = tokenizer(path)
        for batch in batches:
            ids, masks = [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts = [([first], False), (bpe.encode_ordinary(escape(role)), False), ([first + 1], False), (bpe.encode_ordinary(escape(text)), role in trained), ([first + 2], False)]
                i, m = splice(parts)
                ids.append(i)
                masks.append(m.astype(np.int8))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))], ["conv_id", "turn", "role", "text", "ids", "mask"])

    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(encode, f"conv_id {kind}, turn long, role string, text string, ids array<int>, mask array<tinyint>")


def with_offsets(turns: DataFrame) -> DataFrame:
    """Adds pos, the offset of each turn's first token in its conversation."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("pos", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)))


def assemble(turns: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, ids, mask). Each conversation must fit into one row."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "ids", "mask")))
    both = turns.groupBy("conv_id").agg(parts.alias("p"))
    return both.select("conv_id", F.flatten(F.col("p.ids")).alias("ids"), F.flatten(F.col("p.mask")).alias("mask"))


def _parse(ids: np.ndarray, mask: np.ndarray, bpe, first: int) -> tuple[str, str, str, int]:
    """(role, text, text under the mask, code points of the rendering) of one formatted turn."""
    at = np.flatnonzero(ids >= first)
    if list(ids[at]) != [first, first + 1, first + 2]:
        raise ValueError("the ids are not one formatted turn")
    role = bpe.decode_bytes(ids[at[0] + 1 : at[1]].tolist()).decode()
    text = bpe.decode_bytes(ids[at[1] + 1 : at[2]].tolist()).decode()
    held = bpe.decode_bytes(ids[mask == 1].tolist()).decode()
    return unescape(role), unescape(text), unescape(held), len(role) + len(text) + sum(map(len, MARKS))


def digests(turns: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Reads formatted turns back and digests each conversation; memory is bounded by one batch."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, first = tokenizer(path)
        key, state, out = None, None, []

        def closed():
            _, n, turn_hash, chars, loss_hash, total, tokens = state
            return (key, n, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), total, tokens)

        def emit(kind_):
            cols = list(zip(*out, strict=True))
            kinds = [kind_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        arrow_kind = None
        for batch in batches:
            arrow_kind = batch.schema.field(0).type
            for conv, ids, mask in zip(*(batch.column(k) for k in range(3)), strict=True):
                conv = conv.as_py()
                if state is None or conv != key:
                    if state is not None:
                        out.append(closed())
                    key, state = conv, [None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text, held, total = _parse(ids.values.to_numpy(zero_copy_only=False), mask.values.to_numpy(zero_copy_only=False), bpe, first)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(held)
                state[4].update(held.encode())
                state[5] += total
                state[6] += len(ids)
            if out:
                yield emit(arrow_kind)
                out.clear()
        if state is not None:
            out.append(closed())
            yield emit(arrow_kind)

    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
