"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: every turn is marked by control strings, and
control strings inside roles and texts are escaped, so the rendering can be read back
exactly. The rendering is encoded once, with offsets. The turns' text spans are sorted
by construction and so are the tokens' spans, so the tokens of a span are found by
two binary searches; those of the trained role make up the loss mask. Control strings
are special tokens of the encoder, so no token straddles the end of a text.

Escape: a backslash doubles, and ``<|`` becomes ``<\\|``. Both undo by dropping the
backslash before a character, so nothing but a control string reads as one.

Spark deals whole conversations to tasks and sorts them by turn; a task holds one
conversation at a time (and a short batch of renderings), never a group in pandas.

Edge cases: null text or role: empty. Equal turns of a conversation are ordered by
role, then text; null turns come first. Rows with a null conversation id belong to no
conversation and are left out. An empty assistant text has no tokens. Repeated rows
are turns of their own. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = "assistant"
BATCH_CHARS = 1 << 18  # renderings encoded at once
OUT = "conv_id long, formatted string, ids array<int>, loss array<boolean>, loss_spans array<struct<s:int,e:int>>"
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering and the spans of the trained role's (escaped) texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + SEP, escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendering."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def masked(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Loss mask over tokens, and the characters its runs of tokens cover, one run per non-empty span."""
    starts = np.array([a for a, _ in offsets], np.int64)
    ends = np.array([b for _, b in offsets], np.int64)
    mask, runs = np.zeros(len(offsets), bool), []
    for a, b in spans:
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if i < j:
            mask[i:j] = True
            runs.append((int(starts[i]), int(ends[i:j].max())))
    return mask, runs


def encoder(vocabulary: str):
    """The vocabulary's encoder with the control strings as special tokens; others are ordinary text (escaped)."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary)
    t.add_special_tokens([OPEN, SEP, CLOSE])
    return t


def format_chats(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """One row per conversation: rendering, token ids, loss mask, and the characters under the mask.

    ``vocabulary`` is the tokenizer file on the executors."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())),
                        ("loss", pa.list_(pa.bool_())),
                        ("loss_spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)

        def conversations_of() -> Iterator[tuple[int, list[tuple[str, str]]]]:
            conv, turns = None, []
            for batch in batches:
                for c, role, text in zip(*[col.to_pylist() for col in batch.columns]):
                    if c != conv:
                        if turns:
                            yield conv, turns
                        conv, turns = c, []
                    turns.append((role, text))
            if turns:
                yield conv, turns

        def encoded(held: list) -> pa.RecordBatch:
            out = []
            for (conv, text, spans), e in zip(held, enc.encode_batch([h[1] for h in held], add_special_tokens=False)):
                mask, runs = masked(e.offsets, spans)
                out.append((conv, text, e.ids, mask.tolist(), [{"s": a, "e": b} for a, b in runs]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        held, size = [], 0
        for conv, turns in conversations_of():
            text, spans = render(turns)
            held.append((conv, text, spans))
            size += len(text)
            if size >= BATCH_CHARS:
                yield encoded(held)
                held, size = [], 0
        if held:
            yield encoded(held)

    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, OUT)
