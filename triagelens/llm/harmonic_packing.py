"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A document is its token ids and a closing id. It is cut into whole sequences, then
power-of-two pieces down to ``granule`` tokens, then one short rest. Every piece
length falls in the reciprocal class k with capacity/(k+1) < length <= capacity/k,
and a bin of class k always takes exactly k pieces. Bins fill independently in every
task: no shuffle, no driver, and per class at most one open bin, so a task holds at
most one bin per class whatever the input size. Powers of two fill their bins without
a gap; only bins of short rests are padded, by less than one rest each.

When a task's input ends, the pieces in its open bins are cut on to fill whole
sequences, and the last few tokens become sequences of power-of-two length, which
need no padding.

Rows are read in the order of their split, so a repeated task gives the same rows;
sequence ids carry the partition number. Pipelines feed this from a written table.

Edge cases: a null or empty text is its closing id alone. A null doc_id is carried
through. Repeated rows are packed each. Empty table: empty result. Extra columns are
ignored. The vocabulary's added token is matched inside texts, as ``tokenizers`` does.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
GRANULE = 64
CLOSING_ID = 0
# ---- Fixed values: the added token of the contract's vocabulary file and its id ----
ADDED = "<|endoftext|>"
ADDED_ID = 50256
# -----------------------------------------------------------------------------------
SEQUENCE_BITS = 40       # sequences of one partition
MEMO_WORDS = 600_000   # remembered encodings per task; the memo starts anew beyond
OUT_BYTES = 4 << 20      # ids of one output batch
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long, sequence_tokens long")
WIDE_SPACE = re.compile(r" \s")


class Encoder(dict):
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes.

    A space before a visible character always opens a new pre-token, so a text is the
    chain of its space-led words, each remembered once. Texts with a space before
    other white space are encoded whole."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={})

    def whole(self, text: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.whole(" " + word)
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if WIDE_SPACE.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return b"".join([self.whole(first), *[self[w] for w in rest]])

    def contract_ids(self, text: str) -> bytes:
        """Ids with the added token matched: the texts between its occurrences are encoded on their own."""
        if ADDED not in text:
            return self.ids(text)
        return np.asarray([ADDED_ID], "<u4").tobytes().join([self.ids(part) for part in text.split(ADDED)])


def cuts(n: int, capacity: int, granule: int) -> list[int]:
    """Piece lengths of a document of n tokens: whole sequences, halves down to the granule, the rest."""
    out = [capacity] * (n // capacity)
    left, half = n % capacity, capacity // 2
    while half >= granule:
        if left >= half:
            out.append(half)
            left -= half
        half //= 2
    return out + [left] * (left > 0)


class Packer:
    """Bins of one task. ``put`` and ``close`` give finished rows."""

    def __init__(self, capacity: int, granule: int, base: int):
        self.capacity, self.granule, self.next = capacity, granule, base
        self.open: dict[int, list[tuple]] = {}

    def sequence(self, pieces: list[tuple], padded: int) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, ids, total, self.next, at, padded
            at += n
        self.next += 1

    def put(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        for n in cuts(total, self.capacity, self.granule):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[4 * start:4 * (start + n)], total))
            start += n
            if len(bin_) == k:
                del self.open[k]
                yield from self.sequence(bin_, self.capacity)

    def close(self) -> Iterator[tuple]:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) // 4 for p in rest)
        while rest:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            size, taken = room, []
            while room:
                doc, start, ids, total = rest.pop(0)
                n = len(ids) // 4
                if n > room:
                    rest.insert(0, (doc, start + room, ids[4 * room:], total))
                    ids, n = ids[:4 * room], room
                taken.append((doc, start, ids, total))
                room -= n
            yield from self.sequence(taken, size)


def pack(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, granule: int = GRANULE, closing_id: int = CLOSING_ID) -> DataFrame:
    """One row per piece: its document, place in it, ids (little-endian unsigned 32-bit), sequence and offset.

    ``sequence_tokens`` is the padded length of the piece's sequence. ``capacity`` is a
    power of two. ``ranks_path`` is the vocabulary file on the executors."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                        ("sequence_tokens", pa.int64())])
    closing = np.asarray([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path)
        packer = Packer(capacity, granule, TaskContext.get().partitionId() << SEQUENCE_BITS)
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in packer.put(doc, encoder.contract_ids(text.as_py() or "") + closing):
                    rows.append(row)
                    size += len(row[3]) + 64
                if size >= OUT_BYTES:
                    yield flush()
                    rows, size = [], 0
        rows += packer.close()
        if rows:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
