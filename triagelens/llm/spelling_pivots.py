"""Spelling variants by pivotal grams.

Words within one edit of each other are found through their bigrams. All words' bigrams
have one global order, rarest first. A word's prefix is its first three bigrams in that
order (one edit changes at most two), extended by further places of the third. Two
disjoint bigrams of the prefix are its pivots, chosen by dynamic programming so that
their total frequency is least. One edit leaves at least one of two disjoint bigrams as
it is. So of two near words, the one whose prefix ends earlier in the global order has a
pivot that the other has in its prefix: pivots are looked up among the other words'
prefix bigrams, and every hit is verified by the edit distance.

Position limits. With one edit, a bigram that stays moves by at most one place, by as
much as the length changes if the edit is to its left and not at all if it is to its right; and
everything on its other side stays too. On the edit's side, either the first half of the
letters stays or the second. A prefix bigram is therefore filed under its word's length,
the bigram with the letters to its left (edit to the right) or right (edit to the left),
and one half of the others; a pivot asks for the same at the three possible lengths. Words
that merely share a bigram do not meet.

``form`` is a word's near word with the most occurrences, if those are at least
``ratio`` times its own; ``root`` follows the forms to the last. Forms grow by that
factor each step, so chains are short and pointer doubling ends after a few joins.

Edge cases: a null text has no words; a null document id counts as an empty string
where ids matter. Repeated rows count each. Ties of occurrences go to the smaller
word in code-point order. Words shorter than ``SHORTEST`` letters have no two disjoint
bigrams: they stay without near words and are nobody's. Texts of any length are counted whole, in bounded memory per
distinct word held; runs of any length are words. Words without a near word have ``n_near`` 0. Empty table: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.util import unbroadcast
from .common import parked

GRAM = 2            # letters of a gram
EDITS = 1
PREFIX = GRAM * EDITS + 1
SHORTEST = GRAM * (EDITS + 1)  # letters of the shortest word that has disjoint pivots
HELD = 200_000      # distinct words a task counts before it passes them on
HELD_BYTES = 1 << 25  # or so many bytes of words of more than 100 letters
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
LETTERS = 26 + 64   # a-z and the Latin-1 letters: at most LETTERS ** 2 bigrams
# Latin-1 bytes: A-Z lower case, a-z and 0xC0-0xFF stay, all others separate runs.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str | None) -> Counter:
    """Lower-cased letter runs of a text as Latin-1 bytes, with their numbers."""
    return Counter((text or "").encode("latin-1", "replace").translate(TABLE).split())


def misspelt(run: bytes, start: int, every: int) -> bytes:
    """``run`` without one letter, if the checksum of document and run says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    return run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]


def counter(min_chars: int, noise: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        long_bytes = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                              pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs(text.as_py()).items():
                    if len(word) >= min_chars:
                        word = misspelt(word, start, noise) if noise else word
                        if len(word) >= min_chars:
                            held[word] += n
                            long_bytes += len(word) if len(word) > 100 else 0
                if len(held) >= HELD or long_bytes >= HELD_BYTES:
                    yield flush()
                    long_bytes = 0
        yield flush()
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_count: int = MIN_COUNT, noise: int | None = None) -> DataFrame:
    """``word``, ``n``: words of at least ``min_chars`` letters with at least ``min_count`` occurrences.

    With ``noise``, one run in so many loses a letter first, by the checksum of ``<id>:<run>``."""
    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    part = texts.mapInArrow(counter(min_chars, noise), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Every bigram's place in the global order (rarest first) and number of words; at most LETTERS ** 2 rows."""
    at = F.sequence(F.lit(1), F.char_length("word") - GRAM + 1)
    grams = words.select(F.explode(F.transform(at, lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram"))
    rows = sorted((r.n, r.gram) for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect())
    return {gram: (place, n) for place, (n, gram) in enumerate(rows)}


def prefix(word: str, order: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """(place in the order, position) of the first PREFIX bigrams, with every position of the last one."""
    grams = sorted((order[word[i:i + GRAM]][0], i) for i in range(len(word) - GRAM + 1))
    last = grams[min(PREFIX, len(grams)) - 1][0]
    return [g for g in grams if g[0] <= last]


def pivots(word: str, order: dict[str, tuple[int, int]], first: list[tuple[int, int]]) -> list[int]:
    """Positions of EDITS + 1 disjoint prefix bigrams of least total frequency.

    Dynamic programming over the positions from left to right: ``best[j][i]`` is the
    cheapest choice of j bigrams among the first i."""
    at = sorted(p for _, p in first)
    cost = [order[word[p:p + GRAM]][1] for p in at]
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0, ())] * (len(at) + 1)]
    for j in range(1, EDITS + 2):
        row: list[tuple[float, tuple[int, ...]]] = [(math.inf, ())]
        for i, p in enumerate(at):
            before = sum(q <= p - GRAM for q in at[:i])  # bigrams that end before this one
            spent, chosen = best[j - 1][before]
            row.append(min(row[i], (spent + cost[i], (*chosen, p))))
        best.append(row)
    return list(best[-1][-1][1])


MARKED = "word string, n long, last int, prefix array<int>, pivots array<int>"


def marker(order: dict[str, tuple[int, int]]):
    """Function for mapInArrow: every word with its prefix's positions and last place, and its pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            words = batch.column(0).to_pylist()
            first = [prefix(w, order) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[-1][0] for f in first], pa.int32()),
                 pa.array([[p for _, p in f] for f in first], ints),
                 pa.array([pivots(w, order, f) for w, f in zip(words, first)], ints)],
                names=["word", "n", "last", "prefix", "pivots"])
    return run


def keys(word: Column, at: Column, size: Column) -> Column:
    """What ``word``, with a bigram at ``at`` (from 0), shares with a near word of ``size`` letters
    that is filed under the same bigram: one key per side and half of the edit.

    The bigram and one side of it are the same. Of the other side's ``rest`` letters in the
    filed word, either the first half or the last ones are the same too."""
    out = []
    length = F.char_length(word)
    for side in (0, 1):  # 0: the edit is to the right of the bigram; 1: to its left
        same = F.substring(word, F.lit(1), at + GRAM) if side == 0 else F.substring(word, at + 1, length)
        rest = size - F.char_length(same)       # letters of the filed word on the edit's side
        half = F.shiftright(F.greatest(rest, F.lit(0)), 1)
        start = at + GRAM + 1 if side == 0 else F.lit(1)
        stop = length if side == 0 else at      # last letter (from 1) of this word's own rest
        left = F.substring(word, start, half)
        right = F.substring(word, stop - (rest - half) + 1, rest - half)
        ok = (rest >= 0) & (stop - start + 1 >= F.greatest(half, rest - half))  # long enough to share either half
        for part, text in enumerate((left, right)):
            out.append(F.when(ok, F.xxhash64(F.lit(2 * side + part), size, same, text)))
    return F.array_compact(F.array(*out))


def links(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: all ordered pairs of words within one edit. ``words`` has ``word``, ``n``."""
    words = words.where(F.char_length("word") >= SHORTEST)
    marked = parked(words.select("word", "n").mapInArrow(marker(gram_order(words)), MARKED), "pivots")
    size = F.char_length("word")
    index = (marked.select("word", "n", "last", F.explode("prefix").alias("at"))
             .select("word", "n", "last", F.explode(keys(F.col("word"), F.col("at"), size)).alias("key")).alias("s"))
    probes = (marked.select("word", "n", "last", F.explode("pivots").alias("at"))
              .select("word", "n", "last", "at", F.explode(F.sequence(size - EDITS, size + EDITS)).alias("size"))
              .select("word", "n", "last", F.explode(keys(F.col("word"), F.col("at"), F.col("size"))).alias("key")).alias("r"))
    meet = (F.col("r.key") == F.col("s.key")) & (F.col("r.last") <= F.col("s.last")) & (F.col("r.word") != F.col("s.word"))
    pairs = (probes.join(unbroadcast(index), meet).where(F.levenshtein("r.word", "s.word", EDITS) == EDITS)
             .select(F.col("r.word").alias("word"), F.col("r.n").alias("n"), F.col("s.word").alias("near"), F.col("s.n").alias("near_n")))
    pairs = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                           F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the end of every chain of ``word`` -> ``form``. Pointer doubling over words with a form."""
    step = parked(forms, "forms")
    while True:
        ahead = step.select(F.col("word").alias("mid"), F.col("form").alias("after"))
        step = step.join(unbroadcast(ahead), F.col("form") == F.col("mid"), "left")
        step = parked(step.select("word", F.coalesce("after", "form").alias("form"), F.col("after").isNotNull().alias("moved")), "forms")
        if not step.agg(F.coalesce(F.bool_or("moved"), F.lit(False))).first()[0]:
            return step.select("word", F.col("form").alias("root"))
        step = step.select("word", "form")


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every row of ``words`` (``word``, ``n``)."""
    words = parked(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = links(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = parked(near.select("word", "n_near", F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best")).alias("best")), "near")
    ends = roots(near.where("best is not null").select("word", F.col("best.near").alias("form")))
    return (words.join(unbroadcast(near), "word", "left").join(unbroadcast(ends), "word", "left")
            .select("word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.m")).alias("form_n")))
