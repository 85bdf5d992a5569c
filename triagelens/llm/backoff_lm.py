r"""Language-model scoring by a weighted backoff automaton over word bigrams.

Model. States are the training words and a start state. A state ``h`` has an arc for
every word seen after it, with p(w|h) = (1 - b) c(hw) / c(h) + b p(w), and a failure arc of
weight b to the unigram state, which reads every word with the smoothed unigram
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). The failure weight b depends on how often h was
seen: for each power-of-two range of c(h) it is the share of training tokens after such
states whose bigram occurs once, which is the chance that the next word is new (leave
one out). Every state's outgoing mass sums to one over known words and the unknown.

Scoring is one left-to-right pass that carries the state (the word just read) and adds
log10 of the arc, or of failure weight and unigram arc. A text ends with an end word.

Distribution. The automaton grows with the corpus, so it is never broadcast nor held
whole. Every split is read once into blocks of about ``BLOCK_BYTES`` of text, kept as word
numbers and word hashes in a table bucketed by block. A block sends its distinct words,
then its distinct bigrams of known words, each once with its training count, as packed
arrays to hash buckets; a bucket sums them over the blocks and answers every block with
the counts of what it sent, in the order it sent them. A block's own counts are 32-bit,
its texts being bounded; totals of the corpus go back in 32 bits where all of an answer
fit and in 64 where one does not. Answers move to the blocks, the
blocks never move. A block thus gets exactly the part of the automaton that its texts
can reach, and traverses it. A word or bigram in a third of all texts is one entry per
block, however often it occurs, and buckets are even, being ranges of a hash. Words and
bigrams travel as 64-bit hashes. Only totals and at most 64 failure weights reach the
driver.

Edge cases: a null or empty text is the end word alone. Rows with a null id score
as held out or training by the rule given. Repeated rows train as often as they occur.
Empty table, or nothing to train on: counts of zero and the smoothed unigram. Extra
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import parked

BLOCK_BYTES = 16 << 20     # text of one block
BUCKET_TOKENS = 4_000_000  # corpus tokens per hash bucket
ADD = 0.5                  # added to every unigram count
END = xxhash.xxh64_intdigest(b"", 1)  # the end word's hash: no word is empty
START = 0x9E3779B97F4A7C15
BLOCKS = ("block long, doc_ids array<long>, held_out array<boolean>, lengths binary, tokens binary, hashes binary, "
          "n_tokens long, n_train long")
SENT = "block long, bucket int, keys binary, counts binary, tags binary"
ANSWER = "block long, bucket int, totals binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SENT_COLUMNS = ["block", "bucket", "keys", "counts", "tags"]
SCORE_COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]


def blocked(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Documents (id, held out, text bytes) to rows of BLOCKS, in the order of their split."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                        ("lengths", pa.binary()), ("tokens", pa.binary()), ("hashes", pa.binary()),
                        ("n_tokens", pa.int64()), ("n_train", pa.int64())])
    number = TaskContext.get().partitionId() << 24
    ids, held, lengths, tokens, numbers, size = [], [], [], [], {}, 0

    def row() -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        hashes = np.concatenate((np.array([END], np.uint64), hashes)).astype("<u8")
        values = (number, ids, held, np.array(lengths, "<u4").tobytes(), b"".join(tokens), hashes.tobytes(),
                  sum(lengths), sum(not h for h in held))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

    for batch in batches:
        for doc, out, text in zip(*[c.to_pylist() for c in batch.columns]):
            words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
            own = [numbers.setdefault(w, len(numbers) + 1) for w in words]
            own.append(0)  # the end word
            ids.append(doc)
            held.append(out)
            lengths.append(len(own))
            tokens.append(np.array(own, "<u4").tobytes())
            size += len(text) + 64
            if size >= block_bytes:
                yield row()
                number += 1
                ids, held, lengths, tokens, numbers, size = [], [], [], [], {}, 0
    if ids:
        yield row()


class Block:
    """One row of BLOCKS as arrays; word 0 is the end word."""

    def __init__(self, pdf: pd.DataFrame):
        row = pdf.iloc[0]
        self.hashes = np.frombuffer(row["hashes"], "<u8")
        self.token = np.frombuffer(row["tokens"], "<u4").astype(np.int64)
        self.length = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.ids, self.held_out = list(row["doc_ids"]), np.array(row["held_out"], bool)
        self.in_train = np.repeat(~self.held_out, self.length)

    def word_counts(self) -> np.ndarray:
        """Training occurrences of every word number."""
        return np.bincount(self.token[self.in_train], minlength=len(self.hashes))

    def pairs(self) -> np.ndarray:
        """(state, word) of every token as one number; the start state is the number after the last word."""
        v = len(self.hashes)
        state = np.concatenate(([v], self.token[:-1]))
        state[self.first] = v
        return state * v + self.token


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C159E3779B9))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def packed(keys: np.ndarray, counts: np.ndarray, tags: np.ndarray, block: int, buckets: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows for the buckets, and the order in which the keys were sent: sorted, buckets being ranges."""
    order = np.argsort(keys)
    keys = keys[order]
    cut = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
    counts, tags = counts[order].astype("<u4"), tags[order].astype("u1")
    rows = [(block, b, keys[i:j].astype("<u8").tobytes(), counts[i:j].tobytes(), tags[i:j].tobytes())
            for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if i < j]
    return pd.DataFrame(rows, columns=SENT_COLUMNS), order


def widened(totals: np.ndarray) -> bytes:
    """Totals after one byte that says how many bytes each has: 4, or 8 if one needs them."""
    width = 8 if totals.max(initial=0) >= 1 << 32 else 4
    return bytes([width]) + totals.astype(f"<u{width}").tobytes()


def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: totals of every key over all blocks, sent back block by block.

    The row with block -1 carries the bucket's statistics: per tag, training tokens of
    keys that occur once and of all keys (tag 255: distinct trained keys and tokens)."""
    keys = [np.frombuffer(k, "<u8") for k in pdf["keys"]]
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in pdf["counts"]]).astype(np.int64)
    tags = np.concatenate([np.frombuffer(t, "u1") for t in pdf["tags"]])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, counts, len(distinct)).astype(np.int64)
    tag = np.zeros(len(distinct), np.int64)
    tag[at] = tags
    stats = np.concatenate((np.bincount(tag[total == 1], minlength=64)[:64], np.bincount(tag, total, 64)[:64],
                            [np.count_nonzero(total), total.sum()])).astype("<i8")
    back = total[at]
    cut = np.cumsum([0, *map(len, keys)])
    rows = [(int(b), key[0], widened(back[cut[i]:cut[i + 1]])) for i, b in enumerate(pdf["block"])]
    return pd.DataFrame([*rows, (-1, key[0], stats.tobytes())], columns=["block", "bucket", "totals"])


def answered(answers: pd.DataFrame) -> np.ndarray:
    """A block's answers in the order it sent its keys."""
    if answers.empty:
        return np.zeros(0, np.int64)
    rows = answers.sort_values("bucket")["totals"]
    return np.concatenate([np.frombuffer(t, f"<u{t[0]}", offset=1).astype(np.int64) for t in rows])


def unordered(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = values
    return out


def tag_of(c: np.ndarray) -> np.ndarray:
    """The power-of-two range of a count: floor(log2 c)."""
    return np.frexp(np.maximum(c, 1).astype(float))[1] - 1


def send_words(block: Block, number: int, buckets: int) -> tuple[pd.DataFrame, np.ndarray]:
    return packed(block.hashes, block.word_counts(), np.zeros(len(block.hashes)), number, buckets)


def state_counts(block: Block, c: np.ndarray, train_docs: int) -> np.ndarray:
    """Training occurrences of every state; the start state last."""
    return np.concatenate((c, [train_docs]))


def send_pairs(block: Block, c: np.ndarray, train_docs: int, number: int, buckets: int):
    """Distinct bigrams whose state and word are both trained; the rest have count zero."""
    v = len(block.hashes)
    pairs, at = np.unique(block.pairs(), return_inverse=True)
    counts = np.bincount(at[block.in_train], minlength=len(pairs))
    state, word = pairs // v, pairs % v
    seen = state_counts(block, c, train_docs)[state]
    open_ = (seen > 0) & (c[word] > 0)
    hashes = np.concatenate((block.hashes, np.array([START], np.uint64)))
    keys = mix(hashes[state[open_]], block.hashes[word[open_]])
    rows, order = packed(keys, counts[open_], tag_of(seen[open_]), number, buckets)
    return rows, order, open_, at, state, word


def traverse(block: Block, c: np.ndarray, pair_totals: np.ndarray, at: np.ndarray, state: np.ndarray, word: np.ndarray,
             failure: np.ndarray, n: int, v: int, train_docs: int) -> pd.DataFrame:
    """Every document's pass through the automaton, all documents of the block side by side."""
    unigram = (c + ADD) / (n + ADD * (v + 1))
    seen = state_counts(block, c, train_docs)[state]
    b = np.where(seen > 0, failure[tag_of(seen)], 1.0)
    arc = (1 - b) * pair_totals / np.maximum(seen, 1) + b * unigram[word]
    sums = lambda x: np.add.reduceat(x, block.first)  # noqa: E731  every document has its end word
    return pd.DataFrame({
        "doc_id": pd.array(block.ids, "Int64"), "held_out": block.held_out, "n_tokens": block.length,
        "n_known": sums((c[block.token] > 0).astype(np.int64)), "base_score": sums(np.log10(unigram)[block.token]),
        "score": sums(np.log10(arc)[at])})


def totals(answers: DataFrame) -> np.ndarray:
    """The buckets' statistics, summed: 64 counts of keys seen once, 64 of tokens, distinct keys, tokens."""
    @F.pandas_udf("array<long>")
    def read(stats: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in stats:
            yield pd.Series([np.frombuffer(x, "<i8") for x in s])

    rows = answers.where("block = -1").select(F.posexplode(read("totals"))).groupBy("pos").agg(F.sum("col").alias("n"))
    out = np.zeros(130, np.int64)
    for r in rows.collect():  # at most 130 rows
        out[r["pos"]] = r["n"]
    return out


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` per row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    table = f"lm_blocks_{uuid.uuid4().hex}"
    (rows.mapInArrow(lambda batches: blocked(batches, block_bytes), BLOCKS).write.format("parquet")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
     .option("path", scratch_path(spark, table)).option("compression", "zstd").saveAsTable(table))
    blocks = spark.table(table)
    n_tokens, train_docs = blocks.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    buckets, train_docs = max(1, -(-(n_tokens or 0) // bucket_tokens)), train_docs or 0

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                yield send_words(Block(pdf.iloc[i:i + 1]), int(pdf["block"].iloc[i]), buckets)[0]

    # only the columns that count words: the token numbers and the hashes
    words = parked(blocks.mapInPandas(words_of, SENT).groupBy("bucket").applyInPandas(summed, ANSWER), "lm_words")
    stats = totals(words)
    v, n = int(stats[128]), int(stats[129])

    def pairs_of(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:  # the statistics' rows have no block
            return pd.DataFrame(columns=SENT_COLUMNS)
        block = Block(pdf)
        order = send_words(block, key[0], buckets)[1]
        return send_pairs(block, unordered(answered(answers), order), train_docs, key[0], buckets)[0]

    groups = blocks.groupBy("block")
    sent = groups.cogroup(words.groupBy("block")).applyInPandas(pairs_of, SENT)
    pairs = parked(sent.groupBy("bucket").applyInPandas(summed, ANSWER), "lm_pairs")
    stats = totals(pairs)
    failure = (stats[:64] + 0.5) / (stats[64:128] + 1.0)

    def scores_of(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=SCORE_COLUMNS)
        block = Block(pdf)
        order = send_words(block, key[0], buckets)[1]
        c = unordered(answered(answers[answers["kind"] == 0]), order)
        _, order, open_, at, state, word = send_pairs(block, c, train_docs, key[0], buckets)
        seen = np.zeros(len(open_), np.int64)
        seen[open_] = unordered(answered(answers[answers["kind"] == 1]), order)
        return traverse(block, c, seen, at, state, word, failure, n, v, train_docs)

    both = words.withColumn("kind", F.lit(0)).unionByName(pairs.withColumn("kind", F.lit(1)))
    out = groups.cogroup(both.groupBy("block")).applyInPandas(scores_of, SCORES)
    out = parked(out.withColumn("train_tokens", F.lit(n).cast("long")), "lm_scores")
    spark.sql(f"DROP TABLE {table}")  # the catalogue entry; the scores no longer need the blocks
    return out
