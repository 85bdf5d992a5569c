"""Ranked lexical search, reversed: the queries are indexed and the documents stream by.

The items' terms form an inverted index (term -> items), small enough to broadcast in
blocks of at most ``BLOCK`` postings. One pass over the documents counts each text's
terms, keeps those the index knows, and carries the corpus figures (documents, terms,
document frequencies) along; the counts are stored where executors share them. A second
pass streams these counts through the index: a batch of documents adds its terms'
contributions to a (document, item) table, and every item keeps a bounded heap of its k
best. Tasks send their heaps, k rows per item, and a ranked window merges them. No pair
of a document and an item becomes a row.

Score. A term's weight is ``floor(1000 * ln((2N + 2) / (2 df + 1)))`` and a document adds
``weight * ((10**9 * tf) div (1000 * tf + 8 * m))`` with ``m = 100 - 90 + (90 * n * N) div L``
for each of the item's terms once; all but the logarithm is integer.

An item with more distinct terms than a block holds is split by term over several
blocks; its heaps would then see partial scores only, so these blocks send their
partial scores as rows, which are added up per (item, document row) before the ranking.

Edge cases: null and empty texts have no term; such documents count nowhere and such
items rank nothing. Rows with a null document id count in the corpus figures but are not
ranked; null item ids are left out; rows that repeat an item id are one item with all
their terms. Every document row is a document: repeated rows are ranked one by one.
Equal scores go to the smaller id. Fewer than k documents with a score above 0: all of
them. Texts of any length are counted in slices of ``SLICE`` bytes. Empty tables: empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# ---- Fixed values: the contract's terms and the constants of its score ----
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT, GAIN, BASE, LENGTH_SHARE, STEP = 10**9, 1000, 100, 90, 8
# ---------------------------------------------------------------------------
BLOCK = 1_000_000    # postings of one broadcast index
CELLS = 1 << 22      # (document, item) cells scored at once
SLICE = 1 << 20      # bytes of a text counted at once
TEXTS = "doc_id long, text binary, row long"
COUNTS = "kind int, doc_id long, n long, terms binary, tfs binary, row long"
FOUND = "item_id long, doc_id long, score long, row long"
# Non-term bytes become blanks, A-Z lower case; bytes above 0x7F belong to terms.
TABLE = bytes(b if b > 127 or chr(b) in LOWER + "0123456789" else b + 32 if chr(b) in UPPER else 32 for b in range(256))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id``, ``term``: every distinct term of every item."""
    text = F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER)
    return (items.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(text, F.lit(TERM), 0)).alias("term"))
            .distinct())


def term_counts(text: bytes) -> Counter:
    """Occurrences of every term of one UTF-8 text."""
    counts: Counter = Counter()
    plain, at = text.translate(TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)  # a slice ends between terms
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


class Index:
    """Inverted index of one block of items; ``weights`` are filled in from the corpus figures."""

    def __init__(self, pairs: list[tuple[int, bytes]]):
        self.items = np.array(sorted({i for i, _ in pairs}), np.int64)
        terms = sorted({t for _, t in pairs})
        self.vocabulary = {t: n for n, t in enumerate(terms)}
        term = np.array([self.vocabulary[t] for _, t in pairs], np.int64)
        item = np.searchsorted(self.items, np.array([i for i, _ in pairs], np.int64))
        order = np.argsort(term, kind="stable")
        self.postings = item[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms)))))
        self.weights = np.zeros(len(terms), np.int64)

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        for t, n in df.items():
            self.weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))

    def scores(self, term: np.ndarray, value: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Score table (documents x items) of the counted terms of a few documents."""
        each = self.start[term + 1] - self.start[term]
        first = np.repeat(self.start[term] - (np.cumsum(each) - each), each)
        cell = np.repeat(doc, each) * len(self.items) + self.postings[first + np.arange(len(first))]
        out = np.zeros(docs * len(self.items), np.int64)
        np.add.at(out, cell, np.repeat(value, each))
        return out.reshape(docs, len(self.items))


def counter(shared):
    """Function for mapInArrow: known terms of each document (kind 0), and a task's figures (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        df, documents, terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            out = []
            for doc_id, text, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                counts = term_counts(text.as_py() or b"")
                if not counts:
                    continue
                n = counts.total()
                known = {vocabulary[t]: counts[t] for t in counts.keys() & vocabulary.keys()}
                at = np.fromiter(known.keys(), np.int32, len(known))
                df[at] += 1
                documents, terms = documents + 1, terms + n
                if doc_id is not None and known:
                    out.append((0, doc_id, n, at.tobytes(), np.fromiter(known.values(), np.int64, len(known)).tobytes(),
                                row))
            yield packed(out)
        seen = np.nonzero(df)[0]
        yield packed([(1, documents, terms, seen.astype(np.int32).tobytes(), df[seen].tobytes(), None)])
    return run


def packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      names=["kind", "doc_id", "n", "terms", "tfs", "row"])


def found_rows(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score", "row"])


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``m`` of documents with n terms; exact beyond 64 bits as well."""
    if int(n.max(initial=0)) * LENGTH_SHARE * documents < 2**63:
        return BASE - LENGTH_SHARE + n * LENGTH_SHARE * documents // terms
    return np.array([BASE - LENGTH_SHARE + int(x) * LENGTH_SHARE * documents // terms for x in n], np.int64)


def scorer(shared, k: int, documents: int, terms: int, heaps: bool):
    """Function for mapInArrow: the k best of a task's documents per item, or all their scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in index.items]  # heaps of (score, -doc_id), worst first
        floor = np.ones(len(index.items), np.int64)  # smallest score that can still enter
        step = max(1, CELLS // max(1, len(index.items)))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                ids, n = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                found = [np.frombuffer(x.as_py(), np.int32) for x in part.column(2)]
                doc = np.repeat(np.arange(len(ids)), [len(x) for x in found])
                term = np.concatenate(found).astype(np.int64)
                tf = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64)
                m = lengths(n, documents, terms)
                value = index.weights[term] * (UNIT * tf // (GAIN * tf + STEP * m[doc]))
                scores = index.scores(term, value, doc, len(ids))
                d, i = np.nonzero(scores >= floor[None, :])
                if not heaps:
                    rows = part.column(4).to_numpy(zero_copy_only=False)
                    yield found_rows((index.items[i], ids[d], scores[d, i], rows[d]))
                    continue
                for item, entry in zip(i.tolist(), zip(scores[d, i].tolist(), (-ids[d]).tolist())):
                    heap = best[item]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    else:
                        continue
                    if len(heap) == k:
                        floor[item] = max(1, heap[0][0])
        rows = [(int(index.items[i]), -d, s, None) for i, heap in enumerate(best) for s, d in heap]
        for s in range(0, len(rows), 1 << 16):
            yield found_rows(zip(*rows[s:s + (1 << 16)]))
    return run


def _blocks(postings: DataFrame, by: list[Column], limit: int) -> tuple[DataFrame, int]:
    """``postings`` with a ``block``, and the number of blocks: none holds more than ``limit`` rows."""
    total = postings.count()
    blocks = max(1, -(-2 * total // limit)) if total > limit else 1
    while True:
        cut = postings.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(blocks)))
        if blocks == 1 or cut.groupBy("block").count().agg(F.max("count")).first()[0] <= limit:
            return cut, blocks if total else 0
        blocks *= 2


def _searched(texts: DataFrame, pairs: DataFrame, k: int, heaps: bool) -> DataFrame:
    """Scores of one block of postings: two streams over the documents."""
    spark, sc = texts.sparkSession, texts.sparkSession.sparkContext
    index = Index([(r.item_id, bytes(r.term)) for r in pairs.select("item_id", F.col("term").cast("binary")).collect()])
    path = scratch_path(spark, "reversed")
    texts.mapInArrow(counter(sc.broadcast(index)), COUNTS).write.parquet(path)
    counts = spark.read.schema(COUNTS).parquet(path)
    tasks = counts.where("kind = 1")
    documents, terms = tasks.agg(F.coalesce(F.sum("doc_id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, f in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int32).astype(np.int64)),
                                                  pa.array(np.frombuffer(f, np.int64))], names=["term", "df"])

    df = tasks.select("terms", "tfs").mapInArrow(unpacked, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    index.weigh(documents, {r.term: r.df for r in df.collect()})  # at most one row per posting of the block
    run = scorer(sc.broadcast(index), k, documents, terms, heaps)
    return counts.where("kind = 0").select("doc_id", "n", "terms", "tfs", "row").mapInArrow(run, FOUND)


def totals(scores: DataFrame) -> DataFrame:
    each = scores.groupBy("item_id", "doc_id", "row").agg(F.sum("score").alias("score"))
    return each.select("item_id", "doc_id", "score", "row")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text",
         item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of every item."""
    spark = docs.sparkSession
    path = scratch_path(spark, "postings")
    item_terms(items, item_id, item_text).write.parquet(path)
    postings = spark.read.schema("item_id long, term string").parquet(path)
    giants = postings.groupBy("item_id").count().where(F.col("count") > block // 2).select("item_id")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("binary").alias("text"),
                        F.monotonically_increasing_id().alias("row"))
    found = spark.createDataFrame([], FOUND)
    for heaps, part, by in ((True, postings.join(giants, "item_id", "left_anti"), [F.col("item_id")]),
                            (False, postings.join(giants, "item_id", "left_semi"), [F.col("item_id"), F.col("term")])):
        cut, blocks = _blocks(part, by, block)
        kept = scratch_path(spark, "found")
        if blocks and not heaps:  # partial scores meet by row: a table keeps its row numbers, a plan need not
            path = scratch_path(spark, "texts")
            texts.write.parquet(path)
            texts = spark.read.schema(TEXTS).parquet(path)
        for b in range(blocks):  # one block's rows are written before the next block streams by
            scores = _searched(texts, cut.where(F.col("block") == b), k, heaps)
            scores.write.mode("append").parquet(kept)
        if blocks:
            scores = spark.read.schema(FOUND).parquet(kept)
            found = found.unionByName(scores if heaps else totals(scores))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
