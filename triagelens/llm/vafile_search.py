"""Exact top-k inner-product search by vector-approximation files.

Vectors are integers (``floor(scale * x)``). A block of candidates is approximated by
a few bits per dimension: the cell between two marks that a component falls in.
Scanning the cells alone bounds every inner product from both sides. Candidates
whose upper bound is below the k-th lower bound are never looked at again; the others
have their exact vectors read in bound order until the k-th exact score exceeds every
remaining bound, so the answer is exact.

Spark deals the candidates: every task scans its own blocks, carries the best k per
query over them, and sends k rows per query; a ranked window merges the tasks. The
queries travel in blocks of at most ``QUERY_BLOCK`` vectors (a proven size), each
block one pass over the candidates. No pair of a query and a candidate becomes a row.

Edge cases: vectors that are null, or hold a null or non-finite component, take no
part, nor do null ids. Vectors are compared with vectors of their own length only.
A query id that occurs twice asks once, with its smallest vector; every candidate row
counts. A query's own id is no candidate. Equal scores go to the smaller id. Fewer
than k candidates: all of them. Products beyond 64 bits are compared exactly; if one is among the
best k, the job fails, as ``score`` could not hold it. Vectors of any length that fits a
block (``BLOCK`` vectors at once) are held whole. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SCALE = 256
BITS = 5               # bits per dimension of the approximation
BLOCK = 4096           # candidates approximated at once
QUERY_BLOCK = 16_384   # queries of one pass
QUERY_CHUNK = 512      # queries bounded at once: QUERY_CHUNK x BLOCK bounds in memory
STEP = 32              # exact vectors read at once
OUT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``id``, ``v`` (array<long>) of the vectors that take part."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")))


class Approximation:
    """Cells of a block of integer vectors, and the bounds they give."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, bits: int = BITS):
        self.ids, self.exact = ids, exact
        cells = 1 << bits
        low, high = exact.min(axis=0).astype(float), exact.max(axis=0).astype(float)
        marks = np.floor(low[:, None] + (high - low)[:, None] * np.arange(cells + 1) / cells)  # dims x (cells + 1)
        marks[:, 0], marks[:, -1] = low, high
        width = np.maximum(high - low, 1.0)
        self.cell = np.minimum(((exact - low) * cells / width).astype(np.int64), cells - 1).astype(np.uint8)
        for shift in (-1, 1):  # rounding may put a component next to its cell
            d = np.arange(exact.shape[1])
            under = exact < marks[d, self.cell]
            over = exact > marks[d, self.cell + 1]
            self.cell = np.where(under & (shift < 0), self.cell - 1, np.where(over & (shift > 0), self.cell + 1, self.cell))
        self.marks = marks

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of every (query, vector) inner product."""
        d = np.arange(self.cell.shape[1])
        low, high = self.marks[d, self.cell], self.marks[d, self.cell + 1]
        plus, minus = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        slack = 1e-12 * (np.abs(queries).sum(axis=1, dtype=float)[:, None] * np.abs(self.marks).max(initial=0))
        return plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> None:
        """Fold this block into ``best``: per query the k best (-score, id), sorted."""
        lower, upper = self.bounds(queries)
        # beyond 64 bits an integer product wraps: such blocks are scored in Python's integers
        wide = float(np.abs(queries.astype(float)).sum(axis=1).max(initial=0)) * float(np.abs(self.exact.astype(float)).max(initial=0)) >= 2.0**62
        own = self.ids[None, :] == qids[:, None]
        lower[own], upper[own] = -np.inf, -np.inf
        n = len(self.ids)
        floor = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(qids), -np.inf)
        for i, q in enumerate(queries):
            have = best[i]
            need = max(floor[i], -have[-1][0] if len(have) == k else -np.inf)
            found = np.nonzero((upper[i] >= need) & (upper[i] > -np.inf))[0]
            if not len(found):
                continue
            found = found[np.lexsort((self.ids[found], -upper[i][found]))]
            tops = upper[i][found]
            for s in range(0, len(found), STEP):
                if len(have) == k and -have[-1][0] > tops[s]:
                    break
                some = found[s:s + STEP]
                scores = self.exact[some].astype(object) @ q.astype(object) if wide else self.exact[some] @ q
                have = sorted([*have, *zip((-scores).tolist(), self.ids[some].tolist())])[:k]
            best[i] = have


def scanner(qids: np.ndarray, queries: list[np.ndarray], k: int, bits: int):
    """Function for mapInArrow: the best k of a task's candidates for every query of the block."""
    by_dim: dict[int, np.ndarray] = {}
    for i, q in enumerate(queries):
        by_dim.setdefault(len(q), []).append(i)
    asks = {d: (qids[at], np.array([queries[i] for i in at], np.int64).reshape(len(at), d)) for d, at in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: [[] for _ in a[0]] for d, a in asks.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {d: [] for d in asks}

        def fold(d: int) -> None:
            ids, rows = (np.concatenate(x) for x in zip(*held[d]))
            held[d] = []
            block, (qid, q) = Approximation(ids, rows, bits), asks[d]
            for s in range(0, len(qid), QUERY_CHUNK):
                part = best[d][s:s + QUERY_CHUNK]
                block.search(qid[s:s + QUERY_CHUNK], q[s:s + QUERY_CHUNK], k, part)
                best[d][s:s + QUERY_CHUNK] = part

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for d in set(sizes.tolist()) & asks.keys():
                at = np.nonzero(sizes == d)[0]
                held[d].append((ids[at], flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)))
                if sum(len(x[0]) for x in held[d]) >= BLOCK:
                    fold(d)
        for d in asks:
            if held[d]:
                fold(d)
            rows = [(int(q), i, -s) for q, have in zip(asks[d][0], best[d]) for s, i in have]
            for s in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[s:s + (1 << 16)])],
                                                 names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, bits: int = BITS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows of ``vectors`` where ``asks`` holds."""
    spark = vectors.sparkSession
    pool = integers(vectors, id_col, vec_col, scale)
    queries = integers(vectors.where(asks), id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    n = queries.count()
    blocks = max(1, -(-n // (query_block // 2)))  # hashing fills blocks unevenly; half full leaves room
    best, path = None, scratch_path(spark, "vafile")
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        run = scanner(rows["id"].to_numpy(np.int64), [np.asarray(v, np.int64) for v in rows["v"]], k, bits)
        best = pool.mapInArrow(run, OUT)
        if blocks > 1:  # one pass per block of queries, each kept where executors share it
            best.write.mode("append").parquet(path)
    if blocks > 1:
        best = spark.read.schema(OUT).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
