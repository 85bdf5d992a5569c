import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens.llm import vafile_search as V

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def table(seed, n=400, dim=12, spread=1.0):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, spread) for _ in range(dim)], 0, "s", "r") for i in range(n)]
    rows += [(n + i, rows[3][1], 1, "s", "r") for i in range(60)]  # a hot vector: ties
    rows += [(1000, None, 0, "", ""), (1050, [1.0, None] * 6, 0, "", ""), (1100, [float("nan")] * dim, 0, "", ""),
             (1150, [float("inf")] + [0.0] * (dim - 1), 0, "", ""), (None, rows[0][1], 0, "", ""), (1200, [0.5, 0.5], 0, "", ""),
             (1201, [0.25, 0.5], 0, "", ""), (1250, [], 0, "", ""), rows[7], rows[50], (1300, [0.0] * dim, 0, "", "")]
    return rows


def brute(rows, k):
    vs = {}
    ok = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    for i, v in ok:
        if i % 50 == 0:
            vs[i] = min(vs.get(i, v), v)
    out = set()
    for q, v in vs.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("k,query_block,spread", [(5, 16_384, 0.3), (3, 4, 0.01), (700, 16_384, 100.0)])
def test_equals_brute_force(llm, k, query_block, spread):
    rows = table(k, spread=spread)
    df = llm.createDataFrame(rows, SCHEMA).repartition(3)
    got = V.top_k(df, F.col("vec_id") % 50 == 0, k=k, query_block=query_block).collect()
    assert {tuple(r) for r in got} == brute(rows, k)
    assert len(got) == len(set(got))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (2000, 16))
    q = rng.integers(-300, 300, (20, 16))
    block = V.Approximation(np.arange(2000), x)
    low, high = block.bounds(q)
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    kth = np.sort(low, axis=1)[:, -5]
    assert (high >= kth[:, None]).mean() < 0.2  # most exact vectors are never read
    assert (block.marks[np.arange(16), block.cell] <= x).all() and (x <= block.marks[np.arange(16), block.cell + 1]).all()


def test_empty(llm):
    df = llm.createDataFrame([], SCHEMA)
    assert V.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_products_beyond_64_bits(llm):
    """Exact where the best fit, an error where they do not: never a wrapped score."""
    big = 2.0 ** 23
    rows = [(0, [big, big]), (1, [-big, -big]), (2, [big, -big]), (3, [-big, 1.0])]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = V.top_k(df, F.col("vec_id") == 0, k=1, scale=2 ** 8).collect()
    assert [(r.vec_id, r.score) for r in wide] == [(2, 0)]
    more = llm.createDataFrame([(0, [big * 4] * 4), (1, [big * 4] * 4), (2, [0.0] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)int too large|overflow|too big"):
        V.top_k(more, F.col("vec_id") == 0, k=1).collect()
