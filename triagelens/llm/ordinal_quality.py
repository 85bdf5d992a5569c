"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered (0 toxic, 1 poor, 2 good). One weight vector over hashed text
features is shared by all grades and ordered thresholds separate them:
P(grade >= j) = sigmoid(w.x - theta_j), theta_1 < theta_2. A document's expected
grade is the sum of its tail probabilities; it is kept if the tail probability of
the top grade reaches ``min_tail``.

Features are a text's distinct words (lower-case, without outer punctuation), their
beginnings, the punctuation around them, and shares of capitals, symbols and repeats in tenths, each
hashed to 30 bits. Words count by presence, so one slur weighs as much in a long
text as in a short one. Weights exist only for features that enough fitted
documents hold, so unseen words of a long text add nothing and a hash
collision with a weighted feature is rare.

Fit. At most ``FIT_ROWS`` labelled documents (the ones with the smallest hash of
their id) are featurised where they lie; their feature ids, not their texts, meet in one task,
which solves the convex problem, and the driver gets the weights. Both bounds are
parameters. Every document is scored, whole, in one map-side pass; the model is at most
``MAX_FEATURES`` weights.

Edge cases: a null or empty text has only the shape features. Repeated label rows
of a document count as one, with the worst rating; labels with a null id or rating
are left out. With no labelled document, or a single grade, the model is flat and
every document is kept. Null document ids are scored like others. Empty table:
empty result. Extra columns are kept by ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 10_000        # labelled documents fitted at most
MAX_FEATURES = 1 << 17   # weights kept at most
MIN_DOCS = 4             # fitted documents a feature must be in
MIN_TAIL = 0.5           # P(grade >= top) of a kept document
HASH_BITS = 30
STEM = 4                 # letters of a longer word's beginning
MEMO_WORDS = 500_000
L2 = 1.0
STEPS = 120

EDGES = re.compile(r"^(\W*)(.*?)(\W*)$", re.DOTALL)
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-]")


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "replace")) >> (64 - HASH_BITS)


def word_features(word: str) -> tuple[int, ...]:
    """Feature ids of one white-space-separated word."""
    before, core, after = EDGES.match(word).groups()
    core = core.lower()
    out = [bucket("w:" + core)] if core else []
    if len(core) > STEM:  # an inflected word also counts by its beginning
        out.append(bucket("s:" + core[:STEM]))
    out += [bucket("p:" + p) for p in (before, after) if p]
    return tuple(out)


def shape_features(text: str, parts: list[str], distinct: int) -> list[int]:
    """Shares of capitals, symbols and repeats, in tenths, and of very short texts."""
    n = len(parts)
    tenth = lambda a, b: min(10, 10 * a // max(b, 1))
    upper = sum(w.isupper() and len(w) > 1 for w in parts)
    out = [f"upper:{tenth(upper, n)}", f"symbols:{tenth(len(SYMBOLS.findall(text)), n)}"]
    if n < 400:
        out.append(f"distinct:{min(n, 399) // 100}:{tenth(distinct, n)}")
    if n < 20:
        out.append(f"words:{n // 4}")
    return [bucket(f) for f in out]


class Features(dict):
    """Memo of word -> feature ids, limited to the ids in ``known`` when given."""

    def __init__(self, known: dict[int, int] | None = None):
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = word_features(word)
        if self.known is not None:
            ids = tuple(self.known[i] for i in ids if i in self.known)
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str | None) -> set[int]:
        text = text or ""
        parts = text.split()
        distinct = set(parts)
        out = {i for ids in map(self.__getitem__, distinct) for i in ids}
        shape = shape_features(text, parts, len(distinct))
        return out.union(shape if self.known is None else (self.known[i] for i in shape if i in self.known))


@dataclass(frozen=True)
class OrdinalModel:
    """Feature ids (sorted), their weights, and the ordered thresholds."""
    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def solve(rows: list[np.ndarray], grades: np.ndarray, l2: float = L2, steps: int = STEPS,
          min_docs: int = MIN_DOCS, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Maximum penalised likelihood by L-BFGS over weights and threshold gaps."""
    found = sorted(set(grades.tolist()))
    if len(found) < 2:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    flat = np.concatenate(rows)
    ids, counts = np.unique(flat, return_counts=True)
    ids = ids[counts >= min_docs] if (counts >= min_docs).sum() <= max_features else \
        np.sort(ids[np.lexsort((ids, -counts))[:max_features]])
    at = np.searchsorted(ids, flat).astype(np.int32)
    hit = ids[np.minimum(at, len(ids) - 1)] == flat if len(ids) else np.zeros(len(flat), bool)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[hit]
    col, n, k, d = at[hit], len(rows), len(found) - 1, len(ids)
    del flat, at, hit
    level = np.searchsorted(found, grades)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.concatenate(([p[0]], p[0] + np.cumsum(np.exp(p[1:]))))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, p = v[:d], v[d:]
        theta = np.concatenate(([-np.inf], thresholds(p), [np.inf]))
        eta = np.bincount(row, w[col], n)
        upper, lower = theta[level + 1] - eta, theta[level] - eta  # P(grade = level) = S(upper) - S(lower)
        su, sl = np.where(np.isinf(upper), 1.0, sigmoid(upper)), np.where(np.isinf(lower), 0.0, sigmoid(lower))
        prob = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su) / prob, sl * (1 - sl) / prob
        g_eta = du - dl
        g_theta = np.zeros(k)
        np.add.at(g_theta, level[level < k], -du[level < k])
        np.add.at(g_theta, level[level > 0] - 1, dl[level > 0])
        g_p = np.array([g_theta.sum(), *[np.exp(p[j]) * g_theta[j:].sum() for j in range(1, k)]])
        g_w = np.bincount(col, g_eta[row], d) + l2 * w
        return -np.log(prob).sum() + 0.5 * l2 * w @ w, np.concatenate((g_w, g_p))

    share = np.array([np.mean(level < j) for j in range(1, k + 1)])
    start = np.log(share / (1 - share))
    v = np.concatenate((np.zeros(d), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))))
    v = lbfgs(loss, v, steps)
    return OrdinalModel(ids.astype(np.int64), v[:d], thresholds(v[d:]))


def lbfgs(f, x: np.ndarray, steps: int, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    """Minimise a smooth function given with its gradient; backtracking line search."""
    fx, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(np.linalg.norm(g), 1.0)
        for (s, y, rho), a in zip(pairs, reversed(alphas)):
            q += (a - rho * (y @ q)) * s
        t, slope = 1.0, -(g @ q)
        while True:
            fn, gn = f(x - t * q)
            if fn <= fx + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = -t * q, gn - g
        done = abs(fx - fn) <= tol * max(1.0, abs(fx)) * 1e-2
        x, fx, g = x + s, fn, gn
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1:], (s, y, 1 / (s @ y))]
        if done:
            break
    return x


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels to grades: toxic 0, poor quality 1, good 2; one row per document, the worst rating."""
    rated = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return rated.groupBy(F.col(id_col).alias("rated_id")).agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        fit_rows: int = FIT_ROWS, **solver) -> OrdinalModel:
    """Fit on at most ``fit_rows`` documents of ``grades`` (rated_id, grade)."""
    chosen = grades.orderBy(F.xxhash64("rated_id"), "rated_id").limit(fit_rows)
    sample = docs.select(F.col(id_col).alias("rated_id"), F.col(text_col).alias("body")).join(
        F.broadcast(chosen), "rated_id")  # at most fit_rows rows

    @F.pandas_udf("array<int>")
    def feature_ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Features()
        for batch in texts:
            yield pd.Series([sorted(memo.of(t)) for t in batch])

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rated_id", kind="stable")
        m = solve([np.asarray(r, np.int32) for r in pdf["ids"]], pdf["grade"].to_numpy(), **solver)
        return pd.DataFrame([[x.tobytes() for x in (m.ids, m.weights, m.thresholds)]], columns=["ids", "weights", "thresholds"])

    # one task, one bounded sample: at most fit_rows lists of feature ids, for an id that repeats is
    # reduced to its smallest list where its rows are
    rows = sample.select("rated_id", "grade", feature_ids("body").alias("ids"))
    rows = rows.groupBy("rated_id", "grade").agg(F.min("ids").alias("ids"))
    model = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(solved, "ids binary, weights binary, thresholds binary").first()
    if model is None:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    return OrdinalModel(np.frombuffer(model.ids, np.int64), np.frombuffer(model.weights), np.frombuffer(model.thresholds))


def tails(text: Column, model: OrdinalModel) -> Column:
    """Tail probabilities P(grade >= 1), P(grade >= 2), ... of a text as array<double>."""
    known = dict(zip(model.ids.tolist(), range(len(model.ids))))
    weights, thresholds = model.weights, model.thresholds

    @F.pandas_udf("array<double>")
    def tail(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Features(known)
        for batch in texts:
            eta = np.array([sum(weights[i] for i in sorted(memo.of(t))) for t in batch])
            yield pd.Series(list(sigmoid(eta[:, None] - thresholds[None, :])))

    return tail(text)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", min_tail: float = MIN_TAIL) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_top`` and ``kept`` (replacing columns of those names)."""
    old = [c for c in docs.columns if c not in ("expected_grade", "tail_top", "kept")]
    if not len(model.thresholds):
        return docs.select(*old, F.lit(None).cast("double").alias("expected_grade"),
                           F.lit(None).cast("double").alias("tail_top"), F.lit(True).alias("kept"))
    rows = docs.select("*", tails(F.col(text_col), model).alias("__t"))
    total = F.aggregate("__t", F.lit(0.0), lambda a, x: a + x)
    top = F.element_at("__t", -1)
    return rows.select(*[rows[c] for c in old], total.alias("expected_grade"), top.alias("tail_top"),
                       (top >= min_tail).alias("kept"))


def keep(docs: DataFrame, model: OrdinalModel, text_col: str = "text", min_tail: float = MIN_TAIL) -> DataFrame:
    """Rows of ``docs`` the model keeps, columns as given."""
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(text_col).alias("__body"))
    return score(inner, model, "__body", min_tail).where("kept").select("__row.*")
