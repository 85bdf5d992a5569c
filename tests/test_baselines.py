"""Vocabulary certificate, row vectors, and the optimality certificate of the classifier."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triagelens.operators import baselines as B
from triagelens.operators import textvec as TV

WORDS = ["alpha", "beta", "gamma", "delta", "refund", "crash", "login", "price"]
TOPICS = {"bill": ["refund", "price"], "bug": ["crash", "login"], "other": ["alpha", "beta"]}


def rows(n=150, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        label = rnd.choice(list(TOPICS))
        out.append((i, " ".join(rnd.choice(WORDS + TOPICS[label] * 3) for _ in range(rnd.randint(1, 12))), label))
    return out + [(n, None, "bug"), (n + 1, "", "bill"), (n + 2, "alpha crash", None)]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(rows(), "id long, text string, label string").repartition(4).checkpoint()


def zipf(n, seed):
    rnd = random.Random(seed)
    return [" ".join(f"t{int(rnd.paretovariate(0.7))}" for _ in range(30)) for _ in range(n)]


def brute_vocabulary(texts, size):
    total, df = Counter(), Counter()
    for t in texts:
        w = (t or "").lower().split()
        ts = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        total.update(ts), df.update(set(ts))
    top = sorted(total, key=lambda x: (-total[x], x))[:size]
    return {x: df[x] for x in top}


@pytest.mark.parametrize("size,tracked,by_sketch", [(20, 4096, True), (20, 64, None), (900, 1024, False), (10**5, 2**17, True)])
def test_vocabulary_is_the_exact_one_by_either_path(spark, monkeypatch, size, tracked, by_sketch):
    """Small sketches overestimate; then the certificate fails and the exact aggregate answers."""
    texts = zipf(300, 5) + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    exact = []
    monkeypatch.setattr(TV, "term_stats", lambda *a, f=TV.term_stats: exact.append(1) or f(*a))
    model = TV.fit(df, "text", size, tracked=tracked)
    assert {r.term: r.df for r in model.vocab.collect()} == brute_vocabulary(texts, size)
    assert by_sketch is None or bool(exact) != by_sketch


def test_certificate_rejects_ties_and_short_lists():
    assert TV.certified([{"total": 5}, {"total": 3}], 2, 2)
    assert not TV.certified([{"total": 5}, {"total": 3}], 3, 2)
    assert not TV.certified([{"total": 5}], 1, 2)
    assert TV.certified([], 0, 2)


def test_transform_moves_no_text(spark, train):
    model = TV.fit(train, "text")
    plan = TV.transform(model, train, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffleExchange" not in plan and "Exchange hashpartitioning" not in plan and "Exchange RoundRobin" not in plan
    got = TV.vectors(model, train, "text").collect()
    for r in got:
        norm = sum(e.weight ** 2 for e in r.vector)
        assert (norm == 0 and not r.vector) if not r.text else abs(norm - 1) < 1e-9
        assert [e.term_id for e in r.vector] == sorted({e.term_id for e in r.vector})
    assert TV.transform(TV.fit(train.where("false"), "text"), train, "id", "text").count() == 0


def test_stored_weights_are_certified(spark, train):
    good = B.fit_logreg(train, "text", "label", tol=1e-10)
    r = B.certificate(good, train, "label", good.weights()).first()
    assert (r.n, r.n_classes) == (152, 3) and r.gradient < 1e-5 and -1e-9 <= r.gap < 1e-6
    poor = B.fit_logreg(train, "text", "label", max_iter=2)
    q = B.certificate(poor, train, "label", poor.weights()).first()
    assert q.objective > r.objective and q.gap >= q.objective - r.objective - 1e-3 and q.gradient > 1e-3
    off = good.weights().withColumn("weights", F.transform("weights", lambda x: x * 1.1))
    assert B.certificate(good, train, "label", off).first().gradient > 1e-4


def test_fold_models_equal_fits_on_the_training_folds(spark, train):
    folded = train.where("label is not null").withColumn("fold", (F.col("id") % 3).cast("int")).withColumn("t", TV.terms(F.col("text")))
    for i, m in enumerate(B.fold_models(folded, "t", "fold", 3, 40)):
        alone = TV.fit(folded.where(F.col("fold") != i), "text", 40)
        assert m.entries == alone.entries and m.n_docs == alone.n_docs


def test_cross_validation_predicts_every_row_once(train):
    got = B.cv_predictions(train, "id", "text", "label", 3).select("id", "pred", "label").collect()
    assert sorted(r.id for r in got) == list(range(152))
    assert sum(r.pred == r.label for r in got) > 90


def test_training_deals_vectors_not_terms(spark, monkeypatch):
    """a training partition held 100,000 rows' terms as strings, however long the texts."""
    from pyspark.ml.classification import LogisticRegression
    rows = [(i, f"word{i % 3} other{i % 5} and more words for row {i % 2}", "ab"[i % 2]) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, text string, label string").repartition(3)
    monkeypatch.setattr(B, "WEIGHTS_PER_TRAIN_PARTITION", 50)
    monkeypatch.setattr(B, "MIN_ROWS_PER_TRAIN_TASK", 1)
    seen = []
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, f=LogisticRegression.fit: seen.append(df) or f(self, df))
    B.fit_logreg(d, "text", "label", max_iter=2)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # 60 rows of seven words and their six pairs, 50 to a partition; the vectors are computed below the exchange
    top = next(i for i, x in enumerate(plan) if "Repartition" in x)
    assert "Repartition 16, true" in plan[top] and "__features" in plan[top + 1]
    assert seen[0].columns == ["__features", "__label"]


def test_terms_of_odd_texts(spark):
    """the terms stay the same without a filter and without backtracking."""
    texts = ["One two  three", "", None, "a b", "single", "É_1 x9-y ab", "aa a bb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r.t for r in rows.select("id", TV.terms("text").alias("t")).orderBy("id").collect()]
    assert got == [["one", "two", "three", "one two", "two three"], [], None, [], ["single"],
                   ["é_1", "x9", "ab", "é_1 x9", "x9 ab"], ["aa", "bb", "aa bb"]]
