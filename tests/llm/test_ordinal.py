import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens.llm import ordinal_quality as O
from triagelens.llm.common import read

SF = "/root/testdata/sf0.1"


def test_solver_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    truth = {7: 3.0, 8: -3.0}
    rows, grades = [], []
    for _ in range(3000):
        ids = [i for i in range(30) if rng.random() < 0.3]
        eta = sum(truth.get(i, 0) for i in ids) + rng.logistic()
        rows.append(np.array(ids))
        grades.append(int(eta > -1) + int(eta > 1))
    m = O.solve(rows, np.array(grades), l2=0.1)
    w = dict(zip(m.ids.tolist(), m.weights))
    assert w[7] == pytest.approx(3, abs=0.5) and w[8] == pytest.approx(-3, abs=0.5)
    assert m.thresholds[0] < m.thresholds[1] and max(abs(w[i]) for i in w if i not in truth) < 0.5


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    seen = []
    keep = O.lbfgs
    try:
        O.lbfgs = lambda f, x, steps: seen.append(f) or x
        O.solve([rng.choice(9, 4, replace=False) for _ in range(50)], rng.integers(0, 3, 50))
    finally:
        O.lbfgs = keep
    f, x = seen[0], rng.normal(size=11) * 0.3
    _, g = f(x)
    for i in range(11):
        e = np.zeros(11)
        e[i] = 1e-6
        assert (f(x + e)[0] - f(x - e)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-3, abs=1e-4)


def test_held_out_accuracy(llm):
    docs, grades = read(llm, SF, "documents"), O.graded(read(llm, SF, "labels"))
    held = F.pmod(F.xxhash64("rated_id", F.lit(7)), F.lit(5)) == 0
    model = O.fit(docs, grades.where(~held))
    rated = docs.join(grades.where(held), F.col("doc_id") == F.col("rated_id"))
    got = O.score(rated, model).groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept"),
                                                     F.avg("expected_grade").alias("mean")).collect()
    by = {r.grade: r for r in got}
    assert by[2].kept > 0.97 and by[1].kept < 0.15 and by[0].kept < 0.2
    assert by[0]["mean"] < by[1]["mean"] < by[2]["mean"]


def test_odd_rows(llm, odd_docs, no_docs):
    labels = llm.createDataFrame([(3, 1, 0), (3, 0, 0), (4, None, 1), (None, 1, 1), (5, 0, 1), (6, 1, 0), (7, 1, 0), (8, 1, 0)],
                                 "doc_id long, quality int, toxic int")
    grades = O.graded(labels)
    assert sorted(map(tuple, grades.collect())) == [(3, 1), (5, 0), (6, 2), (7, 2), (8, 2)]
    model = O.fit(odd_docs, grades, min_docs=1)
    out = O.score(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.tail_top <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    assert O.keep(odd_docs, model).columns == odd_docs.columns
    flat = O.fit(odd_docs, grades.where("grade = 2"))
    assert O.keep(odd_docs, flat).count() == odd_docs.count()
    assert O.keep(no_docs, model).count() == 0 and O.fit(no_docs, grades).thresholds.size == 0
    assert O.fit(odd_docs, grades, fit_rows=1, min_docs=1).thresholds.size == 0  # one row, one grade


def test_a_repeated_id_is_one_row_of_the_fit(llm):
    """A rated id on many rows reaches the solving task once, and the model does not depend on their order."""
    docs = read(llm, SF, "documents").select("doc_id", "text").limit(60).checkpoint()
    grades = O.graded(read(llm, SF, "labels"))
    one = docs.join(grades, F.col("doc_id") == F.col("rated_id")).select("doc_id").first().doc_id
    many = docs.unionByName(docs.where(F.col("doc_id") == one).crossJoin(llm.range(200)).select("doc_id", F.concat("text", F.lit(" zz")).alias("text")))
    a, b = (O.fit(many.repartition(n), grades, min_docs=1) for n in (1, 7))
    assert a.ids.tolist() == b.ids.tolist() and np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)
