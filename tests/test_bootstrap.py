"""Binomial splitting against the index form: whole counts, the same interval, no dependence on partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens.operators import bootstrap as BS


@pytest.fixture(scope="module")
def values(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([1.0, 2.0, 2.0, 3.5, 7.25]) if i % 3 else round(rnd.gauss(3, 1), 2)) for i in range(600)] + [(999, None)]
    return spark.createDataFrame(rows, "id long, x double").repartition(5)


def test_every_replicate_draws_n(spark, values):
    classes = values.where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    counts = BS.split_counts(classes, 120, 42)
    per = counts.groupBy("b").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("d")).collect()
    d = classes.count()
    assert len(per) == 120 and all((r.n, r.d) == (600, d) for r in per)  # one draw a distinct value
    # expected draws of a value are its own rows; four standard errors over 120 replicates
    own = {r.x: r.c for r in classes.collect()}
    for r in counts.groupBy("x").agg(F.avg("k").alias("k")).collect():
        assert abs(r.k - own[r.x]) < 4 * np.sqrt(own[r.x] / 120)


def test_interval_agrees_with_the_index_form(values):
    a = BS.bootstrap_ci(values, "x", "id", 1000, 0.95, 42, "index").first()
    b = BS.bootstrap_ci(values, "x", "id", 1000, 0.95, 42, "split").first()
    assert (a["mean"], a.n, a.n_boot) == (b["mean"], b.n, b.n_boot)
    width = a.ci_high - a.ci_low
    assert abs(a.ci_low - b.ci_low) < 0.1 * width and abs(a.ci_high - b.ci_high) < 0.1 * width
    assert abs((b.ci_high - b.ci_low) / width - 1) < 0.15


def test_partitions_change_nothing(values):
    a = BS.bootstrap_ci(values, "x", "id", 75, 0.9, 7, "split").first()
    assert a == BS.bootstrap_ci(values.repartition(1), "x", "id", 75, 0.9, 7, "split").first()
    assert a != BS.bootstrap_ci(values, "x", "id", 75, 0.9, 8, "split").first()


def test_one_value_and_no_rows(values):
    one = BS.bootstrap_ci(values.withColumn("x", F.lit(2.5)), "x", "id", 20, 0.95, 1, "split").first()
    assert (one["mean"], one.ci_low, one.ci_high) == (2.5, 2.5, 2.5)
    none = BS.bootstrap_ci(values.where("false"), "x", "id", 20, 0.95, 1, "split").first()
    assert (none["mean"], none.ci_low, none.n) == (None, None, 0)


def test_index_draws_hash_once_in_bounded_tasks(spark, monkeypatch):
    """every hash was computed twice, and a task's draws grew with the rows."""
    d = spark.createDataFrame([(i, float(i % 7)) for i in range(40)], "id long, x double")
    want = BS.bootstrap_ci(d, "x", "id", 50).first()
    monkeypatch.setattr(BS, "DRAWS_PER_TASK", 100)
    for method in ("index", "poisson"):
        out = BS.bootstrap_ci(d, "x", "id", 50, method=method)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 1
        assert "Repartition 20, true" in plan  # 40 rows * 50 replicates / 100
        assert method == "poisson" or out.first() == want
