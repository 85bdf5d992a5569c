"""Exact percentiles by narrowed bands against numpy, over ties, wide domains and empty columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens.operators.percentiles import exact_percentiles

QS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


@pytest.mark.parametrize("band_rows,sketch_k", [(100_000, 2048), (50, 2048), (50, 8)])
def test_equals_numpy(spark, band_rows, sketch_k):
    """Also with a sketch so coarse that its margins fail and have to be doubled."""
    df = spark.range(20_000).select(
        (F.hash("id") / 7.0).alias("wide"), F.pmod(F.hash("id"), F.lit(3)).alias("ties"),
        F.when(F.col("id") % 3 == 0, F.lit(1.5)).otherwise(F.hash("id") * 1e-9).alias("hot"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(F.col("id") % 7 > 0, F.col("id") * 0.1).alias("holes"),
        F.lit(None).cast("double").alias("none"))
    cols = df.columns
    pdf = df.toPandas()
    got = {(r.metric, r.q): r.value for r in exact_percentiles(df, cols, QS, band_rows, sketch_k).collect()}
    assert len(got) == len(cols) * len(QS)
    for c in cols:
        v = pdf[c].astype(float).dropna().to_numpy()
        for q in QS:
            want = np.quantile(v, q) if len(v) else None
            assert got[c, q] == (None if want is None else pytest.approx(want, rel=1e-12, abs=1e-12)), (c, q)


def test_one_row_and_no_rows(spark):
    one = exact_percentiles(spark.createDataFrame([(3.0,)], "v double"), ["v"], [0.5]).collect()
    assert [tuple(r) for r in one] == [("v", 0.5, 3.0)]
    none = exact_percentiles(spark.createDataFrame([], "v double"), ["v"], [0.5]).collect()
    assert [tuple(r) for r in none] == [("v", 0.5, None)]
