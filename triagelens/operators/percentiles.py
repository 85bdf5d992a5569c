"""Exact percentiles in bounded memory.

A percentile is an order statistic, or a point between two neighbouring ones. KLL sketches narrow each to
a band of values that surely holds it, and only the values inside are counted one by one:

* a round sketches the values within each band and takes the sketch's quantiles a little below and
  above the wanted rank as the next band;
* a second scan counts the rows below and inside it. These exact counts say whether the wanted ranks
  lie inside; if not, the sketch erred by more than its margin, the old band stays and the margin doubles;
* when at most ``band_rows`` rows lie strictly inside a band, its distinct values are counted and the
  ranks are read off.

A round leaves about 2 * margin of the rows strictly inside, so 10^10 rows take two or three rounds. Heavy ties
end at a band's edges and are one value with a count. Per scan each task holds one sketch and a few counters
a band, whatever the number of distinct values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SKETCH_K = 2048      # relative rank error about 0.0013
MARGIN = 0.004
BAND_ROWS = 100_000  # rows strictly inside a band that are counted one by one


@dataclass
class Band:
    column: str
    q: float
    lo: int            # the two neighbouring ranks, from 0
    hi: int
    weight: float      # how far the percentile lies from the lower to the upper
    a: float           # the band: a <= value <= b
    b: float
    below: int         # rows below a
    inside: int        # rows in the band
    strict: int        # rows strictly inside
    margin: float = MARGIN
    settled: bool = False


def exact_percentiles(df: DataFrame, columns: list[str], qs, band_rows: int = BAND_ROWS,
                      sketch_k: int = SKETCH_K) -> DataFrame:
    """``metric, q, value``: percentiles of each column by linear interpolation, nulls left out; null for
    a column without values. The columns are written once and scanned from there. Infinite values are ordered as usual;
    NaN counts as null."""
    spark = df.sparkSession
    path = scratch_path(spark, "percentiles")
    df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]).write.parquet(path)
    values = spark.read.schema(", ".join(f"`{c}` double" for c in columns)).parquet(path)
    bands = first_bands(values, columns, qs)
    while todo := [b for b in bands if b.strict > band_rows and not b.settled]:
        narrow(values, todo, sketch_k)
    return selected(values, bands, columns, qs)


def first_bands(values: DataFrame, columns: list[str], qs) -> list[Band]:
    row = values.agg(*[f(F.col(c)).alias(f"{f.__name__}_{i}") for i, c in enumerate(columns)
                       for f in (F.count, F.min, F.max)]).first()
    out = []
    for i, c in enumerate(columns):
        n, low, high = row[f"count_{i}"], row[f"min_{i}"], row[f"max_{i}"]
        if n:
            for q in qs:
                at = (n - 1) * q
                out.append(Band(c, q, math.floor(at), math.ceil(at), at - math.floor(at), low, high, 0, n, n))
    return out


def within(b: Band, low: float, high: float):
    return (F.col(b.column) >= F.lit(low)) & (F.col(b.column) <= F.lit(high))


def narrow(values: DataFrame, bands: list[Band], sketch_k: int) -> None:
    """One round: a scan that sketches every band and one that counts the bands the sketches give."""
    sketches = values.agg(*[F.kll_sketch_agg_double(F.when(within(b, b.a, b.b), F.col(b.column)), sketch_k).alias(f"s{i}")
                            for i, b in enumerate(bands)])
    ends = []
    for i, b in enumerate(bands):
        for j, r in enumerate(((b.lo - b.below) / b.inside - b.margin, (b.hi + 1 - b.below) / b.inside + b.margin)):
            ends.append(F.kll_sketch_get_quantile_double(f"s{i}", F.lit(min(1.0, max(0.0, r)))).alias(f"e{i}_{j}"))
    at = sketches.select(*ends).first()
    new = [(at[f"e{i}_0"], at[f"e{i}_1"]) for i in range(len(bands))]
    counts = []
    for i, (b, (low, high)) in enumerate(zip(bands, new)):
        counts += [F.count_if(F.col(b.column) < F.lit(low)).alias(f"below{i}"), F.count_if(within(b, low, high)).alias(f"in{i}"),
                   F.count_if((F.col(b.column) > F.lit(low)) & (F.col(b.column) < F.lit(high))).alias(f"strict{i}")]
    n = values.agg(*counts).first()
    for i, (b, (low, high)) in enumerate(zip(bands, new)):
        below, inside, strict = n[f"below{i}"], n[f"in{i}"], n[f"strict{i}"]
        if below <= b.lo and b.hi < below + inside and strict < b.strict:
            b.a, b.b, b.below, b.inside, b.strict = low, high, below, inside, strict
        else:
            b.margin *= 2
            b.settled = b.margin > 0.5  # the sketch is too coarse for the band: count what is left of it


def selected(values: DataFrame, bands: list[Band], columns: list[str], qs) -> DataFrame:
    """The wanted ranks of every band, from counts of its distinct values."""
    spark = values.sparkSession
    every = spark.createDataFrame([(c, float(q)) for c in columns for q in qs], "metric string, q double")
    if not bands:
        return every.withColumn("value", F.lit(None).cast("double"))
    cells = F.explode(F.array_compact(F.array(*[
        F.when(within(b, b.a, b.b), F.struct(F.lit(i).alias("band"), F.col(b.column).alias("v"))) for i, b in enumerate(bands)])))
    counted = values.select(cells.alias("c")).groupBy("c.band", "c.v").agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.createDataFrame([(i, b.column, float(b.q), b.lo - b.below, b.hi - b.below, b.weight) for i, b in enumerate(bands)],
                                   "band int, metric string, q double, lo long, hi long, w double")
    upto = F.sum("n").over(Window.partitionBy("band").orderBy("v"))
    ranked = counted.withColumn("upto", upto).join(F.broadcast(wanted), "band")
    has = lambda r: (F.col(r) < F.col("upto")) & (F.col(r) >= F.col("upto") - F.col("n"))
    ends = ranked.groupBy("band", "metric", "q", "w").agg(F.max(F.when(has("lo"), F.col("v"))).alias("low"),
                                                           F.max(F.when(has("hi"), F.col("v"))).alias("high"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + F.col("w") * (F.col("high") - F.col("low")))
    found = ends.select("metric", "q", value.alias("value"))
    return every.join(F.broadcast(found), ["metric", "q"], "left")
