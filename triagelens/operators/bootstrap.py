"""Bootstrap confidence interval of a mean (A8), percentile method.

Three ways to draw. The first two are seeded by md5, so that DuckDB can repeat them exactly:

* ``index``: the reference's estimator, n draws with replacement per replicate.
  Rows get a dense index in seeded order (distributed, see sampling), each row
  emits its draw slot for every replicate, the drawn index is
  md5('seed:b:i') mod n, and a join fetches the value. Work and shuffle are
  n_boot * n rows.
* ``poisson``: each row gets a Poisson(1) weight per replicate (inverse CDF of
  a hashed uniform). No join and no shuffle of draws: the per-replicate sums
  are combined map-side, so only n_boot partial rows per task move.
* ``split``: the estimator of ``index`` by its counts. How often each distinct value is
  drawn is a multinomial split of n down a tree: first over groups of value classes,
  then, inside a group, over its values. A replicate costs one binomial draw per
  distinct value instead of n draws, and its counts add up to n exactly. The
  generator is seeded by (seed, replicate, group), so partitioning changes nothing.
  This is the one to use at scale.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import stratified_rank
from .util import checked_broadcast, r6


HASH_DIGITS = 15  # hex digits of a draw: 2^60 values, so no row count in reach biases or bounds the index


def _hash_int(*parts) -> F.Column:
    """First HASH_DIGITS hex chars of md5 over 'p0:p1:...' as a non-negative integer."""
    s = F.concat_ws(":", *[p if isinstance(p, F.Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(s), 1, HASH_DIGITS), 16, 10).cast("long")


def _interval(reps: DataFrame, mean_col, ci: float, n_boot: int, n_col) -> DataFrame:
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    return reps.agg(F.percentile("m", [lo, hi]).alias("p")).select(
        r6(mean_col).alias("mean"), r6(F.col("p")[0]).alias("ci_low"), r6(F.col("p")[1]).alias("ci_high"),
        n_col.alias("n"), F.lit(n_boot).alias("n_boot"))


REPLICATES = 50   # replicates of one task's group
DRAWS_PER_TASK = 10_000_000  # draws of one task: its time stays the same however many rows there are


def split_counts(values: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``b``, ``g``, ``x``, ``k``: how often replicate b draws each value of ``values`` (``x``, ``c``: its number of rows).

    With D distinct values there are about sqrt(D) groups of about sqrt(D) values: no task
    holds more than a few rows of either."""
    spark = values.sparkSession
    size = values.agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    groups, n = max(1, math.isqrt(size.d)), int(size.n)
    classes = values.withColumn("g", F.pmod(F.xxhash64("x"), F.lit(groups)).cast("int")).checkpoint(eager=True)
    totals = classes.groupBy("g").agg(F.sum("c").alias("c"))
    part = F.floor(F.col("b") / REPLICATES).cast("int").alias("part")
    # the groups' totals, some sqrt(D) rows, once for every block of replicates
    tops = totals.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(REPLICATES)))).select("g", "c", "b", part)

    def first(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("g")
        p = block["c"].to_numpy(float) / n
        start = int(block["b"].iloc[0])
        bs = range(start, min(start + REPLICATES, n_boot))
        ks = np.concatenate([np.random.default_rng([seed, b]).multinomial(n, p) for b in bs])
        return pd.DataFrame({"b": np.repeat(list(bs), len(p)), "g": np.tile(block["g"].to_numpy(), len(bs)), "m": ks})

    def second(key: tuple, tasks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own, tasks = own.sort_values("x"), tasks.sort_values("b")
        p = own["c"].to_numpy(float) / own["c"].sum()
        ks = [np.random.default_rng([seed, int(b), key[0] + 1]).multinomial(int(m), p) for b, m in zip(tasks["b"], tasks["m"])]
        return pd.DataFrame({"b": np.repeat(tasks["b"].to_numpy(), len(p)), "g": key[0], "x": np.tile(own["x"].to_numpy(), len(tasks)),
                             "k": np.concatenate(ks) if ks else np.zeros(0, np.int64)})

    drawn = tops.groupBy("part").applyInPandas(first, "b long, g int, m long")
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // REPLICATES))).alias("part")
    return (drawn.select("*", part).groupBy("g", "part")
            .cogroup(classes.select("g", "x", "c", blocks).groupBy("g", "part")).applyInPandas(second, "b long, g int, x double, k long"))


def split_means(vals: DataFrame, n_boot: int, seed: int) -> DataFrame:
    counts = split_counts(vals.groupBy("x").agg(F.count(F.lit(1)).alias("c")), n_boot, seed)
    return counts.groupBy("b").agg((F.sum(F.col("x") * F.col("k")) / F.sum("k")).alias("m"))


def bootstrap_ci(df: DataFrame, value_col: str, id_col: str, n_boot: int = 2000, ci: float = 0.95,
                 seed: int = 42, method: str = "index") -> DataFrame:
    vals = df.select(F.col(id_col), F.col(value_col).cast("double").alias("x")).where(F.col("x").isNotNull())
    size = vals.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m")).first()
    n, mean = F.lit(size.n).cast("long"), F.lit(size.m).cast("double")
    if method == "split":
        return _interval(split_means(vals, n_boot, seed), mean, ci, n_boot, n)
    replicates = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")
    # Each value row fans out to n_boot rows. Spread the n rows over all cores
    # first, and over more tasks when there are many: AQE sizes partitions by input bytes and
    # would otherwise pack a small value table into one task that then does all n * n_boot rows of work.
    width = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size.n * n_boot / DRAWS_PER_TASK))
    if method == "index":
        ranked = stratified_rank(vals.withColumn("__one", F.lit(1)), ["__one"], id_col, seed, "__rk")
        ranked = ranked.select((F.col("__rk") - 1).alias("idx"), "x").checkpoint(eager=True)  # read twice
        # never null, and said so: the join's filter on a nullable index would compute every hash again
        draws = ranked.repartition(width).select(F.col("idx").alias("i"), replicates).select(
            "b", F.coalesce(_hash_int(seed, F.col("b"), F.col("i")) % n, F.lit(0).cast("long")).alias("idx"))
        # n value rows against n_boot * n draws: the values side is broadcast on its counted size
        values = checked_broadcast(ranked, bound=int(size.n))
        reps = draws.join(values, "idx").groupBy("b").agg(F.avg("x").alias("m"))
    elif method == "poisson":
        cdf, acc, term = [], 0.0, math.exp(-1.0)
        for k in range(12):
            acc += term
            cdf.append(acc)
            term /= (k + 1)
        # the hashed uniform is its own projection, so md5 runs once per draw
        draws = vals.repartition(width).select(id_col, "x", replicates).select(
            "b", "x", (_hash_int(seed, F.col("b"), F.col(id_col)) / float(16 ** HASH_DIGITS)).alias("u"))
        w = sum((F.col("u") >= c).cast("int") for c in cdf)
        weighted = draws.select("b", "x", w.alias("w"))
        reps = (weighted.groupBy("b").agg(F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum("w").alias("sw"))
                .select("b", (F.col("sx") / F.col("sw")).alias("m")))
    else:
        raise ValueError(f"unknown bootstrap method {method!r}")
    return _interval(reps, mean, ci, n_boot, n)


__all__ = ["bootstrap_ci", "checked_broadcast"]
