"""Helpers shared by the training-data operators: whitespace, tables, batches, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

# ---- Fixed values: the contract's white space, as a character class and as characters ----
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
# ------------------------------------------------------------------------------------------

ARROW_ROWS = 256  # rows of one Arrow batch: whole texts are long, so batches stay short


def prepare(spark: SparkSession) -> None:
    """Session settings the Python operators rely on: shared checkpoint folder, short Arrow batches."""
    ensure_checkpoint_dir(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole, by a path that only Spark resolves."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parked(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage with a copy that outlives any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The runs of characters outside the contract's white space, in order (null text: none)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def where_kept(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` that stays above the projections that compute its columns.

    The optimiser would copy the columns' expressions into a filter below them and compute
    them twice. The row number is not deterministic to the optimiser, so the filter
    stays where it is."""
    return df.withColumn("__at", F.monotonically_increasing_id()).where(condition & (F.col("__at") >= 0)).drop("__at")


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table: ``node``, ``root`` (the smallest node reachable).

    Alternating large-star and small-star contraction. Each round is a partial
    minimum per node and a join that AQE can split on a hot hub; the surviving edges
    are written to the checkpoint folder, so a lost executor never replays earlier
    rounds. Only nodes with an edge appear.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = e.checkpoint(eager=True)
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y"), "u", "m")
        e = (small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("v")),
                                            F.struct(F.col("u"), F.col("m").alias("v")))).alias("s"))
             .select("s.u", "s.v").where("u <> v").distinct().checkpoint(eager=True))
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = tuple(mark)
    raise RuntimeError("components did not settle")
