"""Scans (S1-S7) and the table profile.

CSV text in this domain holds newlines and doubled quotes, so records are put together from
lines (``csv_records``) and parsed with ``"`` as quote and escape.
"""

from __future__ import annotations

import bz2
import gzip
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import csv_records
from .schemas import DRIVER_TABLES

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": "\"", "escape": "\"",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


# Tables whose rows carry long text: per-row regex work dominates their cost.
TEXT_TABLES = {"documents", "conversations", "benchmark", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool | None = None) -> DataFrame:
    """Read one driver table with its declared schema.

    Small text tables are spread over the cluster's cores (``spread_small``); larger
    ones have splits of their own and stay as they are.
    """
    reader = spark.read
    schema = DRIVER_TABLES.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread is None:
        spread = name in TEXT_TABLES
    if spread:
        df = spread_small(df)
    return df


SPREAD_BYTES = 256 << 20  # tables of more bytes on disk are never reshuffled for width


def spread_small(df: DataFrame) -> DataFrame:
    """Round-robin a small frame over the cores, for its files may hold one row group each.

    The planner's size estimate decides, so the move is at most SPREAD_BYTES of files."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def read_csv(spark: SparkSession, path: str, schema: StructType, columns=None,
             permissive: bool = True, required: tuple[str, ...] = (), skip_damaged: bool = False) -> DataFrame:
    """CSV scan with declared types, columns taken by name.

    ``path`` may be a glob (S3) over files whose columns differ in order and number: a
    file's extra columns are left out, its missing ones are null, and a file without a
    ``required`` column is left out. Values that do not cast are null (PERMISSIVE; ``cast_failures``
    counts them); blank strings are null. A file that cannot be read fails the scan, unless
    ``skip_damaged`` says to go on with what was read. One file is read by as many tasks as
    it has byte ranges (``csv_records``); headers are found in those tasks.
    """
    wanted = [f for f in schema.fields if columns is None or f.name in columns]
    if not path_exists(spark, path):
        return spark.createDataFrame([], StructType(wanted))
    rows, layouts, _ = csv_records.records(spark, path, required, skip_damaged)
    return rows.select("value", "layout", parsed_record(layouts, permissive).alias("r")).select(
        *[cell_of(f, layouts).alias(f.name) for f in wanted])


def parsed_record(layouts: list[tuple[str, ...]], permissive: bool = True) -> Column:
    """A record's cells as strings ``c0``, ``c1``, ..."""
    width = max([len(names) for names in layouts], default=1)
    return F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)),
                      {**CSV_OPTIONS, "header": "false", "mode": "PERMISSIVE" if permissive else "FAILFAST"})


def cell_of(field: StructField, layouts: list[tuple[str, ...]]) -> Column:
    """The cell with a field's name, wherever a record's layout has it, as the field's type."""
    at: dict[int, list[int]] = {}
    for n, names in enumerate(layouts):
        if field.name in names:
            at.setdefault(names.index(field.name), []).append(n)
    cell = F.lit(None).cast("string")
    for i, having in at.items():
        cell = F.when(F.col("layout").isin(having), F.col(f"r.c{i}")).otherwise(cell)
    filled = F.when(F.trim(cell) != "", cell)
    return filled if isinstance(field.dataType, StringType) else filled.try_cast(field.dataType)


def cast_failures(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What a scan of ``path`` loses: ``column_name``, ``n_rows``, ``n_filled`` cells and ``n_failed``, those of
    them that do not cast to the declared type. One pass, one row per column."""
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    raw = read_csv(spark, path, text)
    cells = F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).isNotNull().alias("filled"),
                 (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias("failed"))
        for f in schema.fields])).alias("c")
    return raw.select(cells).groupBy("c.column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("c.filled").alias("n_filled"), F.count_if("c.failed").alias("n_failed"))


def broken(content: bytes, name: str) -> bool:
    """Whether a compressed file's bytes cannot be unpacked to their end."""
    unpack = gzip.open if name.endswith(".gz") else bz2.open
    try:
        with unpack(io.BytesIO(content)) as f:
            while f.read(1 << 20):
                pass
    except (OSError, EOFError, zlib.error):
        return True
    return False


def scan_ledger(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """What a scan of ``path`` that skips damage takes from each file, and why not more.

    One row per file: ``path``, ``bytes``, ``n_records``, ``n_failed`` cells that do not cast to the
    declared type, and ``status``: ``damaged`` (gzip or bzip2 that does not unpack to its end: the
    records before the damage are counted), ``columns missing`` (a ``required`` one is not in the header) or ``read``. Files of no bytes have no row: Spark's listing leaves them out."""
    out = "path string, bytes long, n_records long, n_failed long, status string"
    if not path_exists(spark, path):
        return spark.createDataFrame([], out)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    at = F.col("_metadata.file_path")
    files = listing.load(path).select(at.alias("path"), F.col("length").alias("bytes"), F.xxhash64(at).alias("file"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = [broken(c, n) for c, n in zip(pdf["content"], pdf["path"])]
            yield pdf.loc[bad, ["file"]]

    packed = listing.option("pathGlobFilter", "*.{gz,bz2}").load(path)
    damaged = packed.select("content", "path", F.xxhash64(at).alias("file")).mapInPandas(check, "file long")
    rows, layouts, headers = csv_records.records(spark, path, required, skip_damaged=True)
    failed = sum((F.when(cell_of(StructField(f.name, StringType()), layouts).isNotNull()
                         & cell_of(f, layouts).isNull(), 1).otherwise(0) for f in schema.fields), F.lit(0))
    counts = (rows.select("file", "layout", parsed_record(layouts).alias("r")).select("file", failed.alias("failed"))
              .groupBy("file").agg(F.count(F.lit(1)).alias("n_records"), F.sum("failed").cast("long").alias("n_failed")))
    status = (F.when(F.col("damaged"), "damaged")
              .when(F.col("layout") < 0, "columns missing").otherwise("read"))
    return (files.join(headers, "file", "left").join(counts, "file", "left")
            .join(damaged.withColumn("damaged", F.lit(True)), "file", "left")
            .select("path", "bytes", F.coalesce("n_records", F.lit(0)).alias("n_records"),
                    F.coalesce("n_failed", F.lit(0)).alias("n_failed"), status.alias("status")))


def read_id_sets(spark: SparkSession, path_glob: str, schema: StructType,
                 id_col: str = "message_id") -> DataFrame:
    """S3 + U1: ids from every file matching a glob, distinct. Unreadable files are skipped."""
    return read_csv(spark, path_glob, schema, [id_col], required=(id_col,), skip_damaged=True).where(F.col(id_col).isNotNull()).distinct()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, or a glob matches anything."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jpath))


def read_stage_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stage table, or an empty frame of the same schema when it does not exist or
    holds no readable file (a first write that died)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)


def profile(df: DataFrame) -> DataFrame:
    """One row per column with its type and row, null and distinct counts, from a single aggregation.

    Exact distinct counts use one Expand per column; pass the columns you need.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs.append(F.count(F.col(c)).alias(f"__nn_{c}"))
        # a string's digest stands for it: the distinct shuffle moves 16 bytes, not the text
        key = F.unhex(F.md5(F.col(c))) if dict(df.dtypes)[c] == "string" else F.col(c)
        aggs.append(F.countDistinct(key).alias(f"__nd_{c}"))
    wide = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i + 1).alias("position"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                 (F.col("__n") - F.col(f"__nn_{c}")).alias("n_null"),
                 F.col(f"__nd_{c}").alias("n_distinct"))
        for i, c in enumerate(cols)
    ])).alias("s")
    return wide.select(F.col("__n").alias("n_rows"), stacked).select(
        "s.column_name", "s.position", "s.data_type", "n_rows", "s.n_null", "s.n_distinct")


def first_rows(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The ``n`` rows of smallest ``key``; each task sends n rows."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)
