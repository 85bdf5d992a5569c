"""Records of CSV files, read in parallel within a file.

A quoted CSV cell may hold line breaks, so a line is not a record and a file cannot be cut at any
line end. Spark's text source reads a file in byte ranges that begin at line starts; this
module finds whether a range begins inside a quoted cell, and puts the records together:

1. Each range is a function on two states, outside and inside a quoted cell, composed of its lines'
   functions. A quote counts only where CSV gives it a meaning, so a stray one within an
   unquoted cell changes nothing. One row a range also holds its *head* (if it begins inside a
   cell, the lines that end that record) and its *tails* (the lines of the record it leaves open), from
   either state.
2. The functions are composed along each file, over those rows, and give each range's true state. A
   record that crosses range ends is a tail and the heads after it: at most one a range.
3. The other records are whole within their range and are put together in the range's own task.

Parsing a record into cells is left to the caller (``from_csv``, in the JVM). The text is scanned
twice. Heads and tails of more than FRAGMENT_BYTES are left out of the first scan and fetched by a
scan of their own, but only those that belong to a true state, for a wrong one's tail is often the whole range.

Lines end in ``\\n`` or ``\\r\\n``; a compressed file is one range; a header's names hold no line break. A
quote that nothing closes makes the rest of its file one record, as in any CSV reader.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.util import BROADCAST_ROW_LIMIT
from ..session import scratch_path

FRAGMENT_BYTES = 1 << 20
KEY = ["file", "start", "length"]
RANGE_SCHEMA = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                          ("from_out", pa.bool_()), ("from_in", pa.bool_()), ("first", pa.string()), ("ends", pa.bool_()),
                          ("head", pa.string()), ("tail_out", pa.string()), ("tail_in", pa.string()),
                          ("head_long", pa.bool_()), ("tail_out_long", pa.bool_()), ("tail_in_long", pa.bool_())])
RANGES = ("file long, start long, length long, from_out boolean, from_in boolean, first string, ends boolean, "
          "head string, tail_out string, tail_in string, head_long boolean, tail_out_long boolean, tail_in_long boolean")
RECORDS = "value string, file long, layout int"

# Whole cells, then one that opens and does not close on this line.
OPEN = re.compile(r'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]|"")*+\Z')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line leaves a quoted cell open, given whether it began in one."""
    if '"' not in line:
        return inside
    return OPEN.match('"' + line if inside else line) is not None


def lines_of(spark: SparkSession, path: str, skip_damaged: bool = False) -> DataFrame:
    """``value`` and its byte range's KEY for every line under a path or glob; ``file`` is a hash of the file's path."""
    text = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
            .option("ignoreCorruptFiles", str(skip_damaged).lower()).text(path))
    return text.select("value", F.xxhash64("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("start"),
                       F.col("_metadata.file_block_length").alias("length"))


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list]]:
    """The lines of a batch, cut where the columns after the first change."""
    values, *keys = [c.to_pylist() for c in batch.columns]
    keys, i = list(zip(*keys)), 0
    for j in range(1, len(values) + 1):
        if j == len(values) or keys[j] != keys[i]:
            yield keys[i], values[i:j]
            i = j


class Fragment:
    """Lines kept up to a bound; past it only the fact that there were more."""

    def __init__(self, bound: int | None):
        self.bound, self.lines, self.size, self.long = bound, [], 0, False

    def add(self, line: str) -> None:
        self.size += len(line) + 1
        self.long = self.bound is not None and self.size > self.bound
        if self.long:
            self.lines.clear()
        else:
            self.lines.append(line)

    def text(self) -> str | None:
        return "\n".join(self.lines) if self.size and not self.long else None


def range_rows(batches: Iterator[pa.RecordBatch], bound: int | None) -> Iterator[pa.RecordBatch]:
    """One row of RANGES for every byte range of the task."""
    key = None

    def row() -> pa.RecordBatch:
        values = (*key, out, inside, first, ends, head.text(), tails[0].text(), tails[1].text(),
                  head.long, tails[0].long, tails[1].long)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, RANGE_SCHEMA.types)], schema=RANGE_SCHEMA)

    for batch in batches:
        for at, lines in runs(batch):
            if at != key:
                if key is not None:
                    yield row()
                key, out, inside, ends, first = at, False, True, False, lines[0] if at[1] == 0 else None
                head, tails = Fragment(bound), [Fragment(bound), Fragment(bound)]
            for line in lines:
                was_ended, same = ends, ends and out == inside
                out = ends_inside(line, out)
                inside = out if same else ends_inside(line, inside)
                if not was_ended:
                    head.add(line)
                    ends = not inside
                # a tail is what came since the state was last outside
                for i, state in enumerate((out, inside and was_ended)):
                    if state:
                        tails[i].add(line)
                    elif tails[i].size:
                        tails[i] = Fragment(bound)
    if key is not None:
        yield row()


def states(ranges: DataFrame) -> DataFrame:
    """``inside``, the true state at a range's begin, and ``header``, its file's first line, for every range."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    # a range sets the state, keeps it or swaps it: what was last set, then the swaps since
    swaps = F.col("from_out") & ~F.col("from_in")
    marked = ranges.withColumn("swaps", F.coalesce(F.count_if(swaps).over(before), F.lit(0)))
    was_set = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("state"), "swaps"))
    last = F.last(was_set, ignorenulls=True).over(before)
    placed = marked.withColumn("last", last).withColumn(
        "inside", F.coalesce("last.state", F.lit(False))
        != (F.pmod(F.col("swaps") - F.coalesce("last.swaps", F.lit(0)), F.lit(2)) == 1))
    begins = ~F.col("inside") | F.col("ends")  # records begin in the range, or may
    return (placed.withColumn("begun", F.count_if(begins).over(upto)).withColumn("begins", begins)
            .withColumn("header", F.max("first").over(Window.partitionBy("file"))).drop("last", "swaps"))


def crossing(known: DataFrame, spark: SparkSession, lines: DataFrame) -> DataFrame:
    """``value, file, layout`` of the records that cross range ends, put together from tails and heads."""
    tail_long = F.when(F.col("inside"), F.col("tail_in_long")).otherwise(F.col("tail_out_long"))
    too_long = (F.col("inside") & F.col("head_long")) | (F.col("begins") & tail_long)
    missing = known.where(too_long).select(*KEY)
    if not missing.isEmpty():
        fetched = lines.join(F.broadcast(missing.limit(BROADCAST_ROW_LIMIT)), KEY, "left_semi").select("value", *KEY)
        full = fetched.mapInArrow(lambda b: range_rows(b, None), RANGES).select(
            *KEY, *[F.col(c).alias(f"{c}_full") for c in ("head", "tail_out", "tail_in")])
        known = known.join(full, KEY, "left")
        for c in ("head", "tail_out", "tail_in"):
            known = known.withColumn(c, F.coalesce(c, f"{c}_full"))
    tail = F.when(F.col("inside"), F.col("tail_in")).otherwise(F.col("tail_out"))
    part = lambda record, text, when: F.when(when & text.isNotNull(), F.struct(record.alias("record"), text.alias("text")))
    parts = F.array_compact(F.array(
        part(F.col("begun") - F.col("begins").cast("int"), F.col("head"), F.col("inside")),
        part(F.col("begun"), tail, F.col("begins"))))
    return (known.select("file", "layout", "start", F.explode(parts).alias("p"))
            .groupBy("file", "layout", "p.record")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "p.text"))), lambda s: s["text"]), "\n")
                 .alias("value"))
            .select(F.rtrim("value", F.lit("\r")).alias("value"), "file", "layout"))


def whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin and end within a range, without the header and blank lines."""
    schema = pa.schema([("value", pa.string()), ("file", pa.int64()), ("layout", pa.int32())])
    key = None
    for batch in batches:
        for at, lines in runs(batch):
            file, start, _, inside, layout = at
            if inside is None:
                raise RuntimeError("the files, or the ranges Spark reads them in, changed between two scans; run again")
            if at != key:
                key, state, record, skip = at, inside, [], inside
                if start == 0:
                    lines = lines[1:]
            out = []
            for line in lines:
                state = ends_inside(line, state)
                if skip:  # the end of a record of an earlier range
                    skip = state
                elif state or record:
                    record.append(line)
                    if not state:
                        out.append("\n".join(record).rstrip("\r"))
                        record = []
                elif line and line != "\r":
                    out.append(line.rstrip("\r"))
            if out and layout is not None and layout >= 0:
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([file] * n, pa.int64()),
                                                  pa.array([layout] * n, pa.int32())], schema=schema)


def names_of(header: str | None) -> tuple[str, ...]:
    """The column names of a header line."""
    cells = next(csv.reader([(header or "").rstrip("\r")]), [])
    return tuple(h.strip().lstrip("\ufeff") for h in cells)


def records(spark: SparkSession, path: str, required: tuple[str, ...] = (), skip_damaged: bool = False,
            bound: int = FRAGMENT_BYTES, broadcast_rows: int = BROADCAST_ROW_LIMIT) -> tuple[DataFrame, list[tuple[str, ...]], DataFrame]:
    """RECORDS of every file under ``path`` that has a header with the ``required`` names; the distinct
    headers, which ``layout`` counts from 0; and ``file, layout`` of every file that holds a line, -1
    for those left out. One value per distinct header reaches the driver."""
    lines = lines_of(spark, path, skip_damaged)
    parked = scratch_path(spark, "csv_ranges")
    lines.mapInArrow(lambda b: range_rows(b, bound), RANGES).write.parquet(parked)
    ranges = spark.read.schema(RANGES).parquet(parked)
    firsts = sorted(r["first"] for r in ranges.where("first is not null").select("first").distinct().collect())
    usable = [h for h in firsts if names_of(h) and set(required) <= set(names_of(h))]
    layout = (F.array_position(F.lit(usable), F.col("header")) - 1).cast("int") if usable else F.lit(-1)
    known = states(ranges).withColumn("layout", F.coalesce(layout, F.lit(-1)))
    kept = scratch_path(spark, "csv_states")
    known.write.parquet(kept)
    known = spark.read.schema(known.schema).parquet(kept)
    small = known.select(*KEY, "inside", "layout")
    if known.count() <= broadcast_rows:  # a broadcast join leaves the lines in their order
        placed = lines.join(F.broadcast(small), KEY, "left")
    else:  # a range's lines meet in one task, in their order
        placed = (lines.withColumn("__line", F.monotonically_increasing_id()).join(small, KEY, "left")
                  .repartition(*KEY).sortWithinPartitions(*KEY, "__line"))
    whole = placed.select("value", *KEY, "inside", "layout").mapInArrow(whole_records, RECORDS)
    split = crossing(known.where("layout >= 0"), spark, lines)
    files = known.where("start = 0").select("file", "layout")
    return whole.unionByName(split), [names_of(h) for h in usable], files
