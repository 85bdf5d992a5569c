"""Resumable model stages.

A stage turns a prompt column into raw model text with a caller-supplied
``complete(prompt) -> str``. The call runs inside ``mapInPandas`` (Arrow
batches, one Python worker per task) with a retry loop per row, over calls that
raise and replies that cannot be parsed; a row that still fails becomes a row
with status 'failed' and the error text, so one bad row never fails the job.

Each stage commits its output as Parquet, slice by slice, to a stage table under
the session's checkpoint dir (shared storage on a cluster), compacted from time to time. Resume = anti join of the
stage's input against rows already done, so a re-run only calls the model for
pending rows; the latest row per key wins (max_by written_at). Writing each
stage before the next one reads it also bounds repeated model calls when a
task is retried after an executor loss.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.responses import reply_error
from ..session import scratch_path
from ..sources.readers import path_exists

SLICES = 2         # commits per stage run
COMPACT_AFTER = 8  # slices between two snapshots of a stage
CALL_ROWS = 256    # prompts of one Arrow batch: whole texts are long, and a task holds a batch several times
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MANIFEST = "kind string, run_id long, part int, folder string, n_rows long, covers array<string>"

CALL_FIELDS = [StructField("raw", StringType()), StructField("attempts", IntegerType()),
               StructField("call_error", StringType())]


def call_model(df: DataFrame, key_col: str, prompt_col: str, complete: Callable[..., str],
               max_attempts: int = 3, backoff_sec: float = 0.0, check: Callable[[str], str | None] | None = reply_error,
               parallelism: int | None = None, threads: int = 1) -> DataFrame:
    """G1: raw text, attempts and error per row; retries happen inside the task.

    A reply is tried again when the call raises or when ``check`` names an error in it;
    the last reply is kept either way. Rows are dealt by key to ``parallelism`` tasks
    (the cores by default) and each task has ``threads`` calls in the air. A ``complete``
    with ``takes_attempt`` gets the attempt's number as its second argument."""
    key_field = df.schema[key_col]
    out_schema = StructType([StructField(key_col, key_field.dataType, key_field.nullable), *CALL_FIELDS])
    numbered = getattr(complete, "takes_attempt", False)

    def one(prompt: str) -> tuple[str | None, int, str | None]:
        raw, err = None, None
        for n in range(1, max_attempts + 1):
            try:
                raw = complete(prompt, n) if numbered else complete(prompt)
                err = None
                if check is None or check(raw) is None:
                    break
            except Exception as e:  # noqa: BLE001 - a failed call is data
                raw, err = None, f"{type(e).__name__}: {e}"
            if backoff_sec and n < max_attempts:
                time.sleep(backoff_sec * n)
        return raw, n, err

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for pdf in batches:
                done = list(pool.map(one, pdf[prompt_col]))
                raws, attempts, errors = zip(*done) if done else ((), (), ())
                yield pd.DataFrame({key_col: pdf[key_col], "raw": raws, "attempts": attempts, "call_error": errors})

    width = parallelism or df.sparkSession.sparkContext.defaultParallelism
    return df.select(key_col, prompt_col).repartition(width, key_col).mapInPandas(run, out_schema)


@contextmanager
def short_batches(spark: SparkSession, rows: int = CALL_ROWS) -> Iterator[None]:
    """What runs inside sends Arrow batches of at most ``rows`` rows; the session's setting stands again afterwards."""
    before = spark.conf.get(BATCH_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


class StageStore:
    """Stage tables under one run directory: a log of committed slices, and snapshots of it.

    A slice is written to a folder of its own and counts once its manifest, one small file with the
    folder and the row count, stands in ``<stage>/manifest``. The manifest is named after (run, slice) and
    put there by a rename, so a slice is committed once, whole or not at all: a folder without a
    manifest (a run that died while writing) is never read. Every ``compact_after`` slices the latest row
    per key is written as a snapshot, whose manifest names the slices it covers; ``latest`` reads
    the newest snapshot and the slices since."""

    def __init__(self, spark: SparkSession, base: str | None = None, compact_after: int = COMPACT_AFTER):
        self.spark, self.compact_after = spark, compact_after
        self.base = base or scratch_path(spark, "stages")

    def path(self, stage: str) -> str:
        return f"{self.base}/{stage}"

    def _fs(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifests(self, stage: str) -> list[dict]:
        """The committed slices and snapshots; one entry per slice, so bounded by runs times slices."""
        path = f"{self.path(stage)}/manifest"
        if not path_exists(self.spark, path):
            return []
        rows = self.spark.read.option("pathGlobFilter", "*.json").schema(MANIFEST).json(path)
        return [r.asDict() for r in rows.orderBy("kind", "run_id", "part").collect()]

    def _commit(self, stage: str, name: str, entry: dict) -> bool:
        """Put a manifest in place; False if that name is already there."""
        folder = f"{self.path(stage)}/manifest"
        target, fs = self._fs(f"{folder}/{name}.json")
        draft, _ = self._fs(f"{folder}/_{name}-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            return False
        return True

    def _committed(self, stage: str, name: str) -> bool:
        return path_exists(self.spark, f"{self.path(stage)}/manifest/{name}.json")

    def append(self, stage: str, df: DataFrame, run_id: int, part: int = 0) -> None:
        """K3: one commit per slice (never per row). A slice that is already there is not written again."""
        name = f"slice-{run_id}-{part}"
        if self._committed(stage, name):
            return
        folder = f"{self.path(stage)}/data/{name}-{uuid.uuid4().hex}"
        rows = df.withColumn("written_at", F.lit(run_id).cast("long"))
        rows.write.parquet(folder)
        self._commit(stage, name, {"kind": "slice", "run_id": run_id, "part": part, "folder": folder,
                                   "n_rows": self.spark.read.schema(rows.schema).parquet(folder).count(), "covers": []})

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A side table of the run: written the first time, read from then on."""
        path = self.path(name)
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _rows(self, entries: list[dict], schema: StructType) -> DataFrame:
        full = StructType([*schema.fields, StructField("written_at", LongType())])
        folders = [e["folder"] for e in entries]
        return self.spark.read.schema(full).parquet(*folders) if folders else self.spark.createDataFrame([], full)

    def read(self, stage: str, schema: StructType) -> DataFrame:
        """Every committed row; an empty frame of the stage schema if nothing was committed yet."""
        return self._rows([e for e in self.manifests(stage) if e["kind"] == "slice"], schema)

    def latest(self, stage: str, schema: StructType, key_col: str) -> DataFrame:
        """Latest row per key (last write wins), from the newest snapshot and the slices it does not cover."""
        entries = self.manifests(stage)
        snapshots = [e for e in entries if e["kind"] == "snapshot"]
        newest = max(snapshots, key=lambda e: len(e["covers"]), default=None)
        since = [e for e in entries if e["kind"] == "slice" and not (newest and f"{e['run_id']}-{e['part']}" in newest["covers"])]
        t = self._rows(([newest] if newest else []) + since, schema)
        if newest and not since:
            return t
        cols = [c for c in t.columns if c != key_col]
        packed = F.struct(*[F.col(c) for c in cols])
        return (t.groupBy(key_col).agg(F.max_by(packed, F.col("written_at")).alias("__r"))
                .select(key_col, "__r.*"))

    def compact(self, stage: str, schema: StructType, key_col: str) -> None:
        """Write a snapshot when ``compact_after`` slices or more came since the last one."""
        entries = self.manifests(stage)
        slices = [f"{e['run_id']}-{e['part']}" for e in entries if e["kind"] == "slice"]
        covered = max((len(e["covers"]) for e in entries if e["kind"] == "snapshot"), default=0)
        if len(slices) - covered < self.compact_after:
            return
        folder = f"{self.path(stage)}/data/snapshot-{uuid.uuid4().hex}"
        names = [*[f.name for f in schema.fields], "written_at"]
        rows = self.latest(stage, schema, key_col).select(*names)
        rows.write.parquet(folder)
        self._commit(stage, f"snapshot-{len(slices)}", {
            "kind": "snapshot", "run_id": 0, "part": len(slices), "folder": folder,
            "n_rows": self.spark.read.schema(rows.schema).parquet(folder).count(), "covers": slices})


def pending(inputs: DataFrame, done: DataFrame, key_col: str, ok_col: str = "status") -> DataFrame:
    """Input rows whose stage output is missing or not ok."""
    ok = done.where(F.col(ok_col) == "ok").select(key_col)
    return inputs.join(ok, key_col, "left_anti")


def run_stage(store: StageStore, stage: str, inputs: DataFrame, key_col: str, prompt_col: str,
              complete: Callable[[str], str], finish: Callable[[DataFrame], DataFrame],
              out_schema: StructType, run_id: int | None = None, max_attempts: int = 3,
              slices: int = SLICES, **call_kw) -> DataFrame:
    """Run one stage for pending rows, append, and return the latest table.

    ``finish`` turns (key, raw, attempts, call_error) into the stage's typed
    columns; it must add ``status`` ('ok' / 'failed') and match ``out_schema``. The
    pending rows go in ``slices`` by the hash of their key, each appended when it is
    done (K3): a stage that dies keeps every finished slice.
    """
    run_id = run_id if run_id is not None else int(time.time() * 1000)
    done = store.latest(stage, out_schema, key_col)
    todo = pending(inputs, done, key_col)
    for i in range(slices):
        some = todo.where(F.pmod(F.hash(key_col), F.lit(slices)) == i) if slices > 1 else todo
        called = call_model(some, key_col, prompt_col, complete, max_attempts, **call_kw)
        with short_batches(store.spark):
            finished = finish(called).select(*[f.name for f in out_schema.fields])
            store.append(stage, finished, run_id, i)
    store.compact(stage, out_schema, key_col)
    return store.latest(stage, out_schema, key_col)
