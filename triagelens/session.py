"""Session helpers: building a session for tests/bench and finding shared scratch space.

On a cluster the session is given to us; we only read its settings. Scratch
output (CSV round trips, stage tables) goes under ``spark.checkpoint.dir``,
which a cluster points at shared storage. A private default is set only when
the setting is missing (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "triagelens") -> SparkSession:
    """Session for local runs and tests. AQE stays on so joins and skew re-plan at runtime."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_shipped: weakref.WeakSet = weakref.WeakSet()  # contexts that already have the package


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so their Python workers can
    import it however the driver found it. A no-op when it is not a plain folder."""
    root = os.path.dirname(os.path.abspath(__file__))
    sc = spark.sparkContext
    if sc in _shipped or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="triagelens-pkg-"), "triagelens_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir. Without one, set a private folder on a local
    master and raise on any other: a driver's own folder is lost on a cluster."""
    sc = spark.sparkContext
    ship_package(spark)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="triagelens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint dir for one run of one job."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/triagelens/{name}-{uuid.uuid4().hex}"
