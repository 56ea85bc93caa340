"""Session helpers for tests, bench and the driver entry point.

Library operators receive a session (or DataFrames) from the caller; only this
module builds one, and only for local runs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter at cluster scale as much as locally: AQE re-plans joins
# from runtime sizes (the only place a broadcast is chosen for data-dependent
# sides), splits skewed join partitions, and coalesces small shuffle outputs.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "pricelens", scan_tasks: int | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if scan_tasks:
        spark.conf.set("pricelens.scanTasks", str(scan_tasks))
    workspace(spark)
    return spark


def compiled_rules(spark: SparkSession) -> None:
    """Let Spark split generated code that the JVM would not compile.

    The listing rules make one generated method of more than 8,000 bytes of bytecode; HotSpot only interprets
    such a method. With this limit Spark runs those steps operator by operator, in methods that are compiled. A
    limit that the session already has stays.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run inside go when it ends, not when the driver's garbage is next collected."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Queries run inside broadcast a side of a join only by the size that adaptive execution measures, never by an estimate.

    Spark takes an exploded table for as large as the one before, and a stored one for as large as its compressed files:
    far too little where few bytes stand for many rows. The session's limit stays as it is, for sizes that were measured.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit, own = spark.conf.get(planned), spark.conf.get(measured, None)
    spark.conf.set(planned, "-1")
    spark.conf.set(measured, limit if own is None else own)
    try:
        yield
    finally:
        spark.conf.set(planned, limit)
        if own is None:
            spark.conf.unset(measured)


def workspace(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system). Only a local-mode session without that setting gets a fresh
    scratch folder of its own, so tests and local runs work unchanged.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="pricelens-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d.rstrip("/") + "/rdd-checkpoints")
    return d


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that the caller has written, and that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the workspace for one written table or stream."""
    base = workspace(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
