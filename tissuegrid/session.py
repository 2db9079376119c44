"""Session set-up and the shared folder for stage tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan in this package relies on.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_roots: dict[str, str] = {}


def build_session(app: str = "tissuegrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Sides of joins that run within are broadcast by the bytes their shuffle measured, not by the size of their files.

    A table that grows with the input can take tens of times its files' bytes on the driver once it is decoded or exploded.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {key: spark.conf.get(key, None) for key in (static, adaptive)}
    if before[adaptive] is None:
        spark.conf.set(adaptive, spark.conf.get(static))
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/") + "/tissuegrid"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        path = tempfile.mkdtemp(prefix="tissuegrid-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local_roots[app] = path
    return _local_roots[app]


def materialize(df: DataFrame, label: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet stage table and read it back.

    Cuts lineage, pins values that depend on partition layout, gives Catalyst true sizes and
    survives the loss of executors. ``by`` names a column of few values to lay out in folders, so
    that a filter on it reads only those.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    # Progress shows up under the stage's name in the job list.
    spark.sparkContext.setJobDescription(f"tissuegrid: {label}")
    try:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.sparkContext.setJobDescription(None)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the stage table behind a frame that ``materialize`` returned and nobody reads now."""
    spark = df.sparkSession
    root = stage_root(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, *keys: str, at_most: int | None = None, rows: int | None = None) -> DataFrame:
    """Even out rows whose cost lies in computing, not in bytes, over all cores.

    A fixed count keeps the adaptive planner from merging the small partitions again. ``rows``
    asks for that many rows per task, but never for fewer tasks than cores; it counts the rows
    first, so pass a stored frame. ``at_most`` limits the tasks outright.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if rows is not None:
        n = min(n, max(spark.sparkContext.defaultParallelism, df.count() // rows))
    if at_most is not None:
        n = max(1, min(n, at_most))
    return df.repartition(n, *keys)
