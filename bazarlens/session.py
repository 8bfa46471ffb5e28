"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "bazarlens", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    Nothing here is required: every function runs on a session that somebody
    else configured. Adaptive execution does the join choice (a side is
    broadcast only after its size was measured) and splits skewed partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # No Python call site is recorded for each column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Sessions of one hot user are merged before the shuffle.
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the cluster.

    Only a local-mode session may fall back to a temporary folder; on a
    cluster a machine-local path would be lost with its machine.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    path = os.path.join(tempfile.mkdtemp(prefix="bazarlens-"), "shared")
    spark.conf.set(CHECKPOINT_SETTING, path)
    return path


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the application's part of the shared folder that nothing has used yet."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_intermediates(spark: SparkSession) -> bool:
    """Delete what this application wrote under :func:`fresh_path`.

    For the end of a job, when no frame that reads these tables is needed any
    more; results that are to stay are written elsewhere before.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs left behind.

    Spark's cleaner drops shuffles and broadcasts when the driver's JVM finds
    them unreachable, which a driver with a roomy heap may not look for in
    hours; the heap also shrinks to what is in use. For the start of a stage.
    """
    spark.sparkContext._jvm.java.lang.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Used where a frame feeds several jobs (a k-means search, a quantile pass).
    Unlike a cache the table survives the loss of executors.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
