"""Session helpers: a sensible local/cluster session, the shared checkpoint folder, materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "blotter", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, the UI off and UTC timestamps.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset: the cluster's own
    settings win. ``shuffle_partitions`` should be sized so one shuffle partition holds
    roughly 128-256 MB at the target scale; AQE coalesces the small ones at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        # Only effective when this call starts the JVM (local mode: the driver is the executor).
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is always used when set.
    On one machine without that setting (tests) a private folder is made; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One machine (tests): a folder of its own, removed when the process ends.
        configured = tempfile.mkdtemp(prefix="blotter-checkpoints-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path inside the shared checkpoint folder, for intermediate tables written by a job."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), "blotter", *parts, uuid.uuid4().hex])


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    The checkpoint lands in the shared folder, so a lost executor does not lose the result
    (unlike a local checkpoint, which lives on executor disks).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    As ``materialise``, for small tables that are used again: the files carry sizes, so the optimizer sees
    what may be broadcast.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for code that needs an OS path (tests only)."""
    return path[len("file:"):] if path.startswith("file:") else path


__all__ = ["get_session", "ensure_checkpoint_dir", "shared_path", "materialise", "stage_table", "local_path"]
