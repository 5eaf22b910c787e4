"""Intermediate tables of the operators, written to the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path


#: Spark then deletes a job's shuffle files when the job ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows go to Python in batches of about so many bytes: 10,000 whole texts at once are held several times over by the JVM
#: and by each worker. A session's own setting stays.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    This computes a result once for several uses, cuts the lineage, and keeps the decisions of
    a stage when an executor is lost. Unlike a checkpoint, the files carry sizes, so later
    joins are planned on real figures. The write's shuffle files go with it: nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = {k: spark.conf.get(k, None) for k in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, before[BATCH] or BATCH_BYTES)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote, once the last job that reads them has ended."""
    for df in staged:
        folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
        for folder in folders:
            path = hadoop(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
