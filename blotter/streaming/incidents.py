"""The categorise-and-count path on a streaming DataFrame (Structured Streaming).

Incident feeds arrive as files; the same column expressions as the batch path run per
micro-batch, and the running counts live in Spark's state store (checkpointed to the shared
folder, so a restarted query resumes where it stopped). Categorisation is inline on a stream:
an unbounded input has no distinct-value dimension to materialise up front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.categorise import Rules, categorise
from ..functions.dates import US_DATE, as_date, month_of
from ..functions.rules import CRIME_RULES, DEFAULT_CATEGORY
from ..session import shared_path


def read_parquet_stream(spark: SparkSession, path: str, schema, glob: str | None = None,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in ``path`` as a stream (explicit schema, as streams require)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def category_counts_stream(stream: DataFrame, text_col: str = "pd_desc", rules: Rules = CRIME_RULES,
                           default: str = DEFAULT_CATEGORY) -> DataFrame:
    """Running ``category, n`` over everything received so far."""
    cat = categorise(stream.select(text_col), text_col, rules, default, "category")
    return cat.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def monthly_counts_stream(stream: DataFrame, date_col: str = "arrest_date", name: str = "total",
                          date_format: str = US_DATE) -> DataFrame:
    """Running rows per calendar month (years pooled)."""
    month = month_of(as_date(stream, date_col, date_format))
    return stream.select(month.alias("month")).groupBy("month").agg(F.count(F.lit(1)).alias(name))


def start_snapshots(result: DataFrame, path: str, checkpoint: str | None = None,
                    available_now: bool = True) -> StreamingQuery:
    """Keep ``path`` as a Parquet snapshot of a complete-mode aggregate.

    Every micro-batch overwrites the snapshot with the full current result (idempotent, so a
    replayed batch after a failure writes the same table). ``checkpoint`` defaults to a fresh
    folder under the session's shared checkpoint folder.
    """
    spark = result.sparkSession
    ckpt = checkpoint or shared_path(spark, "stream-checkpoints")

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    w = result.writeStream.outputMode("complete").option("checkpointLocation", ckpt).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
