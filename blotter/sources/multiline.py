"""CSV files whose quoted values hold line feeds, read by many tasks.

A reader that starts in the middle of a file cannot know whether it is inside quotes. Here the file is read as lines, in byte ranges
as any text file, and only the quotes are counted. What is sorted by one task is a part of a range, of at most 2 ** ``PART_BITS`` lines ("range" below):

1. the quotes of each range are odd or even in number: one small row a range;
2. a running sum over a file's ranges says for each whether it begins inside quotes;
3. inside a range a running sum says the same for each line, so records are cut at line feeds outside quotes;
4. a record of one line is finished. Only records of several lines are gathered, those that cross
   ranges included.

Each record is then parsed by itself. Values in quotes hold doubled quotes and any characters; a quote inside an unquoted value is not
allowed (as in RFC 4180), for it would shift all that follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv import CORRUPT, OK, REJECTED, STATUS, header_schema

PART_BITS = 12


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, at, record): the records of the files at ``path``; ``at`` grows along a file, records of blanks are left out."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"),
        F.monotonically_increasing_id().alias("at"), F.col("value"),
        (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))).alias("quotes"))
    # Numbers grow along the lines of a task, so those of one range and one quotient follow each other.
    lines = lines.withColumn("range", F.struct("begin", F.shiftright("at", PART_BITS).alias("part"))).drop("begin")

    within = Window.partitionBy("file", "range").orderBy("at")
    so_far = F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1))
    ranges = lines.groupBy("file", "range").agg(F.sum("quotes").alias("all"))
    along = Window.partitionBy("file").orderBy("range")
    ranges = ranges.withColumn("before", F.coalesce(F.sum("all").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    placed = lines.withColumn("so_far", F.coalesce(so_far, F.lit(0))).join(ranges.select("file", "range", "before"), ["file", "range"])
    opened = (F.col("before") + F.col("so_far")) % 2 == 1  # the line begins inside quotes
    closes = (F.col("before") + F.col("so_far") + F.col("quotes")) % 2 == 0
    placed = placed.select("file", "range", "at", "value", opened.alias("opened"), closes.alias("closes"))

    whole = placed.where("NOT opened AND closes").select("file", "range", "at", F.col("value").alias("record"))
    several = placed.where("opened OR NOT closes")
    # A record is named by the range and number of the line that begins it; a range that begins inside one has it from the ranges before.
    begin = F.when(~F.col("opened"), F.struct("range", "at"))
    several = several.withColumn("own", F.last(begin, ignorenulls=True).over(within))
    lasts = several.groupBy("file", "range").agg(F.max(begin).alias("latest"))
    lasts = lasts.withColumn("carried", F.last("latest", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    several = several.join(lasts.select("file", "range", "carried"), ["file", "range"])
    gathered = several.withColumn("of", F.coalesce("own", "carried")).groupBy("file", "of").agg(
        F.array_sort(F.collect_list(F.struct("range", "at", "value"))).alias("parts"))
    joined = gathered.select("file", F.col("of.range").alias("range"), F.col("of.at").alias("at"),
                             F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", "")).where(
        F.length(F.trim("record")) > 0).select("file", F.struct("range", "at").alias("at"), "record")


def read_csv_multiline(spark: SparkSession, path: str, schema: T.StructType | None = None, *, header: bool = True,
                       delimiter: str = ",", quote: str = '"', tagged: bool = False) -> DataFrame:
    """Rows of CSV files with line feeds in quoted values, as text columns or by ``schema``.

    Files stay splittable. Rows that do not fit (number of fields, types) are left out; with ``tagged`` they
    stay, as ``csv.read_csv_tagged`` gives them.
    """
    schema = schema or header_schema(spark, path, delimiter, quote, quote)
    found = records(spark, path, quote)
    if header:
        first = found.groupBy("file").agg(F.min("at").alias("first"))
        found = found.join(first, "file").where(F.col("at") > F.col("first"))
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"sep": delimiter, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = found.select(F.from_csv("record", full.toDDL(), options).alias("r")).select("r.*")
    if tagged:
        return rows.withColumn(STATUS, F.when(F.col(CORRUPT).isNull(), OK).otherwise(REJECTED))
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
