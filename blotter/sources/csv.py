"""CSV sources: typed scan, all-text scan, and a reject-counting ingest into Parquet.

The ingest parses each file once: rows are tagged good/rejected in the same scan and written
in one job, partitioned by that tag, so readers of the good rows prune the rejected files
away and nothing is parsed twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import US_DATE

CORRUPT = "_corrupt_record"
STATUS = "_ingest_status"
OK, REJECTED = "ok", "rejected"


def _all_columns_read(names) -> "F.Column":
    """An always-true condition that references every column.

    Spark's CSV reader only tokenises the columns a query needs, and a line's field count is
    only checked against what was tokenised, so a query that reads one column (or none, as
    ``count()``) would see malformed lines as good ones. Referencing every column keeps the
    malformed-line decision independent of the projection.
    """
    cols = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    return F.length(F.concat_ws("\u0001", *cols)) >= 0


def _reader(spark: SparkSession, header: bool, delimiter: str, quote: str, escape: str,
            date_format: str, multiline: bool):
    r = (
        spark.read.option("header", header)
        .option("sep", delimiter)
        .option("quote", quote)
        .option("escape", escape)
        .option("dateFormat", date_format)
    )
    # Quoted newlines need whole-file parsing, which makes files unsplittable: opt-in only.
    return r.option("multiLine", True) if multiline else r


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, *, header: bool = True,
             delimiter: str = ",", quote: str = '"', escape: str = '"', date_format: str = US_DATE,
             infer_schema: bool = False, multiline: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Typed CSV scan. Give ``schema`` for production data; ``infer_schema`` costs an extra pass.

    A value that does not fit its column fails the read; ``read_csv_tagged`` keeps and counts such lines
    instead, and ``mode="PERMISSIVE"`` makes them NULL.
    """
    r = _reader(spark, header, delimiter, quote, escape, date_format, multiline)
    if schema is not None:
        r = r.schema(schema)
    elif infer_schema:
        r = r.option("inferSchema", True)
    df = r.option("mode", mode).csv(path)
    return df.where(_all_columns_read(df.columns)) if mode == "FAILFAST" else df


def header_schema(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"',
                  escape: str = '"') -> T.StructType:
    """All-text schema named after the header line (reads only the first line)."""
    names = _reader(spark, True, delimiter, quote, escape, US_DATE, False).csv(path).columns
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def read_csv_text(spark: SparkSession, path: str, *, delimiter: str = ",", quote: str = '"', escape: str = '"',
                  mode: str = "DROPMALFORMED", multiline: bool = False) -> DataFrame:
    """Every column as text (leading zeros kept); malformed rows (wrong field count) skipped."""
    schema = header_schema(spark, path, delimiter, quote, escape)
    df = (
        _reader(spark, True, delimiter, quote, escape, US_DATE, multiline)
        .schema(schema)
        .option("mode", mode)
        .csv(path)
    )
    return df.where(_all_columns_read(schema.fieldNames())) if mode == "DROPMALFORMED" else df


def read_csv_tagged(spark: SparkSession, path: str, schema: T.StructType | None = None, *, text: bool = False,
                    delimiter: str = ",", quote: str = '"', escape: str = '"', date_format: str = US_DATE,
                    multiline: bool = False, header: bool = True) -> DataFrame:
    """Parse once, keep every line: data columns + ``_ingest_status`` ('ok'/'rejected') + raw
    text of rejected lines in ``_corrupt_record``. Wrong field counts and values that do not
    fit their type are rejected."""
    if schema is None:
        if not text:
            raise ValueError("give a schema, or text=True for an all-text table")
        schema = header_schema(spark, path, delimiter, quote, escape)
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    df = (
        _reader(spark, header, delimiter, quote, escape, date_format, multiline)
        .schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    good = F.col(CORRUPT).isNull() & _all_columns_read(schema.fieldNames())
    return df.withColumn(STATUS, F.when(good, F.lit(OK)).otherwise(F.lit(REJECTED)))


@dataclass
class CsvSource:
    """One CSV input of an ingest: a typed ``schema`` or ``text=True`` for all-text."""

    path: str
    schema: T.StructType | None = None
    text: bool = False
    date_format: str = US_DATE
    options: dict = field(default_factory=dict)


def ingest_csv(spark: SparkSession, source: CsvSource, dest: str, mode: str = "overwrite") -> str:
    """CSV -> Parquet in one job: good rows and rejects side by side under ``dest``,
    partitioned by ``_ingest_status``. Returns ``dest``. Re-running overwrites (idempotent)."""
    tagged = read_csv_tagged(spark, source.path, source.schema, text=source.text,
                             date_format=source.date_format, **source.options)
    tagged.write.mode(mode).partitionBy(STATUS).parquet(dest)
    return dest


def read_ingested(spark: SparkSession, dest: str) -> DataFrame:
    """The good rows of an ingested table (rejected partition pruned at planning time)."""
    df = spark.read.parquet(dest)
    return df.where(F.col(STATUS) == OK).drop(STATUS, CORRUPT)


def read_rejects(spark: SparkSession, dest: str) -> DataFrame:
    """The rejected lines of an ingested table (raw text in ``_corrupt_record``)."""
    return spark.read.parquet(dest).where(F.col(STATUS) == REJECTED).select(CORRUPT)


def ingest_summary(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """``table_name, rows, rejected`` for ingested tables (counts read only the partition tag)."""
    parts = []
    for name, dest in tables.items():
        parts.append(
            spark.read.parquet(dest)
            .agg(
                F.count(F.when(F.col(STATUS) == OK, 1)).alias("rows"),
                F.count(F.when(F.col(STATUS) == REJECTED, 1)).alias("rejected"),
            )
            .select(F.lit(name).alias("table_name"), "rows", "rejected")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_lines(lines: DataFrame, path: str, header: str | None = None, mode: str = "overwrite") -> str:
    """Write a one-column text DataFrame verbatim, one line per row (empty rows are skipped).

    With ``header``, every output file starts with that line, as CSV readers with
    ``header=true`` expect. Done with the CSV writer itself: the header is the column name,
    and a separator and quote character that never occur in text keep each line unquoted.
    """
    col = lines.columns[0]
    one = lines.select(F.col(col).cast("string").alias(header if header is not None else "value"))
    if header is None:
        one.write.mode(mode).text(path)
        return path
    (
        one.write.mode(mode)
        .option("header", True)
        .option("sep", "\u0001")
        .option("quote", "\u0000")
        .option("escapeQuotes", False)
        .csv(path)
    )
    return path
