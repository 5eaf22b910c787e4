"""CSV files without a given schema: the dialect from a bounded sample of lines, the types from all rows.

- **Dialect.** Up to ``SAMPLE_LINES`` lines, of the first file and, if it has fewer (a header alone, say), of the others, are cut with
  each delimiter and quote; the pair that gives most lines the same number of fields (more than one) wins, then the one with more fields. A first line of distinct, non-empty texts is a header if
  some column below it is typed, or if none of its texts comes again in its column.
- **Types.** A column's type is the first of boolean, bigint, double, date, timestamp that every non-empty value of
  the column fits, else string. What the sample rules out needs no test; all rows decide on the rest in one aggregate: for each column and
  candidate the number of values that do not fit, a sum that merges across tasks. Dates and timestamps are candidates for each of
  ``DATE_FORMATS`` and ``TIME_FORMATS``; where several fit all rows, the first counts (so month before day).

Rows with another number of fields have no say in the types; see ``csv`` for reading that keeps and counts them.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv import CORRUPT, OK, STATUS, read_csv_tagged

SAMPLE_LINES = 1000
# What is looked for, in order.
DELIMITERS = (",", ";", "\t", "|")
QUOTES = ('"', "'")
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MM-dd-yyyy", "dd-MM-yyyy", "dd.MM.yyyy")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm:ss")
_TO_PYTHON = (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S"), ("'", ""))
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

#: The types of the lattice, most special first: (name, format).
CANDIDATES: tuple[tuple[str, str | None], ...] = (
    ("boolean", None), ("bigint", None), ("double", None),
    *(("date", f) for f in DATE_FORMATS), *(("timestamp", f) for f in TIME_FORMATS))


@dataclass
class Dialect:
    """What a CSV source looks like; ``formats`` has the date or time format of such columns."""

    delimiter: str
    quote: str
    header: bool
    schema: T.StructType
    formats: dict[str, str] = field(default_factory=dict)


def _value(c: Column, kind: str, fmt: str | None) -> Column:
    """The text as the type, NULL where it does not fit."""
    c = F.trim(c)
    if kind == "boolean":
        return F.when(F.lower(c).isin("true", "false"), c.try_cast("boolean"))
    if kind == "bigint":
        return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
    if kind == "double":
        return F.when(c.rlike(_NUMBER), c.try_cast("double"))
    if kind == "date":
        return F.when(F.length(c) == len(fmt), F.try_to_timestamp(c, F.lit(fmt)).cast("date"))
    if kind == "timestamp":
        return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")
    return c


def _fits(text: str, kind: str, fmt: str | None) -> bool:
    """``_value`` is not NULL, for a sampled value; may say yes too often, never no."""
    text = text.strip(" ")
    try:
        if kind == "boolean":
            return text.lower() in ("true", "false")
        if kind == "bigint":
            return -2 ** 63 <= int(text) < 2 ** 63
        if kind == "double":
            return float(text) is not None
        for spark, python in _TO_PYTHON:
            fmt = fmt.replace(spark, python)
        return datetime.strptime(text, fmt) is not None
    except ValueError:
        return False


def _sample(spark: SparkSession, path: str, lines: int) -> list[str]:
    """The first lines of the first file that has any; where they are too few, lines of the other files too, but for copies of the first line."""
    def some(files: list[str], most: int, but: str = "") -> list[str]:
        df = spark.read.text(files).where((F.length(F.trim("value")) > 0) & (F.col("value") != but))
        return [r.value for r in df.limit(most).collect()]

    files = list(map(unquote, sorted(spark.read.text(path).inputFiles())))
    for i, file in enumerate(files, 1):
        found = some([file], lines)
        if found:
            rest = files[i:] if len(found) < lines else []
            return found + (some(rest, lines - len(found), found[0]) if rest else [])
    return []


def _cut(lines: list[str], delimiter: str, quote: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO("\n".join(lines)), delimiter=delimiter, quotechar=quote, doublequote=True))


def _dialect(lines: list[str]) -> tuple[str, str, list[list[str]]]:
    """(delimiter, quote, the sample's rows of the most common number of fields)."""
    best = None
    for place, (delimiter, quote) in enumerate((d, q) for q in QUOTES for d in DELIMITERS):
        rows = _cut(lines, delimiter, quote)
        width, times = Counter(map(len, rows)).most_common(1)[0]
        score = (width > 1, times / len(rows), width, -place)
        if best is None or score > best[0]:
            best = (score, delimiter, quote, [r for r in rows if len(r) == width])
    return best[1:]


def _open_candidates(rows: list[list[str]], width: int) -> list[list[int]]:
    """For each of ``width`` columns the candidates that every non-empty sampled value fits: without values, all."""
    found = []
    for column in zip(*rows) if rows else [()] * width:
        values = {v for v in column if v.strip()}
        found.append([i for i, c in enumerate(CANDIDATES) if all(_fits(v, *c) for v in values)])
    return found


def _is_header(rows: list[list[str]]) -> bool:
    first, rest = rows[0], rows[1:]
    texts = all(v.strip() for v in first) and len(set(first)) == len(first)
    if not texts or any(_fits(v, *c) for v in first for c in CANDIDATES):
        return False
    typed = any(some and any(r[i].strip() for r in rest) for i, some in enumerate(_open_candidates(rest, len(first))))
    return typed or all(first[i] not in {r[i] for r in rest} for i in range(len(first)))


def sniff(spark: SparkSession, path: str, lines: int = SAMPLE_LINES) -> Dialect:
    """The dialect of the CSV files at ``path`` and the schema that all their rows fit.

    A column without any value is a string; columns of files without a header are named c0, c1, ... Files without
    lines give a dialect without columns.
    """
    sample = _sample(spark, path, lines)
    if not sample:
        return Dialect(",", '"', False, T.StructType([]))
    delimiter, quote, rows = _dialect(sample)
    header = _is_header(rows)
    names = rows[0] if header else [f"c{i}" for i in range(len(rows[0]))]
    names = [n if names.count(n) == 1 else f"{n}_{i}" for i, n in enumerate(names)]
    open_ = _open_candidates(rows[header:], len(names))
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = _texts(spark, path, delimiter, quote, header, text)
    given = [F.col(_quoted(n)) for n in names]
    filled = [F.length(F.trim(c)) > 0 for c in given]
    tests = [F.count_if(f).alias(f"n{i}") for i, f in enumerate(filled)]
    tests += [F.count_if(filled[i] & _value(given[i], *CANDIDATES[k]).isNull()).alias(f"x{i}_{k}")
              for i, some in enumerate(open_) for k in some]
    found = df.agg(*tests).first()
    fields, formats = [], {}
    for i, (name, some) in enumerate(zip(names, open_)):
        kind, fmt = next((CANDIDATES[k] for k in some if found[f"n{i}"] and not found[f"x{i}_{k}"]), ("string", None))
        fields.append(T.StructField(name, T.DataType.fromDDL("timestamp_ntz" if kind == "timestamp" else kind)))
        if fmt:
            formats[name] = fmt
    return Dialect(delimiter, quote, header, T.StructType(fields), formats)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _texts(spark: SparkSession, path: str, delimiter: str, quote: str, header: bool, schema: T.StructType) -> DataFrame:
    """Every column as text, rows with another number of fields left out."""
    df = read_csv_tagged(spark, path, schema, delimiter=delimiter, quote=quote, escape=quote, header=header)
    return df.where(F.col(STATUS) == OK).drop(STATUS, CORRUPT)


def read_csv_auto(spark: SparkSession, path: str, dialect: Dialect | None = None) -> DataFrame:
    """Typed rows of CSV files whose delimiter, quote, header, types and date formats are found out (or given).

    Rows with another number of fields are left out; empty values are NULL.
    """
    dialect = dialect or sniff(spark, path)
    if not dialect.schema.fields:
        return spark.createDataFrame([], dialect.schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in dialect.schema])
    df = _texts(spark, path, dialect.delimiter, dialect.quote, dialect.header, text)
    columns = []
    for f in dialect.schema:
        kind = "timestamp" if isinstance(f.dataType, T.TimestampNTZType) else f.dataType.simpleString()
        c = F.col(_quoted(f.name))
        columns.append((c if kind == "string" else _value(c, kind, dialect.formats.get(f.name))).alias(f.name))
    return df.select(*columns)
