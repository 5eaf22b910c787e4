"""Point data: validity filters, WKT points, counts per exact location, CRS tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Geographic (degree) coordinate systems treated as the same frame at point-grouping precision.
DEGREE_CRS = {4326, 4269}
WGS84 = 4326

_NUM = r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
_NUM_NC = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
WKT_POINT = r"(?i)^\s*POINT\s*\(\s*" + _NUM + r"\s+" + _NUM + r"\s*\)\s*$"
# The same shape with the two numbers captured together ("x y"), for a single regex pass.
WKT_POINT_PAIR = r"(?i)^\s*POINT\s*\(\s*(" + _NUM_NC + r"\s+" + _NUM_NC + r")\s*\)\s*$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def valid_points(df: DataFrame, lon: str = "longitude", lat: str = "latitude", drop_zero: bool = True) -> DataFrame:
    """Drop rows with a missing (NULL or NaN) coordinate and, by default, a zero coordinate."""
    cond = F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    if drop_zero:
        cond = cond & (F.col(lon) != 0) & (F.col(lat) != 0)
    return df.where(cond)


def _number(text: Column) -> Column:
    # The pattern admits only numbers, so only the empty no-match needs guarding.
    return F.when(text != "", text.try_cast("double"))


def wkt_lon(col: Column | str) -> Column:
    """x of a ``POINT (x y)`` WKT text; NULL for anything else (EMPTY, other shapes, junk)."""
    return _number(F.regexp_extract(_c(col), WKT_POINT, 1))


def wkt_lat(col: Column | str) -> Column:
    """y of a ``POINT (x y)`` WKT text; NULL for anything else."""
    return _number(F.regexp_extract(_c(col), WKT_POINT, 2))


def wkt_point(col: Column | str) -> Column:
    """``struct<lon, lat>`` of a ``POINT (x y)`` text with one regex pass (NULL fields if not)."""
    pair = F.regexp_extract(_c(col), WKT_POINT_PAIR, 1)
    parts = F.split(pair, r"\s+")
    return F.struct(_number(F.get(parts, 0)).alias("lon"), _number(F.get(parts, 1)).alias("lat"))


def points_from_wkt(df: DataFrame, col: str, lon: str = "lon", lat: str = "lat", keep: bool = False) -> DataFrame:
    """Parse a WKT point column into ``lon``/``lat`` and drop rows that are not a point.

    The point is produced by a one-element generator, so the validity filter stays above it
    and the text is parsed once per row (not again inside a pushed-down filter).
    """
    others = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in (lon, lat) and (keep or c != col)]
    parsed = df.select(*others, F.explode(F.array(wkt_point(col))).alias("_pt"))
    out = parsed.select(*others, F.col("_pt.lon").alias(lon), F.col("_pt.lat").alias(lat)).where(
        F.col(lon).isNotNull() & F.col(lat).isNotNull()
    )
    return with_crs(out, [lon, lat], WGS84)


def rejected_wkt(df: DataFrame, col: str) -> DataFrame:
    """Rows whose WKT text is NULL or not a parseable point (the side output of the parse)."""
    return df.where(wkt_lon(col).isNull() | wkt_lat(col).isNull())


def points_from_coords(df: DataFrame, lon: str = "longitude", lat: str = "latitude",
                       out_lon: str = "lon", out_lat: str = "lat", crs: int = WGS84) -> DataFrame:
    """Two numeric columns become the point columns (source columns are consumed)."""
    out = df.withColumnRenamed(lon, out_lon).withColumnRenamed(lat, out_lat)
    return with_crs(out, [out_lon, out_lat], crs)


def point_counts(df: DataFrame, lon: str = "lon", lat: str = "lat", keys: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Rows per exact point (and extra keys)."""
    return df.groupBy(lon, lat, *keys).agg(F.count(F.lit(1)).alias(n))


def with_crs(df: DataFrame, cols: Sequence[str], crs: int) -> DataFrame:
    """Tag coordinate columns with their coordinate reference system (column metadata)."""
    out = df
    for c in cols:
        out = out.withMetadata(c, {**out.schema[c].metadata, "crs": int(crs)})
    return out


def crs_of(df: DataFrame, col: str) -> int | None:
    """The CRS tag of a coordinate column, if any."""
    return df.schema[col].metadata.get("crs")


def to_crs(df: DataFrame, cols: Sequence[str], crs: int) -> DataFrame:
    """Re-express coordinates in ``crs``. Only degree-based geographic systems are supported;
    between them the coordinates are kept as they are (a metre-scale approximation)."""
    current = {crs_of(df, c) for c in cols}
    for src in current:
        if src is not None and (src not in DEGREE_CRS or crs not in DEGREE_CRS) and src != crs:
            raise NotImplementedError(f"reprojection {src} -> {crs} is not supported")
    return with_crs(df, cols, crs)


def assert_same_crs(*pairs: tuple[DataFrame, str]) -> int | None:
    """Raise when tagged columns disagree on their CRS; return the common one."""
    seen = {crs_of(df, c) for df, c in pairs} - {None}
    if len(seen) > 1:
        raise ValueError(f"coordinate systems differ: {sorted(seen)}")
    return next(iter(seen), None)
