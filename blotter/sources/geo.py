"""Polygon and line sources (and sinks) as files: newline-delimited GeoJSON features or
Parquet in the library's own layout.

Layouts
-------
polygons: ``name STRING, part INT, rings ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>, properties MAP``
          (one row per polygon; a multi-polygon becomes several rows with increasing ``part``)
lines:    ``way_id BIGINT, part INT, highway STRING, pts ARRAY<STRUCT<x DOUBLE, y DOUBLE>>, properties MAP``
          (a multi-line becomes several rows with increasing ``part``)

One feature per line keeps the files splittable (a single FeatureCollection document is not).

Clustered tables hold either layout as Parquet with the box of every geometry (``xmin, ymin, xmax, ymax``), range-partitioned
and sorted by a Z-order key of the box's centre. Near features so share files and row groups, whose minima and maxima let a
box filter skip all others: ``read_clustered`` sends four comparisons to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.points import with_crs

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
FEATURE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),  # raw JSON, decoded per geometry type below
    ])),
])


def _pts(arr: Column) -> Column:
    return F.transform(arr, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited GeoJSON features: ``properties`` map, ``geom_type``, raw ``coordinates``."""
    df = spark.read.schema(FEATURE_SCHEMA).json(path)
    return df.select("properties", F.col("geometry.type").alias("geom_type"),
                     F.col("geometry.coordinates").alias("coordinates"))


def read_polygons(spark: SparkSession, path: str, name_prop: str = "NAME", fmt: str = "geojson",
                  crs: int = 4269) -> DataFrame:
    """Polygon features (Polygon / MultiPolygon) -> one row per polygon, in one scan."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        f = read_features(spark, path).where(F.col("geom_type").isin("Polygon", "MultiPolygon"))
        parts = F.when(
            F.col("geom_type") == "Polygon",
            F.array(F.from_json("coordinates", "array<array<array<double>>>")),
        ).otherwise(F.from_json("coordinates", "array<array<array<array<double>>>>"))
        df = f.select("properties", F.posexplode(parts).alias("part", "c")).select(
            F.col("properties")[name_prop].alias("name"), "part",
            F.transform("c", _pts).alias("rings"), "properties")
    return with_crs(df, ["rings"], crs)


def read_lines(spark: SparkSession, path: str, id_prop: str = "osm_id", tag: str = "highway",
               fmt: str = "geojson", crs: int = 4326) -> DataFrame:
    """Line features (LineString / MultiLineString) -> ``way_id, part, highway, pts, properties``,
    in one scan."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        f = read_features(spark, path).where(F.col("geom_type").isin("LineString", "MultiLineString"))
        parts = F.when(
            F.col("geom_type") == "LineString",
            F.array(F.from_json("coordinates", "array<array<double>>")),
        ).otherwise(F.from_json("coordinates", "array<array<array<double>>>"))
        df = f.select("properties", F.posexplode(parts).alias("part", "c")).select(
            F.col("properties")[id_prop].try_cast("bigint").alias("way_id"), "part",
            F.col("properties")[tag].alias("highway"),
            _pts(F.col("c")).alias("pts"), "properties")
    return with_crs(df, ["pts"], crs)


def _coords(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["x"], p["y"]))


def write_polygon_features(df: DataFrame, path: str, name_col: str = "name", name_prop: str = "NAME",
                           mode: str = "overwrite") -> str:
    """Polygons (``rings`` column) to newline-delimited GeoJSON features."""
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.create_map(F.lit(name_prop), F.col(name_col)).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"),
                 F.transform("rings", _coords).alias("coordinates")).alias("geometry"),
    )
    df.select(F.to_json(feat).alias("value")).write.mode(mode).text(path)
    return path


def write_line_features(df: DataFrame, path: str, id_col: str = "way_id", tag_col: str = "highway",
                        id_prop: str = "osm_id", tag: str = "highway", mode: str = "overwrite") -> str:
    """Lines (``pts`` column) to newline-delimited GeoJSON features."""
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.create_map(F.lit(id_prop), F.col(id_col).cast("string"), F.lit(tag), F.col(tag_col)).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), _coords(F.col("pts")).alias("coordinates")).alias("geometry"),
    )
    df.select(F.to_json(feat).alias("value")).write.mode(mode).text(path)
    return path


# --- clustered tables -----------------------------------------------------------------------------
BOX = ("xmin", "ymin", "xmax", "ymax")
WORLD = (-180.0, -90.0, 180.0, 90.0)
Z_BITS = 20


def _spread(v: Column, bits: int = Z_BITS) -> Column:
    """Bit i of ``v`` at place 2 * i, by halving steps: each moves the upper half of every group away."""
    step = 1 << (bits - 1).bit_length()
    while step > 1:
        step //= 2
        mask = sum(((1 << step) - 1) << at for at in range(0, 64, 2 * step))
        mask -= (mask >> 63) << 64  # as a signed long
        v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def z_order(x: Column, y: Column, box: tuple[float, float, float, float] = WORLD, bits: int = Z_BITS) -> Column:
    """Z-order key of a point in ``box`` (points outside count as on its border); NULL where a coordinate is."""
    def scaled(c: Column, low: float, high: float) -> Column:
        top = float((1 << bits) - 1)
        inside = F.least(F.greatest(F.floor((c - low) / (high - low) * top), F.lit(0.0)), F.lit(top)).cast("long")
        return F.when(c.isNotNull(), inside)

    xmin, ymin, xmax, ymax = box
    return _spread(scaled(x, xmin, xmax), bits).bitwiseOR(F.shiftleft(_spread(scaled(y, ymin, ymax), bits), 1))


def with_box(df: DataFrame) -> DataFrame:
    """``xmin, ymin, xmax, ymax`` of ``pts`` or of all ``rings``; NULL for a geometry without points."""
    points = F.col("pts") if "pts" in df.columns else F.flatten("rings")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return df.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})


def write_clustered(df: DataFrame, path: str, files: int | None = None, world: tuple[float, float, float, float] = WORLD,
                    mode: str = "overwrite") -> str:
    """Lines or polygons as Parquet, near ones together. ``files``: how many ranges (default: shuffle partitions)."""
    boxed = with_box(df).withColumn("_z", z_order((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, world))
    dealt = boxed.repartitionByRange(files, "_z") if files else boxed.repartitionByRange("_z")
    dealt.sortWithinPartitions("_z").drop("_z").write.mode(mode).parquet(path)
    return path


def in_box(box: tuple[float, float, float, float]) -> Column:
    """The geometry's box meets ``box`` (xmin, ymin, xmax, ymax): four comparisons a Parquet scan can use."""
    xmin, ymin, xmax, ymax = box
    return (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)


def read_clustered(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None,
                   crs: int = 4326) -> DataFrame:
    """A clustered table; with ``box`` the features whose box meets it, row groups elsewhere unread."""
    df = spark.read.parquet(path)
    geometry = "pts" if "pts" in df.columns else "rings"
    return with_crs(df.where(in_box(box)) if box else df, [geometry], crs)
