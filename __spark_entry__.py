"""

Every registered query reads the driver's tables whole (no row subsets). The tables stand in
for the incident data the library is written for:

- free text to categorise: ``documents.text`` (+ ``pages.html``, ``conversations.text``,
  ``benchmark.text``), ``part.p_name``, ``part.p_type``
- dates: ``orders.o_orderdate``, ``events.ts``
- demographic keys: ``lineitem (l_returnflag, l_linestatus)``, ``orders (o_orderstatus,
  o_orderpriority)``, ``customer.c_mktsegment``, ``part.p_type``
- locations: points computed from customer / user keys (some deliberately missing or zero)
- polygons and lines for the base map: rectangles derived from ``nation`` rows and roads
  derived from ``supplier`` rows, written to files and read back through the file sources.

Floating-point outputs are rounded to 6 decimals on both sides for the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.functions.categorise import categorise, categorise_sql, category_dimension
from blotter.functions.labels import fraction_percent_label, percent_label
from blotter.functions.recode import recode
from blotter.functions.rules import (
    CATEGORY_COLOURS,
    CATEGORY_SHORT_NAMES,
    LAYER_COLOURS,
    MAP_VIEW,
    MONTH_ABBREVIATIONS,
    RACE_PALETTE,
)
from blotter.operators.counts import count_by, distinct_values, monthly_counts
from blotter.functions.scales import in_view
from blotter.operators.points import crs_of, point_counts, points_from_wkt, to_crs, with_crs
from blotter.operators.shares import share_within
from blotter.operators.topk import top_k_with_ties
from blotter.functions.names import clean_names
from blotter.operators.clip import clip_lines
from blotter.plans import basemap, hotspots, incidents
from blotter.plans.ingest import ingest_tables, load_table
from blotter.session import shared_path
from blotter.sources.csv import CsvSource, read_csv_text, write_lines
from blotter.sources.geo import BOX, read_clustered, read_lines, read_polygons, write_clustered, write_line_features, write_polygon_features
from blotter.sources.multiline import read_csv_multiline
from blotter.sources.parquet import register_table
from blotter.sources.profile import glimpse, profile
from blotter.sources.sniff import read_csv_auto, sniff

SF0001 = "/root/testdata/sf0.001"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------------------------
# Parameters of the bindings (chosen once; the library defaults are the incident-data values).
# ---------------------------------------------------------------------------------------------
NAME_RULES = (("Warm", "red|hot"), ("Cool", "blue|cold"), ("Aged", "old|new"))
TYPE_RULES = (("Budget", "ECONOMY|PROMO|SMALL"), ("Premium", "LARGE|STANDARD"))
ORDER_STATUS_NAMES = {"F": "Finished", "O": "Open"}
PRIORITY_NAMES = {"1-URGENT": "Urgent"}
PRIORITY_COLOURS = {"Urgent": "#c1121f", "2-HIGH": "#e09f3e"}
LINESTATUS_NAMES = {"O": "Open", "F": "Filled"}
TYPE_COLOURS = {"ECONOMY": "#264653", "PROMO": "#2a9d8f", "LARGE": "#e76f51"}
STATUS_COLOURS = {"F": "#335c67", "O": "#9e2a2b"}
EVENT_COLOURS = {"click": "teal", "error": "maroon"}
ORDER_LIMITS = (1200.0, 1300.0)
TEXT_SOURCES = (("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text"))


# --- derived locations --------------------------------------------------------------------------
def _order_points(orders: DataFrame) -> DataFrame:
    """Orders with a location from the customer key; some keys missing (NULL lon) or zero lat."""
    k = F.col("o_custkey")
    lon = F.when(k % 89 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(-74.25) + (k % 56).cast("double") / F.lit(100.0))
    lat = F.when(k % 97 == 0, F.lit(0.0)).otherwise(
        F.lit(40.5) + ((k * 7) % 43).cast("double") / F.lit(100.0))
    return orders.select(lon.alias("longitude"), lat.alias("latitude"), "o_orderstatus")


_ORDER_POINTS_SQL = """
    SELECT CASE WHEN o_custkey % 89 = 0 THEN NULL
                ELSE CAST(-74.25 AS DOUBLE) + CAST(o_custkey % 56 AS DOUBLE) / CAST(100 AS DOUBLE) END AS longitude,
           CASE WHEN o_custkey % 97 = 0 THEN CAST(0 AS DOUBLE)
                ELSE CAST(40.5 AS DOUBLE) + CAST((o_custkey * 7) % 43 AS DOUBLE) / CAST(100 AS DOUBLE) END AS latitude,
           o_orderstatus
    FROM orders
"""


def _wkt(key: str, kind_key: str) -> F.Column:
    """WKT text built from integers (no float formatting involved), with bad rows mixed in."""
    x = F.concat(F.lit("-73."), F.lpad((F.col(key) % 1000).cast("string"), 3, "0"))
    y = F.concat(F.lit("40."), F.lpad(((F.col(key) * 7) % 1000).cast("string"), 3, "0"))
    kk = F.col(kind_key)
    return (
        F.when(kk % 50 == 0, F.lit("POINT EMPTY"))
        .when(kk % 71 == 0, F.lit(None).cast("string"))
        .when(kk % 23 == 0, F.concat(F.lit("LINESTRING ("), x, F.lit(" "), y, F.lit(", 0 0)")))
        .when(kk % 3 == 0, F.concat(F.lit("POINT("), x, F.lit(" "), y, F.lit(")")))
        .otherwise(F.concat(F.lit("POINT ("), x, F.lit(" "), y, F.lit(")")))
    )


def _wkt_sql(key: str, kind_key: str) -> str:
    x = f"'-73.' || lpad(CAST({key} % 1000 AS VARCHAR), 3, '0')"
    y = f"'40.' || lpad(CAST(({key} * 7) % 1000 AS VARCHAR), 3, '0')"
    return (
        f"CASE WHEN {kind_key} % 50 = 0 THEN 'POINT EMPTY' "
        f"WHEN {kind_key} % 71 = 0 THEN NULL "
        f"WHEN {kind_key} % 23 = 0 THEN 'LINESTRING (' || {x} || ' ' || {y} || ', 0 0)' "
        f"WHEN {kind_key} % 3 = 0 THEN 'POINT(' || {x} || ' ' || {y} || ')' "
        f"ELSE 'POINT (' || {x} || ' ' || {y} || ')' END"
    )


_WKT_RE_SQL = r"^\s*POINT\s*\(\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s+([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s*\)\s*$"


def _wkt_parse_sql(col: str) -> tuple[str, str]:
    return (
        f"TRY_CAST(regexp_extract({col}, '{_WKT_RE_SQL}', 1, 'i') AS DOUBLE)",
        f"TRY_CAST(regexp_extract({col}, '{_WKT_RE_SQL}', 2, 'i') AS DOUBLE)",
    )


# --- SQL fragments shared by several oracles ----------------------------------------------------
def _month_label_sql(m: str) -> str:
    arr = ", ".join(f"'{a}'" for a in MONTH_ABBREVIATIONS)
    return f"([{arr}])[{m}]"


def _short_label_sql(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return (
        f"CASE WHEN abs({v}) >= 1e12 THEN printf('%.1f', round_even({v} / 1e12, 1)) || 'T' "
        f"WHEN abs({v}) >= 1e9 THEN printf('%.1f', round_even({v} / 1e9, 1)) || 'B' "
        f"WHEN abs({v}) >= 1e6 THEN printf('%.1f', round_even({v} / 1e6, 1)) || 'M' "
        f"WHEN abs({v}) >= 1e3 THEN printf('%.1f', round_even({v} / 1e3, 1)) || 'K' "
        f"ELSE printf('%.1f', round_even({v}, 1)) END"
    )


def _pct_label_sql(p: str) -> str:
    return f"regexp_replace(CAST(round_even({p}, 1) AS VARCHAR), '\\.0$', '') || '%'"


def _case_map_sql(col: str, mapping: dict, passthrough: bool = True) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE {col if passthrough else 'NULL'} END"


def _size_sql(n: str, table: str) -> str:
    lo, hi = f"(SELECT min({n}) FROM {table})", f"(SELECT max({n}) FROM {table})"
    return (
        f"CAST(2 AS DOUBLE) + CAST(6 AS DOUBLE) * sqrt(CASE WHEN {hi} = {lo} THEN CAST(0.5 AS DOUBLE) "
        f"ELSE CAST({n} - {lo} AS DOUBLE) / CAST({hi} - {lo} AS DOUBLE) END)"
    )


_IN_VIEW_SQL = "coalesce(lon BETWEEN {} AND {} AND lat BETWEEN {} AND {}, false)".format(*MAP_VIEW)


# =============================================================================================
# Queries
# =============================================================================================
def q_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.category_counts(_t(spark, sf_dir, "documents"), "text")


def q_category_counts_text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        _t(spark, sf_dir, tab).select(F.lit(tab).alias("source"), F.col(col).alias("text"))
        for tab, col in TEXT_SOURCES
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return count_by(categorise(union, "text"), ["source", "category"], "n")


def q_categorise_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.category_counts(_t(spark, sf_dir, "part"), "p_name", NAME_RULES, "Other")


def q_category_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per value, with the category of each distinct value joined on."""
    part = _t(spark, sf_dir, "part").select("p_type")
    lookup = category_dimension(part, "p_type", TYPE_RULES, "Other").withColumnRenamed("p_type", "_value")
    counts = count_by(part, "p_type", "n")
    return counts.join(lookup, counts["p_type"].eqNullSafe(lookup["_value"])).select("p_type", "category", "n")


def q_monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.monthly_trend(_t(spark, sf_dir, "orders"), "o_orderdate", "total_orders")


def q_monthly_trend_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.monthly_trend(_t(spark, sf_dir, "events"), "ts", "total_events", label="integer")


def q_axis_censor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(incidents.monthly_trend(_t(spark, sf_dir, "orders"), "o_orderdate", "total_orders",
                                          limits=ORDER_LIMITS))


def q_share_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_by(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "n")
    shares = share_within(counts, "l_returnflag", "n", "percent")
    return _round(shares.select(
        "l_returnflag", recode("l_linestatus", LINESTATUS_NAMES).alias("l_linestatus"), "n", "percent",
        percent_label("percent").alias("label"),
    ))


def q_stacked_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(incidents.share_by_group(
        _t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", exclude=("P",),
        group_names=ORDER_STATUS_NAMES, key_names=PRIORITY_NAMES, colours=PRIORITY_COLOURS,
    ))


def q_share_then_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(incidents.share_then_exclude(_t(spark, sf_dir, "customer"), "c_mktsegment", ("HOUSEHOLD",)))


def q_donut_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(incidents.donut_segments(_t(spark, sf_dir, "part"), "p_type", TYPE_COLOURS))


def q_topk_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_with_ties(count_by(_t(spark, sf_dir, "lineitem"), "l_partkey", "n"), "n", 100)


def q_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _order_points(_t(spark, sf_dir, "orders"))
    return _round(hotspots.top_locations(pts, "longitude", "latitude", "o_orderstatus", exclude="P",
                                         k=100, colours=STATUS_COLOURS))


def q_wkt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select(_wkt("o_custkey", "o_orderkey").alias("geo"))
    return _round(point_counts(points_from_wkt(orders, "geo"), "lon", "lat"))


def q_layered_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _t(spark, sf_dir, "events").select("event_type", _wkt("user_id", "event_id").alias("geo"))
    layers = {
        et: hotspots.layer_points(ev.where(F.col("event_type") == et), "geo", k=100)
        for et in ("click", "error")
    }
    return _round(hotspots.layered_hotspots(layers, k=100, colours=EVENT_COLOURS))


def q_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(_t(spark, sf_dir, "orders"), "o_orderpriority")


def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(_t(spark, sf_dir, "orders")).select("column_name", "position", "rows", "non_null", "nulls")


# --- CSV ingest ---------------------------------------------------------------------------------
ORDERS_HEADER = "Order Key,O-CustKey,Order Status,Total Price ($),Order Date,Order%Priority"
ORDERS_CSV_SCHEMA = T.StructType([
    T.StructField("Order Key", T.LongType()),
    T.StructField("O-CustKey", T.LongType()),
    T.StructField("Order Status", T.StringType()),
    T.StructField("Total Price ($)", T.DoubleType()),
    T.StructField("Order Date", T.DateType()),
    T.StructField("Order%Priority", T.StringType()),
])
CUSTOMER_HEADER = "Cust Key,Name,Nation Code,Segment"


def _orders_csv_lines(orders: DataFrame) -> DataFrame:
    """CSV lines for orders with US dates; keys % 101 get a non-numeric price (type reject),
    keys % 103 lose their last field (too few fields)."""
    k = F.col("o_orderkey")
    price = F.when(k % 101 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    head = F.concat_ws(",", k.cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), price,
                       F.date_format("o_orderdate", "MM/dd/yyyy"))
    line = F.when((k % 103 == 0) & (k % 101 != 0), head).otherwise(F.concat_ws(",", head, F.col("o_orderpriority")))
    return orders.select(line.alias("value"))


def _customer_csv_lines(customer: DataFrame) -> DataFrame:
    """All-text CSV lines: a quoted name holding a comma and doubled quotes, a zero-padded code;
    keys % 37 lose a field, keys % 41 get an extra one."""
    k = F.col("c_custkey")
    name = F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""'), F.col("c_mktsegment"), F.lit('"""'))
    code = F.lpad(F.col("c_nationkey").cast("string"), 3, "0")
    full = F.concat_ws(",", k.cast("string"), name, code, F.col("c_mktsegment"))
    line = (F.when(k % 37 == 0, F.concat_ws(",", k.cast("string"), name, code))
            .when(k % 41 == 0, F.concat_ws(",", full, F.lit("extra")))
            .otherwise(full))
    return customer.select(line.alias("value"))


_CSV_INPUTS = {
    "orders": ("orders", _orders_csv_lines, ORDERS_HEADER),
    "customer": ("customer", _customer_csv_lines, CUSTOMER_HEADER),
}


def _write_csv_inputs(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, str]:
    root = shared_path(spark, "csv-input")
    out = {}
    for name in names:
        table, make_lines, header = _CSV_INPUTS[name]
        out[name] = write_lines(make_lines(_t(spark, sf_dir, table)), f"{root}/{name}", header)
    return out


def _ingest(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple[str, DataFrame]:
    src = _write_csv_inputs(spark, sf_dir, names)
    dest = shared_path(spark, "ingested")
    sources = {
        "orders": lambda: CsvSource(src["orders"], ORDERS_CSV_SCHEMA),
        "customer": lambda: CsvSource(src["customer"], text=True),
    }
    summary = ingest_tables(spark, {n: sources[n]() for n in names}, dest)
    return dest, summary


def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest, _ = _ingest(spark, sf_dir, ("orders",))
    return load_table(spark, dest, "orders")


def q_csv_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest(spark, sf_dir, ("orders", "customer"))[1]


def q_csv_text_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _write_csv_inputs(spark, sf_dir, ("customer",))
    return clean_names(read_csv_text(spark, src["customer"]))


# --- polygons, roads, clip ---------------------------------------------------------------------
GRID_BOX = (0.5, 0.5, 9.0, 9.0)
ROAD_TAGS = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential")
KEPT_NATIONS = ("NATION_0", "NATION_3", "NATION_7", "NATION_12", "NATION_18")
NATION_ALIASES = {"NATION_0": "Zero", "NATION_7": "Seven", "NATION_18": "Eighteen"}


def _rect(x0: F.Column, y0: F.Column, x1: F.Column, y1: F.Column) -> F.Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))


def _nation_polygons(nation: DataFrame, holes: bool) -> DataFrame:
    """A 1.5 x 1.5 square per nation on a 5 x 5 grid of pitch 2; with ``holes`` every third one
    has a 0.5 x 0.5 hole."""
    k = F.col("n_nationkey")
    x0, y0 = (k % 5) * 2.0, F.floor(k / 5) * 2.0
    outer = _rect(x0, y0, x0 + 1.5, y0 + 1.5)
    hole = _rect(x0 + 0.5, y0 + 0.5, x0 + 1.0, y0 + 1.0)
    rings = F.when(F.lit(holes) & (k % 3 == 0), F.array(outer, hole)).otherwise(F.array(outer))
    return nation.select(F.col("n_name").alias("name"), rings.alias("rings"))


def _off(k: int) -> F.Column:
    """sqrt(k) / 100: an irrational offset (computed identically by both engines) that keeps
    clipped coordinates away from decimal rounding ties and from the squares' edges."""
    return F.sqrt(F.lit(float(k))) / 100.0


def _supplier_roads(supplier: DataFrame, bends: bool) -> DataFrame:
    s = F.col("s_suppkey")
    a = F.struct(((s * 37) % 97).cast("double") / 10.0 + _off(2), ((s * 53) % 89).cast("double") / 10.0 + _off(3))
    b = F.struct(((s * 71) % 101).cast("double") / 10.0 + _off(5), ((s * 29) % 83).cast("double") / 10.0 + _off(7))
    m = F.struct(((s * 13) % 91).cast("double") / 10.0 + _off(11), ((s * 17) % 87).cast("double") / 10.0 + _off(13))
    xy = lambda c: F.struct(c["col1"].alias("x"), c["col2"].alias("y"))
    pts = F.array(xy(a), xy(m), xy(b)) if bends else F.array(xy(a), xy(b))
    tag = F.element_at(F.array(*[F.lit(t) for t in ROAD_TAGS]), (s % 6 + 1).cast("int"))
    return supplier.select(s.alias("way_id"), tag.alias("highway"), pts.alias("pts"))


def _geo_files(spark: SparkSession, sf_dir: str, holes: bool, bends: bool) -> tuple[DataFrame, DataFrame]:
    root = shared_path(spark, "geo")
    write_polygon_features(_nation_polygons(_t(spark, sf_dir, "nation"), holes), f"{root}/areas")
    write_line_features(_supplier_roads(_t(spark, sf_dir, "supplier"), bends), f"{root}/roads")
    return read_polygons(spark, f"{root}/areas"), read_lines(spark, f"{root}/roads")


def q_clip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas, roads = _geo_files(spark, sf_dir, holes=False, bends=False)
    roads = basemap.main_roads(roads, ROAD_TAGS[:5], GRID_BOX).select("way_id", "highway", "pts")
    clipped = clip_lines(roads, areas.select("name", "rings"), ["way_id"], ["name"], cell=0.25)
    last = F.size("pts") - 1
    return _round(clipped.select(
        "name", "way_id", "highway", "piece",
        F.col("pts")[0]["x"].alias("x_start"), F.col("pts")[0]["y"].alias("y_start"),
        F.get("pts", last)["x"].alias("x_end"), F.get("pts", last)["y"].alias("y_end"),
    ))


def q_base_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bent roads in squares with holes; points as whole millionths of a degree."""
    areas, roads = _geo_files(spark, sf_dir, holes=True, bends=True)
    out = basemap.base_map(areas, roads, "name", KEPT_NATIONS, NATION_ALIASES, ROAD_TAGS[:5], GRID_BOX, cell=0.25)
    return out.select("borough_name", "highway", "way_id", "piece", _path("pts").alias("path"))


def _path(pts: str) -> F.Column:
    def micro(c: F.Column) -> F.Column:
        return F.round(c * 1e6).cast("long").cast("string")

    return F.array_join(F.transform(pts, lambda q: F.concat_ws(" ", micro(q["x"]), micro(q["y"]))), ",")


def q_multi_part_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-part roads in districts of several parts: the squares of a region's nations."""
    nation, supplier = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "supplier")
    squares = _nation_polygons(nation, holes=False).join(nation, F.col("name") == F.col("n_name"))
    areas = squares.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("name"),
                           F.col("n_nationkey").alias("part"), "rings")
    bent = _supplier_roads(supplier, bends=True)
    roads = bent.select("way_id", "highway", F.posexplode(F.array(F.slice("pts", 1, 2), F.slice("pts", 2, 2))).alias("part", "pts"))
    out = basemap.base_map(areas, roads, "name", ("R0", "R1", "R3"), {"R0": "Zero"}, ROAD_TAGS[:5], GRID_BOX, cell=0.25)
    return out.select("borough_name", "highway", "way_id", "part", "piece", _path("pts").alias("path"))


# --- CSV without a schema, quoted line feeds, clustered roads, order of a written result -------------
def _dialect_lines(orders: DataFrame, kind: str) -> DataFrame:
    """Order lines in one of three dialects; every fifth note holds the delimiter and a quote, every seventh is empty."""
    sep, quote, day = {"us": (",", '"', "MM/dd/yyyy"), "eu": (";", "'", "dd.MM.yyyy"), "tabs": ("\t", '"', "yyyy-MM-dd")}[kind]
    k = F.col("o_orderkey")
    note = (F.when(k % 7 == 0, F.lit("")).when(k % 5 == 0, F.concat(F.lit(f"{quote}a{sep} {quote}{quote}"), F.col("o_orderpriority"), F.lit(quote)))
            .otherwise(F.col("o_orderpriority")))
    return orders.select(F.concat_ws(sep, k.cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
                                     F.date_format("o_orderdate", day), note).alias("value"))


def q_csv_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three dialects read without a schema: their rows, and the types found."""
    orders, root, out = _t(spark, sf_dir, "orders"), shared_path(spark, "sniffed"), None
    for kind, header in (("us", "order,price,day,note"), ("eu", "order;price;day;note"), ("tabs", None)):
        path = write_lines(_dialect_lines(orders, kind), f"{root}/{kind}", header)
        dialect = sniff(spark, path)
        rows = read_csv_auto(spark, path, dialect).toDF("order_key", "price", "day", "note")
        types = ",".join(f.dataType.simpleString() for f in dialect.schema)
        rows = rows.select(F.lit(kind).alias("file"), F.lit(types).alias("types"), "order_key", F.round("price", 2).alias("price"), "day", "note")
        out = rows if out is None else out.unionByName(rows)
    return out


def q_csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with line feeds, written as quoted CSV files, one a task, and read by ranges."""
    path = shared_path(spark, "multiline")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])
    rows = read_csv_multiline(spark, path, schema)
    return rows.select("doc_id", "lang", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


SMALL_BOX = (2.0, 2.0, 4.5, 4.0)


def q_pruned_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main roads of a small box from a clustered table."""
    path = shared_path(spark, "clustered")
    write_clustered(_supplier_roads(_t(spark, sf_dir, "supplier"), bends=False), path, world=(0.0, 0.0, 10.0, 10.0))
    roads = basemap.main_roads(read_clustered(spark, path), ROAD_TAGS[:5], SMALL_BOX)
    return _round(roads.select("way_id", "highway", *[F.col(c) for c in BOX]))


def q_stacked_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled stack's bounds as axis labels."""
    stack = incidents.share_by_group(_t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", exclude=("P",),
                                     group_names=ORDER_STATUS_NAMES, key_names=PRIORITY_NAMES, colours=PRIORITY_COLOURS)
    return stack.select("o_orderstatus", "o_orderpriority", fraction_percent_label("ymin").alias("from_label"),
                        fraction_percent_label("ymax", 0.1).alias("to_label"))


def q_registered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over registered tables."""
    register_table(_t(spark, sf_dir, "orders"), "blotter_orders")
    register_table(_t(spark, sf_dir, "customer"), "blotter_customer")
    return spark.sql("""
        SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n, max(o_orderdate) AS latest
        FROM blotter_orders JOIN blotter_customer ON o_custkey = c_custkey GROUP BY ALL""")


def q_glimpse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and first values of a table's columns."""
    return glimpse(_t(spark, sf_dir, "orders"), "o_orderkey", 3)


def q_monthly_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written monthly trend: ``place`` is each row's position in the files, read back."""
    path = shared_path(spark, "monthly")
    k = F.col("o_orderkey")
    text = F.when(k % 50 == 0, F.lit("13/45/2020")).when(k % 51 == 0, F.lit(None)).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    monthly_counts(_t(spark, sf_dir, "orders").select(text.alias("day")), "day", "n").write.parquet(path)
    rows = spark.read.parquet(path).select("month", "n", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    place = F.row_number().over(Window.orderBy("f", "i"))  # twelve months and the missing one
    return rows.select("month", "n", place.alias("place"))


# --- one description for every rule, and the branches that the given tables do not reach ----------
DESCRIPTIONS = (
    "ASSAULT 3", "LARCENY,PETIT", "CONTROLLED SUBSTANCE", "CRIM POS WEAP 2", "TRESPASS 2", "PROSTITUTION",
    "TORTURE/INJURE", "SPEEDING", "MONEY LAUNDERING", "ROBBERY, WEAPON", "SALE OF CONTROLLED SUBSTANCE",
    "UNAUTHX SALE", "assault", None, "", "ZZZ",
)


def _description(key: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, DESCRIPTIONS)), (F.col(key) % len(DESCRIPTIONS) + 1).cast("int"))


def _description_sql(key: str) -> str:
    items = ", ".join("NULL" if d is None else f"'{d}'" for d in DESCRIPTIONS)
    return f"([{items}])[{key} % {len(DESCRIPTIONS)} + 1]"


def q_nine_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order gets a description by its key; all ten categories occur."""
    orders = _t(spark, sf_dir, "orders").select(_description("o_orderkey").alias("pd_desc"))
    return incidents.category_counts(orders)


def q_weapons_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-layer map with its own category filter."""
    orders = _t(spark, sf_dir, "orders").select(
        _description("o_orderkey").alias("pd_desc"), _wkt("o_custkey", "o_orderkey").alias("geo"))
    errors = _t(spark, sf_dir, "events").where(F.col("event_type") == "error").select(_wkt("user_id", "event_id").alias("geo"))
    return _round(hotspots.weapons_vs_shootings(incidents.with_category(orders), errors, "geo"))


def q_monthly_trend_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text, some impossible or missing; ``place`` is the position in the promised order."""
    k = F.col("o_orderkey")
    text = F.when(k % 50 == 0, F.lit("13/45/2024")).when(k % 51 != 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
    trend = incidents.monthly_trend(_t(spark, sf_dir, "orders").select(text.alias("arrest_date")))
    return trend.withColumn("place", F.when(F.col("month").isNull(), 13).otherwise(F.col("month")).cast("int"))


def q_ring_without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring whose key is missing on every tenth row."""
    key = F.when(F.col("p_partkey") % 10 != 0, F.col("p_type")).alias("age_group")
    return _round(incidents.donut_segments(_t(spark, sf_dir, "part").select(key), "age_group", TYPE_COLOURS))


def q_points_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside and outside the viewport, with the CRS of the points after a change of frame."""
    k = F.col("o_custkey")
    pts = _t(spark, sf_dir, "orders").select((F.lit(-74.5) + (k % 100) / F.lit(100.0)).alias("lon"),
                                             (F.lit(40.0) + (k % 130) / F.lit(100.0)).alias("lat"))
    moved = to_crs(with_crs(pts, ["lon", "lat"], 4269), ["lon", "lat"], 4326)
    flags = moved.select(in_view("lon", "lat").alias("in_view"), F.lit(crs_of(moved, "lon")).alias("crs"))
    return flags.groupBy("in_view", "crs").agg(F.count(F.lit(1)).alias("n"))


def q_recode_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basemap.named_areas(_t(spark, sf_dir, "nation"), "n_name", KEPT_NATIONS, NATION_ALIASES,
                               "display_name").select("n_nationkey", "n_name", "display_name")


# --- full incident analyses over categorised text ----------------------------------------------
LANG_NAMES = {"en": "English", "fr": "French"}
LANG_COLOURS = {"English": "#540b0e", "French": "#0d3b66"}
LAYER_CATEGORY = "Public Order/Admin"


def _doc_points(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    return docs.select(
        "text",
        (F.lit(-74.25) + (k % 56).cast("double") / F.lit(100.0)).alias("longitude"),
        (F.lit(40.5) + ((k * 7) % 43).cast("double") / F.lit(100.0)).alias("latitude"),
        _wkt("doc_id", "doc_id").alias("geo"),
    )


def q_category_share_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = incidents.with_category(_t(spark, sf_dir, "documents").select("text", "lang"), "text")
    return _round(incidents.share_by_group(docs, "category", "lang", group_names=CATEGORY_SHORT_NAMES,
                                           key_names=LANG_NAMES, colours=LANG_COLOURS))


def q_category_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = incidents.with_category(_doc_points(_t(spark, sf_dir, "documents")), "text")
    return _round(hotspots.top_locations(docs, k=100, colours=CATEGORY_COLOURS))


def q_incident_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = incidents.with_category(_doc_points(_t(spark, sf_dir, "documents")), "text")
    errors = _t(spark, sf_dir, "events").where(F.col("event_type") == "error") \
        .select(_wkt("user_id", "event_id").alias("geo"))
    return _round(hotspots.weapons_vs_shootings(docs, errors, "geo", value=LAYER_CATEGORY))


# --- repeated short text: every event, and its distinct values ---------------------------------
PROPS_RULES = (("Seventies", '"k": 7'), ("Teens", '"k": 1'), ("Single", '"k": 0|"k": 2}|"k": 3}|"k": 4}|"k": 5}'))


def q_props_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated values: counted first, categorised once for each (event_type, props)."""
    ev = count_by(_t(spark, sf_dir, "events"), ["event_type", "props"], "rows")
    cat = categorise(ev, "props", PROPS_RULES, "Other")
    return cat.groupBy("event_type", "category").agg(F.sum("rows").alias("n"))


def q_props_categories_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, categorised for every event."""
    ev = _t(spark, sf_dir, "events").select("event_type", "props")
    return count_by(categorise(ev, "props", PROPS_RULES, "Other"), ["event_type", "category"], "n")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_sniffed": q_csv_sniffed,
    "csv_multiline": q_csv_multiline,
    "pruned_roads": q_pruned_roads,
    "stacked_axis": q_stacked_axis,
    "registered_table": q_registered_table,
    "glimpse": q_glimpse,
    "monthly_order": q_monthly_order,
    "nine_rules": q_nine_rules,
    "weapons_layers": q_weapons_layers,
    "monthly_trend_text": q_monthly_trend_text,
    "ring_without_nulls": q_ring_without_nulls,
    "points_in_view": q_points_in_view,
    "multi_part_map": q_multi_part_map,
    "category_counts": q_category_counts,
    "category_counts_text_sources": q_category_counts_text_sources,
    "categorise_rules": q_categorise_rules,
    "category_dimension": q_category_dimension,
    "monthly_trend": q_monthly_trend,
    "monthly_trend_events": q_monthly_trend_events,
    "axis_censor": q_axis_censor,
    "share_within_group": q_share_within_group,
    "stacked_fill": q_stacked_fill,
    "share_then_exclude": q_share_then_exclude,
    "donut_segments": q_donut_segments,
    "topk_with_ties": q_topk_with_ties,
    "hotspots": q_hotspots,
    "wkt_points": q_wkt_points,
    "layered_hotspots": q_layered_hotspots,
    "distinct_values": q_distinct_values,
    "profile": q_profile,
    "recode_alias": q_recode_alias,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_reject_counts": q_csv_reject_counts,
    "csv_text_reject": q_csv_text_reject,
    "clip_lines": q_clip_lines,
    "base_map": q_base_map,
    "category_share_by_lang": q_category_share_by_lang,
    "category_hotspots": q_category_hotspots,
    "incident_layers": q_incident_layers,
    "props_categories": q_props_categories,
    "props_categories_inline": q_props_categories_inline,
}


# =============================================================================================
# Oracle SQL (DuckDB)
# =============================================================================================
def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["category_counts"] = f"""
        SELECT {categorise_sql('text')} AS category, count(*) AS n FROM documents GROUP BY 1"""
    union = " UNION ALL ".join(f"SELECT '{tab}' AS source, {col} AS text FROM {tab}" for tab, col in TEXT_SOURCES)
    s["category_counts_text_sources"] = f"""
        SELECT source, {categorise_sql('text')} AS category, count(*) AS n FROM ({union}) u GROUP BY 1, 2"""
    s["categorise_rules"] = f"""
        SELECT {categorise_sql('p_name', NAME_RULES, 'Other')} AS category, count(*) AS n FROM part GROUP BY 1"""
    s["category_dimension"] = f"""
        SELECT p_type, {categorise_sql('p_type', TYPE_RULES, 'Other')} AS category, count(*) AS n
        FROM part GROUP BY 1, 2"""
    s["monthly_trend"] = f"""
        WITH m AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS total_orders
                   FROM orders GROUP BY 1)
        SELECT month, {_month_label_sql('month')} AS month_label, total_orders,
               {_short_label_sql('total_orders')} AS label FROM m"""
    s["monthly_trend_events"] = f"""
        WITH m AS (SELECT CAST(month(ts) AS INTEGER) AS month, count(*) AS total_events
                   FROM events GROUP BY 1)
        SELECT month, {_month_label_sql('month')} AS month_label, total_events,
               CAST(TRY_CAST(total_events AS INTEGER) AS VARCHAR) AS label FROM m"""
    lo, hi = ORDER_LIMITS
    s["axis_censor"] = f"""
        WITH m AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS total_orders
                   FROM orders GROUP BY 1)
        SELECT month, {_month_label_sql('month')} AS month_label, total_orders,
               {_short_label_sql('total_orders')} AS label,
               round(CASE WHEN total_orders BETWEEN {lo} AND {hi} THEN CAST(total_orders AS DOUBLE) END, 6) AS y
        FROM m"""
    s["share_within_group"] = f"""
        WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2),
        p AS (SELECT *, 100 * n / sum(n) OVER (PARTITION BY l_returnflag) AS percent FROM c)
        SELECT l_returnflag, {_case_map_sql('l_linestatus', LINESTATUS_NAMES)} AS l_linestatus, n,
               round(percent, 6) AS percent, {_pct_label_sql('percent')} AS label FROM p"""
    s["stacked_fill"] = f"""
        WITH c AS (SELECT o_orderstatus AS g, o_orderpriority AS k, count(*) AS n FROM orders
                   WHERE o_orderstatus NOT IN ('P') GROUP BY 1, 2),
        s AS (SELECT g, k, n, 100 * n / sum(n) OVER (PARTITION BY g) AS percent FROM c),
        r AS (SELECT {_case_map_sql('g', ORDER_STATUS_NAMES)} AS g, {_case_map_sql('k', PRIORITY_NAMES)} AS k,
                     n, percent FROM s),
        o AS (SELECT g, CAST(row_number() OVER (ORDER BY round(avg(-percent), 9), g) AS INTEGER) AS ord
              FROM r GROUP BY g),
        f AS (SELECT r.*, o.ord, n / sum(n) OVER (PARTITION BY r.g) AS frac FROM r JOIN o USING (g)),
        st AS (SELECT *, sum(frac) OVER (PARTITION BY g ORDER BY k DESC NULLS FIRST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ymax FROM f),
        st2 AS (SELECT *, coalesce(lag(ymax) OVER (PARTITION BY g ORDER BY k DESC NULLS FIRST), 0) AS ymin FROM st)
        SELECT g AS o_orderstatus, ord, k AS o_orderpriority, n, round(percent, 6) AS percent,
               round(ymin, 6) AS ymin, round(ymax, 6) AS ymax, round((ymin + ymax) / 2, 6) AS ymid,
               {_pct_label_sql('percent')} AS label,
               {_case_map_sql('k', PRIORITY_COLOURS, passthrough=False)} AS colour
        FROM st2"""
    pal = ", ".join(f"'{c}'" for c in RACE_PALETTE)
    s["share_then_exclude"] = f"""
        WITH c AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1),
        s AS (SELECT k, n, n / (SELECT sum(n) FROM c) * 100 AS percent FROM c),
        kept AS (SELECT * FROM s WHERE k NOT IN ('HOUSEHOLD')),
        g AS (SELECT *, sum(percent) OVER (ORDER BY k DESC NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ymax FROM kept),
        a AS (SELECT *, ymax - percent / 2 AS ypos FROM g),
        b AS (SELECT *, 90 - 360 * ypos / (SELECT sum(percent) FROM kept) AS angle FROM a),
        p AS (SELECT k, row_number() OVER (ORDER BY k) AS rk FROM kept)
        SELECT k AS c_mktsegment, CAST(row_number() OVER (ORDER BY k DESC NULLS LAST) AS INTEGER) AS ord, n, round(percent, 6) AS percent, round(ypos, 6) AS ypos,
               round(angle, 6) AS angle,
               round(CASE WHEN angle < -90 THEN angle + 180 ELSE angle END, 6) AS label_angle,
               CASE WHEN angle < -90 THEN 1 ELSE 0 END AS hjust,
               {_pct_label_sql('percent')} AS label, ([{pal}])[rk] AS colour
        FROM b JOIN p USING (k)"""
    s["donut_segments"] = f"""
        WITH c AS (SELECT p_type AS k, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1),
        s AS (SELECT k, n, n / (SELECT sum(n) FROM c) * 100 AS percent FROM c),
        g AS (SELECT *, sum(percent) OVER (ORDER BY k DESC NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ymax FROM s),
        h AS (SELECT *, coalesce(lag(ymax) OVER (ORDER BY k DESC NULLS LAST), 0) AS ymin FROM g),
        a AS (SELECT *, (ymax + ymin) / 2 AS label_pos FROM h),
        b AS (SELECT *, 90 - 360 * label_pos / (SELECT sum(percent) FROM s) AS angle FROM a)
        SELECT k AS p_type, CAST(row_number() OVER (ORDER BY k DESC NULLS LAST) AS INTEGER) AS ord, n, round(percent, 6) AS percent, round(ymin, 6) AS ymin, round(ymax, 6) AS ymax,
               round(label_pos, 6) AS label_pos, round(angle, 6) AS angle,
               round(CASE WHEN angle < -90 THEN angle + 180 ELSE angle END, 6) AS label_angle,
               {_pct_label_sql('percent')} AS label,
               {_case_map_sql('k', TYPE_COLOURS, passthrough=False)} AS colour
        FROM b"""
    s["topk_with_ties"] = """
        WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT l_partkey, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM c) WHERE r <= 100"""
    s["hotspots"] = f"""
        WITH p AS ({_ORDER_POINTS_SQL}),
        v AS (SELECT longitude AS lon, latitude AS lat, o_orderstatus FROM p
              WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND NOT isnan(longitude) AND NOT isnan(latitude)
                AND longitude <> 0 AND latitude <> 0 AND o_orderstatus <> 'P'),
        c AS (SELECT lon, lat, o_orderstatus, count(*) AS n FROM v GROUP BY 1, 2, 3),
        t AS (SELECT lon, lat, o_orderstatus, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM c) WHERE r <= 100)
        SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, o_orderstatus, n, round({_size_sql('n', 't')}, 6) AS size,
               {_case_map_sql('o_orderstatus', STATUS_COLOURS, passthrough=False)} AS colour,
               {_IN_VIEW_SQL} AS in_view
        FROM t"""
    wl, wa = _wkt_parse_sql("geo")
    s["wkt_points"] = f"""
        WITH w AS (SELECT {_wkt_sql('o_custkey', 'o_orderkey')} AS geo FROM orders),
        p AS (SELECT {wl} AS lon, {wa} AS lat FROM w)
        SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, count(*) AS n FROM p
        WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2"""
    layer_sql = []
    for et in ("click", "error"):
        layer_sql.append(f"""
        SELECT '{et}' AS series, lon, lat, n FROM (
          SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM (
            SELECT lon, lat, count(*) AS n FROM (
              SELECT {wl} AS lon, {wa} AS lat FROM (
                SELECT {_wkt_sql('user_id', 'event_id')} AS geo FROM events WHERE event_type = '{et}')
            ) WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2)
        ) WHERE r <= 100""")
    s["layered_hotspots"] = f"""
        WITH u AS ({' UNION ALL '.join(layer_sql)})
        SELECT series, round(lon, 6) AS lon, round(lat, 6) AS lat, n, round({_size_sql('n', 'u')}, 6) AS size,
               {_case_map_sql('series', EVENT_COLOURS, passthrough=False)} AS colour, {_IN_VIEW_SQL} AS in_view
        FROM u"""
    s["distinct_values"] = "SELECT DISTINCT o_orderpriority FROM orders"
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    s["profile"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS position, count(*) AS rows, count({c}) AS non_null, "
        f"count(*) - count({c}) AS nulls FROM orders"
        for i, c in enumerate(cols, start=1)
    )

    s["recode_alias"] = f"""
        SELECT n_nationkey, n_name, {_case_map_sql('n_name', NATION_ALIASES)} AS display_name FROM nation
        WHERE n_name IN ({', '.join(f"'{n}'" for n in KEPT_NATIONS)})"""
    s["csv_roundtrip"] = """
        SELECT o_orderkey AS order_key, o_custkey AS o_cust_key, o_orderstatus AS order_status,
               o_totalprice AS total_price, CAST(o_orderdate AS DATE) AS order_date,
               o_orderpriority AS order_percent_priority
        FROM orders WHERE o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 0"""
    s["csv_reject_counts"] = """
        SELECT 'orders' AS table_name,
               count(*) FILTER (WHERE o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 0) AS rows,
               count(*) FILTER (WHERE o_orderkey % 101 = 0 OR o_orderkey % 103 = 0) AS rejected FROM orders
        UNION ALL
        SELECT 'customer', count(*) FILTER (WHERE c_custkey % 37 <> 0 AND c_custkey % 41 <> 0),
               count(*) FILTER (WHERE c_custkey % 37 = 0 OR c_custkey % 41 = 0) FROM customer"""
    s["csv_text_reject"] = """
        SELECT CAST(c_custkey AS VARCHAR) AS cust_key, c_name || ', "' || c_mktsegment || '"' AS name,
               lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS nation_code, c_mktsegment AS segment
        FROM customer WHERE c_custkey % 37 <> 0 AND c_custkey % 41 <> 0"""
    s["csv_sniffed"] = " UNION ALL ".join(f"""
        SELECT '{kind}' AS file, 'bigint,double,date,string' AS types, o_orderkey AS order_key, round(o_totalprice, 2) AS price,
               CAST(o_orderdate AS DATE) AS day,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'a{sep} ' || {quote} || o_orderpriority
                    ELSE o_orderpriority END AS note FROM orders"""
        for kind, sep, quote in (("us", ",", "'\"'"), ("eu", ";", "chr(39)"), ("tabs", "\t", "'\"'")))
    s["csv_multiline"] = """
        SELECT doc_id, lang, CASE WHEN text <> '' THEN length(text) END AS chars, CASE WHEN text <> '' THEN md5(text) END AS text_md5
        FROM (SELECT doc_id, lang, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents)"""
    s["registered_table"] = """
        SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n, max(o_orderdate) AS latest
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
    s["glimpse"] = " UNION ALL ".join(f"""
        SELECT '{c}' AS column_name, {i} AS position, '{kind}' AS data_type, count(*) AS rows, count({c}) AS non_null,
               count(*) - count({c}) AS nulls,
               (SELECT string_agg(coalesce(CAST({c} AS VARCHAR), 'NA'), ', ' ORDER BY o_orderkey)
                FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3)) AS first_values FROM orders"""
        for i, (c, kind) in enumerate((("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                                       ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")), 1))
    s["monthly_order"] = """
        WITH m AS (SELECT CASE WHEN o_orderkey % 50 <> 0 AND o_orderkey % 51 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS month,
                          count(*) AS n FROM orders GROUP BY 1)
        SELECT month, n, CAST(row_number() OVER (ORDER BY month NULLS LAST) AS INTEGER) AS place FROM m"""
    s["stacked_axis"] = f"""
        SELECT o_orderstatus, o_orderpriority, printf('%.0f%%', round_even(100 * ymin, 0)) AS from_label,
               printf('%.1f%%', round_even(100 * ymax, 1)) AS to_label FROM ({s['stacked_fill']})"""
    xmin, ymin, xmax, ymax = SMALL_BOX
    corners = [(xmin, ymin), (xmin, ymax), (xmax, ymin), (xmax, ymax)]
    small_sides = ", ".join(f"(x2 - x1) * ({cy} - y1) - (y2 - y1) * ({cx} - x1)" for cx, cy in corners)
    small_tags = ", ".join(f"'{t}'" for t in ROAD_TAGS)
    s["pruned_roads"] = f"""
        WITH l AS (SELECT s_suppkey AS way_id, ([{small_tags}])[s_suppkey % 6 + 1] AS highway,
                     CAST((s_suppkey * 37) % 97 AS DOUBLE) / 10 + sqrt(2.0) / 100 AS x1,
                     CAST((s_suppkey * 53) % 89 AS DOUBLE) / 10 + sqrt(3.0) / 100 AS y1,
                     CAST((s_suppkey * 71) % 101 AS DOUBLE) / 10 + sqrt(5.0) / 100 AS x2,
                     CAST((s_suppkey * 29) % 83 AS DOUBLE) / 10 + sqrt(7.0) / 100 AS y2 FROM supplier)
        SELECT way_id, highway, round(least(x1, x2), 6) AS xmin, round(least(y1, y2), 6) AS ymin,
               round(greatest(x1, x2), 6) AS xmax, round(greatest(y1, y2), 6) AS ymax FROM l
        WHERE highway <> '{ROAD_TAGS[5]}' AND least(x1, x2) <= {xmax} AND greatest(x1, x2) >= {xmin}
          AND least(y1, y2) <= {ymax} AND greatest(y1, y2) >= {ymin} AND least({small_sides}) <= 0 AND greatest({small_sides}) >= 0"""
    xmin, ymin, xmax, ymax = GRID_BOX
    corners = [(xmin, ymin), (xmin, ymax), (xmax, ymin), (xmax, ymax)]
    seg_sides = ", ".join(f"(x2 - x1) * ({cy} - y1) - (y2 - y1) * ({cx} - x1)" for cx, cy in corners)
    sides = ", ".join(f"(x2 - x1) * ({cy} - y1) - (y2 - y1) * ({cx} - x1)" for cx, cy in corners)
    tags = ", ".join(f"'{t}'" for t in ROAD_TAGS)
    kept = ", ".join(f"'{t}'" for t in ROAD_TAGS[:5])
    s["clip_lines"] = f"""
        WITH r AS (SELECT n_name AS name, CAST((n_nationkey % 5) * 2 AS DOUBLE) AS rx0,
                          CAST((n_nationkey // 5) * 2 AS DOUBLE) AS ry0 FROM nation),
        r2 AS (SELECT name, rx0 AS xmin, rx0 + 1.5 AS xmax, ry0 AS ymin, ry0 + 1.5 AS ymax FROM r),
        l AS (SELECT s_suppkey AS way_id, ([{tags}])[s_suppkey % 6 + 1] AS highway,
                     CAST((s_suppkey * 37) % 97 AS DOUBLE) / 10 + sqrt(2.0) / 100 AS x1,
                     CAST((s_suppkey * 53) % 89 AS DOUBLE) / 10 + sqrt(3.0) / 100 AS y1,
                     CAST((s_suppkey * 71) % 101 AS DOUBLE) / 10 + sqrt(5.0) / 100 AS x2,
                     CAST((s_suppkey * 29) % 83 AS DOUBLE) / 10 + sqrt(7.0) / 100 AS y2 FROM supplier),
        lb AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM l
               WHERE highway IN ({kept})
                 AND least(x1, x2) <= {xmax} AND greatest(x1, x2) >= {xmin}
                 AND least(y1, y2) <= {ymax} AND greatest(y1, y2) >= {ymin}
                 AND least({sides}) <= 0 AND greatest({sides}) >= 0),
        c AS (SELECT lb.*, r2.name,
                greatest(0.0, CASE WHEN dx > 0 THEN (xmin - x1) / dx ELSE (xmax - x1) / dx END,
                              CASE WHEN dy > 0 THEN (ymin - y1) / dy ELSE (ymax - y1) / dy END) AS t0,
                least(1.0, CASE WHEN dx > 0 THEN (xmax - x1) / dx ELSE (xmin - x1) / dx END,
                           CASE WHEN dy > 0 THEN (ymax - y1) / dy ELSE (ymin - y1) / dy END) AS t1
              FROM lb, r2)
        SELECT name, way_id, highway, CAST(1 AS INTEGER) AS piece,
               round(x1 + t0 * dx, 6) AS x_start, round(y1 + t0 * dy, 6) AS y_start,
               round(x1 + t1 * dx, 6) AS x_end, round(y1 + t1 * dy, 6) AS y_end
        FROM c WHERE t1 - t0 > 1e-11"""
    # Segments of the bent roads, the parameters where each is inside a square and outside its hole,
    # and islands of intervals that touch.
    bent = f"""
        l AS (SELECT s_suppkey AS way_id, ([{tags}])[s_suppkey % 6 + 1] AS highway,
                     CAST((s_suppkey * 37) % 97 AS DOUBLE) / 10 + sqrt(2.0) / 100 AS ax,
                     CAST((s_suppkey * 53) % 89 AS DOUBLE) / 10 + sqrt(3.0) / 100 AS ay,
                     CAST((s_suppkey * 13) % 91 AS DOUBLE) / 10 + sqrt(11.0) / 100 AS mx,
                     CAST((s_suppkey * 17) % 87 AS DOUBLE) / 10 + sqrt(13.0) / 100 AS my,
                     CAST((s_suppkey * 71) % 101 AS DOUBLE) / 10 + sqrt(5.0) / 100 AS bx,
                     CAST((s_suppkey * 29) % 83 AS DOUBLE) / 10 + sqrt(7.0) / 100 AS by_ FROM supplier),
        seg AS (SELECT way_id, highway, 0 AS seg, ax AS x1, ay AS y1, mx AS x2, my AS y2 FROM l WHERE highway IN ({kept})
                UNION ALL SELECT way_id, highway, 1, mx, my, bx, by_ FROM l WHERE highway IN ({kept})),
        hit AS (SELECT *, least(x1, x2) <= {xmax} AND greatest(x1, x2) >= {xmin}
                 AND least(y1, y2) <= {ymax} AND greatest(y1, y2) >= {ymin}
                 AND least({seg_sides}) <= 0 AND greatest({seg_sides}) >= 0 AS hits FROM seg)"""

    def inside(lo_x: str, hi_x: str, lo_y: str, hi_y: str) -> str:
        return f"""greatest(0.0, CASE WHEN dx > 0 THEN ({lo_x} - x1) / dx ELSE ({hi_x} - x1) / dx END,
                              CASE WHEN dy > 0 THEN ({lo_y} - y1) / dy ELSE ({hi_y} - y1) / dy END) AS t0,
                least(1.0, CASE WHEN dx > 0 THEN ({hi_x} - x1) / dx ELSE ({lo_x} - x1) / dx END,
                           CASE WHEN dy > 0 THEN ({hi_y} - y1) / dy ELSE ({lo_y} - y1) / dy END) AS t1"""

    def point(t: str) -> str:
        return (f"CAST(CAST(round((x1 + {t} * dx) * 1e6) AS BIGINT) AS VARCHAR) || ' ' || "
                f"CAST(CAST(round((y1 + {t} * dy) * 1e6) AS BIGINT) AS VARCHAR)")

    keep_names = ", ".join(f"'{n}'" for n in KEPT_NATIONS)
    s["base_map"] = f"""
        WITH {bent},
        road AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM hit QUALIFY bool_or(hits) OVER (PARTITION BY way_id)),
        sq AS (SELECT n_nationkey AS k, {_case_map_sql('n_name', NATION_ALIASES)} AS borough_name,
                      CAST((n_nationkey % 5) * 2 AS DOUBLE) AS qx, CAST((n_nationkey // 5) * 2 AS DOUBLE) AS qy
               FROM nation WHERE n_name IN ({keep_names})),
        o AS (SELECT road.*, sq.*, {inside('qx', 'qx + 1.5', 'qy', 'qy + 1.5')} FROM road, sq),
        o2 AS (SELECT * FROM o WHERE t1 - t0 > 1e-11),
        h AS (SELECT o2.* EXCLUDE (t0, t1), t0 AS o0, t1 AS o1, {inside('qx + 0.5', 'qx + 1.0', 'qy + 0.5', 'qy + 1.0')} FROM o2),
        cut AS (SELECT *, k % 3 = 0 AND t1 - t0 > 1e-11 AS holed FROM h),
        iv AS (SELECT * REPLACE (o0 AS t0, CASE WHEN holed THEN greatest(o0, t0) ELSE o1 END AS t1) FROM cut
               UNION ALL SELECT * REPLACE (least(o1, t1) AS t0, o1 AS t1) FROM cut WHERE holed),
        f AS (SELECT * FROM iv WHERE t1 - t0 > 1e-11),
        g AS (SELECT *, CASE WHEN lag(seg) OVER w = seg - 1 AND lag(t1) OVER w > 1 - 1e-9 AND t0 < 1e-9 THEN 0 ELSE 1 END AS fresh
              FROM f WINDOW w AS (PARTITION BY way_id, k ORDER BY seg, t0)),
        p AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY way_id, k ORDER BY seg, t0) AS INTEGER) AS piece FROM g)
        SELECT borough_name, highway, way_id, piece,
               arg_min({point('t0')}, seg + t0) || ',' || string_agg({point('t1')}, ',' ORDER BY seg, t0) AS path
        FROM p GROUP BY borough_name, highway, way_id, piece"""
    s["multi_part_map"] = f"""
        WITH {bent},
        road AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM hit WHERE hits),
        sq AS (SELECT 'R' || n_regionkey AS name, CAST((n_nationkey % 5) * 2 AS DOUBLE) AS qx,
                      CAST((n_nationkey // 5) * 2 AS DOUBLE) AS qy
               FROM nation WHERE n_regionkey IN (0, 1, 3)),
        o AS (SELECT road.*, sq.*, {inside('qx', 'qx + 1.5', 'qy', 'qy + 1.5')} FROM road, sq)
        SELECT CASE WHEN name = 'R0' THEN 'Zero' ELSE name END AS borough_name, highway, way_id, CAST(seg AS INTEGER) AS part,
               CAST(row_number() OVER (PARTITION BY way_id, seg, name ORDER BY t0) AS INTEGER) AS piece,
               {point('t0')} || ',' || {point('t1')} AS path
        FROM o WHERE t1 - t0 > 1e-11"""
    described = _description_sql("o_orderkey")
    s["nine_rules"] = f"""
        SELECT {categorise_sql('d')} AS category, count(*) AS n FROM (SELECT {described} AS d FROM orders) GROUP BY 1"""
    s["monthly_trend_text"] = f"""
        WITH m AS (SELECT CASE WHEN o_orderkey % 50 <> 0 AND o_orderkey % 51 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS month,
                          count(*) AS total_arrests FROM orders GROUP BY 1)
        SELECT month, {_month_label_sql('month')} AS month_label, total_arrests, {_short_label_sql('total_arrests')} AS label,
               CAST(row_number() OVER (ORDER BY month NULLS LAST) AS INTEGER) AS place FROM m"""
    s["ring_without_nulls"] = s["donut_segments"].replace(
        "FROM part WHERE p_type IS NOT NULL", "FROM part WHERE p_type IS NOT NULL AND p_partkey % 10 <> 0").replace(
        "AS p_type", "AS age_group")
    s["points_in_view"] = f"""
        SELECT {_IN_VIEW_SQL} AS in_view, CAST(4326 AS INTEGER) AS crs, count(*) AS n
        FROM (SELECT -74.5::DOUBLE + (o_custkey % 100) / 100.0::DOUBLE AS lon, 40.0::DOUBLE + (o_custkey % 130) / 100.0::DOUBLE AS lat
              FROM orders) GROUP BY ALL"""
    cat = categorise_sql("text")
    short = _case_map_sql("g", CATEGORY_SHORT_NAMES)
    s["category_share_by_lang"] = f"""
        WITH d AS (SELECT {cat} AS g, lang AS k FROM documents),
        c AS (SELECT g, k, count(*) AS n FROM d WHERE g NOT IN ('Other') GROUP BY 1, 2),
        s AS (SELECT g, k, n, 100 * n / sum(n) OVER (PARTITION BY g) AS percent FROM c),
        r AS (SELECT {short} AS g, {_case_map_sql('k', LANG_NAMES)} AS k, n, percent FROM s),
        o AS (SELECT g, CAST(row_number() OVER (ORDER BY round(avg(-percent), 9), g) AS INTEGER) AS ord
              FROM r GROUP BY g),
        f AS (SELECT r.*, o.ord, n / sum(n) OVER (PARTITION BY r.g) AS frac FROM r JOIN o USING (g)),
        st AS (SELECT *, sum(frac) OVER (PARTITION BY g ORDER BY k DESC NULLS FIRST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ymax FROM f),
        st2 AS (SELECT *, coalesce(lag(ymax) OVER (PARTITION BY g ORDER BY k DESC NULLS FIRST), 0) AS ymin FROM st)
        SELECT g AS category, ord, k AS lang, n, round(percent, 6) AS percent,
               round(ymin, 6) AS ymin, round(ymax, 6) AS ymax, round((ymin + ymax) / 2, 6) AS ymid,
               {_pct_label_sql('percent')} AS label,
               {_case_map_sql('k', LANG_COLOURS, passthrough=False)} AS colour
        FROM st2"""
    doc_pts = """
        SELECT text, doc_id,
               CAST(-74.25 AS DOUBLE) + CAST(doc_id % 56 AS DOUBLE) / CAST(100 AS DOUBLE) AS longitude,
               CAST(40.5 AS DOUBLE) + CAST((doc_id * 7) % 43 AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude
        FROM documents"""
    s["category_hotspots"] = f"""
        WITH p AS ({doc_pts}),
        v AS (SELECT longitude AS lon, latitude AS lat, {categorise_sql('text')} AS category FROM p
              WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND NOT isnan(longitude) AND NOT isnan(latitude)
                AND longitude <> 0 AND latitude <> 0),
        c AS (SELECT lon, lat, category, count(*) AS n FROM v WHERE category <> 'Other' GROUP BY 1, 2, 3),
        t AS (SELECT lon, lat, category, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM c) WHERE r <= 100)
        SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, category, n, round({_size_sql('n', 't')}, 6) AS size,
               {_case_map_sql('category', CATEGORY_COLOURS, passthrough=False)} AS colour,
               {_IN_VIEW_SQL} AS in_view
        FROM t"""
    def layers(weapons: str) -> str:
        layers_sql = []
        for series, src in (
            ("Weapon Arrests", weapons),
            ("Shooting Incidents", f"SELECT {_wkt_sql('user_id', 'event_id')} AS geo FROM events WHERE event_type = 'error'"),
        ):
            layers_sql.append(f"""
            SELECT '{series}' AS series, lon, lat, n FROM (
              SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM (
                SELECT lon, lat, count(*) AS n FROM (SELECT {wl} AS lon, {wa} AS lat FROM ({src}))
                WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2)
            ) WHERE r <= 100""")
        return f"""
            WITH u AS ({' UNION ALL '.join(layers_sql)})
            SELECT series, round(lon, 6) AS lon, round(lat, 6) AS lat, n, round({_size_sql('n', 'u')}, 6) AS size,
                   {_case_map_sql('series', LAYER_COLOURS, passthrough=False)} AS colour, {_IN_VIEW_SQL} AS in_view
            FROM u"""

    s["incident_layers"] = layers(f"SELECT {_wkt_sql('doc_id', 'doc_id')} AS geo FROM documents "
                                  f"WHERE {categorise_sql('text')} = '{LAYER_CATEGORY}'")
    s["weapons_layers"] = layers(f"SELECT {_wkt_sql('o_custkey', 'o_orderkey')} AS geo FROM orders "
                                 f"WHERE {categorise_sql(described)} = 'Weapons/Explosives'")
    props = f"""
        SELECT event_type, {categorise_sql('props', PROPS_RULES, 'Other')} AS category, count(*) AS n
        FROM events GROUP BY 1, 2"""
    s["props_categories"] = props
    s["props_categories_inline"] = props
    return s


# =============================================================================================
# Driver entry points
# =============================================================================================
def entry(spark: SparkSession) -> DataFrame:
    """Flagship: category counts over the whole documents table at sf0.001."""
    return q_category_counts(spark, SF0001)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_llm()[0]}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _sql().items() if k in _QUERIES} | _llm()[1]


def _llm() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-data operators; none where that subpackage cannot be imported."""
    try:
        from blotter.llm import ORACLES, QUERIES
        from corpus_pipeline import ORACLE_SQL, run
    except ImportError:
        return {}, {}

    return {**QUERIES, "pipeline": run}, ORACLES | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
