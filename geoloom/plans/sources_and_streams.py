"""Queries over sources, sinks, catalog, versions, text logs, time windows and streams."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from geoloom.functions import codec, text
from geoloom.layer import BOX, GEOM, Layer, single_vertex_lines
from geoloom.operators import textlog, timeline
from geoloom.plans import layers
from geoloom.plans.registry import query, rounded
from geoloom.sources import catalog, export, geoparquet, ingest, versions
from geoloom.sources.place import fresh_path
from geoloom.streaming import jobs

POINT_ROWS = "SELECT pt_id, category, val, lon, lat FROM geo_points"


@query("o01_scan", POINT_ROWS)
def scan(spark, sf_dir):
    customers = ingest.scan(spark, f"{sf_dir}/customer.parquet")
    return spark.sql(layers.POINTS_SQL.replace("FROM customer", "FROM {customer}"), customer=customers)


@query("o02_geojson_ingest", "SELECT pt_id, category, val, 'Point' AS kind, lon AS x, lat AS y FROM geo_points")
def geojson_ingest(spark, sf_dir):
    path = fresh_path(spark, "points-geojson")
    points = layers.points(spark, sf_dir)
    export.write_geojson(points, path, "points", columns=["pt_id", "category", "val"], limit=None)
    layer, _ = ingest.read_geojson(spark, path, lines=True, id="pt_id")
    return layer.df.select(
        "pt_id",
        "category",
        F.col("val").cast("double").alias("val"),
        F.col(f"{GEOM}.kind").alias("kind"),
        F.col("xmin").alias("x"),
        F.col("ymin").alias("y"),
    )


@query("o02_geojson_collections", "SELECT pt_id, category, val, 'Point' AS kind, lon AS x, lat AS y FROM geo_points")
def geojson_collections(spark, sf_dir):
    path = fresh_path(spark, "points-collections")
    export.write_collections(layers.points(spark, sf_dir), path, ["pt_id", "category", "val"], 100_000)
    layer, _ = ingest.read_geojson(spark, path, id="pt_id")
    attributes = ["pt_id", "category", F.col("val").cast("double").alias("val"), F.col(f"{GEOM}.kind").alias("kind")]
    return layer.df.select(*attributes, F.col("xmin").alias("x"), F.col("ymin").alias("y"))


PARCEL_BOXES = """SELECT parcel_id, 'Polygon' AS kind, 5 AS n_points, round(least(x1,x4), 9) AS xmin, round(least(y1,y2), 9) AS ymin,
    round(greatest(x2,x3), 9) AS xmax, round(greatest(y3,y4), 9) AS ymax FROM geo_parcels"""


def _shape_columns(layer: Layer):
    return layer.df.select(
        "parcel_id",
        F.col(f"{GEOM}.kind").alias("kind"),
        F.size(F.flatten(F.flatten(F.col(f"{GEOM}.parts")))).cast("long").alias("n_points"),
        *[rounded(c, 9) for c in BOX],
    )


@query("o03_geoparquet_ingest", PARCEL_BOXES)
def geoparquet_ingest(spark, sf_dir):
    path = fresh_path(spark, "parcels-geoparquet")
    parcels = layers.parcels(spark, sf_dir)
    export.write_geoparquet(parcels.with_df(parcels.df.select("parcel_id", GEOM, *BOX)), path)
    layer, _ = ingest.read_geoparquet(spark, path, id="parcel_id")
    return _shape_columns(layer)


@query("o03_wkt_ingest", PARCEL_BOXES)
def wkt_ingest(spark, sf_dir):
    parcels = layers.parcels(spark, sf_dir).df.select("parcel_id", text.to_wkt(F.col(GEOM)).alias("shape"))
    layer, _ = ingest.normalize_layer(parcels, "shape", id="parcel_id")
    return _shape_columns(layer)


@query(
    "o03_quarantine",
    """SELECT line_id, count(*) AS n_vertices FROM geo_vertices GROUP BY line_id HAVING count(*) < 2""",
)
def quarantine(spark, sf_dir):
    return single_vertex_lines(layers.line_vertices(spark, sf_dir), "line_id")


@query(
    "o04_union_layers",
    """SELECT category, event_type, count(*) AS n, round(sum(val), 2) AS total, round(sum(value), 2) AS event_total FROM (
      SELECT pt_id, category, val, NULL AS event_type, NULL AS value FROM geo_points
      UNION ALL SELECT event_id, NULL, NULL, event_type, value FROM geo_events) u GROUP BY category, event_type""",
)
def union_layers(spark, sf_dir):
    points, events = layers.points(spark, sf_dir), layers.events(spark, sf_dir)
    renamed = Layer(events.df.withColumnRenamed("event_id", "pt_id").drop("ts"), "pt_id", "point")
    merged = ingest.union_layers([points, renamed]).df
    return merged.groupBy("category", "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("val"), 2).alias("total"), F.round(F.sum("value"), 2).alias("event_total")
    )


MESSY = """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_orderkey % 13 = 0 THEN 'abc' ELSE concat(' ', CAST(o_custkey AS VARCHAR(20)), ' ') END AS customer_text,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR(30)) END AS price_text,
    CASE WHEN o_orderstatus = 'O' THEN '1998-02-30' ELSE '1997-03-05' END AS day_text,
    CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'maybe' END AS flag_text,
    o_orderkey * 86400123 + 631152000000 AS created_at FROM orders"""


def _messy(spark, sf_dir) -> Layer:
    sql = MESSY.replace("FROM orders", "FROM {orders}")
    return Layer(spark.sql(sql, orders=layers.table(spark, sf_dir, "orders")), "id")


@query(
    "o05_preview",
    f"""WITH m AS ({MESSY}) SELECT 'id' AS column_name, 'BIGINT' AS data_type, 0 AS null_count, count(*) AS row_count FROM m
    UNION ALL SELECT 'priority', 'VARCHAR', count(*) - count(priority), count(*) FROM m
    UNION ALL SELECT 'customer_text', 'VARCHAR', count(*) - count(customer_text), count(*) FROM m
    UNION ALL SELECT 'price_text', 'VARCHAR', count(*) - count(price_text), count(*) FROM m
    UNION ALL SELECT 'day_text', 'VARCHAR', count(*) - count(day_text), count(*) FROM m
    UNION ALL SELECT 'flag_text', 'VARCHAR', count(*) - count(flag_text), count(*) FROM m
    UNION ALL SELECT 'created_at', 'BIGINT', count(*) - count(created_at), count(*) FROM m""",
)
def preview(spark, sf_dir):
    return ingest.preview(_messy(spark, sf_dir).df)[1]


OVERRIDES = {
    "customer_text": "INTEGER",
    "price_text": "DOUBLE",
    "day_text": "DATE",
    "flag_text": "BOOLEAN",
    "created_at": "TIMESTAMP",
}
CAST_SQL = f"""WITH m AS ({MESSY}), cast_rows AS (SELECT id, priority, TRY_CAST(NULLIF(TRIM(customer_text), '') AS INTEGER) AS customer_text,
      TRY_CAST(NULLIF(TRIM(price_text), '') AS DOUBLE) AS price_text, CAST(TRY_CAST(NULLIF(TRIM(day_text), '') AS DATE) AS VARCHAR) AS day_text,
      TRY_CAST(NULLIF(TRIM(flag_text), '') AS BOOLEAN) AS flag_text, make_timestamp(created_at * 1000) AS created_at FROM m)"""


@query("o06_retype", CAST_SQL + " SELECT * FROM cast_rows")
def retype(spark, sf_dir):
    layer, _ = ingest.retype(_messy(spark, sf_dir), OVERRIDES)
    return layer.df.withColumn("day_text", F.col("day_text").cast("string"))


@query(
    "o06_retype_warnings",
    CAST_SQL
    + "\n    "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, (SELECT count(*) - count({c}) FROM cast_rows) AS null_count,
      (SELECT count(*) - count({c}) FROM cast_rows) - (SELECT count(*) - count({c}) FROM m) AS newly_null"""
        for c in OVERRIDES
    ),
)
def retype_warnings(spark, sf_dir):
    return ingest.retype(_messy(spark, sf_dir), OVERRIDES)[1]


FAMILY_COUNTS = """SELECT '_points' AS suffix, count(*) AS n FROM geo_points
    UNION ALL SELECT '_lines', count(*) FROM (SELECT line_id FROM geo_vertices GROUP BY line_id HAVING count(*) > 1) l
    UNION ALL SELECT '_polygons', count(*) FROM geo_parcels"""


def _mixed(spark, sf_dir) -> Layer:
    parts = [
        (layers.points(spark, sf_dir), "pt_id"),
        (layers.lines(spark, sf_dir), "line_id"),
        (layers.parcels(spark, sf_dir), "parcel_id"),
    ]
    return ingest.union_layers(
        [Layer(layer.df.select(F.col(id).cast("long").alias("id"), GEOM, *BOX), "id", layer.family) for layer, id in parts]
    )


@query("o07_split_by_family", FAMILY_COUNTS)
def split_by_family(spark, sf_dir):
    split = ingest.split_by_family(_mixed(spark, sf_dir))
    return catalog.row_counts({f".{suffix}": df for suffix, df in split.items()}).select(
        F.col("table_name").alias("suffix"), F.col("row_count").alias("n")
    )


@query("o07_family_of_wkb", FAMILY_COUNTS.replace("'_points'", "'point'").replace("'_lines'", "'line'").replace("'_polygons'", "'polygon'"))
def family_of_wkb(spark, sf_dir):
    stored = _mixed(spark, sf_dir).df.select(codec.to_wkb(F.col(GEOM)).alias("wkb"))
    return stored.groupBy(codec.family_of_wkb(F.col("wkb")).alias("suffix")).agg(F.count("*").alias("n"))


CATEGORY_TOTALS = "SELECT category, count(*) AS n, round(sum(val), 2) AS total FROM geo_points"


def _category_totals(df):
    return df.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("val"), 2).alias("total"))


@query("o08_write_append", CATEGORY_TOTALS + " GROUP BY category")
def write_append(spark, sf_dir):
    path = fresh_path(spark, "points")
    points = layers.points(spark, sf_dir)
    ingest.write_layer(ingest_where(points, F.col("category") == "BUILDING"), path)
    ingest.write_layer(ingest_where(points, F.col("category") != "BUILDING"), path, append=True)
    return _category_totals(ingest.scan(spark, path))


def ingest_where(layer: Layer, condition) -> Layer:
    return layer.with_df(layer.df.filter(condition))


@query("o08_write_clustered", "SELECT pt_id, category FROM geo_points WHERE lon >= -106e0 AND lon <= -104e0 AND lat >= 38e0 AND lat <= 40e0")
def write_clustered(spark, sf_dir):
    from geoloom.operators.filters import where_bbox

    path = fresh_path(spark, "points-clustered")
    points = layers.points(spark, sf_dir)
    ingest.write_clustered(points, path, partitions=8)
    stored = points.with_df(spark.read.parquet(path))
    return where_bbox(stored, (-106.0, 38.0, -104.0, 40.0)).df.select("pt_id", "category")


def _scratch(spark, sf_dir) -> tuple[str, str]:
    db = f"_scratch_{uuid.uuid4().hex[:8]}"
    points = layers.points(spark, sf_dir).df.select("pt_id", "category", "val", GEOM)
    catalog.materialize(points, "result", db, location=fresh_path(spark, db), as_wkb=GEOM)
    return db, f"{db}.result"


@query("o09_materialize", CATEGORY_TOTALS + " GROUP BY category")
def materialize(spark, sf_dir):
    _, ref = _scratch(spark, sf_dir)
    return _category_totals(spark.table(ref))


def _promoted(spark, sf_dir) -> tuple[str, str]:
    db, ref = _scratch(spark, sf_dir)
    home = f"kept_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {home} LOCATION '{fresh_path(spark, home)}'")
    catalog.promote(spark, ref, f"{home}.points")
    return db, f"{home}.points"


@query("o11_promote", CATEGORY_TOTALS + " GROUP BY category")
def promote(spark, sf_dir):
    return _category_totals(spark.table(_promoted(spark, sf_dir)[1]))


@query("o12_drop_scratch", "SELECT 'result' AS dropped, count(*) AS kept_rows FROM geo_points")
def drop_scratch(spark, sf_dir):
    """What is dropped with the scratch namespace, and the rows of the promoted copy afterwards."""
    db, ref = _promoted(spark, sf_dir)
    dropped = catalog.drop_scratch(spark, db)
    return spark.table(ref).agg(F.count("*").alias("kept_rows")).select(F.lit(",".join(dropped)).alias("dropped"), "kept_rows")


# Four commits: BUILDING and HOUSEHOLD rows, then one further category each.
COMMITS = (("BUILDING", "HOUSEHOLD"), ("AUTOMOBILE",), ("FURNITURE",), ("MACHINERY",))
VERSION_OF = "CASE category WHEN 'AUTOMOBILE' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 1 END"


def _history(spark, sf_dir):
    """Points with the version that added them and its commit time, a day apart."""
    rows = layers.points(spark, sf_dir).df.select("pt_id", "category", "val")
    number = F.lit(None).cast("int")
    for i, categories in enumerate(COMMITS, start=1):
        number = F.when(F.col("category").isin(*categories), i).otherwise(number)
    return rows.withColumn("version", number).withColumn("committed_at", F.make_timestamp_ntz(F.lit(2024), F.lit(1), "version", F.lit(0), F.lit(0), F.lit(0)))


@query(
    "o13_snapshots",
    f"""SELECT {VERSION_OF} AS version, 'append' AS operation, count(*) AS rows,
      make_timestamp(2024, 1, {VERSION_OF}, 0, 0, 0) AS committed_at FROM geo_points GROUP BY {VERSION_OF}""",
)
def snapshots(spark, sf_dir):
    return versions.commits(_history(spark, sf_dir))


@query("o14_as_of_version", f"{CATEGORY_TOTALS} WHERE {VERSION_OF} <= 2 GROUP BY category")
def as_of_version(spark, sf_dir):
    return _category_totals(versions.as_of(_history(spark, sf_dir), 2))


@query("o14_as_of_time", f"{CATEGORY_TOTALS} WHERE {VERSION_OF} <= 3 GROUP BY category")
def as_of_time(spark, sf_dir):
    return _category_totals(versions.as_of(_history(spark, sf_dir), timestamp=datetime(2024, 1, 3, 12)))


@query(
    "o15_diff",
    """SELECT pt_id, 'removed' AS change FROM geo_points WHERE category = 'BUILDING'
    UNION ALL SELECT pt_id, 'changed' FROM geo_points WHERE category = 'MACHINERY'
    UNION ALL SELECT pt_id + 100000000, 'added' FROM geo_points WHERE category = 'AUTOMOBILE'""",
)
def diff(spark, sf_dir):
    rows = layers.points(spark, sf_dir).df.select("pt_id", "category", "val")
    kept = rows.filter("category <> 'BUILDING'").withColumn(
        "val", F.when(F.col("category") == "MACHINERY", F.col("val") + 1).otherwise(F.col("val"))
    )
    new = rows.filter("category = 'AUTOMOBILE'").withColumn("pt_id", F.col("pt_id") + 100000000)
    return versions.diff(rows, kept.unionByName(new), "pt_id")


@query("o15_diff_appended", f"SELECT pt_id, 'added' AS change FROM geo_points WHERE {VERSION_OF} IN (3, 4)")
def diff_appended(spark, sf_dir):
    history = _history(spark, sf_dir)
    before, after = (versions.as_of(history, n).select("pt_id", "category", "val") for n in (2, 4))
    return versions.diff(before, after, "pt_id")


@query("o16_export_geojson", "SELECT pt_id, 'Feature' AS type, 'Point' AS kind, lon AS x, lat AS y, category FROM geo_points WHERE val > 0")
def export_geojson(spark, sf_dir):
    """The exported lines, read back as JSON."""
    path = fresh_path(spark, "export-geojson")
    export.write_geojson(
        layers.points(spark, sf_dir), path, "points", columns=["pt_id", "category"], where=F.col("val") > 0, limit=None
    )
    schema = (
        "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<pt_id:long,category:string>"
    )
    lines = spark.read.text(path).select(F.from_json("value", schema).alias("f"))
    return lines.select(
        "f.properties.pt_id",
        "f.type",
        F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates")[0].alias("x"),
        F.col("f.geometry.coordinates")[1].alias("y"),
        "f.properties.category",
    )


@query(
    "o16_export_summary",
    "SELECT 'points' AS source_table, count(*) AS feature_count, false AS truncated FROM geo_points",
)
def export_summary(spark, sf_dir):
    return export.write_geojson(layers.points(spark, sf_dir), fresh_path(spark, "export-all"), "points")


QUOTED_TEXT = """CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10))
    THEN concat('"', replace(text, '"', '""'), '"') ELSE text END"""


@query("o17_export_csv_text", f"SELECT concat_ws(',', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, {QUOTED_TEXT}) AS line FROM conversations")
def export_csv_text(spark, sf_dir):
    return export.csv_lines(Layer(layers.table(spark, sf_dir, "conversations"), "conv_id"), ["conv_id", "turn", "role", "text"])


@query(
    "o17_export_csv",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type,
    CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE printf('%.4f', value) END AS value FROM events""",
)
def export_csv(spark, sf_dir):
    """The written files, read back as text columns."""
    path = fresh_path(spark, "export-csv")
    events = Layer(layers.table(spark, sf_dir, "events"), "event_id")
    export.write_csv(events, path, ["event_id", "ts", "event_type", "value"], order_by=[F.col("ts").asc_nulls_last()])
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("o19_write_geoparquet", "SELECT pt_id, 21 AS bytes, 1 AS type_code, round(lon, 9) AS x, round(lat, 9) AS y FROM geo_points")
def write_geoparquet(spark, sf_dir):
    path = fresh_path(spark, "points-geoparquet")
    points = layers.points(spark, sf_dir)
    export.write_geoparquet(points.with_df(points.df.select("pt_id", GEOM, *BOX)), path)
    stored = spark.read.parquet(path)
    decoded = stored.withColumn("g", codec.from_wkb(F.col("geometry")))
    spot = F.col("g.parts")[0][0][0]
    return decoded.select(
        "pt_id",
        F.octet_length("geometry").cast("long").alias("bytes"),
        codec.type_code(F.col("geometry")).alias("type_code"),
        F.round(spot["x"], 9).alias("x"),
        F.round(spot["y"], 9).alias("y"),
    )


@query(
    "o19_geoparquet_footers",
    """SELECT 'shape' AS primary_column, 'Polygon' AS kinds, count(*) AS n_rows, round(min(least(x1,x4)), 9) AS xmin, round(min(least(y1,y2)), 9) AS ymin,
    round(max(greatest(x2,x3)), 9) AS xmax, round(max(greatest(y3,y4)), 9) AS ymax FROM geo_parcels""",
)
def geoparquet_footers(spark, sf_dir):
    path = fresh_path(spark, "parcels-footers")
    export.write_geoparquet(layers.parcels(spark, sf_dir), path, "shape")
    found = geoparquet.footers(spark, path).groupBy("primary_column", F.concat_ws(",", "kinds").alias("kinds"))
    lows = [F.round(F.min(c), 9).alias(c) for c in BOX[:2]]
    return found.agg(F.sum("n_rows").alias("n_rows"), *lows, *[F.round(F.max(c), 9).alias(c) for c in BOX[2:]])


@query(
    "o20_esri_features",
    """SELECT parcel_id, 1 AS rings, 5 AS n_points, round(x2, 9) AS second_x, round(y2, 9) AS second_y, parcel_type FROM geo_parcels""",
)
def esri_features(spark, sf_dir):
    features = export.esri_features(layers.parcels(spark, sf_dir))
    shape = F.from_json("geometry", "rings array<array<array<double>>>")
    read = features.select("parcel_id", shape.alias("g"), F.get_json_object("attributes", "$.parcel_type").alias("parcel_type"))
    return read.select(
        "parcel_id",
        F.size("g.rings").cast("long").alias("rings"),
        F.size(F.col("g.rings")[0]).cast("long").alias("n_points"),
        F.round(F.col("g.rings")[0][1][0], 9).alias("second_x"),
        F.round(F.col("g.rings")[0][1][1], 9).alias("second_y"),
        "parcel_type",
    )


@query("o20_esri_points", "SELECT pt_id, lon AS x, lat AS y FROM geo_points")
def esri_points(spark, sf_dir):
    features = export.esri_features(layers.points(spark, sf_dir))
    spot = F.from_json("geometry", "x double, y double")
    return features.select("pt_id", spot["x"].alias("x"), spot["y"].alias("y"))


def _quantized_sql() -> str:
    grid = ", ".join(
        f"CAST(round_even((x{i} - tx)/sx, 0) AS BIGINT) AS qx{i}, CAST(round_even((y{i} - ty)/sy, 0) AS BIGINT) AS qy{i}"
        for i in (1, 2, 3, 4)
    )
    order = (1, 2, 3, 4, 1)
    steps = ["qx1 AS c0", "qy1 AS c1"]
    for k, (a, b) in enumerate(zip(order, order[1:]), start=1):
        steps += [f"qx{b} - qx{a} AS c{2 * k}", f"qy{b} - qy{a} AS c{2 * k + 1}"]
    return f"""WITH frame AS (SELECT min(least(x1,x4)) AS tx, min(least(y1,y2)) AS ty,
      (max(greatest(x2,x3)) - min(least(x1,x4)))/1e8 AS sx, (max(greatest(y3,y4)) - min(least(y1,y2)))/1e8 AS sy FROM geo_parcels),
    grid AS (SELECT parcel_id, {grid} FROM geo_parcels CROSS JOIN frame) SELECT parcel_id, 5 AS ring_length, {", ".join(steps)} FROM grid"""


@query("o21_quantize", _quantized_sql())
def quantize(spark, sf_dir):
    quantized = export.quantize_layer(layers.parcels(spark, sf_dir))
    return quantized.select(
        "parcel_id",
        F.col("lengths")[0].cast("long").alias("ring_length"),
        *[F.col("coords")[i].alias(f"c{i}") for i in range(10)],
    )


@query("o21_quantize_round_trip", "SELECT parcel_id, 0 AS position, round(x1, 6) AS x, round(y1, 6) AS y FROM geo_parcels UNION ALL SELECT parcel_id, 2, round(x3, 6), round(y3, 6) FROM geo_parcels")
def quantize_round_trip(spark, sf_dir):
    restored = export.dequantize(export.quantize_layer(layers.parcels(spark, sf_dir)), "parcel_id")
    corners = restored.filter(F.col("position").isin(0, 2))
    return corners.select("parcel_id", F.col("position").cast("long").alias("position"), rounded("x", 6), rounded("y", 6))


def _tables(spark, sf_dir, names=layers.TABLES):
    return {f"shop.{n}": layers.table(spark, sf_dir, n) for n in names}


WIDTHS = {"region": 2, "nation": 3, "customer": 5, "part": 6, "orders": 6, "lineitem": 11, "events": 6}


@query(
    "o22_inventory",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {w} AS column_count, count(*) AS row_count FROM {t}" for t, w in WIDTHS.items()
    ),
)
def inventory(spark, sf_dir):
    tables = _tables(spark, sf_dir, WIDTHS)
    listed = catalog.list_tables(catalog.inventory_of(tables, spark))
    counted = listed.join(catalog.row_counts(tables), ["namespace", "table_name"])
    return counted.select("table_name", "column_count", "row_count")


DESCRIBED = {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR", "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR"}


@query(
    "o23_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, false AS is_geometry, count(*) - count({c}) AS null_count FROM orders"
        for c, t in DESCRIBED.items()
    ),
)
def describe(spark, sf_dir):
    tables = _tables(spark, sf_dir, ["orders"])
    described = catalog.describe(catalog.inventory_of(tables, spark), "shop", "orders")
    nulls = ingest.preview(tables["shop.orders"])[1].select("column_name", "null_count")
    return described.join(nulls, "column_name").select("column_name", "data_type", "is_geometry", "null_count")


@query(
    "o24_search",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("customer", "supplier", "orders", "nation")),
)
def search(spark, sf_dir):
    tables = _tables(spark, sf_dir, ["region", "nation", "customer", "supplier", "part", "orders", "events"])
    inv = catalog.inventory_of(tables, spark)
    by_column = catalog.search(inv, column_pattern="CUSTKEY").unionByName(catalog.search(inv, column_pattern="s_N"))
    by_name = catalog.search(inv, pattern="Tion")
    found = by_column.unionByName(by_name).select("namespace", "table_name").distinct()
    return found.join(catalog.row_counts(tables), ["namespace", "table_name"]).select("table_name", "row_count")


@query(
    "o25_inventory_delta",
    """SELECT 'lineitem' AS table_name, 'added' AS change, count(*) AS row_count FROM lineitem
    UNION ALL SELECT 'customer', 'removed', count(*) FROM customer""",
)
def inventory_delta(spark, sf_dir):
    tables = _tables(spark, sf_dir, ["customer", "orders", "lineitem"])
    before = catalog.inventory_of({k: v for k, v in tables.items() if "lineitem" not in k}, spark)
    after = catalog.inventory_of({k: v for k, v in tables.items() if "customer" not in k}, spark)
    delta = catalog.inventory_delta(before, after)
    return delta.join(catalog.row_counts(tables), ["namespace", "table_name"]).select("table_name", "change", "row_count")


@query(
    "union_of_counts",
    "SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
)
def union_of_counts(spark, sf_dir):
    counts = catalog.row_counts(_tables(spark, sf_dir, ["customer", "orders", "lineitem"]))
    return counts.select("table_name", F.col("row_count").alias("n"))


@query(
    "multi_table_query",
    """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS spent, count(*) AS n FROM orders GROUP BY o_custkey),
    ranked AS (SELECT c.c_mktsegment AS segment, c.c_custkey AS customer, s.n,
      row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY s.spent DESC, c.c_custkey) AS place
      FROM customer c JOIN spend s ON s.o_custkey = c.c_custkey)
    SELECT segment, customer, n, place FROM ranked WHERE place <= 5""",
)
def multi_table_query(spark, sf_dir):
    from pyspark.sql import Window

    orders, customers = layers.table(spark, sf_dir, "orders"), layers.table(spark, sf_dir, "customer")
    spend = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("n"))
    best = Window.partitionBy("c_mktsegment").orderBy(F.col("spent").desc(), "c_custkey")
    ranked = customers.join(spend, F.col("c_custkey") == F.col("o_custkey")).withColumn("place", F.row_number().over(best))
    return ranked.filter("place <= 5").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("customer"), "n", F.col("place").cast("long").alias("place")
    )


# The oracle engine's regular expressions know only ASCII words; for it, letters beyond ASCII are
# replaced by one that occurs in no rule, which leaves every match and word boundary as it was.
ASCII_TEXT = "regexp_replace(text, '[À-ÖØ-öø-ɏͰ-ϿЀ-ӿ]', 'q', 'g')"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches_sql(pattern: str, on: str = "t") -> str:
    return f"regexp_matches({on}, {_sql_text(pattern)})"


INTENT_SQL = f"""CASE WHEN {_matches_sql(textlog.META)} THEN 'meta' WHEN {_matches_sql(textlog.SPATIAL)} THEN 'spatial'
    WHEN {_matches_sql("(?i)" + textlog.GREETING_PATTERN, "s")} THEN 'conversational'
    WHEN {_matches_sql("(?i)" + textlog.HELP_PATTERN, "s")} THEN 'conversational'
    WHEN len(string_split_regex(s, '\\s+')) < 4 AND NOT {_matches_sql(textlog.DATA_TERM, "lower(t)")} THEN 'conversational'
    ELSE 'analytics' END"""
LOG_SQL = f"SELECT *, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT conv_id, turn, role, {ASCII_TEXT} AS t FROM conversations) a"


@query("o81_triage", f"WITH log AS ({LOG_SQL}) SELECT conv_id, turn, role, {INTENT_SQL} AS intent FROM log")
def triage(spark, sf_dir):
    return textlog.triage(layers.table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "role", "intent")


@query(
    "o81_triage_documents",
    f"""WITH log AS (SELECT *, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT lang, {ASCII_TEXT} AS t FROM documents) a)
    SELECT lang, {INTENT_SQL} AS intent, count(*) AS n FROM log GROUP BY 1, 2""",
)
def triage_documents(spark, sf_dir):
    labelled = textlog.triage(layers.table(spark, sf_dir, "documents"), "text")
    return labelled.groupBy("lang", "intent").agg(F.count("*").alias("n"))


QUESTIONS = """SELECT o_orderkey AS id, concat(CASE o_orderkey % 8 WHEN 0 THEN 'Show the first ' WHEN 1 THEN 'Preview '
      WHEN 2 THEN 'What did the orders table look like on ' WHEN 3 THEN 'Show orders at snapshot '
      WHEN 4 THEN 'How far is customer ' WHEN 5 THEN 'Describe the schema of customer number ' WHEN 6 THEN 'total revenue of client no. '
      ELSE 'Export the parcels as geojson, batch ' END,
    CASE WHEN o_orderkey % 8 = 2 AND o_orderstatus = 'F' THEN concat('March ', CAST(1 + o_orderkey % 28 AS VARCHAR(9)), ', ', CAST(1990 + o_custkey % 40 AS VARCHAR(9)))
      WHEN o_orderkey % 8 = 2 THEN concat(CAST(1990 + o_custkey % 40 AS VARCHAR(9)), '-0', CAST(1 + o_orderkey % 9 AS VARCHAR(9)), '-1', CAST(o_custkey % 10 AS VARCHAR(9)))
      ELSE CAST(o_custkey % 130 AS VARCHAR(9)) END, CASE WHEN o_orderkey % 8 < 2 THEN ' rows of orders' ELSE '' END) AS question FROM orders"""


def _questions(spark, sf_dir):
    return spark.sql(QUESTIONS.replace("FROM orders", "FROM {orders}"), orders=layers.table(spark, sf_dir, "orders"))


@query(
    "o81_extract",
    f"""WITH log AS (SELECT *, question AS t, question AS s FROM ({QUESTIONS}) a)
    SELECT id, {INTENT_SQL} AS intent,
      CASE WHEN regexp_matches(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN concat(regexp_extract(t, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ' 00:00:00')
        WHEN regexp_matches(t, 'March \\d+, \\d{{4}}') THEN concat(regexp_extract(t, 'March (\\d+), (\\d{{4}})', 2), '-03-',
          lpad(regexp_extract(t, 'March (\\d+), (\\d{{4}})', 1), 2, '0'), ' 00:00:00') END AS asked_date,
      TRY_CAST(nullif(regexp_extract(t, 'snapshot (\\d+)', 1), '') AS BIGINT) AS snapshot_id,
      CASE WHEN regexp_matches(t, '\\d+ rows') THEN greatest(1, least(100, CAST(regexp_extract(t, '(\\d+) rows', 1) AS BIGINT))) END AS sample_n FROM log""",
)
def extract(spark, sf_dir):
    labelled = textlog.triage(_questions(spark, sf_dir), "question")
    return labelled.select("id", "intent", "asked_date", "snapshot_id", F.col("sample_n").cast("long").alias("sample_n"))


KNOWN = ["shop.orders", "shop.customer", "shop.parcels", "town.buildings"]


@query(
    "o82_route",
    f"""WITH log AS (SELECT *, id % 8 AS form FROM ({QUESTIONS}) a)
    SELECT CASE form WHEN 0 THEN 'sample_data' WHEN 1 THEN 'sample_data' WHEN 2 THEN 'time_travel_query'
      WHEN 3 THEN 'time_travel_query' WHEN 5 THEN 'describe_table' WHEN 7 THEN 'export_geojson' END AS operator,
      CASE WHEN form IN (0, 1, 2, 3) THEN 'shop.orders' WHEN form = 5 THEN 'shop.customer' WHEN form = 7 THEN 'shop.parcels' END AS target,
      count(*) AS n FROM log GROUP BY 1, 2""",
)
def route(spark, sf_dir):
    routed = textlog.route(_questions(spark, sf_dir), "question", KNOWN)
    return routed.groupBy("operator", "target").agg(F.count("*").alias("n"))


def _route_sql(source: str) -> str:
    """The free-standing rules (those that need no parameter) over real text."""
    return f"""CASE WHEN {_matches_sql("(?i)" + textlog.RULES[0].pattern)} THEN 'list_namespaces'
      WHEN {_matches_sql("(?i)" + textlog.RULES[1].pattern)} THEN 'search_geometry_tables'
      WHEN {_matches_sql("(?i)" + textlog.RULES[-1].pattern)} THEN 'list_tables' END"""


@query(
    "o82_route_log",
    f"WITH log AS ({LOG_SQL}) SELECT role, {_route_sql('log')} AS operator, count(*) AS n FROM log GROUP BY 1, 2",
)
def route_log(spark, sf_dir):
    free = (textlog.RULES[0], textlog.RULES[1], textlog.RULES[-1])
    routed = textlog.route(layers.table(spark, sf_dir, "conversations"), "text", KNOWN, rules=free)
    return routed.groupBy("role", "operator").agg(F.count("*").alias("n"))


# Windows of a day that start every half day, on the epoch grid.
SLIDING_SQL = """SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (
      SELECT *, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start FROM events
      UNION ALL SELECT *, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOURS FROM events) w
    GROUP BY window_start, event_type"""



def _aggregates():
    return {"n": F.count("*"), "total": F.sum("value")}


@query("o83_sliding_windows", SLIDING_SQL)
def sliding_windows(spark, sf_dir):
    events = layers.table(spark, sf_dir, "events")
    found = timeline.sliding_windows(events, "ts", "day", _aggregates(), ["event_type"])
    return found.withColumn("total", F.round("total", 2))


@query(
    "o83_default_window",
    """WITH axis AS (SELECT epoch(max(ts) - min(ts)) AS seconds, count(DISTINCT ts) AS n FROM events)
    SELECT CASE WHEN seconds <= 3600 THEN 'hour' WHEN seconds <= 86400 THEN 'day' WHEN seconds <= 604800 THEN 'week'
      WHEN seconds <= 2592000 THEN 'month' ELSE 'year' END AS preset, round(least(greatest(seconds/least(n, 200), 60), seconds), 3) AS step_seconds,
      (SELECT count(*) FROM events) AS events FROM axis""",
)
def default_window(spark, sf_dir):
    events = layers.table(spark, sf_dir, "events")
    axis = timeline.time_axis(events, "ts")
    return events.agg(F.count("*").alias("events")).select(
        F.lit(axis.window).alias("preset"), F.lit(round(axis.step_seconds, 3)).alias("step_seconds"), "events"
    )


def _event_stream(spark, sf_dir):
    schema = layers.table(spark, sf_dir, "events").schema
    return jobs.file_stream(spark, f"{sf_dir}/events*.parquet", schema, event_time="ts")


def _wall_windows(found):
    return found.withColumns(
        {
            "window_start": jobs.wall_time("window_start"),
            "window_end": jobs.wall_time("window_end"),
            "total": F.round("total", 2),
        }
    )


@query("o83_sliding_stream", SLIDING_SQL)
def sliding_stream(spark, sf_dir):
    out = fresh_path(spark, "sliding")
    stream = jobs.sliding_stream(_event_stream(spark, sf_dir), "ts", "day", _aggregates(), "2 days", ["event_type"])
    jobs.run_updates(stream, out, fresh_path(spark, "sliding-checkpoint"))
    found = jobs.latest(spark, out, ["window_start", "window_end", "event_type"])
    return _wall_windows(found)


@query("o84_ingest_stream", "SELECT 'point' AS family, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def ingest_stream(spark, sf_dir):
    root = fresh_path(spark, "ingested")
    jobs.ingest_stream(_event_stream(spark, sf_dir), layers.event_layer, root, fresh_path(spark, "ingest-checkpoint"))
    rows = jobs.ingested(spark, root)
    return rows.groupBy("family", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


ZONE_WINDOWS_SQL = """SELECT z.zone_id, time_bucket(INTERVAL 1 DAY, e.ts, TIMESTAMP '1970-01-01') AS window_start,
      time_bucket(INTERVAL 1 DAY, e.ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end, count(*) AS n, round(sum(e.value), 2) AS total
    FROM geo_events e JOIN geo_zones z ON e.lon > z.xmin AND e.lon < z.xmax AND e.lat > z.ymin AND e.lat < z.ymax GROUP BY 1, 2, 3"""


@query("o85_zone_counts", ZONE_WINDOWS_SQL)
def zone_counts(spark, sf_dir):
    found = timeline.zone_counts_by_window(
        layers.events(spark, sf_dir), layers.zones(spark, sf_dir), "ts", "day", "value"
    )
    return found.withColumn("total", F.round("total", 2))


@query("o85_zone_counts_stream", ZONE_WINDOWS_SQL)
def zone_counts_stream(spark, sf_dir):
    out = fresh_path(spark, "zone-counts")
    events = layers.event_layer(_event_stream(spark, sf_dir))
    stream = jobs.live_zone_counts(events, layers.zones(spark, sf_dir), "ts", "day", "value", "2 days")
    jobs.run_updates(stream, out, fresh_path(spark, "zone-counts-checkpoint"))
    return _wall_windows(jobs.latest(spark, out, ["zone_id", "window_start", "window_end"]))


GEOFENCE_SQL = """WITH placed AS (SELECT e.user_id, e.ts, e.event_id, z.zone_id AS zone FROM geo_events e LEFT JOIN geo_zones z
      ON e.lon > z.xmin AND e.lon < z.xmax AND e.lat > z.ymin AND e.lat < z.ymax),
    moved AS (SELECT *, lag(zone) OVER w AS before, row_number() OVER w AS k FROM placed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, ts, event_id, before AS left_zone, zone AS entered_zone FROM moved WHERE zone IS DISTINCT FROM before"""


@query("o86_geofence", GEOFENCE_SQL)
def geofence(spark, sf_dir):
    visits = timeline.with_zone(layers.events(spark, sf_dir), layers.zones(spark, sf_dir), ["user_id", "ts"])
    return timeline.geofence_events(visits, "user_id", "ts", "event_id")


@query("o86_geofence_stream", GEOFENCE_SQL)
def geofence_stream(spark, sf_dir):
    out = fresh_path(spark, "geofence")
    events = layers.event_layer(_event_stream(spark, sf_dir))
    visits = timeline.with_zone_column(events, layers.zones(spark, sf_dir), ["user_id", "ts"])
    notices = jobs.geofence_stream(visits, "user_id", "ts", "event_id", watermark="2 days")
    jobs.run_appends(notices, out, fresh_path(spark, "geofence-checkpoint"))
    return spark.read.parquet(out).select(
        F.col("key").alias("user_id"),
        jobs.wall_time("ts").alias("ts"),
        F.col("id").alias("event_id"),
        "left_zone",
        "entered_zone",
    )
