"""Layers derived from the driver tables. The SQL is valid in Spark and in the oracle engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.layer import Layer, box_layer, line_layer, point_layer, ring_layer

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

POINTS_SQL = """
SELECT c_custkey AS pt_id, c_mktsegment AS category, c_acctbal AS val,
  -109.05e0 + (((c_custkey*7919) % 70000) + 0.5e0)/1e4 AS lon,
  37e0 + (((c_custkey*104729) % 40000) + 0.5e0)/1e4 AS lat
FROM customer"""

ZONES_SQL = """
SELECT n_nationkey AS zone_id, n_name AS zone_name, n_regionkey AS zone_class,
  -109.05e0 + 1.4e0*(n_nationkey % 5) AS xmin,
  37e0 + 0.8e0*CAST(floor(n_nationkey/5e0) AS BIGINT) AS ymin,
  -109.05e0 + 1.4e0*((n_nationkey % 5)+1) AS xmax,
  37e0 + 0.8e0*(CAST(floor(n_nationkey/5e0) AS BIGINT)+1) AS ymax
FROM nation"""

PARCELS_SQL = """
SELECT parcel_id, parcel_type, val,
  cx-dx+j1 AS x1, cy-dy+j2 AS y1, cx+dx+j3 AS x2, cy-dy+j4 AS y2,
  cx+dx+j2 AS x3, cy+dy+j1 AS y3, cx-dx+j4 AS x4, cy+dy+j3 AS y4
FROM (
  SELECT p_partkey AS parcel_id, p_type AS parcel_type, p_retailprice AS val,
    -109.04e0 + (((p_partkey*6271) % 69800)+0.25e0)/1e4 AS cx,
    37.01e0 + (((p_partkey*15485) % 39800)+0.25e0)/1e4 AS cy,
    0.004e0 + ((p_partkey*31) % 160)/1e4 AS dx, 0.004e0 + ((p_partkey*47) % 160)/1e4 AS dy,
    ((p_partkey*13) % 21 - 10)/1e4 AS j1, ((p_partkey*17) % 21 - 10)/1e4 AS j2,
    ((p_partkey*19) % 21 - 10)/1e4 AS j3, ((p_partkey*23) % 21 - 10)/1e4 AS j4
  FROM part) AS shaped"""

LINE_VERTICES_SQL = """
SELECT l_orderkey AS line_id,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
  -109e0 + ((l_orderkey*3571) % 68000)/1e4 + ((l_partkey*37) % 1000 - 500)/1e4 AS lon,
  37.06e0 + ((l_orderkey*8887) % 38000)/1e4 + ((l_suppkey*53) % 1000 - 500)/1e4 AS lat
FROM lineitem"""

EVENTS_SQL = """
SELECT event_id, ts, user_id, event_type, value,
  -109.05e0 + (((user_id*7919 + event_id*13) % 70000) + 0.5e0)/1e4 AS lon,
  37e0 + (((user_id*104729 + event_id*29) % 40000) + 0.5e0)/1e4 AS lat
FROM events"""

WITH = {
    "geo_points": POINTS_SQL,
    "geo_zones": ZONES_SQL,
    "geo_parcels": PARCELS_SQL,
    "geo_vertices": LINE_VERTICES_SQL,
    "geo_events": EVENTS_SQL,
}


def with_views(sql: str) -> str:
    """Prefix oracle SQL with the views it mentions."""
    used = [f"{name} AS ({body})" for name, body in WITH.items() if name in sql]
    sql = sql.strip()
    if not used:
        return sql
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(head):
            return head + ", ".join(used) + ", " + sql[len(head) :]
    return "WITH " + ", ".join(used) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, source: str) -> DataFrame:
    """One of the views above over its Parquet table."""
    sql = WITH[name].replace(f"FROM {source}", "FROM {source}")
    return spark.sql(sql, source=table(spark, sf_dir, source))


def points(spark: SparkSession, sf_dir: str) -> Layer:
    return point_layer(view(spark, sf_dir, "geo_points", "customer"), "pt_id")


def zones(spark: SparkSession, sf_dir: str) -> Layer:
    return box_layer(view(spark, sf_dir, "geo_zones", "nation"), "zone_id")


def parcels(spark: SparkSession, sf_dir: str) -> Layer:
    corners = [(f"x{i}", f"y{i}") for i in (1, 2, 3, 4)]
    return ring_layer(view(spark, sf_dir, "geo_parcels", "part"), "parcel_id", corners)


def line_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "geo_vertices", "lineitem")


def lines(spark: SparkSession, sf_dir: str) -> Layer:
    return line_layer(line_vertices(spark, sf_dir), "line_id", "seq")


def event_layer(df: DataFrame) -> Layer:
    """The events layer over a static or streaming events table."""
    sql = EVENTS_SQL.replace("FROM events", "FROM {events}")
    return point_layer(df.sparkSession.sql(sql, events=df), "event_id")


def events(spark: SparkSession, sf_dir: str) -> Layer:
    return event_layer(table(spark, sf_dir, "events"))
