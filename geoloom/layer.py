"""The canonical layer: attribute columns, one geometry column, and its bounding box.

A geometry is ``struct<kind string, parts array<array<array<struct<x double, y double>>>>>``:
parts (of a multi-geometry), rings (of a polygon part), vertices. Keeping coordinates as nested
arrays instead of WKB means predicates and measures are Column expressions the JVM evaluates, and
``xmin ymin xmax ymax`` are plain doubles Parquet statistics can prune on. WKB, WKT and GeoJSON
exist only at the edges (see ``geoloom.functions.codec``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PARTS = T.ArrayType(T.ArrayType(T.ArrayType(VERTEX)))
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", PARTS)])

GEOM = "geom"
BOX = ["xmin", "ymin", "xmax", "ymax"]

# Column names that mark a geometry or an id column, in order of preference.
GEOMETRY_NAMES = ("geometry", "geom", "wkb_geometry", "shape", "the_geom")
ID_NAMES = ("objectid", "id", "fid", "gid", "ogc_fid")

# Geometry kinds and their families.
KIND_FAMILY = {
    "Point": "point",
    "LineString": "line",
    "Polygon": "polygon",
    "MultiPoint": "point",
    "MultiLineString": "line",
    "MultiPolygon": "polygon",
}


@dataclass(frozen=True)
class Layer:
    """A layer DataFrame plus what the planner of a job needs to know about it.

    ``family`` is ``point`` (single points only), ``line``, ``polygon`` or ``mixed``; ``boxes``
    says every feature is an axis-aligned rectangle, so its box columns are its geometry.
    """

    df: DataFrame
    id: str
    family: str = "mixed"
    boxes: bool = False
    srid: int = 4326

    def with_df(self, df: DataFrame, **changes) -> Layer:
        return replace(self, df=df, **changes)

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.df.columns if c != GEOM and c not in BOX]


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str | Column, parts: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), parts.alias("parts"))


def vertices(geom: Column) -> Column:
    """All vertices of a geometry as one array."""
    return F.flatten(F.flatten(geom["parts"]))


def with_box(df: DataFrame, geom: str = GEOM) -> DataFrame:
    """Add the bounding box columns of ``geom``."""
    points = vertices(F.col(geom))
    xs = F.transform(points, lambda v: v["x"])
    ys = F.transform(points, lambda v: v["y"])
    return df.withColumns(
        {
            "xmin": F.array_min(xs),
            "ymin": F.array_min(ys),
            "xmax": F.array_max(xs),
            "ymax": F.array_max(ys),
        }
    )


def point_layer(df: DataFrame, id: str, x: str = "lon", y: str = "lat") -> Layer:
    """Point layer over coordinate columns, which stay as they are."""
    lon, lat = F.col(x).cast("double"), F.col(y).cast("double")
    geom = geometry("Point", F.array(F.array(F.array(vertex(lon, lat)))))
    box = dict(zip(BOX, (lon, lat, lon, lat)))
    return Layer(df.withColumns({GEOM: geom, **box}), id, "point")


def box_layer(df: DataFrame, id: str) -> Layer:
    """Layer of axis-aligned rectangles over columns ``xmin ymin xmax ymax``."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    ring = F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0))
    return Layer(
        df.withColumn(GEOM, geometry("Polygon", F.array(F.array(ring)))), id, "polygon", boxes=True
    )


def ring_layer(df: DataFrame, id: str, corners: list[tuple[str, str]]) -> Layer:
    """Layer of polygons whose corners are pairs of columns; the ring is closed here."""
    points = [vertex(F.col(x), F.col(y)) for x, y in corners]
    ring = F.array(*points, points[0])
    xs, ys = zip(*[(F.col(x), F.col(y)) for x, y in corners])
    box = dict(zip(BOX, (F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))))
    return Layer(
        df.withColumns({GEOM: geometry("Polygon", F.array(F.array(ring))), **box}), id, "polygon"
    )


def line_layer(df: DataFrame, id: str, seq: str, x: str = "lon", y: str = "lat") -> Layer:
    """One LineString per ``id`` from a vertex table; lines of a single vertex are not lines
    and are left out (``single_vertex_lines`` reports them).
    """
    lines = (
        df.groupBy(id)
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), vertex(F.col(x), F.col(y)).alias("v")))).alias("_v"),
            F.min(x).alias("xmin"),
            F.min(y).alias("ymin"),
            F.max(x).alias("xmax"),
            F.max(y).alias("ymax"),
        )
        .filter(F.size("_v") > 1)
    )
    path = F.transform(F.col("_v"), lambda e: e["v"])
    geom = geometry("LineString", F.array(F.array(path)))
    return Layer(lines.select(id, geom.alias(GEOM), *BOX), id, "line")


def single_vertex_lines(df: DataFrame, id: str) -> DataFrame:
    """The quarantine of ``line_layer``: ids with fewer than two vertices."""
    return df.groupBy(id).agg(F.count("*").alias("n_vertices")).filter(F.col("n_vertices") < 2)


def geometry_column(df: DataFrame) -> str:
    """Find the geometry column: a known name of a geometry-capable type first, then the first
    geometry-capable column, else ``geometry``.
    """
    capable = [f.name for f in df.schema.fields if is_geometry_type(f.dataType)]
    for name in capable:
        if name.lower() in GEOMETRY_NAMES:
            return name
    return capable[0] if capable else "geometry"


def is_geometry_type(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.BinaryType):
        return True
    return isinstance(dtype, T.StructType) and {"kind", "parts"} <= set(dtype.fieldNames())


def id_column(df: DataFrame) -> str:
    """Find the id column: a known name, else the first integer column, else ``objectid``."""
    for field in df.schema.fields:
        if field.name.lower() in ID_NAMES:
            return field.name
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return field.name
    return "objectid"
