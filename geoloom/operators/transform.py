"""Geometry columns computed over a layer: measures, simplification, buffers, dissolve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import coords, kernels, shapes
from geoloom.layer import BOX, GEOM, GEOMETRY, Layer, geometry, point_layer, with_box
from geoloom.operators.filters import simplify_tolerance
from geoloom.operators.joins import box_pairs, spatial_pairs
from geoloom.operators.rings import polygons
from geoloom.sources.place import written

# A buffer's circle has this many segments per quadrant.
QUADRANT_SEGMENTS = 8

# Rows whose buffers are outlined at once, by arrays that fit a processor's cache.
GROWN_ROWS = 200

# geodesic_measures cuts vertex sequences into runs of this length.
RUN = 4096


def measure_layer(layer: Layer) -> DataFrame:
    """Attributes plus kind, area, length, centroid, envelope corners and vertex count."""
    rows = layer.df.withColumn("_m", kernels.measure(F.col(GEOM)))
    return rows.select(
        *layer.attributes,
        F.col(f"{GEOM}.kind").alias("kind"),
        "_m.area",
        "_m.length",
        F.col("_m.x").alias("centroid_x"),
        F.col("_m.y").alias("centroid_y"),
        *BOX,
        shapes.n_points(F.col(GEOM)).cast("long").alias("n_points"),
    )


def to_mercator(layer: Layer) -> Layer:
    rows = with_box(layer.df.withColumn(GEOM, shapes.to_mercator(F.col(GEOM))))
    return layer.with_df(rows, srid=3857)


def to_lonlat(layer: Layer) -> Layer:
    rows = with_box(layer.df.withColumn(GEOM, shapes.to_lonlat(F.col(GEOM))))
    return layer.with_df(rows, srid=4326)


def explode_parts(layer: Layer) -> Layer:
    """One row per part of a multi-geometry; single geometries stay as they are."""
    single = F.regexp_replace(F.col(f"{GEOM}.kind"), "^Multi", "")
    rows = layer.df.withColumns({"_kind": single, "_part": F.explode(F.col(f"{GEOM}.parts"))})
    rows = rows.withColumn(GEOM, geometry(F.col("_kind"), F.array(F.col("_part"))))
    return layer.with_df(with_box(rows.drop("_part", "_kind")))


def flatten_structs(df: DataFrame, keep: tuple[str, ...] = (GEOM,)) -> DataFrame:
    """Replace each struct column by its fields (one level)."""
    columns, names = [], []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType) and field.name not in keep:
            for child in field.dataType.fieldNames():
                columns.append(F.col(f"`{field.name}`.`{child}`").alias(child))
                names.append(child)
        else:
            columns.append(F.col(f"`{field.name}`"))
            names.append(field.name)
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"flattening repeats column names: {', '.join(repeated)}")
    return df.select(*columns)


def simplify_layer(layer: Layer, zooms: list[int]) -> DataFrame:
    """Overview pyramid: each feature once per zoom, simplified to that zoom's pixel."""
    levels = F.array(
        *[F.struct(F.lit(z).alias("zoom"), F.lit(float(simplify_tolerance(z))).alias("tolerance")) for z in zooms]
    )
    rows = layer.df.withColumn("_level", F.explode(levels)).select("*", "_level.*").drop("_level")
    return rows.withColumn(GEOM, kernels.simplify(F.col(GEOM), F.col("tolerance")))


def simplify(layer: Layer, tolerance: float) -> Layer:
    return layer.with_df(layer.df.withColumn(GEOM, kernels.simplify(F.col(GEOM), F.lit(float(tolerance)))))


def buffer_layer(layer: Layer, metres: float) -> Layer:
    """Grow every feature by a Web-Mercator distance. Points become 32-gons as expressions; lines
    and polygons are outlined per feature in Arrow batches, in degrees of the Mercator plane: in metres
    the last digit of a coordinate is larger than the kernels' tolerances.
    """
    if metres <= 0:
        raise ValueError("distance must be positive")
    if layer.family == "point":
        circle = shapes.mercator_circle(F.col("xmin"), F.col("ymin"), metres, 4 * QUADRANT_SEGMENTS)
        rows = layer.df.withColumn(GEOM, circle)
    else:
        distance = F.lit(metres * coords.DEGREES_PER_MERCATOR_M)
        rows = layer.df.withColumn(GEOM, shapes.from_mercator_degrees(_grow(shapes.to_mercator_degrees(F.col(GEOM)), distance)))
    return layer.with_df(with_box(rows), family="polygon", boxes=False)


@F.arrow_udf(GEOMETRY)
def _grow(geom: pa.Array, distance: pa.Array) -> pa.Array:
    """Union of a capsule around every edge and, for polygons, the polygon itself; few rows at a time, since every edge of a
    capsule is held once per capsule near it."""
    limits = distance.to_numpy(zero_copy_only=False)
    blocks = [np.arange(at, min(at + GROWN_ROWS, len(geom))) for at in range(0, max(len(geom), 1), GROWN_ROWS)]
    return pa.concat_arrays([_grown(geom.take(pa.array(rows)), limits[rows]) for rows in blocks])


def _grown(geom: pa.Array, limits: np.ndarray) -> pa.Array:
    edges = kernels.edges_of(geom)
    regions, row = kernels.capsules(edges, limits[edges.owner], 4 * QUADRANT_SEGMENTS)
    filled = np.flatnonzero((edges.dimension == 2) & (edges.count > 0))
    regions = pa.concat_arrays([regions, geom.take(pa.array(filled)).cast(kernels.GEOMETRY_ARROW)])
    row = np.concatenate([row, filled])
    order = np.argsort(row, kind="stable")
    grown, present = kernels.unite(regions.take(pa.array(order)), row[order])
    place = np.full(len(geom), -1)
    place[present] = np.arange(len(present))
    return grown.take(pa.array(place, mask=place < 0))


# Sub-groups per tile between the batch unions and the tile's union.
FAN_IN = 64
REGION = T.StructType(
    [T.StructField("_tile", T.LongType()), T.StructField("_share", T.IntegerType()), T.StructField(GEOM, GEOMETRY)]
)


def tile_unions(layer: Layer) -> Layer:
    """Unite the polygons of each grid tile (the tile, on the level of its own extent, that holds a
    polygon's centre).

    Unions of unions are unions: every Arrow batch first unites what it holds of a tile, then
    ``FAN_IN`` sub-groups per tile do, so no task needs a whole tile. Equal polygons count once.
    """
    tile = F.expr(coords.point_cell(f"({coords.level_of_box()})", *coords.CENTRE))
    share = F.pmod(F.xxhash64(GEOM), F.lit(FAN_IN)).cast("int")
    # Few bytes but much arithmetic: the number of partitions must not follow the bytes.
    partitions = int(layer.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = layer.df.select(tile.alias("_tile"), share.alias("_share"), GEOM)
    rows = rows.repartition(partitions, "_tile", GEOM).dropDuplicates(["_tile", GEOM])
    rows = rows.mapInArrow(_unite_tiles, REGION)
    for keys in (["_tile", "_share"], ["_tile"]):
        rows = rows.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(_unite_tiles, REGION)
    return Layer(with_box(rows.drop("_share")), "_tile", "polygon")


def _unite_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite equal tiles of each batch; when tiles arrive sorted, also across batches, by holding
    the last tile's union back until the next batch.
    """
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        order = np.argsort(table["_tile"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        tiles = table["_tile"].to_numpy()
        dtype = table.schema.field(GEOM).type
        merged, tiles = kernels.unite(table[GEOM].combine_chunks().cast(kernels.GEOMETRY_ARROW), tiles)
        shares = table["_share"].to_numpy()[np.searchsorted(table["_tile"].to_numpy(), tiles)]
        united = pa.Table.from_arrays([pa.array(tiles), pa.array(shares), merged.cast(dtype)], schema=table.schema)
        yield from united.slice(0, united.num_rows - 1).to_batches()
        held = united.slice(united.num_rows - 1)
    if held is not None:
        yield from held.to_batches()


def dissolve_pieces(layer: Layer, **options) -> DataFrame:
    """Boundary of the union of all polygons as directed pieces (x1, y1, x2, y2), interior on the
    left.

    The union of a large layer is itself large, so it is a table and no single value. Polygons are
    united per tile; every edge of a tile's union then meets the other tiles' unions through the
    spatial join and loses the stretches they cover.
    """
    # The unions are read by several steps: write them once.
    tiles = Layer(written(tile_unions(layer).df, "tile-unions"), "_tile", "polygon")
    rings = F.transform(
        F.flatten(F.transform(F.col(f"{GEOM}.parts"), _oriented_rings)), lambda ring: _ring_segments(ring)
    )
    edges = tiles.df.select(F.col("_tile"), F.posexplode(F.flatten(rings)).alias("_at", "_e"))
    ends = [F.col(f"_e.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    edges = edges.select(F.struct("_tile", "_at").alias("_edge"), *ends)
    path = F.array(
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    )
    segments = Layer(
        edges.withColumn(GEOM, geometry("LineString", F.array(F.array(path)))).withColumns(
            {
                "xmin": F.least("x1", "x2"),
                "ymin": F.least("y1", "y2"),
                "xmax": F.greatest("x1", "x2"),
                "ymax": F.greatest("y1", "y2"),
            }
        ),
        "_edge",
        "line",
    )
    met = box_pairs(segments, tiles, left_columns=["x1", "y1", "x2", "y2"], right_columns=[], **options)
    met = met.filter(F.col("l__edge._tile") != F.col("r__tile"))
    cover = kernels.covered_intervals(
        F.col("l__geom"), F.col("r__geom"), F.col("r__tile") < F.col("l__edge._tile")
    )
    covered = met.select(
        F.col("l__edge").alias("_edge"), *[F.col(f"l_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], F.explode(cover).alias("_c")
    ).select("_edge", "x1", "y1", "x2", "y2", "_c.t0", "_c.t1")
    # A mark at the end of every edge turns the uncovered tail into one more gap.
    marks = edges.select("*", F.lit(1.0).alias("t0"), F.lit(1.0).alias("t1"))
    along = Window.partitionBy("_edge").orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1)
    gaps = (
        covered.unionByName(marks)
        .withColumn("_from", F.coalesce(F.max("t1").over(along), F.lit(0.0)))
        .filter(F.col("t0") - F.col("_from") > F.lit(1e-9))
    )

    def along_edge(t, a, b):
        return F.when(t == 0.0, a).when(t == 1.0, b).otherwise(a + (b - a) * t)

    return gaps.select(
        along_edge(F.col("_from"), F.col("x1"), F.col("x2")).alias("x1"),
        along_edge(F.col("_from"), F.col("y1"), F.col("y2")).alias("y1"),
        along_edge(F.col("t0"), F.col("x1"), F.col("x2")).alias("x2"),
        along_edge(F.col("t0"), F.col("y1"), F.col("y2")).alias("y2"),
    )


def dissolve_parts(layer: Layer, **options) -> Layer:
    """The union of a polygon layer as geometry: one row per connected part with its rings (part, part_area, boundary_length,
    n_vertices, n_holes, geom) and the number of features it unites, ``feature_count``.

    Parts that share single points only are parts of their own. A feature belongs to the part on or in which the middle of its first
    edge lies. Areas are in degrees squared; features without a ring are in no part.
    """
    parts = polygons(written(dissolve_pieces(layer, **options), "pieces"), **options)
    parts = parts.with_df(written(parts.df, "parts"))
    ring = F.col(f"{GEOM}.parts")[0][0]
    spots = layer.df.where(F.size(ring) > 1).select(layer.id, *[((ring[0][c] + ring[1][c]) / 2).alias(c) for c in ("x", "y")])
    members = spatial_pairs(point_layer(spots, layer.id, "x", "y"), parts, "intersects", left_columns=[], right_columns=[], **options)
    owner = members.groupBy(f"l_{layer.id}").agg(F.min("r_part").alias("part"))
    counts = owner.groupBy("part").agg(F.count("*").alias("feature_count"), F.min(f"l_{layer.id}").alias("first_feature"))
    rows = parts.df.join(counts, "part", "left").withColumn("feature_count", F.coalesce("feature_count", F.lit(0)))
    return parts.with_df(rows)


def _oriented_rings(part: Column) -> Column:
    """Shell counter-clockwise, holes clockwise."""
    return F.transform(
        part, lambda ring, i: F.when((shapes.ring_signed_area(ring) > 0) == (i == 0), ring).otherwise(F.reverse(ring))
    )


def _ring_segments(ring: Column) -> Column:
    ends = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    starts = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def dissolve(layer: Layer, **options) -> DataFrame:
    """One row for the union of a polygon layer: features, area (degrees squared), boundary length."""
    pieces = dissolve_pieces(layer, **options)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    bounded = pieces.agg(
        F.coalesce(F.sum((x1 * y2 - x2 * y1) / 2), F.lit(0.0)).alias("area"),
        F.coalesce(F.sum(coords.planar(x2 - x1, y2 - y1)), F.lit(0.0)).alias("boundary_length"),
        F.count("*").alias("piece_count"),
    )
    counted = layer.df.agg(F.count("*").alias("feature_count"))
    # Two one-row tables side by side.
    one = F.lit(1).alias("_one")
    return counted.select("*", one).join(F.broadcast(bounded.select("*", one)), "_one").drop("_one")


def geodesic_measures(vertices: DataFrame, id: str, seq: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Great-circle length and spherical polygon area of vertex sequences numbered 1, 2, 3, ...

    Sequences are cut into runs that share their end vertices, so a sequence that holds a third
    of all vertices is many window groups, not one.
    """
    run = F.floor((F.col(seq) - 1) / RUN).cast("long")
    shares_vertex = (F.pmod(F.col(seq) - 1, F.lit(RUN)) == 0) & (F.col(seq) > 1)
    runs = F.when(shares_vertex, F.array(run - 1, run)).otherwise(F.array(run))
    rows = vertices.select(id, seq, F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(runs).alias("_run"))
    along = Window.partitionBy(id, "_run").orderBy(seq)
    steps = rows.withColumns({"_px": F.lag("_x").over(along), "_py": F.lag("_y").over(along)})
    step_length = coords.haversine(F.col("_px"), F.col("_py"), F.col("_x"), F.col("_y"))
    spot = F.struct("_x", "_y")
    totals = steps.groupBy(id).agg(
        F.count_if(~(shares_vertex & (F.col("_run") < run))).alias("n_vertices"),
        F.coalesce(F.sum(step_length), F.lit(0.0)).alias("length_m"),
        F.coalesce(F.sum(_sphere_term(F.col("_px"), F.col("_py"), F.col("_x"), F.col("_y"))), F.lit(0.0)).alias("_term"),
        F.min_by(spot, seq).alias("_first"),
        F.max_by(spot, seq).alias("_last"),
    )
    closing = _sphere_term(F.col("_last._x"), F.col("_last._y"), F.col("_first._x"), F.col("_first._y"))
    radius = F.lit(coords.HAVERSINE_RADIUS_M)
    return totals.select(
        id, "n_vertices", "length_m", (F.abs(F.col("_term") + closing) * radius * radius / 2).alias("area_m2")
    )


def _sphere_term(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.radians(lon2 - lon1) * (F.sin(F.radians(lat1)) + F.sin(F.radians(lat2)) + 2)
