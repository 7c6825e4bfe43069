"""Nearest features: to one point, and for every row of a layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import coords, kernels, shapes
from geoloom.layer import BOX, GEOM, Layer, geometry, point_layer, vertex
from geoloom.operators.joins import BROADCAST_BYTES, BYTES_PER_ROW, BYTES_PER_VERTEX, footprint, spatial_pairs
from geoloom.operators.spread import spread_join
from geoloom.sources.place import fresh_path, written

# nearest_join refines its grid until an average occupied cell holds this many features.
FEATURES_PER_CELL = 16
# A level's cell table is broadcast only up to this many rows.
BROADCAST_CELLS = 200_000


def nearest(
    layer: Layer,
    lon: float,
    lat: float,
    k: int = 5,
    max_distance: float | None = None,
    where: Column | None = None,
    metric: str = "mercator",
) -> DataFrame:
    """The k features nearest to a point, with ``distance_meters``; ties by id.

    Each task keeps its own best k rows and only those travel (``TakeOrderedAndProject``).
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = layer.df if where is None else layer.df.filter(where)
    if max_distance and max_distance > 0:
        margin = coords.search_margin(max_distance, metric) * (1 + 1e-9)
        rows = rows.filter(
            (F.col("xmin") <= lon + margin)
            & (F.col("xmax") >= lon - margin)
            & (F.col("ymin") <= lat + margin)
            & (F.col("ymax") >= lat - margin)
        )
    rows = rows.withColumn("distance_meters", distance_to(layer, lon, lat, metric))
    if max_distance and max_distance > 0:
        rows = rows.filter(F.col("distance_meters") <= F.lit(float(max_distance)))
    return rows.orderBy("distance_meters", layer.id).limit(k)


def distance_to(layer: Layer, lon: float, lat: float, metric: str = "mercator") -> Column:
    """Distance of each feature to a fixed point."""
    x, y = F.lit(float(lon)), F.lit(float(lat))
    if layer.family == "point":
        return coords.point_distance(F.col("xmin"), F.col("ymin"), x, y, metric)
    here = geometry("Point", F.array(F.array(F.array(vertex(x, y)))))
    if metric == "mercator":
        return kernels.mercator_separation(F.col(GEOM), here)
    scale = {"degrees": 1.0, "degree_m": coords.METRES_PER_DEGREE}[metric]
    return kernels.degree_separation(F.col(GEOM), here) * F.lit(scale)


def _gap(lo: Column, hi: Column, at: Column) -> Column:
    return F.greatest(lo - at, at - hi, F.lit(0.0))


def _reach(lo: Column, hi: Column, at: Column) -> Column:
    return F.greatest(F.abs(at - lo), F.abs(at - hi))


def _still_possible(reached: DataFrame, px: Column, py: Column, k: int) -> DataFrame:
    """Of the boxes (x0, y0, x1, y1, holding n features) reached by each ``_id``, those that may hold
    one of its k nearest: they begin no farther away than the distance that surely covers k.
    """
    near = coords.planar(_gap(F.col("x0"), F.col("x1"), px), _gap(F.col("y0"), F.col("y1"), py))
    far = coords.planar(_reach(F.col("x0"), F.col("x1"), px), _reach(F.col("y0"), F.col("y1"), py))
    reached = reached.withColumns({"_near": near, "_far": far})
    if k == 1:
        sure = F.min("_far").over(Window.partitionBy("_id"))
    else:
        covered = F.sum("n").over(Window.partitionBy("_id").orderBy("_far", "_here"))
        reached = reached.withColumn("_covered", covered)
        sure = F.coalesce(
            F.min(F.when(F.col("_covered") >= k, F.col("_far"))).over(Window.partitionBy("_id")),
            F.lit(float("inf")),
        )
    return reached.withColumn("_sure", sure).filter(F.col("_near") <= F.col("_sure") * (1 + 1e-12))


def _written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: a spread join reads them twice."""
    path = fresh_path(df.sparkSession, "frontier")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# The walk starts on a level whose parent has at most this many occupied cells.
ROOT_CELLS = 4


# Index of the cell one level up.
PARENT = f"CAST(floor({{}} / {coords.GRID_FACTOR}) AS BIGINT)"


def _pyramid(right: Layer, k: int) -> tuple[list[DataFrame], list[int], list[int], bool]:
    """Occupied cells per grid level with their count and the tight box of their features.

    Each coarser level is rolled up from the finer one, so the features are read once. Returns the
    tables, their levels and their row counts, from the first useful coarse level downwards, and
    whether the layer itself is small enough to broadcast.
    """
    features = right.df
    n_vertices = F.lit(1) if right.family == "point" or right.boxes else shapes.n_points(F.col(GEOM))
    # Which levels are worth walking: one pass without a shuffle. The counts only steer the walk.
    counts = features.agg(
        F.count("*").alias("rows"),
        F.sum(n_vertices).alias("vertices"),
        *[
            F.expr(f"hll_sketch_estimate(hll_sketch_agg({coords.point_cell(m, *coords.CENTRE)}, 12))").alias(
                f"level{m}"
            )
            for m in range(coords.TOP_LEVEL + 1)
        ],
    ).first()
    occupied = [counts[f"level{m}"] or 0 for m in range(coords.TOP_LEVEL + 1)]
    rows = counts["rows"] or 0
    # Start where the world is a handful of cells; stop where cells hold a handful of features.
    start = max((m for m, n in enumerate(occupied) if n > ROOT_CELLS), default=0)
    fine = [m for m, n in enumerate(occupied) if rows <= n * FEATURES_PER_CELL * max(1, k)]
    stop = min(max(fine, default=0), start)
    tight = [
        F.expr(f"{f}({c}) AS {c}") for f, c in (("sum", "n"), ("min", "x0"), ("min", "y0"), ("max", "x1"), ("max", "y1"))
    ]
    size = coords.size_of_level(stop)
    table = (
        features.selectExpr(
            f"{coords.column_index(coords.CENTRE[0], size)} AS ix",
            f"{coords.row_index(coords.CENTRE[1], size)} AS iy",
            "1 AS n",
            "xmin AS x0",
            "ymin AS y0",
            "xmax AS x1",
            "ymax AS y1",
        )
        .groupBy("ix", "iy")
        .agg(*tight)
    )
    tables = {stop: table}
    for m in range(stop + 1, start + 1):
        table = table.groupBy(F.expr(f"{PARENT.format('ix')} AS ix"), F.expr(f"{PARENT.format('iy')} AS iy")).agg(*tight)
        tables[m] = table
    chosen = list(range(start, stop - 1, -1))
    size = rows * BYTES_PER_ROW + (counts["vertices"] or 0) * BYTES_PER_VERTEX
    return [tables[m] for m in chosen], chosen, [occupied[m] for m in chosen], size <= BROADCAST_BYTES


def nearest_join(
    left: Layer,
    right: Layer,
    k: int = 1,
    metric: str = "degrees",
    left_columns: list[str] | None = None,
    right_columns: list[str] | None = None,
    rows_per_share: int | None = None,
) -> DataFrame:
    """For each left feature the k right features nearest to its centroid, ties by right id.

    Walks down a pyramid of grid cells. On each level a left row keeps the cells that could still
    hold one of its k nearest: those whose tight box starts no farther away than the distance that
    certainly covers k features. Only cells, never features, are paired until the last step, so a
    dense spot on the right costs a left row a few cells. Exact for every k and metric.

    Where polygons overlap, many cells begin at no distance at all. So rows that k polygons hold are settled first, by a join.
    """
    left_columns = left.attributes if left_columns is None else left_columns
    right_columns = right.attributes if right_columns is None else right_columns
    if left.family == "point":
        seekers = left.df.select(F.col(left.id).alias("_id"), F.col("xmin").alias("_cx"), F.col("ymin").alias("_cy"))
    else:
        measured = left.df.select(F.col(left.id).alias("_id"), kernels.measure(F.col(GEOM)).alias("_m"))
        seekers = measured.select("_id", F.col("_m.x").alias("_cx"), F.col("_m.y").alias("_cy"))
    # Distances between boxes are compared in plane coordinates of the metric.
    flat = {"mercator": (coords.mercator_x, coords.mercator_y)}.get(metric, (lambda c: c, lambda c: c))
    if metric not in ("mercator", "degrees", "degree_m"):
        raise ValueError(f"metric {metric!r} is not planar")
    px, py = flat[0](F.col("_cx")), flat[1](F.col("_cy"))

    tables, levels, occupied, small = _pyramid(right, k)
    # text and other carried columns count with their actual length
    small = small and footprint(right, columns=right_columns).bytes <= BROADCAST_BYTES
    small = small and rows_per_share is None
    options = {} if rows_per_share is None else {"rows_per_share": rows_per_share}
    held = None
    if right.family == "polygon" and (right.boxes or metric != "mercator"):  # edges that are straight in the metric's plane
        held = _held(seekers, right, k, right_columns, **options)
        settled = held.where(F.col("rank") == k).select(F.col("_id").alias("_settled"))
        seekers = seekers.join(settled.hint("merge"), F.col("_id").eqNullSafe(F.col("_settled")), "left_anti")
    frontier = None
    for table, level, n_cells in zip(tables, levels, occupied):
        parent = coords.cell_key(level + 1, PARENT.format("ix"), PARENT.format("iy"))
        cells = table.select(
            F.expr(f"{coords.cell_key(level, 'ix', 'iy')} AS _here"),
            F.expr(f"{parent} AS _cell"),
            "n",
            flat[0](F.col("x0")).alias("x0"),
            flat[1](F.col("y0")).alias("y0"),
            flat[0](F.col("x1")).alias("x1"),
            flat[1](F.col("y1")).alias("y1"),
        )
        if frontier is None:
            # At most ROOT_CELLS parents of GRID_FACTOR**2 cells each: small enough for literals.
            roots = [
                F.struct(*[F.lit(v).alias(c) for c, v in row.asDict().items()])
                for row in cells.drop("_cell").collect()
            ]
            if not roots:
                return _no_hits(left, right, left_columns, right_columns)
            reached = seekers.withColumn("_root", F.explode(F.array(*roots))).select("*", "_root.*")
        elif n_cells <= BROADCAST_CELLS and rows_per_share is None:
            reached = frontier.join(F.broadcast(cells), "_cell")
        else:
            frontier = _written(frontier)
            reached = spread_join(
                frontier, cells, "_cell", F.xxhash64("_id"), F.xxhash64("_here"), **options
            )
        frontier = _still_possible(reached, px, py, k).select("_id", "_cx", "_cy", F.col("_here").alias("_cell"))

    targets = right.df.withColumn("_cell", F.expr(coords.point_cell(levels[-1], *coords.CENTRE)))
    carried = [F.col(right.id).alias("_rid"), *[F.col(c).alias(f"right_{c}") for c in right_columns]]
    if right.family == "point":
        # Of features on one spot only the k lowest ids can be among the k nearest; Spark applies
        # this limit before the shuffle as well, so a spot holding millions stays cheap.
        spot = Window.partitionBy("_cell", "xmin", "ymin").orderBy(right.id)
        targets = targets.withColumn("_rank", F.row_number().over(spot)).filter(F.col("_rank") <= k)
        targets = targets.select("_cell", F.col("xmin").alias("_x"), F.col("ymin").alias("_y"), *carried)
        distance = coords.point_distance(F.col("_cx"), F.col("_cy"), F.col("_x"), F.col("_y"), metric)
    else:
        box = [flat[i % 2](F.col(c)).alias(f"{'xy'[i % 2]}{i // 2}") for i, c in enumerate(BOX)]
        targets = targets.select("_cell", *([] if right.boxes else [F.col(GEOM).alias("_geom")]), *box, *carried)
        if right.boxes:
            gap = coords.planar(_gap(F.col("x0"), F.col("x1"), px), _gap(F.col("y0"), F.col("y1"), py))
            nowhere = px.isNull() | py.isNull()  # gaps leave null out; without a place there is no distance, as for shapes
            distance = F.when(nowhere, float("nan")).when(gap <= kernels.TOLERANCE, 0.0).otherwise(gap)
        else:
            here = geometry("Point", F.array(F.array(F.array(vertex(F.col("_cx"), F.col("_cy"))))))
            kernel = kernels.mercator_separation if metric == "mercator" else kernels.degree_separation
            distance = kernel(here, F.col("_geom"))
        if metric == "degree_m":
            distance = distance * F.lit(coords.METRES_PER_DEGREE)
    if small:
        found = frontier.join(F.broadcast(targets), "_cell")
    else:
        frontier = _written(frontier)
        found = spread_join(frontier, targets, "_cell", F.xxhash64("_id"), F.xxhash64("_rid"), **options)
    if right.family != "point":
        # The boxes of the features themselves narrow the choice before any shape is looked at.
        found = _still_possible(found.withColumns({"n": F.lit(1), "_here": F.col("_rid")}), px, py, k)
    found = found.withColumn("distance", distance)
    order = Window.partitionBy("_id").orderBy("distance", "_rid")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    hits = ranked.select("_id", "rank", "distance", *[f"right_{c}" for c in right_columns])
    if held is not None:
        whole = Window.partitionBy("_id")
        hits = hits.unionByName(held.withColumn("_most", F.max("rank").over(whole)).where(F.col("_most") == k).drop("_most"))
    if left_columns == [left.id]:
        return hits.withColumnRenamed("_id", left.id)
    rows = left.df.select(*dict.fromkeys([left.id, *left_columns]))
    return rows.join(hits, F.col(left.id) == F.col("_id")).drop("_id")


def _held(seekers: DataFrame, right: Layer, k: int, right_columns: list[str], **options) -> DataFrame:
    """The k lowest ids of the polygons that hold each left row, as hits: nothing is nearer than they are."""
    at = point_layer(seekers, "_id", "_cx", "_cy")
    pairs = spatial_pairs(at, right, "intersects", left_columns=[], right_columns=right_columns, **options)
    pairs = pairs.select(
        F.col("l__id").alias("_id"), F.col(f"r_{right.id}").alias("_rid"), *[F.col(f"r_{c}").alias(f"right_{c}") for c in right_columns]
    )
    first = Window.partitionBy("_id").orderBy("_rid")
    ranked = pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return written(ranked.select("_id", "rank", F.lit(0.0).alias("distance"), *[f"right_{c}" for c in right_columns]), "held")


def _no_hits(left: Layer, right: Layer, left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """The result's shape when the right layer is empty."""
    rows = left.df.select(*left_columns).limit(0)
    other = right.df.select(*[F.col(c).alias(f"right_{c}") for c in right_columns]).limit(0)
    return rows.join(other.withColumns({"rank": F.lit(1), "distance": F.lit(0.0)}), F.lit(False), "left").select(
        *left_columns, "rank", "distance", *[f"right_{c}" for c in right_columns]
    )
