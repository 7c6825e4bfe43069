"""Semi and anti joins of points by covers: grid cells that settle whether a match exists, without pairs.

Every right feature (a polygon, or the disc around a point) is covered by cells ``DEPTH`` levels finer than its own. A
cell wholly inside some feature settles all its points; a cell that no feature meets settles them too. Only points in
the remaining cells, which a border crosses, are tested exactly. A cell is one row however many features share it, so a point in a
crowd costs one lookup per level and not one pair per neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import coords, kernels
from geoloom.layer import BOX, GEOM, Layer, geometry, vertex
from geoloom.operators import joins

DEPTH = 2  # levels a cover is finer than its feature; a feature then meets at most CELLS cells
CELLS = (coords.GRID_FACTOR**DEPTH + 1) ** 2
BYTES_PER_CELL = 64
#: Where polygons meet fewer points than this each, by count, their pairs cost less than their covers.
POINTS_PER_COVER = 32
#: Degrees a cell must lie away from a border to be inside; far more than rounding moves a point, far less than a cell.
RIM = 1e-9
#: The same for distances, as a share of the distance.
RIM_SHARE = 1e-9

_PLACE = 25  # bits of a column or row in a cell's key, see coords.cell_key
_SHIFT = 1 << 23


def can_cover(left: Layer, right: Layer, predicate: str, metric: str) -> bool:
    """Points against polygons (intersects, within), or against points within a planar distance."""
    if left.family != "point":
        return False
    if predicate == "dwithin":
        return right.family == "point" and metric in ("mercator", "degrees", "degree_m")
    return right.family == "polygon" and predicate in ("intersects", "within")


def _bounds(cell: str) -> dict[str, Column]:
    """The box of a cell, from its key."""
    size = coords.size_of_level(coords.level_of_cell(cell))
    mask = (1 << _PLACE) - 1
    ix, iy = f"((shiftright({cell}, {_PLACE}) & {mask}L) - {_SHIFT}L)", f"(({cell} & {mask}L) - {_SHIFT}L)"
    low = {"cx0": f"{ix} * {size} - 180D", "cy0": f"{iy} * {size} - 90D"}
    high = {"cx1": f"({ix} + 1) * {size} - 180D", "cy1": f"({iy} + 1) * {size} - 90D"}
    return {name: F.expr(text) for name, text in (low | high).items()}


def _cover_level(depth: int, margin: float = 0.0) -> str:
    return f"greatest({coords.level_of_box('', margin)} - {depth}, 0)"


def _cells_of(df: DataFrame, level: str, margin: float = 0.0) -> DataFrame:
    """One row per cell the box, grown by ``margin``, meets at ``level``, with the cell's bounds."""
    m = f"{margin!r}D"
    spots = coords.box_cells("_level", f"(xmin - {m})", f"(ymin - {m})", f"(xmax + {m})", f"(ymax + {m})")
    found = df.select("*", F.expr(level).alias("_level")).select("*", F.expr(f"explode({spots})").alias("_cell"))
    return found.withColumns(_bounds("_cell"))


def _disc_cover(right: Layer, distance: float, metric: str, margin: float) -> DataFrame:
    """(_cell, inner) of the discs around points: the farthest corner is inside, or the nearest point is not outside."""
    cells = _cells_of(right.df.select(*BOX), _cover_level(DEPTH, margin), margin)
    x, y = F.col("xmin"), F.col("ymin")

    def to(px: Column, py: Column) -> Column:
        return coords.point_distance(x, y, px, py, metric)

    near = to(F.least(F.greatest(x, F.col("cx0")), F.col("cx1")), F.least(F.greatest(y, F.col("cy0")), F.col("cy1")))
    # Beyond the poles there is no distance: such a cell is neither inside nor outside and tested exactly. NaN sorts above all.
    inner = F.lit(True)
    for cx, cy in [("cx0", "cy0"), ("cx0", "cy1"), ("cx1", "cy0"), ("cx1", "cy1")]:
        inner = inner & (to(F.col(cx), F.col(cy)) <= F.lit(distance * (1 - RIM_SHARE)))
    inner = F.coalesce(inner, F.lit(False))
    outside = F.coalesce((near > F.lit(distance * (1 + RIM_SHARE))) & ~F.isnan(near), F.lit(False))
    return cells.where(~outside).select("_cell", inner.alias("inner"))


def _box_cover(right: Layer) -> DataFrame:
    """(_cell, inner) of rectangles."""
    inner = "cx0 - {0} > xmin AND cx1 + {0} < xmax AND cy0 - {0} > ymin AND cy1 + {0} < ymax".format(f"{RIM!r}D")
    return _cells_of(right.df.select(*BOX), _cover_level(DEPTH)).select("_cell", F.expr(inner).alias("inner"))


def _classified(cells: DataFrame) -> DataFrame:
    """``cells`` that meet their polygon, with ``inner``: the cell, grown by RIM, is within it."""
    x0, y0, x1, y1 = F.col("cx0") - RIM, F.col("cy0") - RIM, F.col("cx1") + RIM, F.col("cy1") + RIM
    ring = F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0))
    related = cells.withColumn("_relation", kernels.relate(geometry("Polygon", F.array(F.array(ring))), F.col(GEOM)))
    return related.where("_relation.intersects").withColumn("inner", F.col("_relation.within")).drop("_relation")


def _polygon_cover(right: Layer) -> DataFrame:
    """(_cell, inner) of polygons: large cells first, and only those on the border are looked at closer, so that few
    cells carry a copy of the shape. Cells found inside are named by their children: one level per feature."""
    coarse = _classified(_cells_of(right.df.select(GEOM, *BOX), _cover_level(DEPTH - 1)))
    # The children of a cell are the finer cells at its own bounds, which end half a child before the next cell.
    half = f"({coords.size_of_level('_fine')} / 2)"
    spots = coords.box_cells("_fine", f"(cx0 + {half})", f"(cy0 + {half})", f"(cx1 - {half})", f"(cy1 - {half})")
    finer = coarse.withColumn("_fine", F.expr("greatest(_level - 1, 0)"))
    children = F.expr(f"explode(CASE WHEN _level > _fine THEN {spots} ELSE array(_cell) END)")
    inside = finer.where("inner").select(children.alias("_cell"), F.lit(True).alias("inner"))
    border = finer.where("NOT inner").select(GEOM, children.alias("_cell")).withColumns(_bounds("_cell"))
    return inside.unionByName(_classified(border).select("_cell", "inner"))


def _points_met(left: Layer, right: Layer, levels: tuple[int, ...]) -> float:
    """About how many points the boxes of ``right`` hold, each for itself: by counts per cell of the boxes' own levels."""
    cells = [coords.point_cell(m, "xmin", "ymin") for m in levels]
    points = left.df.select(F.expr(f"explode(array({', '.join(cells)}))").alias("_spot")).groupBy("_spot").agg(F.count("*").alias("_n"))
    share = "(xmax - xmin) * (ymax - ymin) / pow({0}, 2)".format(coords.size_of_level("_level"))
    boxes = right.df.select(*BOX, F.explode(F.array(F.expr(coords.level_of_box()))).alias("_level"))  # keeps the level from being inlined
    boxes = boxes.select(F.expr(coords.point_cell("_level", *coords.CENTRE)).alias("_cell"), F.expr(share).alias("_share"))
    boxes = boxes.groupBy("_cell").agg(F.sum("_share").alias("_share"))
    met = points.join(boxes.hint("merge"), F.col("_spot") == F.col("_cell"))
    return met.agg(F.sum(F.col("_n") * F.col("_share")).alias("met")).first()["met"] or 0.0


def _by_pairs(left: Layer, right: Layer, predicate: str, anti: bool, **options) -> DataFrame:
    """The same rows by pairs. A match depends on the spot only: points on one spot are tested once, and ids do not matter."""
    spot = F.struct(F.col("xmin").alias("x"), F.col("ymin").alias("y"))
    spots = left.df.select("xmin", "ymin").where("xmin IS NOT NULL AND ymin IS NOT NULL").distinct()
    spots = Layer(spots.select(spot.alias("_spot"), *BOX[:2], F.col("xmin").alias("xmax"), F.col("ymin").alias("ymax")), "_spot", "point")
    pairs = joins.spatial_pairs(spots, right, predicate, left_columns=[], right_columns=[], **options)
    matched = pairs.select("l__spot").distinct().select(F.col("l__spot.x").alias("_x"), F.col("l__spot.y").alias("_y"))
    here = (F.col("xmin") == F.col("_x")) & (F.col("ymin") == F.col("_y"))
    return left.df.join(matched.hint("merge"), here, "left_anti" if anti else "left_semi")


def exists_join(
    left: Layer,
    right: Layer,
    predicate: str = "intersects",
    distance: float | None = None,
    metric: str = "mercator",
    anti: bool = False,
    **options,
) -> DataFrame:
    """The rows of ``left`` (points, unique ids) that some row of ``right`` matches, or none with ``anti``.

    Rows of ``right`` without a shape match nothing; points without coordinates are matched by nothing. The cover has at
    most CELLS rows per right feature before features that share cells merge: of use where left rows are
    many or crowded. It is broadcast if that bound allows, else joined (AQE splits a hot cell's points). Polygons that
    meet few points each are paired with them instead.
    """
    if not can_cover(left, right, predicate, metric):
        raise ValueError("covers need points against polygons (intersects, within) or against points within a planar distance")
    margin = 0.0
    if predicate == "dwithin":
        if not distance or distance <= 0:
            raise ValueError("dwithin needs distance > 0")
        margin = coords.search_margin(distance, metric) * (1 + 1e-9)
    size = joins.footprint(right, margin, columns=[])
    if predicate != "dwithin" and not right.boxes:
        levels = tuple(level for level in size.levels if level is not None)
        if levels and _points_met(left, right, levels) <= POINTS_PER_COVER * size.rows:
            return _by_pairs(left, right, predicate, anti, **options)
    if predicate == "dwithin":
        cover = _disc_cover(right, float(distance), metric, margin)
    else:
        cover = _box_cover(right) if right.boxes else _polygon_cover(right)
    cover = cover.where("_cell IS NOT NULL").groupBy("_cell").agg(F.max("inner").alias("inner"))
    small = size.rows * CELLS * BYTES_PER_CELL <= joins.BROADCAST_BYTES

    marked = left.df
    levels = sorted({max(level - DEPTH, 0) for level in size.levels if level is not None})
    for m in levels:
        here = cover.where(F.expr(f"{coords.level_of_cell('_cell')} = {m}")).select(
            F.col("_cell").alias("_spot"), F.when(F.col("inner"), 2).otherwise(1).alias(f"_found_{m}")
        )
        spot = F.expr(coords.point_cell(m, "xmin", "ymin"))
        marked = marked.join(F.broadcast(here) if small else here.hint("merge"), spot == F.col("_spot"), "left").drop("_spot")
    marks = [f"_found_{m}" for m in levels]
    found = F.coalesce(F.greatest(F.lit(0), *marks), F.lit(0)) if marks else F.lit(0)
    marked = marked.withColumn("_found", found).drop(*marks)

    border = marked.where("_found = 1").drop("_found")
    pairs = joins.spatial_pairs(left.with_df(border), right, predicate, distance, metric, left_columns=[], right_columns=[], **options)
    matched = pairs.select(F.col(f"l_{left.id}").alias(left.id))
    tested = border.join(matched, left.id, "left_anti" if anti else "left_semi").select(*left.df.columns)
    return marked.where(F.col("_found") == (0 if anti else 2)).select(*left.df.columns).unionByName(tested)
