"""Spatial joins as equi-joins on grid cells.

Every feature is put into the few cells it meets on the grid level that fits its own extent, so a
country and a kiosk cost the same handful of rows. A pair is tested on the coarser of its two levels
only, and reported only by the cell that holds the lower-left corner of the box both share, so no
pass over the pairs is needed to remove duplicates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import clip, coords, kernels, shapes
from geoloom.layer import BOX, GEOM, Layer
from geoloom.operators.spread import spread_join

PREDICATES = ("intersects", "contains", "within", "crosses", "touches", "overlaps", "dwithin")

# A side is broadcast only when its measured size, times the copies its cells can make of it, stays
# below this many bytes: the driver holds several times as much while it collects and builds the table.
BROADCAST_BYTES = 64 << 20
BYTES_PER_VERTEX = 48
BYTES_PER_ROW = 160
CELLS_PER_LEVEL = 4


@dataclass(frozen=True)
class Footprint:
    """What one narrow aggregate over a layer tells the join: rows, bytes and grid levels."""

    rows: int
    bytes: int
    levels: tuple[int, ...]


def footprint(layer: Layer, margin: float = 0.0, columns: list[str] | None = None) -> Footprint:
    """Measure a layer with the given attributes: at most ten rows reach the driver, whatever the
    layer's size. Text and nested attributes count with their actual length.
    """
    simple = layer.family == "point" or layer.boxes
    size = F.lit(1) if simple else shapes.n_points(F.col(GEOM))
    wide = [c for c in columns or [] if not isinstance(layer.df.schema[c].dataType, FIXED_WIDTH)]
    text = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in wide), F.lit(0))
    found = (
        layer.df.select(
            F.expr(coords.level_of_box("", margin)).alias("level"), size.alias("size"), text.alias("text")
        )
        .groupBy("level")
        .agg(F.count("*").alias("rows"), F.sum("size").alias("vertices"), F.sum("text").alias("text"))
        .collect()
    )
    rows = sum(r["rows"] for r in found)
    fixed = BYTES_PER_ROW + 8 * len(columns or [])
    bytes_ = rows * fixed + sum(BYTES_PER_VERTEX * r["vertices"] + r["text"] for r in found)
    return Footprint(rows, bytes_, tuple(sorted(r["level"] for r in found)))


FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _prefixed(layer: Layer, prefix: str, columns: list[str]) -> DataFrame:
    keep = list(dict.fromkeys([layer.id, *columns]))
    shape = [c for c in (GEOM, *BOX) if c in layer.df.columns]
    return layer.df.select(
        *[F.col(c).alias(prefix + c) for c in keep], *[F.col(c).alias(f"{prefix}_{c}") for c in shape]
    )


def _point_cells(df: DataFrame, prefix: str, levels) -> DataFrame:
    """Points: one row per grid level on which they may meet something."""
    keys = [coords.point_cell(m, f"{prefix}_xmin", f"{prefix}_ymin") for m in levels]
    cell = keys[0] if len(keys) == 1 else f"explode(array({', '.join(keys)}))"
    return df.select("*", F.expr(f"{cell} AS _cell"))


def _own_cells(df: DataFrame, prefix: str) -> DataFrame:
    """One row per cell a feature meets on its own level."""
    cells = coords.box_cells(f"{prefix}_level", *[f"{prefix}_{c}" for c in BOX])
    return df.select("*", F.expr(f"{coords.level_of_box(f'{prefix}_')} AS {prefix}_level")).select(
        "*", F.expr(f"explode({cells}) AS _cell")
    )


def _cells(df: DataFrame, prefix: str, margin: float, levels) -> DataFrame:
    """One row per (feature, level, cell): the feature's own level (``own``) and every coarser one
    in ``levels``, where it may meet features too large for its own.
    """
    x0, y0, x1, y1 = (f"{prefix}_{c}" for c in BOX)
    mine, m = f"{prefix}_level", f"{margin!r}D"
    listed = ", ".join(str(level) for level in levels)
    cells = coords.box_cells("m", f"({x0} - {m})", f"({y0} - {m})", f"({x1} + {m})", f"({y1} + {m})")
    spots = (
        f"inline(flatten(transform(concat(array({mine}), filter(array({listed}), m -> m > {mine})), "
        f"m -> transform({cells}, c -> struct(c AS _cell, m = {mine} AS {prefix}_own)))))"
    )
    leveled = df.select("*", F.expr(f"{coords.level_of_box(f'{prefix}_', margin)} AS {mine}"))
    return leveled.select("*", F.expr(spots))


def box_pairs(
    left: Layer,
    right: Layer,
    margin: float = 0.0,
    left_columns: list[str] | None = None,
    right_columns: list[str] | None = None,
    broadcast: bool | None = None,
    rows_per_share: int | None = None,
) -> DataFrame:
    """Pairs whose boxes come within ``margin`` degrees, each exactly once.

    Columns are prefixed ``l_``/``r_``; geometry and box become ``l__geom``, ``l__xmin`` and so on.
    The right side is broadcast when its measured size allows; beyond that both sides are shuffled
    on the cell, hot cells split (``spread_join``).
    """
    left_columns = left.attributes if left_columns is None else left_columns
    right_columns = right.attributes if right_columns is None else right_columns
    left_point = left.family == "point" and margin == 0
    right_size = footprint(right, columns=right_columns)
    left_levels = (0,) if left_point else footprint(left, margin).levels
    levels = tuple(sorted({*right_size.levels, *(m for m in left_levels if not left_point)}))
    if not levels:
        levels = (0,)

    lhs, rhs = _prefixed(left, "l_", left_columns), _prefixed(right, "r_", right_columns)
    if left_point:
        lhs, rhs = _point_cells(lhs, "l_", levels), _own_cells(rhs, "r_")
    else:
        lhs, rhs = _cells(lhs, "l_", margin, levels), _cells(rhs, "r_", 0.0, levels)

    if broadcast is None:
        copies = CELLS_PER_LEVEL * (1 if left_point else len(levels))
        broadcast = right_size.bytes * copies <= BROADCAST_BYTES
    if broadcast:
        pairs = lhs.join(F.broadcast(rhs), "_cell")
    else:
        options = {} if rows_per_share is None else {"rows_per_share": rows_per_share}
        pairs = spread_join(
            lhs, rhs, "_cell", F.xxhash64(f"l_{left.id}"), F.xxhash64(f"r_{right.id}"), **options
        )
    m = f"{margin!r}D"
    meet = (
        f"l__xmin - {m} <= r__xmax AND l__xmax + {m} >= r__xmin AND l__ymin - {m} <= r__ymax AND l__ymax + {m} >= r__ymin"
    )
    if left_point:
        return pairs.filter(meet).drop("_cell", "r__level")
    corner = f"greatest(l__xmin - {m}, r__xmin)", f"greatest(l__ymin - {m}, r__ymin)"
    home = coords.point_cell(coords.level_of_cell("_cell"), *corner)
    kept = pairs.filter(f"{meet} AND (l__own OR r__own) AND _cell = {home}")
    return kept.drop("_cell", "l__own", "r__own", "l__level", "r__level")


def _box(prefix: str):
    return tuple(F.col(f"{prefix}_{c}") for c in BOX)


def _box_predicate(predicate: str, a, b) -> Column:
    """Rectangle against rectangle (or point) without looking at the geometry."""
    ax0, ay0, ax1, ay1 = a
    bx0, by0, bx1, by1 = b
    meets = (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)
    interiors = (ax0 < bx1) & (ax1 > bx0) & (ay0 < by1) & (ay1 > by0)
    a_in_b = (ax0 >= bx0) & (ax1 <= bx1) & (ay0 >= by0) & (ay1 <= by1)
    b_in_a = (bx0 >= ax0) & (bx1 <= ax1) & (by0 >= ay0) & (by1 <= ay1)
    return {
        "intersects": meets,
        "contains": interiors & b_in_a,
        "within": interiors & a_in_b,
        "touches": meets & ~interiors,
        "overlaps": interiors & ~a_in_b & ~b_in_a,
        "crosses": F.lit(False),
    }[predicate]


def _point_predicate(predicate: str, point, boxes: bool, box, geom: Column, point_is_left: bool) -> Column:
    """Point against polygon; their boxes are known to meet."""
    x, y = point[0], point[1]
    inside = (x > box[0]) & (x < box[2]) & (y > box[1]) & (y < box[3])
    if predicate == "intersects":
        return F.lit(True) if boxes else kernels.place(x, y, geom) != 0
    if predicate == ("within" if point_is_left else "contains"):
        return inside if boxes else inside & (kernels.place(x, y, geom) == 1)
    if predicate == "touches":
        return ~inside if boxes else kernels.place(x, y, geom) == 2
    return F.lit(False)


def apply_predicate(pairs: DataFrame, left: Layer, right: Layer, predicate: str) -> DataFrame:
    """Keep the pairs for which the exact predicate holds, by the cheapest sufficient test."""
    a, b = _box("l_"), _box("r_")
    if left.family == "point" and right.family == "point":
        return pairs if predicate in ("intersects", "contains", "within") else pairs.filter(F.lit(False))
    if left.boxes and right.boxes:
        return pairs.filter(_box_predicate(predicate, a, b))
    if left.family == "point" and right.family == "polygon":
        return pairs.filter(_point_predicate(predicate, a, right.boxes, b, F.col("r__geom"), True))
    if right.family == "point" and left.family == "polygon":
        return pairs.filter(_point_predicate(predicate, b, left.boxes, a, F.col("l__geom"), False))
    related = kernels.relate(F.col("l__geom"), F.col("r__geom"))
    return pairs.withColumn("_relation", related).filter(F.col(f"_relation.{predicate}")).drop("_relation")


def pair_distance(left: Layer, right: Layer, metric: str) -> Column:
    """Distance between the two geometries of a pair."""
    a, b = _box("l_"), _box("r_")
    if left.family == "point" and right.family == "point":
        return coords.point_distance(a[0], a[1], b[0], b[1], metric)
    if metric == "mercator":
        return kernels.mercator_separation(F.col("l__geom"), F.col("r__geom"))
    if metric == "degrees":
        return kernels.degree_separation(F.col("l__geom"), F.col("r__geom"))
    if metric == "degree_m":
        return kernels.degree_separation(F.col("l__geom"), F.col("r__geom")) * F.lit(coords.METRES_PER_DEGREE)
    raise ValueError(f"metric {metric!r} needs point layers")


def spatial_pairs(
    left: Layer,
    right: Layer,
    predicate: str = "intersects",
    distance: float | None = None,
    metric: str = "mercator",
    **options,
) -> DataFrame:
    """Matching pairs with ``l_``/``r_`` prefixed columns (and ``_distance`` for dwithin)."""
    if predicate not in PREDICATES:
        raise ValueError(f"unknown predicate {predicate!r}; use one of {', '.join(PREDICATES)}")
    if predicate == "dwithin":
        if not distance or distance <= 0:
            raise ValueError("dwithin needs distance > 0")
        if metric == "haversine":
            return _sphere_pairs(left, right, float(distance), **options)
        # A hair wider than the exact radius: rounding must never lose a pair at the rim.
        margin = coords.search_margin(distance, metric) * (1 + 1e-9)
        pairs = box_pairs(left, right, margin, **options)
        return pairs.withColumn("_distance", pair_distance(left, right, metric)).filter(
            F.col("_distance") <= F.lit(float(distance))
        )
    return apply_predicate(box_pairs(left, right, **options), left, right, predicate)


def _sphere_cells(df: DataFrame, prefix: str, size: float, around: bool) -> DataFrame:
    """Points keyed by their cell in space, a cube of ``size`` earth radii; ``around`` adds the 26 neighbours."""
    lon, lat = F.radians(f"{prefix}_xmin"), F.radians(f"{prefix}_ymin")
    at = [F.floor(v / F.lit(size)) for v in (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))]
    if not around:
        return df.withColumn("_cell", F.struct(*[v.alias(n) for n, v in zip("xyz", at)]))
    for name, v in zip("xyz", at):
        df = df.withColumn(f"_c{name}", F.explode(F.sequence(v - 1, v + 1)))
    return df.withColumn("_cell", F.struct(*[F.col(f"_c{n}").alias(n) for n in "xyz"])).drop("_cx", "_cy", "_cz")


def _sphere_pairs(
    left: Layer,
    right: Layer,
    distance: float,
    left_columns: list[str] | None = None,
    right_columns: list[str] | None = None,
    broadcast: bool | None = None,
    rows_per_share: int | None = None,
) -> DataFrame:
    """Pairs of points within great-circle metres. The grid lies in space, not on the map: a chord no longer
    than a cell's side ends in a neighbouring cell, at the poles and across the date line as anywhere.
    """
    if left.family != "point" or right.family != "point":
        raise ValueError("metric 'haversine' needs point layers")
    left_columns = left.attributes if left_columns is None else left_columns
    right_columns = right.attributes if right_columns is None else right_columns
    arc = min(distance / coords.HAVERSINE_RADIUS_M, math.pi)
    size = max(2 * math.sin(arc / 2), 1e-9) * (1 + 1e-9)
    lhs = _sphere_cells(_prefixed(left, "l_", left_columns), "l_", size, around=False)
    rhs = _sphere_cells(_prefixed(right, "r_", right_columns), "r_", size, around=True)
    if broadcast is None:
        broadcast = footprint(right, columns=right_columns).bytes * 27 <= BROADCAST_BYTES
    if broadcast:
        pairs = lhs.join(F.broadcast(rhs), "_cell")
    else:
        shares = {} if rows_per_share is None else {"rows_per_share": rows_per_share}
        pairs = spread_join(lhs, rhs, "_cell", F.xxhash64(f"l_{left.id}"), F.xxhash64(f"r_{right.id}"), **shares)
    far = pair_distance(left, right, "haversine")
    return pairs.drop("_cell").withColumn("_distance", far).filter(F.col("_distance") <= F.lit(distance))


def spatial_join(
    left: Layer,
    right: Layer,
    predicate: str = "intersects",
    distance: float | None = None,
    how: str = "inner",
    metric: str = "mercator",
    left_columns: list[str] | None = None,
    right_columns: list[str] | None = None,
    **options,
) -> DataFrame:
    """Join two layers on a spatial predicate.

    ``how``: inner, left, left_semi or left_anti. Columns are the left columns and
    ``right_<column>``; semi and anti joins return left rows, each once;
    for points these are settled by covers (``existence``), pairs are tested along borders only.
    """
    left_columns = left.attributes if left_columns is None else left_columns
    right_columns = right.attributes if right_columns is None else right_columns
    if how in ("left_semi", "left_anti"):
        from geoloom.operators import existence  # builds on this module

        if existence.can_cover(left, right, predicate, metric):
            rows = existence.exists_join(left, right, predicate, distance, metric, anti=how == "left_anti", **options)
            return rows.select(*left_columns)
        pairs = spatial_pairs(left, right, predicate, distance, metric, left_columns=[], right_columns=[], **options)
        matched = pairs.select(F.col(f"l_{left.id}").alias(left.id))
        return left.df.join(matched, left.id, how).select(*left_columns)
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    carried = left_columns if how == "inner" else []
    pairs = spatial_pairs(
        left, right, predicate, distance, metric, left_columns=carried, right_columns=right_columns, **options
    )
    matched = [F.col(f"r_{c}").alias(f"right_{c}") for c in right_columns]
    if how == "inner":
        return pairs.select(*[F.col(f"l_{c}").alias(c) for c in left_columns], *matched)
    matches = pairs.select(F.col(f"l_{left.id}").alias("_left_id"), *matched)
    rows = left.df.select(*dict.fromkeys([left.id, *left_columns]))
    joined = rows.join(matches, F.col(left.id) == F.col("_left_id"), "left").drop("_left_id")
    return joined.select(*left_columns, *[f"right_{c}" for c in right_columns])


def overlay(left: Layer, right: Layer, **options) -> DataFrame:
    """Shared area (degrees squared) and clipped length of every intersecting pair."""
    pairs = box_pairs(left, right, left_columns=[], right_columns=[], **options)
    related = pairs.withColumn("_relation", kernels.relate(F.col("l__geom"), F.col("r__geom")))
    return related.filter("_relation.intersects").select(
        F.col(f"l_{left.id}").alias(left.id),
        F.col(f"r_{right.id}").alias(f"right_{right.id}"),
        F.col("_relation.area").alias("shared_area"),
        F.col("_relation.length").alias("shared_length"),
    )


def overlay_geometry(left: Layer, right: Layer, **options) -> DataFrame:
    """(left id, right_<right id>, geom, rest) of every pair of a line or polygon with a polygon that share a length or an area:
    ``geom`` is what they share, ``rest`` what of the left feature lies outside that right one (null: nothing).

    Rings begin at their leftmost, lowest corner, without corners on straight lines; holes follow their shell. Pairs that
    only touch are left out.
    """
    pairs = box_pairs(left, right, left_columns=[], right_columns=[], **options)
    found = pairs.withColumn("_clip", clip.clip(F.col("l__geom"), F.col("r__geom"))).where("_clip.shared is not null")
    return found.select(
        F.col(f"l_{left.id}").alias(left.id), F.col(f"r_{right.id}").alias(f"right_{right.id}"), F.col("_clip.shared").alias(GEOM), F.col("_clip.rest").alias("rest")
    )
