"""Projections and filters on layers. Every spatial filter compares the box columns first, which
reach Parquet statistics, and looks at coordinates only for rows that survive.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import coords, kernels, text
from geoloom.layer import BOX, GEOM, Layer, geometry, vertex
from geoloom.operators.joins import spatial_pairs
from geoloom.operators.nearest import distance_to

# Fixed value: viewport padding.
VIEWPORT_PAD = 1.5


def project(layer: Layer, fields: list[str] | str = "*", geometry: bool = True, oid: str = "oid") -> DataFrame:
    """Choose attribute columns; the row id never appears twice; geometry on request."""
    names = layer.attributes if fields == "*" else list(fields)
    names = list(dict.fromkeys(n for n in names if n != oid or n in layer.df.columns))
    return layer.df.select(*names, *([GEOM] if geometry else []))


def where(layer: Layer, condition: Column | str) -> Layer:
    return layer.with_df(layer.df.filter(condition))


def where_equals(layer: Layer, values: dict[str, str]) -> Layer:
    """All properties equal the given text, read as each column's type (unreadable text matches
    nothing instead of failing the query).
    """
    tests = [
        F.col(c) == F.lit(str(v)).try_cast(layer.df.schema[c].dataType) for c, v in values.items()
    ]
    return where(layer, reduce(lambda a, b: a & b, tests, F.lit(True)))


def where_text(layer: Layer, term: str, columns: list[str] | None = None) -> Layer:
    """Any attribute contains the term, ignoring case; nulls never match."""
    term = F.lit(term.lower())
    names = layer.attributes if columns is None else columns
    hits = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), term), F.lit(False)) for c in names]
    return where(layer, reduce(lambda a, b: a | b, hits, F.lit(False)))


def box_overlap(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """The feature's box meets the given one, edges included."""
    return (
        (F.col("xmax") >= F.lit(float(xmin)))
        & (F.col("xmin") <= F.lit(float(xmax)))
        & (F.col("ymax") >= F.lit(float(ymin)))
        & (F.col("ymin") <= F.lit(float(ymax)))
    )


def _box_geometry(xmin: float, ymin: float, xmax: float, ymax: float) -> str:
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return "POLYGON((" + ", ".join(f"{x!r} {y!r}" for x, y in corners) + "))"


def where_bbox(layer: Layer, bbox: tuple[float, float, float, float]) -> Layer:
    """Features that intersect the box."""
    rows = layer.df.filter(box_overlap(*bbox))
    if layer.family != "point" and not layer.boxes:
        xmin, ymin, xmax, ymax = (F.lit(float(v)) for v in bbox)
        inside = (
            (F.col("xmin") >= xmin) & (F.col("xmax") <= xmax) & (F.col("ymin") >= ymin) & (F.col("ymax") <= ymax)
        )
        # Only features that stick out of the box need their coordinates looked at.
        exact = kernels.relate(F.col(GEOM), text.from_wkt(F.lit(_box_geometry(*bbox))))["intersects"]
        rows = rows.withColumn("_hit", F.when(inside, F.lit(True)).otherwise(exact)).filter("_hit").drop("_hit")
    return layer.with_df(rows)


def wkt_bounds(wkt: str) -> tuple[float, float, float, float]:
    """Bounding box of a query geometry given as text (a small constant, read on the driver)."""
    pairs = re.findall(r"(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(-?[\d.]+(?:[eE][-+]?\d+)?)", wkt)
    xs, ys = [float(x) for x, _ in pairs], [float(y) for _, y in pairs]
    return min(xs), min(ys), max(xs), max(ys)


def where_spatial(layer: Layer, predicate: str, wkt: str) -> Layer:
    """``predicate(feature, query)`` for intersects, contains or within."""
    if predicate not in ("intersects", "contains", "within"):
        raise ValueError(f"unknown operation {predicate!r}; use intersects, contains or within")
    query = text.from_wkt(F.lit(wkt))
    rows = layer.df.filter(box_overlap(*wkt_bounds(wkt)))
    if layer.family == "point" and wkt.strip().upper().startswith(("POLYGON", "MULTIPOLYGON")):
        place = kernels.place(F.col("xmin"), F.col("ymin"), query)
        test = {"intersects": place != 0, "within": place == 1, "contains": F.lit(False)}[predicate]
        return layer.with_df(rows.filter(test))
    rows = rows.withColumn("_relation", kernels.relate(F.col(GEOM), query))
    return layer.with_df(rows.filter(F.col(f"_relation.{predicate}")).drop("_relation"))


def where_envelope(layer: Layer, wkt: str) -> Layer:
    """Features whose envelope intersects the query geometry."""
    rows = layer.df.filter(box_overlap(*wkt_bounds(wkt)))
    query = text.from_wkt(F.lit(wkt))
    if layer.family == "point":
        return layer.with_df(rows.filter(kernels.place(F.col("xmin"), F.col("ymin"), query) != 0))
    hit = kernels.relate(box_polygon(), query)["intersects"]
    return layer.with_df(rows.withColumn("_hit", hit).filter("_hit").drop("_hit"))


def box_polygon() -> Column:
    """The box columns as a polygon."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    ring = F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0))
    return geometry("Polygon", F.array(F.array(ring)))


def where_within(
    layer: Layer, lon: float, lat: float, distance: float, metric: str = "mercator", strict: bool = False
) -> Layer:
    """Features within a distance of a point. ``metric`` is mercator (planar metres), degree_m
    (metres at 111 320 per degree) or degrees; ``strict`` excludes the rim.
    """
    margin = coords.search_margin(distance, metric, abs(lat)) * (1 + 1e-9)
    rows = layer.df.filter(box_overlap(lon - margin, lat - margin, lon + margin, lat + margin))
    rows = rows.withColumn("_distance", distance_to(layer, lon, lat, metric))
    limit = F.lit(float(distance))
    keep = F.col("_distance") < limit if strict else F.col("_distance") <= limit
    return layer.with_df(rows.filter(keep).drop("_distance"))


def where_time(layer: Layer, column: str, start: str | None, end: str | None) -> Layer:
    """Rows between two times, both ends included; without both ends nothing is filtered."""
    if not (column and start and end):
        return layer
    if column not in layer.df.columns:
        raise ValueError(f"no column {column!r}")
    dtype = layer.df.schema[column].dataType
    dtype = dtype if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else T.TimestampType()
    return where(layer, F.col(column).between(F.lit(start).cast(dtype), F.lit(end).cast(dtype)))


def simplify_tolerance(zoom: int) -> float:
    """Degrees one pixel covers at a zoom level; nothing is simplified from zoom 12 on."""
    return 360.0 / (2**zoom * 256) if zoom < 12 else 0.0


def padded_bbox(bbox: tuple[float, float, float, float], pad: float = VIEWPORT_PAD):
    """The box grown about its centre and clamped to the globe."""
    xmin, ymin, xmax, ymax = bbox
    grow_x, grow_y = (xmax - xmin) * (pad - 1) / 2, (ymax - ymin) * (pad - 1) / 2
    return (
        max(xmin - grow_x, -180.0),
        max(ymin - grow_y, -90.0),
        min(xmax + grow_x, 180.0),
        min(ymax + grow_y, 90.0),
    )


def viewport(layer: Layer, bbox, zoom: int, pad: float = VIEWPORT_PAD, limit: int | None = None) -> Layer:
    """Features a map view needs: inside the padded box, polygons simplified for the zoom; all of them, or the
    ``limit`` lowest ids.
    """
    seen = where_bbox(layer, padded_bbox(bbox, pad))
    tolerance = simplify_tolerance(zoom)
    rows = seen.df if limit is None else seen.df.orderBy(layer.id).limit(limit)
    if tolerance > 0 and layer.family == "polygon" and not layer.boxes:
        rows = rows.withColumn(GEOM, kernels.simplify(F.col(GEOM), F.lit(tolerance)))
    return seen.with_df(rows)


def where_near_feature(layer: Layer, reference: Layer, condition: Column | str, distance: float, metric: str = "mercator") -> Layer:
    """Features within a distance of the one reference feature with the lowest id that satisfies
    ``condition``.
    """
    chosen = reference.df.filter(condition).orderBy(reference.id).limit(1)
    one = reference.with_df(chosen)
    pairs = spatial_pairs(
        layer, one, "dwithin", distance, metric, left_columns=layer.attributes, right_columns=[], broadcast=True
    )
    return layer.with_df(
        pairs.select(
            *[F.col(f"l_{c}").alias(c) for c in layer.attributes],
            F.col(f"l__{GEOM}").alias(GEOM),
            *[F.col(f"l__{c}").alias(c) for c in BOX],
        )
    )


def json_attribute(column: str, path: str) -> Column:
    """Text at a JSON path of a text column."""
    return F.get_json_object(F.col(column), path)
