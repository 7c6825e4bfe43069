"""Shapes as Column expressions over nested coordinate arrays.

Only what is short per vertex is written this way; measures and predicates, which touch every edge,
are in ``geoloom.functions.kernels``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import coords
from geoloom.layer import geometry, vertex, vertices

def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_edges(ring: Column, zero: Column, step) -> Column:
    """Fold ``step(acc, start, end)`` over the consecutive vertex pairs of a ring or path."""
    positions = F.when(F.size(ring) > 1, F.sequence(F.lit(1), F.size(ring) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(
        positions,
        zero,
        lambda acc, i: let(
            F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")),
            lambda e: step(acc, e["a"], e["b"]),
        ),
    )


def ring_signed_area(ring: Column) -> Column:
    """Shoelace area relative to the first vertex, so that large offsets do not cancel."""

    def from_origin(ring, o):
        def step(acc, a, b):
            return acc + (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])

        return fold_edges(ring, F.lit(0.0), step) / 2.0

    return let(ring, lambda r: let(F.get(r, F.lit(0)), lambda o: from_origin(r, o)))


def n_points(geom: Column) -> Column:
    return F.size(vertices(geom))


def map_vertices(geom: Column, f) -> Column:
    """Apply ``f(vertex) -> vertex`` to every vertex."""
    return geometry(
        geom["kind"],
        F.transform(
            geom["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, f))
        ),
    )


def to_mercator(geom: Column) -> Column:
    return map_vertices(
        geom, lambda v: vertex(coords.mercator_x(v["x"]), coords.mercator_y(v["y"]))
    )


def to_lonlat(geom: Column) -> Column:
    return map_vertices(
        geom, lambda v: vertex(coords.mercator_lon(v["x"]), coords.mercator_lat(v["y"]))
    )


def to_mercator_degrees(geom: Column) -> Column:
    """The Mercator plane in degrees of longitude, the unit that the kernels' tolerances are made for."""
    return map_vertices(geom, lambda v: vertex(v["x"], coords.mercator_y(v["y"]) * F.lit(coords.DEGREES_PER_MERCATOR_M)))


def from_mercator_degrees(geom: Column) -> Column:
    return map_vertices(geom, lambda v: vertex(v["x"], coords.mercator_lat(v["y"] / F.lit(coords.DEGREES_PER_MERCATOR_M))))


def circle(x: Column, y: Column, radius: float | Column, segments: int = 32) -> Column:
    """Closed ring of ``segments`` vertices around a point, counter-clockwise."""
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(segments)),
        lambda i: vertex(
            x + F.cos((i % segments) * F.lit(2 * math.pi / segments)) * radius,
            y + F.sin((i % segments) * F.lit(2 * math.pi / segments)) * radius,
        ),
    )
    return geometry("Polygon", F.array(F.array(ring)))


def mercator_circle(lon: Column, lat: Column, metres: float, segments: int = 32) -> Column:
    """Buffer of a point: a circle in Web-Mercator metres, back in lon/lat."""
    ring = circle(coords.mercator_x(lon), coords.mercator_y(lat), F.lit(float(metres)), segments)
    return to_lonlat(ring)


def family(geom: Column) -> Column:
    return (
        F.when(geom["kind"].isin("Point", "MultiPoint"), "point")
        .when(geom["kind"].isin("LineString", "MultiLineString"), "line")
        .when(geom["kind"].isin("Polygon", "MultiPolygon"), "polygon")
        .otherwise("other")
    )
