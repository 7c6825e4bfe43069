"""Coordinate arithmetic as Column expressions: projections, distances, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radii and degree lengths the metrics are defined by.
MERCATOR_RADIUS_M = 6378137.0
HAVERSINE_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0
KM_PER_DEGREE = 111.32

# One Web-Mercator metre is never more than this many degrees of longitude or latitude
# (along latitude the projection only stretches), so it bounds any search box.
DEGREES_PER_MERCATOR_M = 180.0 / (math.pi * MERCATOR_RADIUS_M)

# The grid: level m has square cells of FINEST_CELL * 4**m degrees, level 9 spans the globe.
GRID_FACTOR = 4
TOP_LEVEL = 9
FINEST_CELL = 360.0 / GRID_FACTOR**TOP_LEVEL


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * F.lit(MERCATOR_RADIUS_M)


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(MERCATOR_RADIUS_M)


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(MERCATOR_RADIUS_M))


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / F.lit(MERCATOR_RADIUS_M))) - F.lit(math.pi / 2))


def planar(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(h)) * F.lit(2 * HAVERSINE_RADIUS_M)


def point_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, metric: str) -> Column:
    """Distance between two points.

    ``mercator``: planar Web-Mercator metres; ``degrees``: planar degrees; ``degree_m``: planar
    degrees times 111 320; ``haversine``: great-circle metres.
    """
    if metric == "mercator":
        return planar(mercator_x(lon1) - mercator_x(lon2), mercator_y(lat1) - mercator_y(lat2))
    if metric == "degrees":
        return planar(lon1 - lon2, lat1 - lat2)
    if metric == "degree_m":
        return planar(lon1 - lon2, lat1 - lat2) * F.lit(METRES_PER_DEGREE)
    if metric == "haversine":
        return haversine(lon1, lat1, lon2, lat2)
    raise ValueError(f"unknown metric {metric!r}")


def search_margin(distance: float, metric: str, max_abs_lat: float = 85.06) -> float:
    """Degrees by which a box must grow so that it holds everything within ``distance``."""
    if metric == "mercator":
        return distance * DEGREES_PER_MERCATOR_M
    if metric == "degrees":
        return distance
    if metric == "degree_m":
        return distance / METRES_PER_DEGREE
    if metric == "haversine":
        degrees = math.degrees(distance / HAVERSINE_RADIUS_M)
        return degrees / max(math.cos(math.radians(min(max_abs_lat + degrees, 89.9))), 1e-3)
    raise ValueError(f"unknown metric {metric!r}")


def cell_size(level: int) -> float:
    return FINEST_CELL * GRID_FACTOR**level


# The grid expressions below are SQL text over column names: they are long, and used many times.


def level_of_extent(extent: str) -> str:
    """Finest level whose cells are at least ``extent`` wide (a feature then meets few cells)."""
    steps = " ".join(f"WHEN {extent} <= {cell_size(m)!r}D THEN {m}" for m in range(TOP_LEVEL))
    return f"CASE {steps} ELSE {TOP_LEVEL} END"


def level_of_box(prefix: str = "", margin: float = 0.0) -> str:
    """Level of the box columns ``<prefix>xmin`` ... grown by ``margin`` on every side."""
    return level_of_extent(
        f"(greatest({prefix}xmax - {prefix}xmin, {prefix}ymax - {prefix}ymin) + {2 * margin!r}D)"
    )


def size_of_level(level: str | int) -> str:
    if isinstance(level, int):
        return f"{cell_size(level)!r}D"
    sizes = ", ".join(f"{cell_size(m)!r}D" for m in range(TOP_LEVEL + 1))
    return f"element_at(array({sizes}), {level} + 1)"


def column_index(lon: str, size: str) -> str:
    return f"CAST(floor(({lon} + 180D) / {size}) AS BIGINT)"


def row_index(lat: str, size: str) -> str:
    return f"CAST(floor(({lat} + 90D) / {size}) AS BIGINT)"


def cell_key(level: str | int, ix: str, iy: str) -> str:
    """One long per (level, column, row); the offsets keep slightly out-of-range indices positive."""
    return f"(shiftleft(CAST({level} AS BIGINT), 50) + shiftleft({ix} + {1 << 23}L, 25) + ({iy} + {1 << 23}L))"


def level_of_cell(cell: str) -> str:
    return f"CAST(shiftright({cell}, 50) AS INT)"


def point_cell(level: str | int, lon: str, lat: str) -> str:
    size = size_of_level(level)
    return cell_key(level, column_index(lon, size), row_index(lat, size))


def box_cells(level: str | int, xmin: str, ymin: str, xmax: str, ymax: str) -> str:
    """Array of the keys of the cells a box meets at ``level``."""
    size = size_of_level(level)
    columns = f"sequence({column_index(xmin, size)}, {column_index(xmax, size)})"
    rows = f"sequence({row_index(ymin, size)}, {row_index(ymax, size)})"
    return f"flatten(transform({columns}, ix -> transform({rows}, iy -> {cell_key(level, 'ix', 'iy')})))"


CENTRE = ("((xmin + xmax) / 2)", "((ymin + ymax) / 2)")
