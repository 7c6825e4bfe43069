"""Small geometries as the nested form."""

import pyarrow as pa

from geoloom.functions.kernels import GEOMETRY_ARROW


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def polygon(*rings):
    return {"kind": "Polygon", "parts": [[ring(r) for r in rings]]}


def multipolygon(*polygons):
    return {"kind": "MultiPolygon", "parts": [[ring(r) for r in rings] for rings in polygons]}


def line(*points):
    return {"kind": "LineString", "parts": [[ring(points)]]}


def point(x, y):
    return {"kind": "Point", "parts": [[ring([(x, y)])]]}


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def column(*geometries):
    return pa.array(list(geometries), GEOMETRY_ARROW)
