"""Shared boundaries are simplified once: neighbours keep touching and areas add up."""

import math

import pytest
from shapes_for_tests import box, multipolygon, polygon
from test_clip import area, paths
from test_joins import layer_of

from geoloom.layer import GEOM
from geoloom.operators import topology


def simplified(spark, geometries, tolerance):
    layer = layer_of(spark, geometries)
    rows = topology.simplify_topology(layer.with_df(layer.df.repartition(3)), tolerance).df.collect()
    return {r.id: r[GEOM].asDict(recursive=True) for r in rows}


def wavy(p, q, n=40):
    """A path between two points that neighbours walk both ways over the same vertices."""
    if q < p:
        return wavy(q, p, n)[::-1]
    (ax, ay), (bx, by) = p, q
    out = [p]
    for k in range(1, n):
        t = k / n
        off = 0.05 * math.sin(7 * math.pi * t + ax + 3 * ay) + 0.003 * math.sin(90 * t)
        out.append((ax + (bx - ax) * t - (by - ay) * off, ay + (by - ay) * t + (bx - ax) * off))
    return [*out, q]


def tile(x, y):
    corners = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    ring = [v for k in range(4) for v in wavy(corners[k], corners[(k + 1) % 4])[:-1]]
    return [*ring, ring[0]]


def edges(geometry):
    return [(a, b) for part in paths(geometry) for ring in part for a, b in zip(ring, ring[1:])]


def test_tiling_stays_a_tiling(spark):
    tiles = [polygon(tile(x, y)) for x in range(4) for y in range(3)]
    got = simplified(spark, tiles, 0.02)
    assert sum(len(edges(g)) for g in got.values()) < 0.4 * sum(len(edges(t)) for t in tiles)
    inner = {}
    for g in got.values():
        for a, b in edges(g):
            inner[min(a, b), max(a, b)] = inner.get((min(a, b), max(a, b)), 0) + (1 if a < b else -1)
    rim = [e for e, n in inner.items() if n]  # every inner edge is walked once each way
    outline = sum((a[0] * b[1] - b[0] * a[1]) / 2 * inner[a, b] for a, b in rim)
    assert outline == pytest.approx(sum(area(g) for g in got.values()), abs=1e-12)
    assert all(abs(area(g) - area(t)) < 0.1 for g, t in zip((got[k] for k in sorted(got)), tiles))


def test_rings_do_not_collapse(spark):
    circle = [(math.cos(k * math.pi / 30), math.sin(k * math.pi / 30)) for k in range(60)]
    island = polygon([*circle, circle[0]])
    lens = polygon([*circle[:31], circle[0]])  # shares half of its boundary, and a chord, with the next
    other = polygon([circle[0], circle[30], *circle[31:], circle[0]])
    got = simplified(spark, [island], 10.0)
    assert len(paths(got[0])[0][0]) == 4 and area(got[0]) > 0.5
    got = simplified(spark, [lens, other], 10.0)
    assert [len(paths(got[k])[0][0]) for k in (0, 1)] == [4, 4] and area(got[0]) + area(got[1]) > 0.5


def test_hole_filled_by_a_feature_and_other_rows(spark):
    hole = wavy((1, 1), (2, 1))[:-1] + wavy((2, 1), (2, 2))[:-1] + wavy((2, 2), (1, 2))[:-1] + wavy((1, 2), (1, 1))
    shapes = [polygon(box(0, 0, 3, 3), hole[::-1]), polygon(hole), multipolygon([box(5, 5, 6, 6)], [box(6, 6, 7, 7)]), {"kind": "Point", "parts": [[[{"x": 1.0, "y": 1.0}]]]}]
    got = simplified(spark, shapes, 0.05)
    assert area(got[0]) + area(got[1]) == pytest.approx(9) and len(paths(got[1])[0][0]) < len(hole) / 2
    assert sorted(edges(got[1])) == sorted((b, a) for a, b in edges({"parts": [got[0]["parts"][0][1:]]}))
    assert area(got[2]) == 2 and got[2]["kind"] == "MultiPolygon" and got[3]["kind"] == "Point"


def test_zero_tolerance_and_nothing(spark):
    got = simplified(spark, [polygon(tile(0, 0))], 0.0)
    assert sorted(edges(got[0])) == sorted(edges(polygon(tile(0, 0))))
    layer = layer_of(spark, [polygon(box(0, 0, 1, 1))])
    assert topology.simplify_topology(layer.with_df(layer.df.where("false")), 1.0).df.count() == 0
