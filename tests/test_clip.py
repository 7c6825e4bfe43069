"""Clipped geometries against areas of relations, point samples and corner lists."""

import numpy as np
import pytest
from shapes_for_tests import box, column, line, multipolygon, polygon
from test_joins import layer_of

from geoloom.functions import clip, kernels
from geoloom.layer import GEOM
from geoloom.operators import joins


def one(left, right):
    shared, rest = clip.clipped(column(left), column(right))
    return shared.to_pylist()[0], rest.to_pylist()[0]


def paths(geometry):
    return [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in geometry["parts"]]


def area(geometry):
    if geometry is None:
        return 0.0
    total = 0.0
    for part in paths(geometry):
        for ring in part:
            total += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2
    return total


def test_corners_of_boxes():
    shared, rest = one(polygon(box(0, 0, 4, 4)), polygon(box(2, 1, 6, 3)))
    assert paths(shared) == [[[(2, 1), (4, 1), (4, 3), (2, 3), (2, 1)]]]
    assert paths(rest) == [[[(0, 0), (4, 0), (4, 1), (2, 1), (2, 3), (4, 3), (4, 4), (0, 4), (0, 0)]]]


def test_contained_equal_touching_and_apart():
    outer, inner = polygon(box(0, 0, 4, 4)), polygon(box(1, 1, 2, 2))
    shared, rest = one(outer, inner)
    assert paths(shared) == [[box(1, 1, 2, 2)]] and paths(rest) == [[box(0, 0, 4, 4), [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]]]
    shared, rest = one(inner, outer)
    assert paths(shared) == [[box(1, 1, 2, 2)]] and rest is None
    assert one(outer, outer)[1] is None and paths(one(outer, outer)[0]) == [[box(0, 0, 4, 4)]]
    for other in (box(4, 0, 5, 4), box(4, 4, 5, 5), box(9, 9, 10, 10)):
        shared, rest = one(outer, polygon(other))
        assert shared is None and paths(rest) == [[box(0, 0, 4, 4)]]


def test_hole_multipolygon_and_corner_contact():
    ring = polygon(box(0, 0, 6, 6), box(2, 2, 4, 4))
    shared, rest = one(ring, polygon(box(3, -1, 9, 7)))
    assert area(shared) == 18 - 2 and area(rest) == 18 - 2 and len(paths(shared)) == 1
    shared, rest = one(ring, polygon(box(-1, 2, 7, 4)))
    assert shared["kind"] == "MultiPolygon" and area(shared) == 8 and rest["kind"] == "MultiPolygon" and area(rest) == 24
    corners = multipolygon([box(0, 0, 1, 1)], [box(1, 1, 2, 2)])
    shared, _ = one(corners, polygon(box(-1, -1, 3, 3)))
    assert [len(p[0]) for p in paths(shared)] == [5, 5]  # parts that touch in a corner stay apart


def test_lines():
    shared, rest = one(line((-1, 1), (5, 1), (5, 3), (-1, 3)), polygon(box(0, 0, 4, 4)))
    assert paths(shared) == [[[(0, 1), (4, 1)]], [[(4, 3), (0, 3)]]]
    assert paths(rest) == [[[(-1, 1), (0, 1)]], [[(4, 1), (5, 1), (5, 3), (4, 3)]], [[(0, 3), (-1, 3)]]]
    assert one(line((10, 10), (11, 11)), polygon(box(0, 0, 4, 4)))[0] is None


def star(r, cx, cy, n):
    angles = (np.arange(n) + r.uniform(0.1, 0.9, n)) * 2 * np.pi / n  # no gap of half a turn: the ring is simple
    radii = r.uniform(0.3, 1.5, n)
    points = [(cx + a * np.cos(t), cy + a * np.sin(t)) for a, t in zip(radii, angles)]
    return [*points, points[0]]


def test_random_stars_in_one_batch_against_relations():
    r = np.random.default_rng(3)
    left, right = [], []
    for k in range(300):
        left.append(polygon(star(r, 0, 0, int(r.integers(5, 30)))))
        right.append(polygon(star(r, *r.uniform(-1, 1, 2), int(r.integers(5, 30)))))
    shared, rest = clip.clipped(column(*left), column(*right))
    related = kernels.relation(column(*left), column(*right)).to_pylist()
    for a, s, d, rel in zip(left, shared.to_pylist(), rest.to_pylist(), related):
        whole = abs(area(a))
        assert area(s) == pytest.approx(rel["area"], abs=1e-9)
        assert area(s) + area(d) == pytest.approx(whole, abs=1e-9)
        for g in (s, d):
            for part in paths(g) if g else []:
                signs = [sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) for ring in part]
                assert signs[0] > 0 and all(x < 0 for x in signs[1:])
                assert all(ring[0] == min(ring) and ring[0] == ring[-1] for ring in part)


def test_join_keeps_pairs_with_area_or_length(spark):
    left = layer_of(spark, [polygon(box(0, 0, 2, 2)), polygon(box(2, 0, 4, 2)), polygon(box(8, 8, 9, 9))])
    right = layer_of(spark, [polygon(box(1, 1, 3, 3)), polygon(box(4, 0, 5, 2))])
    found = {(r.id, r.right_id): r for r in joins.overlay_geometry(left, right).collect()}
    assert sorted(found) == [(0, 0), (1, 0)]
    assert [(p.x, p.y) for p in found[1, 0][GEOM].parts[0][0]] == [(2, 1), (3, 1), (3, 2), (2, 2), (2, 1)]
    assert joins.overlay_geometry(left.with_df(left.df.where("false")), right).count() == 0
