import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shapes_for_tests import box, column, line, multipolygon, point, polygon

from geoloom.functions import kernels

UNIT = polygon(box(0, 0, 1, 1))
HOLED = polygon(box(0, 0, 4, 4), box(1, 1, 2, 2))

CASES = [
    (polygon(box(0, 0, 2, 2)), polygon(box(1, 1, 3, 3)), {"intersects", "overlaps"}),
    (polygon(box(0, 0, 4, 4)), polygon(box(1, 1, 2, 2)), {"intersects", "contains"}),
    (UNIT, polygon(box(0, 0, 1, 1)[::-1]), {"intersects", "contains", "within"}),
    (UNIT, polygon(box(1, 0, 2, 1)), {"intersects", "touches"}),
    (UNIT, polygon(box(1, 1, 2, 2)), {"intersects", "touches"}),
    (UNIT, polygon(box(3, 3, 4, 4)), set()),
    (UNIT, polygon(box(0, 0, 2, 2)), {"intersects", "within"}),
    (polygon(box(1, 1, 2, 2)), HOLED, {"intersects", "touches"}),
    (polygon(box(1.2, 1.2, 1.8, 1.8)), HOLED, set()),
    (HOLED, polygon(box(0.5, 0.5, 2.5, 2.5)), {"intersects", "overlaps"}),
    (multipolygon([box(0, 0, 1, 1)], [box(2, 0, 3, 1)]), polygon(box(2.2, 0.2, 2.4, 0.4)), {"intersects", "contains"}),
    (line((-1, 0.5), (2, 0.5)), UNIT, {"intersects", "crosses"}),
    (line((0.2, 0.5), (0.8, 0.5)), UNIT, {"intersects", "within"}),
    (line((0, 0), (1, 0)), UNIT, {"intersects", "touches"}),
    (line((0, 0), (2, 2)), line((0, 2), (2, 0)), {"intersects", "crosses"}),
    (line((0, 0), (2, 0)), line((1, 0), (1, 2)), {"intersects", "touches"}),
    (line((0, 0), (2, 0)), line((1, 0), (3, 0)), {"intersects", "overlaps"}),
    (line((0.5, 0), (1.5, 0)), line((0, 0), (3, 0)), {"intersects", "within"}),
    (point(0.5, 0.5), UNIT, {"intersects", "within"}),
    (point(0, 0.5), UNIT, {"intersects", "touches"}),
    (point(1, 1), UNIT, {"intersects", "touches"}),
    (point(5, 0.5), UNIT, set()),
    (point(1.5, 1.5), HOLED, set()),
    (point(1, 1), point(1, 1), {"intersects", "contains", "within"}),
    (point(1, 1), point(1, 2), set()),
    (point(1, 0), line((0, 0), (2, 0)), {"intersects", "within"}),
    (point(0, 0), line((0, 0), (2, 0)), {"intersects", "touches"}),
]


def relation(a, b):
    row = kernels.relation(column(a), column(b)).to_pylist()[0]
    return {k for k in kernels.PREDICATES if row[k]}, row


@pytest.mark.parametrize("a, b, expected", CASES)
def test_predicates(a, b, expected):
    assert relation(a, b)[0] == expected


@pytest.mark.parametrize("a, b, expected", CASES)
def test_swapping_swaps_contains_and_within(a, b, expected):
    swap = {"contains": "within", "within": "contains"}
    assert relation(b, a)[0] == {swap.get(p, p) for p in expected}


def test_many_pairs_at_once_equal_one_by_one(monkeypatch):
    together = kernels.relation(column(*[c[0] for c in CASES]), column(*[c[1] for c in CASES])).to_pylist()
    assert together == [relation(a, b)[1] for a, b, _ in CASES]
    monkeypatch.setattr(kernels, "SLICE", 5)
    assert kernels.relation(column(*[c[0] for c in CASES]), column(*[c[1] for c in CASES])).to_pylist() == together


def test_shared_area_and_length():
    assert relation(polygon(box(0, 0, 2, 2)), polygon(box(1, 1, 3, 3)))[1]["area"] == pytest.approx(1)
    assert relation(HOLED, polygon(box(0.5, 0.5, 2.5, 2.5)))[1]["area"] == pytest.approx(3)
    assert relation(line((-1, 0.5), (2, 0.5)), UNIT)[1]["length"] == pytest.approx(1)


def test_separation():
    left = column(point(0, 0), UNIT, line((-1, 0.5), (2, 0.5)), point(0.5, 0.5), polygon(box(0, 0, 9, 9)))
    right = column(point(3, 4), polygon(box(4, 0, 5, 1)), UNIT, UNIT, polygon(box(2, 2, 3, 3)))
    assert kernels.separation(left, right, mercator=False) == pytest.approx([5, 3, 0, 0, 0])


def area_of(geometry):
    total = 0
    for part in geometry["parts"]:
        for i, vertices in enumerate(part):
            xy = np.array([(v["x"], v["y"]) for v in vertices])
            a = abs((xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1]).sum() / 2)
            total += a if i == 0 else -a
    return total


def union_by_cells(boxes):
    """Area of a union of boxes by coordinate compression."""
    xs = np.unique([v for b in boxes for v in (b[0], b[2])])
    ys = np.unique([v for b in boxes for v in (b[1], b[3])])
    covered = np.zeros((len(xs) - 1, len(ys) - 1), bool)
    for x0, y0, x1, y1 in boxes:
        covered[np.searchsorted(xs, x0) : np.searchsorted(xs, x1), np.searchsorted(ys, y0) : np.searchsorted(ys, y1)] = True
    return (covered * np.diff(xs)[:, None] * np.diff(ys)[None, :]).sum()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 5), st.integers(1, 5)), min_size=1, max_size=40))
def test_union_area_of_lattice_boxes(spec):
    boxes = [(x, y, x + w, y + h) for x, y, w, h in spec]
    united, _ = kernels.unite(column(*[polygon(box(*b)) for b in boxes]), np.zeros(len(boxes), np.int64))
    assert area_of(united.to_pylist()[0]) == pytest.approx(union_by_cells(boxes))


@pytest.mark.parametrize("empty", [None, {"kind": "Polygon", "parts": []}])
def test_unite_takes_empty_regions(empty):
    boxes = [polygon(box(0, 0, 2, 2)), polygon(box(1, 1, 3, 3))]
    for regions in ([*boxes, empty], [boxes[0], empty, boxes[1]], [empty, *boxes], [empty] * 9 + boxes):
        united, _ = kernels.unite(column(*regions), np.zeros(len(regions), np.int64))
        assert len(united) == 1 and area_of(united.to_pylist()[0]) == pytest.approx(7)
    united, group = kernels.unite(column(empty, empty, boxes[0]), np.array([1, 1, 2]))
    assert group.tolist() == [1, 2] and area_of(united.to_pylist()[1]) == pytest.approx(4)


def test_unite_keeps_groups_apart():
    boxes = column(polygon(box(0, 0, 2, 2)), polygon(box(1, 1, 3, 3)), polygon(box(0, 0, 1, 1)), polygon(box(1, 0, 2, 1)))
    united, group = kernels.unite(boxes, np.array([3, 3, 7, 7]))
    assert group.tolist() == [3, 7]
    assert [area_of(g) for g in united.to_pylist()] == pytest.approx([7, 2])


def test_ring_of_boxes_leaves_a_hole():
    boxes = [(0, 0, 3, 1), (0, 2, 3, 3), (0, 0, 1, 3), (2, 0, 3, 3)]
    united, _ = kernels.unite(column(*[polygon(box(*b)) for b in boxes]), np.zeros(4, np.int64))
    assert [len(part) for part in united.to_pylist()[0]["parts"]] == [2]


def test_capsule_is_the_swept_polygon():
    edges = kernels.edges_of(column(line((0, 0), (3, 4)), point(1, 1)))
    rings, owner = kernels.capsules(edges, np.array([1.0, 1.0]), 32)
    gon = 0.5 * 32 * math.sin(2 * math.pi / 32)
    width = 2 * max(abs(math.cos(k * math.pi / 16 - math.atan2(4, 3) - math.pi / 2)) for k in range(32))
    assert owner.tolist() == [0, 1]
    assert [area_of(g) for g in rings.to_pylist()] == pytest.approx([gon + 5 * width, gon])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=40))
def test_hull_holds_every_point(points):
    corners = kernels.hull(np.array(points, float))
    assert {tuple(c) for c in corners} <= {tuple(map(float, p)) for p in points}
    if len(corners) > 2:
        nxt = np.roll(corners, -1, axis=0)
        for x, y in points:
            cross = (nxt[:, 0] - corners[:, 0]) * (y - corners[:, 1]) - (nxt[:, 1] - corners[:, 1]) * (x - corners[:, 0])
            assert (cross >= 0).all()


def test_simplified_path_stays_within_tolerance():
    rng = np.random.default_rng(3)
    x, y = np.arange(200.0), rng.random(200)
    keep = kernels._kept_by_tolerance(x, y, 0.3)
    kx, ky = x[keep], y[keep]
    assert keep[0] and keep[-1] and keep.sum() < 200
    segment = np.clip(np.searchsorted(kx, x, side="right") - 1, 0, len(kx) - 2)
    dx, dy = kx[segment + 1] - kx[segment], ky[segment + 1] - ky[segment]
    off = np.abs(dx * (y - ky[segment]) - dy * (x - kx[segment])) / np.hypot(dx, dy)
    assert off.max() <= 0.3 + 1e-12
    assert kernels._kept_by_tolerance(x, y, 0.0).all()
