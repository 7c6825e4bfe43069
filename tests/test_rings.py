"""Rings and polygons assembled from directed pieces."""

import random

import pytest
from pyspark.sql import functions as F
from shapes_for_tests import box, polygon
from test_joins import layer_of

from geoloom.layer import GEOM
from geoloom.operators import rings, transform

PIECES = "x1 double, y1 double, x2 double, y2 double"


def pieces_of(spark, *paths):
    rows = [(*map(float, a), *map(float, b)) for p in paths for a, b in zip(p, p[1:])]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, PIECES).repartition(3)


def test_long_ring_keeps_its_order(spark):
    n = 300
    path = [(k, 0) for k in range(n)] + [(n - 1 - k, 1) for k in range(n)] + [(0, 0)]
    row = rings.rings(pieces_of(spark, path)).collect()
    assert len(row) == 1 and row[0].n_vertices == 2 * n and row[0].ring_area == pytest.approx(n - 1)
    found = [(p.x, p.y) for p in row[0].path]
    k = path.index(found[0])
    assert found == path[k:-1] + path[: k + 1]


def test_parts_that_touch_in_a_point_and_open_chains(spark):
    open_chain = [(20, 0), (21, 0), (22, 1)]
    found = rings.rings(pieces_of(spark, box(0, 0, 1, 1), box(1, 1, 2, 2), box(5, 5, 6, 6), open_chain)).collect()
    assert sorted((r.n_vertices, round(r.ring_area, 9)) for r in found) == [(4, 1.0)] * 3


def test_ends_that_differ_in_the_last_digits(spark):
    half = rings.STEP / 2
    a, b = 1 + half - 1e-13, 1 + half + 1e-13
    rows = [(0.0, 0.0, a, 0.0), (b, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 0.0)]
    found = rings.rings(spark.createDataFrame(rows, PIECES)).collect()
    assert [r.n_vertices for r in found] == [3] and found[0].ring_area == pytest.approx(0.5)


def test_holes_go_to_the_smallest_shell(spark):
    clockwise = lambda *b: box(*b)[::-1]
    layer = rings.polygons(pieces_of(spark, box(0, 0, 10, 10), clockwise(1, 1, 9, 9), box(2, 2, 8, 8), clockwise(3, 3, 4, 4), clockwise(5, 5, 6, 6)))
    found = {round(r.part_area, 9): r for r in layer.df.collect()}
    assert sorted(found) == [34.0, 36.0]
    assert found[36.0].n_holes == 1 and found[34.0].n_holes == 2
    assert [len(p) for p in found[34.0][GEOM].parts] == [3] and found[34.0].xmin == 2 and found[36.0].boundary_length == pytest.approx(72)


def test_dissolved_parts_of_boxes(spark):
    frame = [(0, 0, 5, 1), (0, 4, 5, 5), (0, 0, 1, 5), (4, 0, 5, 5)]  # a frame round a hole
    boxes = [*frame, (2, 2, 3, 3), (2, 2, 3, 3), (5, 5, 6, 6), (10, 0, 11, 1), (11, 0, 12, 1)]
    found = transform.dissolve_parts(layer_of(spark, [polygon(box(*b)) for b in boxes])).df.collect()
    got = sorted((r.feature_count, round(r.part_area, 9), r.n_holes, round(r.boundary_length, 9)) for r in found)
    assert got == [(1, 1.0, 0, 4.0), (2, 1.0, 0, 4.0), (2, 2.0, 0, 6.0), (4, 16.0, 1, 32.0)]


def test_dissolve_of_nothing(spark):
    layer = layer_of(spark, [polygon(box(0, 0, 1, 1))])
    assert transform.dissolve_parts(layer.with_df(layer.df.where("false"))).df.count() == 0


def test_plan_holds_no_cross_join(spark):
    follow = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "piece long, next long")
    assert sorted(tuple(r) for r in rings.ranked(follow).collect()) == [(1, 1, 0), (2, 1, 1)]
    plan = rings.successors(pieces_of(spark, box(0, 0, 1, 1)))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
