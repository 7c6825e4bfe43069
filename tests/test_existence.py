"""Semi and anti joins by covers against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F
from shapes_for_tests import box, multipolygon, polygon
from test_joins import crowd, layer_of, plan

from geoloom.functions import coords
from geoloom.layer import box_layer, point_layer
from geoloom.operators import existence, joins

RANDOM = random.Random(5)
SPOTS = [(i, RANDOM.uniform(-3, 7), RANDOM.uniform(40, 50)) for i in range(700)]
SPOTS += [(700 + i, 1.0, 44.0) for i in range(300)]  # a crowd on one spot
SPOTS += [(1000, None, 44.0), (1001, None, None), (1002, 0.0, 40.0), (1003, 6.0, 46.0), (1004, -3.0, 89.9999)]


def points(spark, rows=SPOTS):
    return point_layer(spark.createDataFrame(rows, "id long, lon double, lat double"), "id")


def both(left, right, predicate, **options):
    """Ids of the semi join; the anti join must hold all others."""
    semi, anti = (
        sorted(r[0] for r in joins.spatial_join(left, right, predicate, how=how, left_columns=["id"], **options).collect()) for how in ("left_semi", "left_anti")
    )
    assert sorted(semi + anti) == sorted(r[0] for r in left.df.select("id").collect())
    return semi


def merc(x, y):
    return math.radians(x) * coords.MERCATOR_RADIUS_M, math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) * coords.MERCATOR_RADIUS_M


@pytest.mark.parametrize("metric, distance", [("mercator", 60_000.0), ("degrees", 0.5), ("degree_m", 55_660.0)])
def test_discs(spark, metric, distance):
    anchors = [(1, 1.0, 44.5), (2, -2.0, 41.0), (3, -2.0, 41.0), (4, 6.5, 49.9), (5, None, 41.0), (6, -3.0, 89.99)]
    scale = {"mercator": merc, "degrees": lambda x, y: (x, y), "degree_m": lambda x, y: (x * 111320.0, y * 111320.0)}[metric]

    def near(s):
        return any(a[1] is not None and math.dist(scale(*s[1:]), scale(*a[1:])) <= distance for a in anchors)

    want = sorted(s[0] for s in SPOTS if s[1] is not None and s[2] is not None and near(s))
    assert both(points(spark), points(spark, anchors), "dwithin", distance=distance, metric=metric) == want
    assert 700 in want if metric != "mercator" else want


@pytest.mark.parametrize("predicate", ["intersects", "within"])
def test_boxes_with_their_borders(spark, predicate):
    boxes = [(1, 0.0, 40.0, 6.0, 46.0), (2, 5.5, 45.5, 5.5001, 45.5001), (3, None, 1.0, 2.0, 3.0)]
    right = box_layer(spark.createDataFrame(boxes, "zid long, xmin double, ymin double, xmax double, ymax double"), "zid")

    def inside(x, y, b):
        return b[1] <= x <= b[3] and b[2] <= y <= b[4] if predicate == "intersects" else b[1] < x < b[3] and b[2] < y < b[4]

    want = sorted(i for i, x, y in SPOTS if x is not None and any(inside(x, y, b) for b in boxes[:2]))
    got = both(points(spark), right, predicate)
    assert got == want and ({1002, 1003} <= set(got)) == (predicate == "intersects")


@pytest.mark.parametrize("predicate", ["intersects", "within"])
def test_polygons_with_holes_and_parts(spark, predicate):
    holed = polygon(box(-1, 41, 5, 47), box(0.5, 43.5, 1.5, 44.5))
    parts = multipolygon([box(-3, 48, -2, 49)], [[(5, 48), (7, 48), (6, 50), (5, 48)]])
    right = layer_of(spark, [holed, parts])
    left = points(spark)
    pairs = joins.spatial_pairs(left, right, predicate, left_columns=[], right_columns=[])
    want = sorted({r[0] for r in pairs.select("l_id").collect()})
    got = both(left, right, predicate)
    assert got == want and len(got) > 200 and 700 not in got  # the crowd stands in the hole


def test_only_border_points_are_paired(spark):
    right = layer_of(spark, [polygon(box(-2.9, 40.1, 6.9, 49.9), box(3, 43, 4, 44))])
    seen = []
    original = joins.spatial_pairs

    def counted(left, *args, **options):
        seen.append(left.df.count())
        return original(left, *args, **options)

    joins.spatial_pairs = counted
    try:
        found = existence.exists_join(points(spark), right)
    finally:
        joins.spatial_pairs = original
    assert found.count() > 800 and 0 < seen[0] < 300


def test_no_distinct_over_pairs_and_shuffled_cover(spark, monkeypatch):
    _, left = crowd(spark)
    near = left.with_df(left.df.where("id % 3 = 0"))
    want = both(left, near, "dwithin", distance=0.01, metric="degrees")
    text = plan(joins.spatial_join(left, near, "dwithin", distance=0.01, metric="degrees", how="left_semi", left_columns=["id"]))
    assert "Aggregate [l_id" not in text and "LeftSemi" in text
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert both(left, near, "dwithin", distance=0.01, metric="degrees") == want


def test_empty_sides_clashing_names_and_refusals(spark):
    left = points(spark)
    named = left.with_df(left.df.withColumn("_cells", F.lit(1)).withColumn("inner", F.lit(2)))
    none = left.with_df(left.df.where("false"))
    assert both(left, none, "dwithin", distance=1.0, metric="degrees") == []
    assert both(none, left, "dwithin", distance=1.0, metric="degrees") == []
    rows = joins.spatial_join(named, left, "dwithin", distance=0.1, metric="degrees", how="left_semi")
    assert {"_cells", "inner"} <= set(rows.columns) and rows.count() == 1003
    with pytest.raises(ValueError):
        existence.exists_join(left, left, "dwithin", distance=1.0, metric="haversine")
    with pytest.raises(ValueError):
        existence.exists_join(left, left, "dwithin", distance=0)


@pytest.mark.parametrize("predicate", ["intersects", "within"])
def test_many_small_polygons_are_paired_and_not_covered(spark, monkeypatch, predicate):
    corners = [(x, y, x + RANDOM.uniform(0.1, 0.4), y + RANDOM.uniform(0.1, 0.4)) for x, y in ((RANDOM.uniform(-3, 7), RANDOM.uniform(40, 50)) for _ in range(300))]
    corners += [(0.0, 40.0, 0.1, 40.1), (0.9, 43.9, 1.1, 44.1)]  # a corner on point 1002, and the crowd
    right = layer_of(spark, [polygon(box(*c)) for c in corners])
    rows = [*SPOTS, (None, 1.0, 44.0), (None, 0.05, 40.05), (0, 90.0, 0.0)]  # ids that are null or come twice

    def inside(x, y):
        return any(x0 <= x <= x1 and y0 <= y <= y1 if predicate == "intersects" else x0 < x < x1 and y0 < y < y1 for x0, y0, x1, y1 in corners)

    want = {kept: sorted(repr(r) for r in rows if (None not in r[1:] and inside(*r[1:])) == kept) for kept in (True, False)}
    monkeypatch.setattr(existence, "_polygon_cover", lambda right: pytest.fail("a cover was made"))
    for anti in (False, True):
        found = existence.exists_join(points(spark, rows), right, predicate, anti=anti).select("id", "lon", "lat")
        assert sorted(repr(tuple(r)) for r in found.collect()) == want[not anti]
