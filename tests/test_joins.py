"""Join strategies against brute force, with hot cells, huge features and shared spots."""

import math
import random

import pytest
from pyspark.sql import functions as F
from shapes_for_tests import box, column, polygon

from geoloom.functions import kernels
from geoloom.layer import GEOM, GEOMETRY, Layer, box_layer, point_layer, with_box
from geoloom.operators import aggregate, joins, nearest
from geoloom.operators.spread import spread_join


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def layer_of(spark, geometries, family="polygon"):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField(GEOM, GEOMETRY)])
    rows = [(i, (g["kind"], [[[(v["x"], v["y"]) for v in r] for r in p] for p in g["parts"]])) for i, g in enumerate(geometries)]
    return Layer(with_box(spark.createDataFrame(rows, schema)), "id", family)


def crowd(spark):
    """A third of the points on one spot, a third in one cell, the rest spread out."""
    spots = [(i, 10.0005, 20.0005) for i in range(150)]
    spots += [(150 + i, 10 + (i % 15) / 2e4, 20 + (i // 15) / 2e4) for i in range(150)]
    spots += [(300 + i, 5 + (i * 37 % 100) / 10, 15 + (i * 53 % 100) / 10) for i in range(150)]
    return spots, point_layer(spark.createDataFrame(spots, "id long, lon double, lat double"), "id")


BOXES = [(0, 0.0, 0.0, 180.0, 89.0), (1, 9.9999, 19.9999, 10.0004, 20.0004), (2, 10.0, 20.0, 10.0005, 20.0005), (3, 5.0, 15.0, 9.0, 24.0)]
BOXES += [(10 + i, 10 + i / 1e5, 20.0, 10.0006 + i / 1e5, 20.0006) for i in range(40)]


def zones(spark):
    return box_layer(spark.createDataFrame(BOXES, "zid long, xmin double, ymin double, xmax double, ymax double"), "zid")


STRATEGIES = [{"broadcast": True}, {"broadcast": False}, {"broadcast": False, "rows_per_share": 7}]


@pytest.mark.parametrize("options", STRATEGIES)
def test_points_in_boxes(spark, options):
    spots, points = crowd(spark)
    found = joins.spatial_join(points, zones(spark), "within", left_columns=["id"], right_columns=["zid"], **options)
    got = sorted(tuple(r) for r in found.collect())
    want = sorted((i, z) for i, x, y in spots for z, x0, y0, x1, y1 in BOXES if x0 < x < x1 and y0 < y < y1)
    assert got == want


@pytest.mark.parametrize("options", STRATEGIES)
@pytest.mark.parametrize("predicate", ["intersects", "contains", "within", "overlaps", "touches"])
def test_boxes_against_general_kernel(spark, predicate, options):
    shapes = [polygon(box(*b[1:])) for b in BOXES]
    n = len(shapes)
    pairs = [(i, j) for i in range(n) for j in range(n)]
    every = kernels.relation(column(*[shapes[i] for i, _ in pairs]), column(*[shapes[j] for _, j in pairs])).to_pylist()
    want = sorted((BOXES[i][0], BOXES[j][0]) for (i, j), r in zip(pairs, every) if r[predicate])
    z = zones(spark)
    found = joins.spatial_join(z, z, predicate, left_columns=["zid"], right_columns=["zid"], **options)
    assert sorted(tuple(r) for r in found.collect()) == want
    general = Layer(z.df, "zid", "polygon")
    found = joins.spatial_join(general, general, predicate, left_columns=["zid"], right_columns=["zid"], **options)
    assert sorted(tuple(r) for r in found.collect()) == want


@pytest.mark.parametrize("options", STRATEGIES)
def test_points_within_distance(spark, options):
    spots, points = crowd(spark)
    few = points.with_df(points.df.filter("id >= 140"))
    found = joins.spatial_join(
        few, few, "dwithin", distance=0.01, metric="degrees", left_columns=["id"], right_columns=["id"], **options
    )
    chosen = [s for s in spots if s[0] >= 140]
    want = sorted((a[0], b[0]) for a in chosen for b in chosen if math.hypot(a[1] - b[1], a[2] - b[2]) <= 0.01)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_join_types(spark):
    _, points = crowd(spark)
    z = zones(spark)
    far = z.with_df(z.df.filter("zid = 3"))
    semi = joins.spatial_join(points, far, "within", how="left_semi", left_columns=["id"])
    anti = joins.spatial_join(points, far, "within", how="left_anti", left_columns=["id"])
    left = joins.spatial_join(points, far, "within", how="left", left_columns=["id"], right_columns=["zid"])
    assert semi.count() + anti.count() == 450 and semi.intersect(anti).count() == 0
    assert left.count() == 450 and left.filter("right_zid is not null").count() == semi.count()
    with pytest.raises(ValueError):
        joins.spatial_join(points, far, "beside")
    with pytest.raises(ValueError):
        joins.spatial_join(points, far, "dwithin")


def test_reference_values(spark):
    """Five buildings and two zones: the hall lies downtown, both zones are reported."""
    buildings = [
        (1, "City Hall", -104.9903, 39.7392, 45.0), (2, "Library", -104.9847, 39.7502, 12.0),
        (3, "Stadium", -104.9716, 39.7437, 30.0), (4, "Hospital", -104.9825, 39.7312, 25.0),
        (5, "School", -104.9950, 39.7455, 15.0),
    ]
    areas = [(1, "Downtown", -105.0, 39.73, -104.97, 39.76), (2, "Suburbs", -105.05, 39.70, -105.0, 39.73)]
    b = point_layer(spark.createDataFrame(buildings, "id long, name string, lon double, lat double, height double"), "id")
    z = box_layer(spark.createDataFrame(areas, "zid long, zone string, xmin double, ymin double, xmax double, ymax double"), "zid")
    counted = aggregate.aggregate_within(b, z, {"n": ("count", None), "tallest": ("max", "height")}, labels=["zone"])
    assert {r["zone"]: (r["n"], r["tallest"]) for r in counted.collect()} == {"Downtown": (5, 45.0), "Suburbs": (0, None)}
    closest = nearest.nearest(b, -104.9903, 39.7392, k=2).collect()
    assert [r["name"] for r in closest] == ["City Hall", "School"] and closest[0]["distance_meters"] == 0


@pytest.mark.parametrize("rows_per_share", [None, 5])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_join_against_brute_force(spark, k, rows_per_share):
    spots, points = crowd(spark)
    seekers = [(1, 10.0, 20.0), (2, 10.0005, 20.0005), (3, -170.0, -80.0), (4, 12.34, 18.7), (5, 5.0, 15.0)]
    left = point_layer(spark.createDataFrame(seekers, "sid long, lon double, lat double"), "sid")
    found = nearest.nearest_join(left, points, k=k, left_columns=["sid"], right_columns=["id"], rows_per_share=rows_per_share)
    got = sorted((r["sid"], r["rank"], r["right_id"]) for r in found.collect())
    want = []
    for sid, x, y in seekers:
        best = sorted((math.hypot(px - x, py - y), i) for i, px, py in spots)[:k]
        want += [(sid, rank, i) for rank, (_, i) in enumerate(best, start=1)]
    assert got == sorted(want)


def test_nearest_join_edges(spark):
    _, points = crowd(spark)
    none = points.with_df(points.df.filter("id < 0"))
    assert nearest.nearest_join(points, none, left_columns=["id"], right_columns=["id"]).count() == 0
    one = points.with_df(points.df.filter("id = 7"))
    assert nearest.nearest_join(points, one, k=3, left_columns=["id"], right_columns=["id"]).count() == 450
    z = zones(spark)
    inside = nearest.nearest_join(points, z, left_columns=["id"], right_columns=["zid"])
    assert inside.filter("distance > 0").count() == 0 and inside.count() == 450


def test_plans_have_no_cartesian_product(spark):
    _, points = crowd(spark)
    z = zones(spark)
    for options in STRATEGIES:
        text = plan(joins.spatial_join(points, z, "within", **options))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    wide = plan(joins.spatial_join(points, z, "within", broadcast=False))
    assert "_i" in wide and "_j" in wide


def test_spread_join_is_an_equi_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(600).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    spread = spread_join(left, right, "k", F.xxhash64("a"), F.xxhash64("b"), rows_per_share=30)
    plain = left.join(right, "k")
    assert spread.count() == plain.count() == 400 * 200 + 200
    assert spread.exceptAll(plain.select(*spread.columns)).count() == 0


def test_overlay_of_polygons_with_holes(spark):
    holed = layer_of(spark, [polygon(box(0, 0, 4, 4), box(1, 1, 2, 2))])
    other = layer_of(spark, [polygon(box(0.5, 0.5, 2.5, 2.5)), polygon(box(1.2, 1.2, 1.8, 1.8))])
    rows = joins.overlay(holed, other).collect()
    assert [(r["right_id"], round(r["shared_area"], 9)) for r in rows] == [(0, 3.0)]


def test_broadcast_follows_the_measured_size(spark, monkeypatch):
    _, points = crowd(spark)
    z = zones(spark)
    described = z.with_df(z.df.withColumn("text", F.repeat(F.lit("x"), 10_000)))
    small, large = joins.footprint(z, columns=["zid"]), joins.footprint(described, columns=["zid", "text"])
    assert small.rows == large.rows == 44 and large.bytes > small.bytes + 44 * 10_000
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 4 * small.bytes)
    assert "_j" not in plan(joins.spatial_join(points, z, "within", right_columns=["zid"]))
    assert "_j" in plan(joins.spatial_join(points, described, "within", right_columns=["zid", "text"]))


def test_haversine_pairs_near_the_poles_and_the_date_line(spark):
    rng = random.Random(5)
    spots = [(0, 179.999, 0.0), (1, -179.999, 0.0), (2, 0.0, 89.0), (3, 20.0, 89.0), (4, 10.0, 90.0), (5, -170.0, -89.9)]
    spots += [(i, rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90), rng.uniform(-1, 1)])) for i in range(6, 300)]
    spots += [(i, rng.choice([-1, 1]) * rng.uniform(179.5, 180), rng.uniform(-0.5, 0.5)) for i in range(300, 360)]
    points = point_layer(spark.createDataFrame(spots, "id long, lon double, lat double"), "id")

    def metres(a, b):
        (lon1, lat1), (lon2, lat2) = (map(math.radians, p[1:]) for p in (a, b))
        h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
        return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))

    for distance in (1000.0, 40_000.0, 3_000_000.0):
        want = sorted((a[0], b[0]) for a in spots for b in spots if metres(a, b) <= distance)
        for options in STRATEGIES:
            found = joins.spatial_join(points, points, "dwithin", distance, metric="haversine", left_columns=["id"], right_columns=["id"], **options)
            assert sorted((r["id"], r["right_id"]) for r in found.collect()) == want


def test_a_side_too_large_to_broadcast_is_not_left_to_the_planner(spark, tmp_path):
    _, points = crowd(spark)
    points.df.select("id", "lon", "lat").write.parquet(f"{tmp_path}/points")  # a few kB for the planner, whatever copies are made of them
    points = point_layer(spark.read.parquet(f"{tmp_path}/points"), "id")
    text = plan(joins.spatial_join(points, points, "dwithin", 4000.0, metric="haversine", broadcast=False)).split("== Physical Plan ==")[1]
    assert text.count("SortMergeJoin") == 1


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_of_boxes_that_overlap(spark, k):
    rng = random.Random(8)
    boxes = [(i, x, y, x + rng.uniform(0.5, 3), y + rng.uniform(0.5, 3)) for i, x, y in ((i, rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(60))]
    boxes += [(60 + i, 8.0 + i, 8.0, 8.5 + i, 8.5) for i in range(4)]
    spots = [(i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(150)] + [(150, 2.0, 2.0), (150, 8.2, 8.2), (151, None, 1.0)]
    right = box_layer(spark.createDataFrame(boxes, "zid long, xmin double, ymin double, xmax double, ymax double"), "zid")
    points = point_layer(spark.createDataFrame(spots, "id long, lon double, lat double"), "id")

    def gap(s, b):
        return math.hypot(max(b[1] - s[1], s[1] - b[3], 0), max(b[2] - s[2], s[2] - b[4], 0))

    want = []
    for i in range(151):  # an id on two spots has its nearest from either
        best = sorted((gap(s, b), b[0]) for s in spots if s[0] == i for b in boxes)[:k]
        want += [(i, rank, round(d, 9), z) for rank, (d, z) in enumerate(best, 1)]
    for options in ({}, {"rows_per_share": 50}):
        found = nearest.nearest_join(points, right, k, left_columns=["id"], right_columns=["zid"], **options)
        rows = found.collect()
        assert sorted((r["id"], r["rank"], round(r["distance"], 9), r["right_zid"]) for r in rows if r["id"] != 151) == want
        assert all(math.isnan(r["distance"]) for r in rows if r["id"] == 151)  # it has no place
    assert "ArrowEvalPython" not in plan(found)  # neither shapes nor Python for boxes
    assert nearest._held(points.df.selectExpr("id _id", "lon _cx", "lat _cy"), right, k, ["zid"]).where(f"rank = {k}").count() > 10
