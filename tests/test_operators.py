import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from shapes_for_tests import box, line, multipolygon, polygon
from test_joins import layer_of

from geoloom.functions import kernels, text
from geoloom.layer import GEOM, geometry_column, id_column, point_layer
from geoloom.operators import aggregate, filters, nearest, paging, profile, textlog, timeline, transform


@pytest.mark.parametrize("rows_per_slice", [100_000, 37])
def test_row_ids_are_global(spark, rows_per_slice):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000 * 3).alias("k")).repartition(5)
    numbered = paging.with_row_id(df, "k", rows_per_slice=rows_per_slice)
    assert numbered.filter(F.col("oid") * 3 != F.col("k")).count() == 0 and numbered.count() == 5000
    named = spark.range(500).select(F.format_string("%05d", "id").alias("name")).repartition(3)
    numbered = paging.with_row_id(named, "name", rows_per_slice=rows_per_slice)
    assert numbered.filter(F.col("oid") != F.col("name").cast("long")).count() == 0


def test_deep_pages(spark, monkeypatch):
    monkeypatch.setattr(paging, "DEEP_OFFSET", 10)
    layer = point_layer(spark.range(100).select("id", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")), "id")
    assert [r["id"] for r in paging.page(layer, limit=5, offset=40).rows.collect()] == [40, 41, 42, 43, 44]
    assert paging.page(layer, limit=10, offset=95).summary.first() == Row(total_count=100, returned=5, exceeded=False)


@pytest.mark.parametrize("limit, expected", [(99, (99, True)), (100, (100, False)), (200, (100, False))])
def test_truncation_is_exact(spark, limit, expected):
    assert tuple(paging.truncated(spark.range(100).toDF("id"), limit).first()) == expected


def test_default_page_sizes(spark):
    rows = spark.range(600).select("id", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    points = point_layer(rows, "id")
    assert paging.page(points).rows.count() == 600
    assert paging.page(points.with_df(points.df, family="polygon")).rows.count() == 500


def test_quartiles_of_hot_values(spark):
    values = [5.0] * 700 + [float(i) for i in range(300)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("empty", F.lit(None).cast("double"))
    row = profile.column_stats(df, ["v", "empty"]).filter("column_name = 'v'").first()
    exact = df.selectExpr("percentile(v, array(0.25, 0.5, 0.75)) p").first()["p"]
    assert [row["q25"], row["median"], row["q75"]] == exact and row["distinct_count"] == 300


def test_dissolve_overlapping_and_equal_boxes(spark):
    boxes = [(0, 0, 2, 2), (1, 1, 3, 3), (1, 1, 3, 3), (10, 10, 11, 11), (11, 10, 12, 11), (0, 0, 50, 0.5)]
    row = transform.dissolve(layer_of(spark, [polygon(box(*b)) for b in boxes])).first()
    # 4 + 4 - 1, two touching unit boxes, and a long strip of which 2 x 0.5 is shared.
    assert row["feature_count"] == 6 and row["area"] == pytest.approx(7 + 2 + 25 - 1)


def test_dissolved_circles_bound(spark):
    spots = [(i, (i % 10) * 0.01, (i // 10) * 0.01) for i in range(60)] + [(60 + i, 0.005, 0.005) for i in range(60)]
    points = point_layer(spark.createDataFrame(spots, "id long, lon double, lat double"), "id")
    grown = transform.buffer_layer(points, 900.0)
    areas = transform.measure_layer(grown).agg(F.sum("area").alias("s"), F.max("area").alias("m")).first()
    row = transform.dissolve(grown).first()
    assert areas["m"] < row["area"] < areas["s"] and row["feature_count"] == 120
    united, _ = kernels.unite(
        grown.df.dropDuplicates(["lon", "lat"]).select(GEOM).toArrow()[GEOM].combine_chunks().cast(kernels.GEOMETRY_ARROW),
        np.zeros(61, np.int64),
    )
    from test_kernels import area_of

    assert row["area"] == pytest.approx(area_of(united.to_pylist()[0]), rel=1e-9)


def test_buffer_of_line_and_polygon(spark):
    grown = transform.buffer_layer(layer_of(spark, [line((0, 0), (0.1, 0)), polygon(box(0, 0, 0.1, 0.1), box(0.04, 0.04, 0.06, 0.06))], "mixed"), 500.0)
    line_area, polygon_area = [r["area"] for r in transform.measure_layer(grown).orderBy("id").collect()]
    r = 500.0 / 111319.49
    disc = 3.1214 * r * r
    assert line_area == pytest.approx(0.1 * 2 * r + disc, rel=2e-3)
    assert polygon_area == pytest.approx(0.01 + 4 * 0.1 * r + disc - (0.02 - 2 * r) ** 2, rel=2e-3)


def area_by_slabs(path, r, slabs=20_000):
    """Area of the union of the discs (32-gons) around the path's vertices and the strips between them, by widths at many y."""
    corners = [(math.cos(k * math.pi / 16) * r, math.sin(k * math.pi / 16) * r) for k in range(32)]
    lo, hi = min(p[1] for p in path) - r, max(p[1] for p in path) + r
    ys = lo + (np.arange(slabs) + 0.5) * (hi - lo) / slabs
    spans = []
    for a, b in zip(path, path[1:]):
        swept = [np.array([(x + dx, y + dy) for dx, dy in corners]) for x, y in (a, b)]
        segments = [(s[k], s[k - 1]) for s in swept for k in range(32)] + list(zip(*swept))
        left, right = np.full(slabs, np.inf), np.full(slabs, -np.inf)
        for (x1, y1), (x2, y2) in segments:
            at = (ys >= min(y1, y2)) & (ys <= max(y1, y2)) & (y1 != y2)
            x = x1 + (ys[at] - y1) * (x2 - x1) / (y2 - y1)
            left[at], right[at] = np.minimum(left[at], x), np.maximum(right[at], x)
        spans.append((left, right))
    total, reach = np.zeros(slabs), np.full(slabs, -np.inf)
    left, right = (np.array([s[k] for s in spans]) for k in (0, 1))
    for k in np.argsort(left, 0, kind="stable"):
        a, b = left[k, np.arange(slabs)], right[k, np.arange(slabs)]
        total += np.maximum(0, np.where(b > a, b - np.maximum(a, reach), 0))
        reach = np.maximum(reach, b)
    return total.sum() * (hi - lo) / slabs


def test_buffers_of_lines_far_from_the_origin(spark):
    rng = np.random.default_rng(3)
    paths = [[(-105 + x, y) for x, y in np.cumsum(rng.normal(0, 0.02, (n, 2)), 0)] for n in (2, 3, 4, 5, 9) * 8]
    grown = transform.buffer_layer(layer_of(spark, [line(*p) for p in paths], "mixed"), 500.0)
    rows = transform.measure_layer(grown).orderBy("id").collect()
    for path, row in zip(paths, rows, strict=True):  # near the equator both degrees are alike
        assert row["area"] == pytest.approx(area_by_slabs(path, 500.0 * 180 / (math.pi * 6378137)), rel=1e-3)


def test_simplify_zero_is_identity(spark):
    layer = layer_of(spark, [line((0, 0), (1, 0.1), (2, 0)), polygon(box(0, 0, 1, 1))], "mixed")
    same = transform.simplify(layer, 0.0).df.select("id", GEOM)
    assert same.exceptAll(layer.df.select("id", GEOM)).count() == 0
    dropped = transform.simplify(layer, 0.5).df.filter("id = 0").first()[GEOM]
    assert len(dropped["parts"][0][0]) == 2


def test_explode_measures_and_wkt(spark):
    layer = layer_of(spark, [multipolygon([box(0, 0, 2, 2), box(0.5, 0.5, 1, 1)], [box(5, 5, 6, 6)])])
    assert transform.measure_layer(layer).first()["area"] == pytest.approx(4 - 0.25 + 1)
    parts = transform.explode_parts(layer)
    assert sorted(round(r["area"], 6) for r in transform.measure_layer(parts).collect()) == [1.0, 3.75]
    again = layer.df.select(GEOM, text.from_wkt(text.to_wkt(F.col(GEOM))).alias("back"))
    assert again.filter(F.col("back") != F.col(GEOM)).count() == 0


WKT = [
    ("POINT (1 2)", 1), ("point(1.5 -2e1)", 1), ("POINT Z (1 2 3)", 1), ("LINESTRING(0 0, 1 1, 2 0)", 3),
    ("POLYGON((0 0, 1 0, 1 1, 0 0))", 4), ("MULTIPOINT((1 2), (3 4))", 2), ("MULTIPOINT(1 2, 3 4)", 2),
    ("MULTILINESTRING((0 0, 1 1), (2 2, 3 3))", 4), ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", 8),
    ("SRID=4326;POINT(1 2)", 1), ("POINT EMPTY", None), ("CIRCLE(1 2)", None), ("LINESTRING(1 x)", None), (None, None),
]


def test_wkt_reader(spark):
    rows = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(WKT)], "i int, w string")
    parsed = rows.select("i", text.from_wkt(F.col("w")).alias("g")).orderBy("i").collect()
    sizes = [None if r["g"] is None else sum(len(ring) for part in r["g"]["parts"] for ring in part) for r in parsed]
    assert sizes == [n for _, n in WKT]


def test_filters_on_edges_and_holes(spark):
    spots = [(1, 0.0, 0.0), (2, 1.0, 0.5), (3, 2.0, 2.0), (4, 1.5, 1.5), (5, 5.0, 5.0)]
    points = point_layer(spark.createDataFrame(spots, "id long, lon double, lat double"), "id")
    wkt = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    ids = lambda layer: [r["id"] for r in layer.df.orderBy("id").collect()]
    assert ids(filters.where_spatial(points, "intersects", wkt)) == [1, 2, 3]
    assert ids(filters.where_spatial(points, "within", wkt)) == [2]
    assert ids(filters.where_bbox(points, (1.0, 0.5, 2.0, 2.0))) == [2, 3, 4]
    with pytest.raises(ValueError):
        filters.where_spatial(points, "near", wkt)
    with pytest.raises(ValueError):
        filters.where_time(points, "when", "2024-01-01", "2024-01-02")
    assert filters.where_time(points, "when", None, None) is points


def test_bbox_filter_reaches_parquet(spark, tmp_path):
    rows = spark.range(100).select("id", F.col("id").cast("double").alias("xmin"), F.lit(0.0).alias("ymin"), F.col("id").cast("double").alias("xmax"), F.lit(0.0).alias("ymax"), F.lit("x").alias("wide"))
    rows.write.parquet(str(tmp_path / "t"))
    from geoloom.layer import Layer

    layer = Layer(spark.read.parquet(str(tmp_path / "t")), "id", "point")
    text_plan = filters.where_bbox(layer, (1, -1, 2, 1)).df.select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(xmax,1.0)" in text_plan and "wide" not in text_plan.split("ReadSchema")[-1]


def test_viewport_parameters():
    assert filters.padded_bbox((-170, 0, 170, 80)) == (-180.0, -20.0, 180.0, 90.0)
    assert filters.simplify_tolerance(0) == 360 / 256 and filters.simplify_tolerance(12) == 0


def test_detection(spark):
    df = spark.range(1).select(
        F.lit("x").alias("a"), F.lit(b"").alias("location"), F.lit(1).alias("FID")
    )
    assert geometry_column(df) == "location" and id_column(df) == "FID"
    assert geometry_column(df.drop("location")) == "geometry" and id_column(df.select("a")) == "objectid"


@pytest.mark.parametrize(
    "message, intent",
    [
        ("What tables are available?", "meta"), ("Show me the bounding box of places", "meta"),
        ("Find hospitals within 500 meters of the river", "spatial"), ("How far is the museum?", "spatial"),
        ("hello there", "conversational"), ("help", "conversational"), ("thanks a lot", "conversational"),
        ("average revenue per customer segment", "analytics"), ("count by class", "analytics"),
    ],
)
def test_intents(spark, message, intent):
    df = spark.createDataFrame([(message,)], "m string")
    assert textlog.triage(df, "m").first()["intent"] == intent


@pytest.mark.parametrize(
    "message, operator, target",
    [
        ("What namespaces exist?", "list_namespaces", None), ("Which tables have geometry columns?", "search_geometry_tables", None),
        ("bounding box of orders", "get_bbox", "shop.orders"), ("How many rows are in the buildings table?", "table_stats", "town.buildings"),
        ("Preview the first 5 rows of orders", "sample_data", "shop.orders"), ("Describe the schema of orders", "describe_table", "shop.orders"),
        ("Are there any tables with a population column?", "search_tables_by_column", "population"),
        ("Which tables have timestamps?", "search_tables_by_column", "timestamps"),
        ("Find tables related to water", "search_tables", "water"), ("Show orders as it was at snapshot 12", "time_travel_query", "shop.orders"),
        ("Show orders as it was at the earliest", "table_snapshots", "shop.orders"), ("Export the schools as geojson", "export_geojson", "town.buildings"),
        ("What data is available?", "list_tables", None), ("make me a sandwich", None, None), ("summarize", None, None),
    ],
)
def test_routes(spark, message, operator, target):
    df = spark.createDataFrame([(message,)], "m string")
    row = textlog.route(df, "m", ["shop.orders", "town.buildings"]).first()
    assert (row["operator"], row["target"]) == (operator, target)


def test_scorecard_of_the_published_table(spark):
    """47 cases, of which 41 pass; null checks do not apply."""
    tiers = [1] * 15 + [2] * 15 + [3] * 17
    failing = {3, 4, 5, 28, 29, 40}
    cases = spark.createDataFrame([(t, None if i % 2 else True, i not in failing) for i, t in enumerate(tiers)], "tier int, a boolean, b boolean")
    rows = {(r["dimension"], r["value"]): (r["total"], r["passed"], r["rate"]) for r in aggregate.scorecard(cases, ["a", "b"], ["tier"]).collect()}
    assert rows == {("overall", "all"): (47, 41, 87), ("tier", "1"): (15, 12, 80), ("tier", "2"): (15, 13, 87), ("tier", "3"): (17, 16, 94)}


def test_default_windows():
    assert [timeline.default_window(s) for s in (3600, 86400, 604800, 2592000, 2592001)] == ["hour", "day", "week", "month", "year"]


def test_geofence_across_chunks(spark):
    rows = [(1, "2024-01-01 23:00:00", 1, 5), (1, "2024-01-02 01:00:00", 2, 5), (1, "2024-01-03 01:00:00", 3, None), (1, "2024-01-05 00:00:00", 4, 6), (2, "2024-01-01 00:00:00", 5, None)]
    visits = spark.createDataFrame(rows, "u int, ts string, id int, zone int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    moves = timeline.geofence_events(visits, "u", "ts", "id").orderBy("id").collect()
    assert [(r["id"], r["left_zone"], r["entered_zone"]) for r in moves] == [(1, None, 5), (3, 5, None), (4, None, 6)]


def test_long_sequences_are_cut_into_runs(spark, monkeypatch):
    vertices = spark.range(1, 200).select(F.lit(1).alias("id"), F.col("id").alias("seq"), (F.col("id") / 100).alias("lon"), F.sin(F.col("id") / 10).alias("lat"))
    whole = transform.geodesic_measures(vertices, "id", "seq").first()
    monkeypatch.setattr(transform, "RUN", 7)
    cut = transform.geodesic_measures(vertices, "id", "seq").first()
    assert cut["n_vertices"] == whole["n_vertices"] == 199
    assert cut["length_m"] == pytest.approx(whole["length_m"]) and cut["area_m2"] == pytest.approx(whole["area_m2"])


def test_limits_are_the_callers(spark):
    points = point_layer(spark.range(400).selectExpr("id", "id / 10.0D AS lon", "0.0D AS lat"), "id")
    assert nearest.nearest(points, 0.0, 0.0, k=300).count() == 300
    assert paging.sample(points, 300).count() == 300
    assert paging.take_rows(points, list(range(150_000))).count() == 400
    assert filters.viewport(points, (0.0, -1.0, 50.0, 1.0), zoom=8).df.count() == 400
    for wrong in (lambda: nearest.nearest(points, 0.0, 0.0, k=0), lambda: paging.sample(points, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_column_stats_take_nan_as_no_value(spark):
    rows = [(float(i),) for i in range(1, 9)] + [(float("nan"),), (None,)]
    found = profile.column_stats(spark.createDataFrame(rows, "v double"), ["v"]).first()
    assert (found["min"], found["max"], found["mean"], found["q25"], found["median"], found["q75"]) == (1.0, 8.0, 4.5, 2.75, 4.5, 6.25)
    assert found["distinct_count"] == 8


def test_time_axis_counts_few_times_exactly(spark):
    for n in (2, 120, 150, 199, 200, 500):
        times = spark.range(n).selectExpr("timestamp_seconds(id * 86400) AS ts").unionAll(spark.sql("SELECT CAST(NULL AS timestamp) AS ts"))
        seconds = (n - 1) * 86400
        assert timeline.time_axis(times, "ts").step_seconds == seconds / min(n, 200)


def test_buffers_compare_few_edges_and_do_not_depend_on_the_block(monkeypatch):
    rng = np.random.default_rng(9)
    n, one = rng.integers(2, 7, 60), np.ones(60, np.int64)
    x, y = -105 + np.repeat(rng.uniform(0, 3, 60), n) + rng.uniform(-0.05, 0.05, n.sum()), rng.uniform(40, 40.1, n.sum())
    lines = kernels.rebuild(["LineString"] * 60, x, y, n, one, one)
    reach = pa.array([500.0 * 180 / (math.pi * 6378137)] * 60)
    compared = []
    original = kernels._against

    def counted(*args):
        for i, j in original(*args):
            compared.append(len(i))
            yield i, j

    monkeypatch.setattr(kernels, "_against", counted)
    grown = transform._grow.func(lines, reach).to_pylist()
    per_edge = 2 * 34 * 34  # a capsule's edges against another's, cut and placed
    assert sum(compared) < per_edge * (n - 1).sum() and len(grown) == 60
    monkeypatch.setattr(transform, "GROWN_ROWS", 7)
    assert transform._grow.func(lines, reach).to_pylist() == grown
