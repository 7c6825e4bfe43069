"""Queries over filters, projections, pages, profiles and geometry columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import coords, shapes, text
from geoloom.layer import BOX, GEOM, Layer, box_layer, geometry, vertex, with_box
from geoloom.operators import filters, paging, profile, ranks, topology, transform
from geoloom.plans import layers
from geoloom.plans.joins_and_aggregates import (
    LINE_CENTROIDS,
    MERCATOR_X,
    MERCATOR_Y,
    QUAD_CENTROID,
    _quad_meets_box,
    mercator_sql,
)
from geoloom.plans.registry import query, rounded

BBOX = (-106.0, 38.0, -104.0, 40.0)
BBOX_SQL = "(SELECT -106e0 AS xmin, 38e0 AS ymin, -104e0 AS xmax, 40e0 AS ymax)"
# A convex quadrilateral, counter-clockwise, and the same as SQL half-planes.
AREA_WKT = "POLYGON((-107.00003 37.50007, -103.50007 38.00003, -104.00009 40.20001, -106.50003 39.70009, -107.00003 37.50007))"
AREA = [(-107.00003, 37.50007), (-103.50007, 38.00003), (-104.00009, 40.20001), (-106.50003, 39.70009)]
IN_AREA = " AND ".join(
    f"(({bx!r}e0 - ({ax!r}e0))*(lat - {ay!r}e0) - ({by!r}e0 - {ay!r}e0)*(lon - ({ax!r}e0))) > 0"
    for (ax, ay), (bx, by) in zip(AREA, AREA[1:] + AREA[:1])
)


@query("o26_project", "SELECT pt_id, val FROM geo_points")
def project(spark, sf_dir):
    return filters.project(layers.points(spark, sf_dir), ["pt_id", "val", "pt_id"], geometry=False)


@query("o27_where", "SELECT pt_id, category, val FROM geo_points WHERE val > 1000e0 AND category <> 'BUILDING'")
def where(spark, sf_dir):
    found = filters.where(layers.points(spark, sf_dir), "val > 1000D AND category <> 'BUILDING'")
    return found.df.select("pt_id", "category", "val")


@query(
    "o28_where_equals",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber = 3 AND l_returnflag = 'R' AND l_quantity = 17",
)
def where_equals(spark, sf_dir):
    layer = Layer(layers.table(spark, sf_dir, "lineitem"), "l_orderkey")
    found = filters.where_equals(layer, {"l_linenumber": "3", "l_returnflag": "R", "l_quantity": "17"})
    return found.df.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "o29_where_text",
    """SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'und') OR contains(lower(role), 'und')
    OR contains(lower(CAST(conv_id AS VARCHAR)), 'und') OR contains(lower(CAST(turn AS VARCHAR)), 'und')""",
)
def where_text(spark, sf_dir):
    layer = Layer(layers.table(spark, sf_dir, "conversations"), "conv_id")
    return filters.where_text(layer, "UND").df.select("conv_id", "turn", "role")


@query("o30_bbox", "SELECT pt_id, category FROM geo_points WHERE lon >= -106e0 AND lon <= -104e0 AND lat >= 38e0 AND lat <= 40e0")
def bbox(spark, sf_dir):
    return filters.where_bbox(layers.points(spark, sf_dir), BBOX).df.select("pt_id", "category")


@query("o30_bbox_polygons", f"SELECT c.parcel_id FROM geo_parcels c JOIN {BBOX_SQL} z ON {_quad_meets_box(strict=False)}")
def bbox_polygons(spark, sf_dir):
    return filters.where_bbox(layers.parcels(spark, sf_dir), BBOX).df.select("parcel_id")


@query(
    "o31_envelope",
    """SELECT parcel_id FROM geo_parcels WHERE least(x1,x4) <= -104e0 AND greatest(x2,x3) >= -106e0
    AND least(y1,y2) <= 40e0 AND greatest(y3,y4) >= 38e0""",
)
def envelope(spark, sf_dir):
    wkt = "POLYGON((-106 38, -104 38, -104 40, -106 40, -106 38))"
    return filters.where_envelope(layers.parcels(spark, sf_dir), wkt).df.select("parcel_id")


@query("o32_intersects", f"SELECT pt_id FROM geo_points WHERE {IN_AREA}")
def intersects(spark, sf_dir):
    return filters.where_spatial(layers.points(spark, sf_dir), "intersects", AREA_WKT).df.select("pt_id")


@query("o32_within", f"SELECT event_id, event_type FROM geo_events WHERE {IN_AREA}")
def within(spark, sf_dir):
    return filters.where_spatial(layers.events(spark, sf_dir), "within", AREA_WKT).df.select("event_id", "event_type")


@query(
    "o32_contains",
    "SELECT zone_id FROM geo_zones WHERE xmin <= -107.5e0 AND xmax >= -106.5e0 AND ymin <= 37.1e0 AND ymax >= 37.7e0",
)
def contains(spark, sf_dir):
    wkt = "POLYGON((-107.5 37.1, -106.5 37.1, -106.5 37.7, -107.5 37.7, -107.5 37.1))"
    return filters.where_spatial(layers.zones(spark, sf_dir), "contains", wkt).df.select("zone_id")


@query(
    "o33_within_distance",
    f"SELECT pt_id FROM geo_points WHERE {mercator_sql('lon', 'lat', '-104.82e0', '38.83e0')} <= 40000e0",
)
def within_distance(spark, sf_dir):
    return filters.where_within(layers.points(spark, sf_dir), -104.82, 38.83, 40000.0).df.select("pt_id")


@query(
    "o33_within_distance_zones",
    f"""SELECT zone_id FROM geo_zones WHERE {mercator_sql("-104.82e0", "38.83e0", "greatest(least(-104.82e0, xmax), xmin)", "greatest(least(38.83e0, ymax), ymin)")} <= 90000e0""",
)
def within_distance_zones(spark, sf_dir):
    return filters.where_within(layers.zones(spark, sf_dir), -104.82, 38.83, 90000.0).df.select("zone_id")


DEGREES = "sqrt((lon+104.82e0)*(lon+104.82e0)+(lat-38.83e0)*(lat-38.83e0))"


@query("o34_within_degree_metres", f"SELECT pt_id FROM geo_points WHERE {DEGREES} <= 30000e0/111320e0")
def within_degree_metres(spark, sf_dir):
    found = filters.where_within(layers.points(spark, sf_dir), -104.82, 38.83, 30000.0 / 111320.0, metric="degrees")
    return found.df.select("pt_id")


@query(
    "o35_within_strict_degrees",
    f"SELECT pt_id, category, round({DEGREES}*111.32e0, 2) AS dist_km FROM geo_points WHERE {DEGREES} < 0.225e0",
)
def within_strict_degrees(spark, sf_dir):
    found = filters.where_within(layers.points(spark, sf_dir), -104.82, 38.83, 0.225, metric="degrees", strict=True)
    away = coords.point_distance(F.col("lon"), F.col("lat"), F.lit(-104.82), F.lit(38.83), "degrees")
    return found.df.select("pt_id", "category", F.round(away * coords.KM_PER_DEGREE, 2).alias("dist_km"))


@query(
    "o36_time_window",
    "SELECT event_id, ts FROM geo_events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-07 12:30:00'",
)
def time_window(spark, sf_dir):
    found = filters.where_time(layers.events(spark, sf_dir), "ts", "2024-01-05 00:00:00", "2024-01-07 12:30:00")
    return found.df.select("event_id", "ts")


@query(
    "o37_near_feature",
    f"""WITH one AS (SELECT lon AS rx, lat AS ry FROM geo_points WHERE category = 'BUILDING' AND val > 9000 ORDER BY pt_id LIMIT 1)
    SELECT e.event_id FROM geo_events e CROSS JOIN one WHERE {mercator_sql("e.lon", "e.lat", "one.rx", "one.ry")} <= 50000e0""",
)
def near_feature(spark, sf_dir):
    found = filters.where_near_feature(
        layers.events(spark, sf_dir),
        layers.points(spark, sf_dir),
        "category = 'BUILDING' AND val > 9000",
        50000.0,
    )
    return found.df.select("event_id")


OIDS = [0, 1, 5, 17, 99, 100, 101, 137]
OID_LIST = ", ".join(str(i) for i in OIDS)
NUMBERED = "(SELECT row_number() OVER (ORDER BY pt_id) - 1 AS oid, * FROM geo_points)"


@query("o38_by_ids", f"SELECT oid, pt_id, category FROM {NUMBERED} n WHERE oid IN ({OID_LIST})")
def by_ids(spark, sf_dir):
    return paging.by_ids(layers.points(spark, sf_dir), OIDS).select("oid", "pt_id", "category")


@query(
    "o39_viewport",
    "SELECT pt_id FROM geo_points WHERE lon >= -106.5e0 AND lon <= -103.5e0 AND lat >= 37.5e0 AND lat <= 40.5e0",
)
def viewport(spark, sf_dir):
    return filters.viewport(layers.points(spark, sf_dir), BBOX, zoom=8).df.select("pt_id")


@query(
    "o39_viewport_polygons",
    """SELECT parcel_id FROM geo_parcels c JOIN (SELECT -106.5e0 AS xmin, 37.5e0 AS ymin, -103.5e0 AS xmax, 40.5e0 AS ymax) z ON """
    + _quad_meets_box(strict=False),
)
def viewport_polygons(spark, sf_dir):
    return filters.viewport(layers.parcels(spark, sf_dir), BBOX, zoom=13).df.select("parcel_id")


@query(
    "o40_json_attribute",
    """SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 2) AS total FROM events
    GROUP BY json_extract_string(props, '$.k')""",
)
def json_attribute(spark, sf_dir):
    events = layers.table(spark, sf_dir, "events")
    return events.groupBy(filters.json_attribute("props", "$.k").alias("k")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "o47_measure_polygons",
    f"""SELECT parcel_id, 'Polygon' AS kind, round(abs(a)/2, 10) AS area, 0e0 AS length, round(ox + sx/(3*a), 7) AS centroid_x,
      round(oy + sy/(3*a), 7) AS centroid_y, 5 AS n_points FROM ({QUAD_CENTROID}) q""",
)
def measure_polygons(spark, sf_dir):
    measured = transform.measure_layer(layers.parcels(spark, sf_dir))
    return measured.select(
        "parcel_id", "kind", rounded("area", 10), "length", rounded("centroid_x", 7), rounded("centroid_y", 7), "n_points"
    )


@query(
    "o47_measure_lines",
    f"""WITH {LINE_CENTROIDS}, sizes AS (SELECT line_id, count(*) AS n, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax,
      max(lat) AS ymax FROM geo_vertices GROUP BY line_id)
    SELECT c.line_id, round(c.len*111.32e0, 6) AS length_km, round(c.cx, 8) AS centroid_x, round(c.cy, 8) AS centroid_y,
      s.n AS n_points, s.xmin, s.ymin, s.xmax, s.ymax FROM centroids c JOIN sizes s ON s.line_id = c.line_id""",
)
def measure_lines(spark, sf_dir):
    measured = transform.measure_layer(layers.lines(spark, sf_dir))
    return measured.select(
        "line_id",
        F.round(F.col("length") * coords.KM_PER_DEGREE, 6).alias("length_km"),
        rounded("centroid_x", 8),
        rounded("centroid_y", 8),
        "n_points",
        *BOX,
    )


@query("o48_simplify_pyramid")
def simplify_pyramid(spark, sf_dir):
    levels = transform.simplify_layer(layers.lines(spark, sf_dir), [2, 4, 6, 8, 10, 12])
    return levels.groupBy("zoom").agg(
        F.count("*").alias("features"), F.sum(shapes.n_points(F.col(GEOM))).alias("vertices")
    )


# Three corners of every parcel and a vertex halfway: simplification must drop just the latter.
@query(
    "o48_simplify_straight",
    """SELECT parcel_id, round(x1, 9) AS x_first, round(y1, 9) AS y_first, round(x3, 9) AS x_last, round(y3, 9) AS y_last, 3 AS n_points FROM geo_parcels""",
)
def simplify_straight(spark, sf_dir):
    df = layers.view(spark, sf_dir, "geo_parcels", "part")
    half = vertex((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    path = F.array(*[vertex(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1,)], half, *[vertex(F.col(f"x{i}"), F.col(f"y{i}")) for i in (2, 3)])
    layer = Layer(df.withColumn(GEOM, geometry("LineString", F.array(F.array(path)))), "parcel_id", "line")
    kept = transform.simplify(layer, 1e-4).df.select("parcel_id", F.col(f"{GEOM}.parts")[0][0].alias("p"))
    return kept.select(
        "parcel_id",
        F.round(F.col("p")[0]["x"], 9).alias("x_first"),
        F.round(F.col("p")[0]["y"], 9).alias("y_first"),
        F.round(F.element_at("p", -1)["x"], 9).alias("x_last"),
        F.round(F.element_at("p", -1)["y"], 9).alias("y_last"),
        F.size("p").cast("long").alias("n_points"),
    )


def _tiling(spark, sf_dir) -> Layer:
    """One tile per part, 50 to a row. A side bends out to its middle, by how much its line of the lattice says, and carries
    smaller teeth; both neighbours have its nine vertices."""
    df = layers.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tile_id"), (F.col("p_partkey") % 50).alias("c"), F.floor(F.col("p_partkey") / 50).alias("r"))

    def along(base, k, j):
        return F.when(j == 8, base + (k + 1) * 0.02).otherwise(base + k * 0.02 + j * 0.0025)

    def across(base, k, j):
        teeth = F.when((j % 8) == 0, 0.0).when(j == 4, 0.0).when(j % 2 == 1, 0.0001).otherwise(-0.0001)
        return base + k * 0.02 + F.lit(0.002) * (1 + k % 3) * (1 - F.abs(j - 4) / 4) + teeth

    def side(steps, upright, line):
        x, y = F.lit(-110.0), F.lit(36.0)
        spot = (lambda j: vertex(across(x, line, j), along(y, F.col("r"), j))) if upright else (lambda j: vertex(along(x, F.col("c"), j), across(y, line, j)))
        return F.transform(F.array(*[F.lit(j) for j in steps]), spot)

    up, down = range(8), range(8, 0, -1)
    path = F.concat(side(up, False, F.col("r")), side(up, True, F.col("c") + 1), side(down, False, F.col("r") + 1), side(down, True, F.col("c")))
    closed = F.concat(path, F.slice(path, 1, 1))
    return Layer(with_box(df.select("tile_id", geometry("Polygon", F.array(F.array(closed))).alias(GEOM))), "tile_id", "polygon")


# The teeth go and the bends stay, on both sides of a boundary: a tile gains what its neighbour loses.
@query(
    "o48_topology",
    """SELECT tile_id, 9 AS n_points, round(0.0004e0 + 0.01e0*0.002e0*((c+1)%3 - c%3 + (r+1)%3 - r%3), 10) AS area
    FROM (SELECT p_partkey AS tile_id, p_partkey%50 AS c, p_partkey//50 AS r FROM part) t""",
)
def simplify_topology(spark, sf_dir):
    measured = transform.measure_layer(topology.simplify_topology(_tiling(spark, sf_dir), 0.0005))
    return measured.select("tile_id", "n_points", rounded("area", 10))


INV_LAT = "degrees(2*atan(exp({y}/6378137e0)) - pi()/2)"


@query(
    "o49_buffer_points",
    f"""WITH rings AS (SELECT p.pt_id, t.i, p.lon + degrees(cos(t.i*2*pi()/32)*2500e0/6378137e0) AS x,
      {INV_LAT.format(y="(" + MERCATOR_Y.format(lat="p.lat") + " + sin(t.i*2*pi()/32)*2500e0)")} AS y, p.lon, p.lat
      FROM geo_points p CROSS JOIN range(32) t(i)),
    steps AS (SELECT pt_id, x-lon AS x, y-lat AS y, coalesce(lead(x) OVER w, first_value(x) OVER w) - lon AS nx,
      coalesce(lead(y) OVER w, first_value(y) OVER w) - lat AS ny FROM rings WINDOW w AS (PARTITION BY pt_id ORDER BY i))
    SELECT pt_id, round(sum(x*ny - nx*y)/2, 9) AS area, 33 AS n_points FROM steps GROUP BY pt_id""",
)
def buffer_points(spark, sf_dir):
    grown = transform.buffer_layer(layers.points(spark, sf_dir), 2500.0)
    measured = transform.measure_layer(grown)
    return measured.select("pt_id", rounded("area", 9), "n_points")


@query("o49_buffer_lines")
def buffer_lines(spark, sf_dir):
    grown = transform.buffer_layer(layers.lines(spark, sf_dir), 500.0)
    return transform.measure_layer(grown).select("line_id", "kind", rounded("area", 9), "n_points")


# The union's boundary: of every edge of every circle (a 32-gon) the stretches that no other circle covers. A
# convex polygon covers one stretch of an edge, bounded by its 32 half-planes; stretches merge along the edge.
@query(
    "o50_dissolve_buffers",
    f"""WITH corners AS (SELECT p.pt_id, p.lon, p.lat, t.i, p.lon + degrees(cos(t.i*2*pi()/32)*15000e0/6378137e0) AS x,
      {INV_LAT.format(y="(" + MERCATOR_Y.format(lat="p.lat") + " + sin(t.i*2*pi()/32)*15000e0)")} AS y
      FROM geo_points p CROSS JOIN range(32) t(i)),
    edges AS (SELECT a.pt_id, a.lon, a.lat, a.i, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy
      FROM corners a JOIN corners b ON a.pt_id = b.pt_id AND b.i = (a.i + 1) % 32),
    near AS (SELECT a.pt_id AS a, b.pt_id AS b FROM geo_points a JOIN geo_points b
      ON a.pt_id <> b.pt_id AND abs(a.lon - b.lon) < 0.28e0 AND abs(a.lat - b.lat) < 0.28e0),
    sides AS (SELECT e.pt_id, e.i, n.b, h.dx*(e.y - h.y) - h.dy*(e.x - h.x) AS c0, h.dx*e.dy - h.dy*e.dx AS c1
      FROM edges e JOIN near n ON e.pt_id = n.a JOIN edges h ON h.pt_id = n.b),
    stretches AS (SELECT pt_id, i, b, greatest(0e0, max(CASE WHEN c1 > 0 THEN -c0/c1 WHEN c1 = 0 AND c0 < 0 THEN 2e0 END)) AS t0,
      least(1e0, min(CASE WHEN c1 < 0 THEN -c0/c1 END)) AS t1 FROM sides GROUP BY pt_id, i, b),
    marks AS (SELECT pt_id, i, t0, t1 FROM stretches WHERE t1 > t0 UNION ALL SELECT pt_id, i, 1e0, 1e0 FROM edges),
    gaps AS (SELECT pt_id, i, t0, coalesce(max(t1) OVER (PARTITION BY pt_id, i ORDER BY t0, t1
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS reach FROM marks)
    SELECT (SELECT count(*) FROM geo_points) AS feature_count,
      round(sum((g.t0 - g.reach) * (e.x*e.dy - e.y*e.dx)/2), 7) AS area,
      round(sum((g.t0 - g.reach) * sqrt(e.dx*e.dx + e.dy*e.dy)), 6) AS boundary_length
    FROM gaps g JOIN edges e USING (pt_id, i) WHERE g.t0 > g.reach""",
)
def dissolve_buffers(spark, sf_dir):
    grown = transform.buffer_layer(layers.points(spark, sf_dir), 15000.0)
    return transform.dissolve(grown).select(
        "feature_count", rounded("area", 7), rounded("boundary_length", 6)
    )


@query(
    "o50_dissolve_zones",
    """SELECT count(*) AS feature_count, round((max(xmax)-min(xmin))*(max(ymax)-min(ymin)), 6) AS area,
    round(2*((max(xmax)-min(xmin))+(max(ymax)-min(ymin))), 6) AS boundary_length FROM geo_zones""",
)
def dissolve_zones(spark, sf_dir):
    return transform.dissolve(layers.zones(spark, sf_dir)).select(
        "feature_count", rounded("area", 6), rounded("boundary_length", 6)
    )


# Area of a union of boxes: cut the plane at every x, merge the y-intervals of each slab.
@query(
    "o50_dissolve_boxes",
    """WITH boxes AS (SELECT least(x1,x4) AS x0, least(y1,y2) AS y0, greatest(x2,x3) AS x1, greatest(y3,y4) AS y1 FROM geo_parcels),
    cuts AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT x0 AS x FROM boxes UNION SELECT x1 FROM boxes) u),
    spans AS (SELECT c.x, c.nx - c.x AS w, b.y0, b.y1,
      max(b.y1) OVER (PARTITION BY c.x ORDER BY b.y0, b.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM cuts c JOIN boxes b ON b.x0 <= c.x AND b.x1 >= c.nx WHERE c.nx > c.x)
    SELECT (SELECT count(*) FROM boxes) AS feature_count,
      round(sum(w * greatest(y1 - greatest(y0, coalesce(reach, y0)), 0)), 7) AS area FROM spans""",
)
def dissolve_boxes(spark, sf_dir):
    parcels = layers.parcels(spark, sf_dir)
    envelopes = box_layer(parcels.df.select("parcel_id", *BOX), "parcel_id")
    return transform.dissolve(envelopes).select("feature_count", rounded("area", 7))


# Connected parts of the same union: boxes reach one another over pairs that share more than a point; the slabs are cut per part.
@query(
    "o50_dissolve_parts",
    """WITH RECURSIVE boxes AS (SELECT parcel_id, least(x1,x4) AS x0, least(y1,y2) AS y0, greatest(x2,x3) AS x1, greatest(y3,y4) AS y1 FROM geo_parcels),
    shared AS (SELECT a.parcel_id AS a, b.parcel_id AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h
      FROM boxes a JOIN boxes b ON a.x0 < b.x1 + 1e-9 AND b.x0 < a.x1 + 1e-9 AND a.y0 < b.y1 + 1e-9 AND b.y0 < a.y1 + 1e-9),
    pairs AS (SELECT a, b FROM shared WHERE w > 1e-9 OR h > 1e-9),
    reached AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a),
    parts AS (SELECT a AS parcel_id, min(b) AS first_feature FROM reached GROUP BY a),
    placed AS (SELECT * FROM boxes JOIN parts USING (parcel_id)),
    cuts AS (SELECT first_feature, x, lead(x) OVER (PARTITION BY first_feature ORDER BY x) AS nx
      FROM (SELECT first_feature, x0 AS x FROM placed UNION SELECT first_feature, x1 FROM placed) u),
    spans AS (SELECT first_feature, c.nx - c.x AS w, b.y0, b.y1,
      max(b.y1) OVER (PARTITION BY first_feature, c.x ORDER BY b.y0, b.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM cuts c JOIN placed b USING (first_feature) WHERE b.x0 <= c.x AND b.x1 >= c.nx AND c.nx > c.x),
    areas AS (SELECT first_feature, round(sum(w * greatest(y1 - greatest(y0, coalesce(reach, y0)), 0)), 8) AS part_area FROM spans GROUP BY first_feature)
    SELECT first_feature, count(*) AS feature_count, any_value(part_area) AS part_area
    FROM parts JOIN areas USING (first_feature) GROUP BY first_feature""",
)
def dissolve_parts(spark, sf_dir):
    parcels = layers.parcels(spark, sf_dir)
    envelopes = box_layer(parcels.df.select("parcel_id", *BOX), "parcel_id")
    return transform.dissolve_parts(envelopes).df.select("first_feature", "feature_count", rounded("part_area", 8))


CORNERS_SQL = " UNION ALL ".join(f"SELECT parcel_id, x{i} AS x, y{i} AS y FROM geo_parcels" for i in (1, 2, 3, 4))


@query("o52_explode_parts", f"SELECT parcel_id, 'Point' AS kind, x, y FROM ({CORNERS_SQL}) c")
def explode_parts(spark, sf_dir):
    df = layers.view(spark, sf_dir, "geo_parcels", "part")
    parts = F.array(*[F.array(F.array(vertex(F.col(f"x{i}"), F.col(f"y{i}")))) for i in (1, 2, 3, 4)])
    multi = Layer(df.select("parcel_id", geometry("MultiPoint", parts).alias(GEOM)), "parcel_id", "mixed")
    single = transform.explode_parts(multi).df
    return single.select("parcel_id", F.col(f"{GEOM}.kind").alias("kind"), F.col("xmin").alias("x"), F.col("ymin").alias("y"))


@query("o53_flatten_structs", "SELECT event_id, event_type AS kind, value AS amount, user_id FROM events")
def flatten_structs(spark, sf_dir):
    events = layers.table(spark, sf_dir, "events").select(
        "event_id", F.struct(F.col("event_type").alias("kind"), F.col("value").alias("amount")).alias("what"), "user_id"
    )
    return transform.flatten_structs(events)


COORDINATE_TEXT = """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'no coordinates'
      WHEN c_custkey % 7 = 0 THEN concat(CAST(c_custkey % 90 AS VARCHAR(9)), '.5 ', CAST(c_custkey % 180 AS VARCHAR(9)), '.25')
      ELSE concat('-', CAST(91 + c_custkey % 80 AS VARCHAR(9)), '.125, ', CAST(c_custkey % 90 AS VARCHAR(9)), '.75') END AS said FROM customer"""


@query(
    "o54_parse_lonlat",
    f"""WITH asked AS ({COORDINATE_TEXT}), parsed AS (SELECT id, TRY_CAST(split_part(replace(said, ',', ''), ' ', 1) AS DOUBLE) AS a,
      TRY_CAST(split_part(replace(said, ',', ''), ' ', 2) AS DOUBLE) AS b FROM asked)
    SELECT id, CASE WHEN abs(a) > 90 AND abs(b) <= 90 THEN a ELSE b END AS lon,
      CASE WHEN abs(a) > 90 AND abs(b) <= 90 THEN b ELSE a END AS lat FROM parsed""",
)
def parse_lonlat(spark, sf_dir):
    asked = spark.sql(COORDINATE_TEXT.replace("FROM customer", "FROM {customer}"), customer=layers.table(spark, sf_dir, "customer"))
    spot = asked.select("id", text.parse_lonlat(F.col("said")).alias("spot"))
    return spot.select("id", "spot.lon", "spot.lat")


@query(
    "o55_reproject",
    f"""SELECT pt_id, round({MERCATOR_X.format(lon="lon")}, 4) AS x, round({MERCATOR_Y.format(lat="lat")}, 4) AS y,
    round(lon, 8) AS lon, round(lat, 8) AS lat FROM geo_points""",
)
def reproject(spark, sf_dir):
    projected = transform.to_mercator(layers.points(spark, sf_dir))
    back = shapes.to_lonlat(F.col(GEOM))["parts"][0][0][0]
    return projected.df.select(
        "pt_id", rounded("xmin", 4, "x"), rounded("ymin", 4, "y"), rounded(back["x"], 8, "lon"), rounded(back["y"], 8, "lat")
    )


HAVERSINE = """2*6371000e0*asin(sqrt(pow(sin(radians(nlat-lat)/2), 2) + cos(radians(lat))*cos(radians(nlat))*pow(sin(radians(nlon-lon)/2), 2)))"""


@query(
    "o56_geodesic_measures",
    f"""WITH steps AS (SELECT line_id, seq, lon, lat, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat,
      first_value(lon) OVER w AS flon, first_value(lat) OVER w AS flat FROM geo_vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq))
    SELECT line_id, count(*) AS n_vertices, round(coalesce(sum({HAVERSINE}), 0), 3) AS length_m,
      round(abs(sum(radians(coalesce(nlon, flon)-lon)*(2+sin(radians(lat))+sin(radians(coalesce(nlat, flat))))))*6371000e0*6371000e0/2/1e6, 3) AS area_km2
    FROM steps GROUP BY line_id""",
)
def geodesic_measures(spark, sf_dir):
    found = transform.geodesic_measures(layers.line_vertices(spark, sf_dir), "line_id", "seq")
    return found.select(
        "line_id", "n_vertices", rounded("length_m", 3), F.round(F.col("area_m2") / 1e6, 3).alias("area_km2")
    )


@query(
    "o56_display_measures",
    """SELECT o_orderkey, CASE WHEN m > 1000 THEN concat(printf('%.2f', m/1000), ' km (', printf('%.0f', m*3.28084e0), ' ft)')
      ELSE concat(printf('%.1f', m), ' m (', printf('%.0f', m*3.28084e0), ' ft)') END AS distance,
      CASE WHEN a > 1000000 THEN concat(printf('%.3f', a/1000000), ' km² (', printf('%.1f', a/4046.86e0), ' acres)')
      ELSE concat(printf('%.0f', a), ' m² (', printf('%.3f', a/4046.86e0), ' acres)') END AS area
    FROM (SELECT o_orderkey, o_totalprice/97e0 + 0.0123e0 AS m, o_totalprice*7.3e0 + 0.0123e0 AS a FROM orders) q""",
)
def display_measures(spark, sf_dir):
    orders = layers.table(spark, sf_dir, "orders")
    m, a = F.col("o_totalprice") / 97.0 + 0.0123, F.col("o_totalprice") * 7.3 + 0.0123
    return orders.select(
        "o_orderkey", text.display_distance(m).alias("distance"), text.display_area(a).alias("area")
    )


@query("o60_row_id", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS oid, o_orderkey, o_orderstatus FROM orders")
def row_id(spark, sf_dir):
    orders = layers.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return paging.with_row_id(orders, "o_orderkey")


@query("o60_row_id_text", "SELECT row_number() OVER (ORDER BY c_name) - 1 AS oid, c_name FROM customer")
def row_id_text(spark, sf_dir):
    return paging.with_row_id(layers.table(spark, sf_dir, "customer").select("c_name"), "c_name")


@query("o18_take_rows", f"SELECT pt_id, category, val FROM {NUMBERED} n WHERE oid IN ({OID_LIST})")
def take_rows(spark, sf_dir):
    return paging.take_rows(layers.points(spark, sf_dir), OIDS).select("pt_id", "category", "val")


EXTENT_SQL = "min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat"


@query("o64_extent", f"SELECT {EXTENT_SQL} FROM geo_events")
def extent(spark, sf_dir):
    return profile.extent(layers.events(spark, sf_dir))


@query(
    "o64_namespace_extent",
    f"""SELECT min(min_lon) AS min_lon, min(min_lat) AS min_lat, max(max_lon) AS max_lon, max(max_lat) AS max_lat FROM (
      SELECT {EXTENT_SQL} FROM geo_points UNION ALL SELECT {EXTENT_SQL} FROM geo_events
      UNION ALL SELECT {EXTENT_SQL} FROM geo_points WHERE val > 1e9
      UNION ALL SELECT min(xmin), min(ymin), max(xmax), max(ymax) FROM geo_zones
      UNION ALL SELECT min(least(x1,x4)), min(least(y1,y2)), max(greatest(x2,x3)), max(greatest(y3,y4)) FROM geo_parcels) e""",
)
def namespace_extent(spark, sf_dir):
    points = layers.points(spark, sf_dir)
    return profile.namespace_extent(
        {
            "points": points,
            "events": layers.events(spark, sf_dir),
            "nothing": points.with_df(points.df.filter(F.col("val") > 1e9)),
            "zones": layers.zones(spark, sf_dir),
            "parcels": layers.parcels(spark, sf_dir),
        }
    )


@query(
    "o65_layer_stats",
    f"""SELECT count(*) AS row_count, 8 AS column_count, count(*) AS non_null_geometries, 0 AS null_geometries, {EXTENT_SQL} FROM geo_events""",
)
def layer_stats(spark, sf_dir):
    return profile.layer_stats(layers.events(spark, sf_dir))


STATS_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
STATS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 5) AS mean,
    round(stddev_samp({c}), 5) AS stddev, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, count(DISTINCT {c}) AS distinct_count FROM lineitem"""
    for c in STATS_COLUMNS
)


@query("o66_column_stats", STATS_SQL)
def column_stats(spark, sf_dir):
    found = profile.column_stats(layers.table(spark, sf_dir, "lineitem"), STATS_COLUMNS)
    return found.select(
        "column_name",
        "min",
        "max",
        rounded("mean", 5),
        rounded("stddev", 5),
        rounded("q25", 6),
        rounded("median", 6),
        rounded("q75", 6),
        "distinct_count",
    )


@query(
    "o67_temporal_profile",
    """SELECT 'l_shipdate' AS column_name, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S.%f') AS min,
      strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S.%f') AS max, count(DISTINCT l_shipdate) AS distinct_count FROM lineitem""",
)
def temporal_profile(spark, sf_dir):
    return profile.temporal_profile(layers.table(spark, sf_dir, "lineitem"))


@query(
    "o67_temporal_profile_events",
    """SELECT 'ts' AS column_name, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS min,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS max, count(DISTINCT ts) AS distinct_count FROM events""",
)
def temporal_profile_events(spark, sf_dir):
    return profile.temporal_profile(layers.table(spark, sf_dir, "events"))


@query(
    "o68_category_profile",
    """WITH counts AS (SELECT 'type' AS column_name, p_type AS value, count(*) AS n FROM part GROUP BY p_type
      UNION ALL SELECT 'class', p_brand, count(*) FROM part GROUP BY p_brand),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM counts)
    SELECT column_name, value, n, rank FROM ranked WHERE rank <= 15""",
)
def category_profile(spark, sf_dir):
    part = layers.table(spark, sf_dir, "part").withColumnsRenamed({"p_type": "type", "p_brand": "class"})
    return profile.category_profile(part).withColumn("rank", F.col("rank").cast("long"))


@query(
    "o69_profile",
    """SELECT 'points' AS table_name, count(*) AS row_count, 'Point' AS kinds, min(lon) AS min_lon, min(lat) AS min_lat,
      max(lon) AS max_lon, max(lat) AS max_lat, (SELECT string_agg('category=' || category, ',' ORDER BY category) FROM (SELECT DISTINCT category FROM geo_points) c) AS categories
      FROM geo_points
    UNION ALL SELECT 'zones', count(*), 'Polygon', min(xmin), min(ymin), max(xmax), max(ymax), '' FROM geo_zones""",
)
def table_profile(spark, sf_dir):
    return profile.profile({"points": layers.points(spark, sf_dir), "zones": layers.zones(spark, sf_dir)})


@query(
    "o73_collected_envelope",
    f"""SELECT round(min(lon), 8) AS x0, round(min(lat), 8) AS y0, round(max(lon), 8) AS x1, round(max(lat), 8) AS y1, 'Polygon' AS kind FROM geo_points""",
)
def collected_envelope(spark, sf_dir):
    box = profile.extent(layers.points(spark, sf_dir)).toDF(*BOX)
    shape = box_layer(box, "xmin").df.select(F.col(f"{GEOM}.kind").alias("kind"), F.col(f"{GEOM}.parts")[0][0].alias("r"))
    return shape.select(
        "kind",
        F.round(F.col("r")[0]["x"], 8).alias("x0"),
        F.round(F.col("r")[0]["y"], 8).alias("y0"),
        F.round(F.col("r")[2]["x"], 8).alias("x1"),
        F.round(F.col("r")[2]["y"], 8).alias("y1"),
    )


@query(
    "o75_page",
    "SELECT pt_id, category, val FROM geo_points WHERE val > 0 ORDER BY category, val DESC NULLS LAST, pt_id LIMIT 100 OFFSET 50",
)
def page(spark, sf_dir):
    cut = paging.page(layers.points(spark, sf_dir), ["category", "val desc"], limit=100, offset=50, where=F.col("val") > 0)
    return cut.rows.select("pt_id", "category", "val")


@query(
    "o75_page_summary",
    """SELECT count(*) AS total_count, greatest(least(count(*) - 50, 100), 0) AS returned, count(*) > 150 AS exceeded FROM geo_points WHERE val > 0""",
)
def page_summary(spark, sf_dir):
    cut = paging.page(layers.points(spark, sf_dir), ["category", "val desc"], limit=100, offset=50, where=F.col("val") > 0)
    return cut.summary


# Deep pages in any order: 250 rows that begin past the middle of all line vertices, and 100 row ids spread over them.
@query(
    "o75_deep_page",
    """SELECT line_id, seq, round(lat, 9) AS lat FROM geo_vertices ORDER BY line_id % 7 DESC, CASE WHEN seq > 5 THEN NULL ELSE lat END, line_id, seq
    LIMIT 250 OFFSET (SELECT count(*) // 2 FROM geo_vertices)""",
)
def deep_page(spark, sf_dir):
    rows = layers.line_vertices(spark, sf_dir)
    rows = rows.withColumns({"g": F.col("line_id") % 7, "k": F.when(F.col("seq") <= 5, F.col("lat"))})
    keys = paging.sort_keys(["g desc", "k", "line_id", "seq"])
    cut = ranks.rows_between(rows, keys, rows.count() // 2, 250)
    return cut.select("line_id", "seq", rounded("lat", 9))


@query(
    "o18_take_spread_rows",
    """SELECT o_orderkey, n - 1 AS oid FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS total FROM orders) o
    WHERE (n - 1) % (total // 100 + 1) = 0""",
)
def take_spread_rows(spark, sf_dir):
    orders = layers.table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    total = orders.count()
    found = paging.by_ids(Layer(orders, "o_orderkey", "point"), list(range(0, total, total // 100 + 1)))
    return found.select("o_orderkey", "oid")


@query("o75_page_by_row_id", f"SELECT pt_id, val FROM {NUMBERED} n WHERE oid >= 70 AND oid < 120")
def page_by_row_id(spark, sf_dir):
    """A page cut by row number, as deep pages are."""
    numbered = paging.with_row_id(layers.points(spark, sf_dir).df, "pt_id")
    return numbered.filter((F.col("oid") >= 70) & (F.col("oid") < 120)).select("pt_id", "val")


@query("o76_count_only", "SELECT count(*) AS count FROM geo_points WHERE category = 'FURNITURE'")
def count_only(spark, sf_dir):
    return paging.count_only(layers.points(spark, sf_dir), F.col("category") == "FURNITURE")


@query("o76_ids_only", f"SELECT oid, pt_id FROM {NUMBERED} n WHERE category = 'FURNITURE'")
def ids_only(spark, sf_dir):
    return paging.ids_only(layers.points(spark, sf_dir), F.col("category") == "FURNITURE")


NULLABLE = "SELECT pt_id, CASE WHEN val < 0 THEN NULL ELSE category END AS category, CASE WHEN val > 9000 THEN NULL ELSE val END AS val FROM geo_points"


def _nullable(spark, sf_dir):
    points = layers.points(spark, sf_dir)
    return points.with_df(
        points.df.withColumns(
            {
                "category": F.when(F.col("val") < 0, None).otherwise(F.col("category")),
                "val": F.when(F.col("val") > 9000, None).otherwise(F.col("val")),
            }
        )
    )


@query(
    "o77_order_by",
    f"""WITH n AS ({NULLABLE}) SELECT pt_id, row_number() OVER (ORDER BY category DESC NULLS LAST, val ASC NULLS LAST, pt_id) AS place
    FROM n ORDER BY category DESC NULLS LAST, val ASC NULLS LAST, pt_id LIMIT 300""",
)
def order_by(spark, sf_dir):
    from pyspark.sql import Window

    cut = paging.page(_nullable(spark, sf_dir), ["category desc", "val asc"], limit=300).rows
    order = Window.orderBy(*paging.order_columns(["category desc", "val"]), "pt_id")  # 300 rows
    return cut.select("pt_id", F.row_number().over(order).cast("long").alias("place"))


@query(
    "o78_sort_nulls_last",
    f"""WITH n AS ({NULLABLE}) SELECT pt_id, val FROM n ORDER BY val DESC NULLS LAST, pt_id LIMIT 500 OFFSET 1000""",
)
def sort_nulls_last(spark, sf_dir):
    return paging.page(_nullable(spark, sf_dir), ["val desc"], limit=500, offset=1000).rows.select("pt_id", "val")


@query("o79_sample", "SELECT pt_id, category, val, lon, lat FROM geo_points ORDER BY pt_id LIMIT 25")
def sample(spark, sf_dir):
    return paging.sample(layers.points(spark, sf_dir), 25, geometry=False)


@query(
    "o80_truncated",
    """SELECT least(count(*), 200) AS returned, count(*) > 200 AS truncated FROM geo_points WHERE category = 'BUILDING'""",
)
def truncated(spark, sf_dir):
    points = layers.points(spark, sf_dir)
    return paging.truncated(points.df.filter(F.col("category") == "BUILDING"), 200)


@query(
    "o83_epoch_columns",
    """SELECT 'created_at' AS column_name, min(v) >= 631152000000 AND max(v) <= 4102444800000 AS is_epoch_ms FROM (SELECT epoch_ms(o_orderdate) AS v FROM orders) a
    UNION ALL SELECT 'updated_by', min(o_custkey) >= 631152000000 AND max(o_custkey) <= 4102444800000 FROM orders""",
)
def epoch_columns(spark, sf_dir):
    orders = layers.table(spark, sf_dir, "orders")
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return profile.detect_epoch_ms(orders.select(millis.alias("created_at"), F.col("o_custkey").alias("updated_by"), "o_orderkey"))
