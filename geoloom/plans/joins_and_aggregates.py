"""Queries over joins, aggregations and nearest searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import coords, kernels, shapes
from geoloom.layer import BOX, GEOM, Layer, box_layer, with_box
from geoloom.operators import aggregate, joins, nearest, profile, timeline
from geoloom.plans import layers
from geoloom.plans.registry import query, rounded

# Oracle fragments: a point strictly inside a counter-clockwise quad, and a quad against a box.
QUAD_EDGES = ((1, 2), (2, 3), (3, 4), (4, 1))


def _side(a: int, b: int, px: str, py: str) -> str:
    return f"((c.x{b}-c.x{a})*({py}-c.y{a}) - (c.y{b}-c.y{a})*({px}-c.x{a}))"


IN_QUAD = " AND ".join(_side(a, b, "p.lon", "p.lat") + " > 0" for a, b in QUAD_EDGES)
QUAD_BOX = "least(c.x1,c.x4) AS qx0, least(c.y1,c.y2) AS qy0, greatest(c.x2,c.x3) AS qx1, greatest(c.y3,c.y4) AS qy1"
CORNERS = (("z.xmin", "z.ymin"), ("z.xmax", "z.ymin"), ("z.xmax", "z.ymax"), ("z.xmin", "z.ymax"))


def _quad_meets_box(strict: bool) -> str:
    """Separating axes: the box sides and the quad's edges."""
    op, at = (">", "<") if strict else (">=", "<=")
    boxes = (
        f"least(c.x1,c.x4) {at} z.xmax AND greatest(c.x2,c.x3) {op} z.xmin "
        f"AND least(c.y1,c.y2) {at} z.ymax AND greatest(c.y3,c.y4) {op} z.ymin"
    )
    edges = [
        "greatest(" + ", ".join(_side(a, b, x, y) for x, y in CORNERS) + f") {op} 0" for a, b in QUAD_EDGES
    ]
    return boxes + " AND " + " AND ".join(edges)


QUAD_IN_BOX = (
    "least(c.x1,c.x4) >= z.xmin AND greatest(c.x2,c.x3) <= z.xmax "
    "AND least(c.y1,c.y2) >= z.ymin AND greatest(c.y3,c.y4) <= z.ymax"
)
MERCATOR_X = "(radians({lon}) * 6378137e0)"
MERCATOR_Y = "(ln(tan(pi()/4 + radians({lat})/2)) * 6378137e0)"


def mercator_sql(a_lon: str, a_lat: str, b_lon: str, b_lat: str) -> str:
    dx = f"({MERCATOR_X.format(lon=a_lon)} - {MERCATOR_X.format(lon=b_lon)})"
    dy = f"({MERCATOR_Y.format(lat=a_lat)} - {MERCATOR_Y.format(lat=b_lat)})"
    return f"sqrt({dx}*{dx} + {dy}*{dy})"


POINTS_IN_ZONES = (
    "geo_zones z LEFT JOIN geo_points p ON p.lon > z.xmin AND p.lon < z.xmax AND p.lat > z.ymin AND p.lat < z.ymax"
)


@query(
    "o61_aggregate_within",
    f"""SELECT z.zone_id, z.zone_name, count(p.pt_id) AS n, round(sum(p.val), 2) AS total,
      round(avg(p.val), 6) AS mean, min(p.val) AS low, max(p.val) AS high,
      round(stddev_samp(p.val), 4) AS spread
    FROM {POINTS_IN_ZONES} GROUP BY z.zone_id, z.zone_name""",
)
def aggregate_within(spark, sf_dir):
    found = aggregate.aggregate_within(
        layers.points(spark, sf_dir),
        layers.zones(spark, sf_dir),
        {
            "n": ("count", None),
            "total": ("sum", "val"),
            "mean": ("avg", "val"),
            "low": ("min", "val"),
            "high": ("max", "val"),
            "spread": ("stddev", "val"),
        },
        labels=["zone_name"],
    )
    return found.select(
        "zone_id", "zone_name", "n", rounded("total", 2), rounded("mean", 6), "low", "high", rounded("spread", 4)
    )


@query(
    "o61_aggregate_within_filtered",
    f"""SELECT z.zone_id, round(max(p.val), 2) AS high FROM {POINTS_IN_ZONES} AND p.category = 'BUILDING'
    WHERE z.zone_class <> 2 GROUP BY z.zone_id ORDER BY high DESC NULLS LAST, z.zone_id LIMIT 12""",
)
def aggregate_within_filtered(spark, sf_dir):
    return aggregate.aggregate_within(
        layers.points(spark, sf_dir),
        layers.zones(spark, sf_dir),
        {"high": ("max", "val")},
        where_points=F.col("category") == "BUILDING",
        where_zones=F.col("zone_class") != 2,
        limit=12,
    )


@query(
    "o61_aggregate_within_parcels",
    f"""SELECT c.parcel_id, count(p.pt_id) AS n, round(coalesce(sum(p.val), 0), 2) AS total
    FROM geo_parcels c LEFT JOIN geo_points p ON {IN_QUAD} GROUP BY c.parcel_id""",
)
def aggregate_within_parcels(spark, sf_dir):
    found = aggregate.aggregate_within(
        layers.points(spark, sf_dir),
        layers.parcels(spark, sf_dir),
        {"n": ("count", None), "total": ("sum", "val")},
    )
    return found.select("parcel_id", "n", F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query(
    "o42_point_in_polygon",
    f"""SELECT p.pt_id, p.category, c.parcel_id AS right_parcel_id, c.parcel_type AS right_parcel_type
    FROM geo_points p JOIN geo_parcels c ON {IN_QUAD}""",
)
def point_in_polygon(spark, sf_dir):
    return joins.spatial_join(
        layers.points(spark, sf_dir),
        layers.parcels(spark, sf_dir),
        "within",
        left_columns=["pt_id", "category"],
        right_columns=["parcel_id", "parcel_type"],
    )


@query(
    "o42_event_in_zone",
    """SELECT e.event_id, z.zone_id AS right_zone_id FROM geo_events e JOIN geo_zones z
    ON e.lon > z.xmin AND e.lon < z.xmax AND e.lat > z.ymin AND e.lat < z.ymax""",
)
def event_in_zone(spark, sf_dir):
    return joins.spatial_join(
        layers.events(spark, sf_dir),
        layers.zones(spark, sf_dir),
        "within",
        left_columns=["event_id"],
        right_columns=["zone_id"],
    )


def _parcels_zones(spark, sf_dir, predicate):
    return joins.spatial_join(
        layers.parcels(spark, sf_dir),
        layers.zones(spark, sf_dir),
        predicate,
        left_columns=["parcel_id"],
        right_columns=["zone_id"],
    )


PARCEL_ZONE = "SELECT c.parcel_id, z.zone_id AS right_zone_id FROM geo_parcels c JOIN geo_zones z ON "


@query("o41_join_intersects", PARCEL_ZONE + _quad_meets_box(strict=False))
def join_intersects(spark, sf_dir):
    return _parcels_zones(spark, sf_dir, "intersects")


@query("o41_join_within", PARCEL_ZONE + QUAD_IN_BOX)
def join_within(spark, sf_dir):
    return _parcels_zones(spark, sf_dir, "within")


@query("o41_join_overlaps", PARCEL_ZONE + _quad_meets_box(strict=True) + f" AND NOT ({QUAD_IN_BOX})")
def join_overlaps(spark, sf_dir):
    return _parcels_zones(spark, sf_dir, "overlaps")


@query(
    "o41_join_contains",
    f"SELECT z.zone_id, c.parcel_id AS right_parcel_id FROM geo_zones z JOIN geo_parcels c ON {QUAD_IN_BOX}",
)
def join_contains(spark, sf_dir):
    return joins.spatial_join(
        layers.zones(spark, sf_dir),
        layers.parcels(spark, sf_dir),
        "contains",
        left_columns=["zone_id"],
        right_columns=["parcel_id"],
    )


# The views number the rows and columns of the zone tiling, so that shared edges compare exactly.
@query(
    "o41_join_touches",
    """SELECT a.zone_id, b.zone_id AS right_zone_id FROM geo_zones a JOIN geo_zones b ON a.zone_id <> b.zone_id
    AND abs((a.zone_id % 5) - (b.zone_id % 5)) <= 1
    AND abs(CAST(floor(a.zone_id/5e0) AS BIGINT) - CAST(floor(b.zone_id/5e0) AS BIGINT)) <= 1""",
)
def join_touches(spark, sf_dir):
    zones = layers.zones(spark, sf_dir)
    return joins.spatial_join(zones, zones, "touches", left_columns=["zone_id"], right_columns=["zone_id"])


SEGMENTS = """segments AS (SELECT line_id, lon AS ax, lat AS ay,
    lead(lon) OVER (PARTITION BY line_id ORDER BY seq) AS bx,
    lead(lat) OVER (PARTITION BY line_id ORDER BY seq) AS by_ FROM geo_vertices)"""


def _segment_side(px: str, py: str) -> str:
    return f"((s.bx-s.ax)*({py}-s.ay) - (s.by_-s.ay)*({px}-s.ax))"


def _segment_meets_open_box() -> str:
    sides = ", ".join(_segment_side(x, y) for x, y in CORNERS)
    return (
        "least(s.ax,s.bx) < z.xmax AND greatest(s.ax,s.bx) > z.xmin "
        "AND least(s.ay,s.by_) < z.ymax AND greatest(s.ay,s.by_) > z.ymin "
        f"AND least({sides}) < 0 AND greatest({sides}) > 0"
    )


@query(
    "o41_join_crosses",
    f"""WITH {SEGMENTS}, inside AS (SELECT DISTINCT s.line_id, z.zone_id FROM segments s JOIN geo_zones z
      ON s.bx IS NOT NULL AND {_segment_meets_open_box()}),
    outside AS (SELECT DISTINCT v.line_id, z.zone_id FROM geo_vertices v JOIN geo_zones z
      ON v.lon < z.xmin OR v.lon > z.xmax OR v.lat < z.ymin OR v.lat > z.ymax)
    SELECT i.line_id, i.zone_id AS right_zone_id FROM inside i
    JOIN outside o ON i.line_id = o.line_id AND i.zone_id = o.zone_id""",
)
def join_crosses(spark, sf_dir):
    return joins.spatial_join(
        layers.lines(spark, sf_dir),
        layers.zones(spark, sf_dir),
        "crosses",
        left_columns=["line_id"],
        right_columns=["zone_id"],
    )


@query(
    "o41_join_dwithin",
    f"""SELECT a.pt_id, b.pt_id AS right_pt_id FROM geo_points a JOIN geo_points b
    ON {mercator_sql("a.lon", "a.lat", "b.lon", "b.lat")} <= 5000e0""",
)
def join_dwithin(spark, sf_dir):
    points = layers.points(spark, sf_dir)
    return joins.spatial_join(
        points, points, "dwithin", distance=5000.0, left_columns=["pt_id"], right_columns=["pt_id"]
    )


HAVERSINE_SQL = """2 * 6371000e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"""


@query(
    "o41_join_dwithin_haversine",
    f"SELECT a.pt_id, b.pt_id AS right_pt_id FROM geo_points a JOIN geo_points b ON {HAVERSINE_SQL} <= 4000e0",
)
def join_dwithin_haversine(spark, sf_dir):
    points = layers.points(spark, sf_dir)
    return joins.spatial_join(
        points, points, "dwithin", distance=4000.0, metric="haversine", left_columns=["pt_id"], right_columns=["pt_id"]
    )


@query(
    "o83_few_times",
    """WITH few AS (SELECT DISTINCT date_trunc('day', ts) AS ts FROM events),
    facts AS (SELECT date_diff('second', min(ts), max(ts)) AS seconds, count(*) AS n FROM few)
    SELECT round(least(greatest(seconds / least(n, 200), 60), seconds), 6) AS step FROM facts""",
)
def few_times(spark, sf_dir):
    """The slider's step over a range with fewer times than steps."""
    days = layers.table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("ts"))
    axis = timeline.time_axis(days, "ts")
    return spark.range(1).select(F.round(F.lit(axis.step_seconds), 6).alias("step"))


def _segment_meets_quad() -> str:
    quad = ["greatest(" + _side(a, b, "s.ax", "s.ay") + ", " + _side(a, b, "s.bx", "s.by_") + ") >= 0" for a, b in QUAD_EDGES]
    sides = ", ".join(_segment_side(f"c.x{i}", f"c.y{i}") for i in (1, 2, 3, 4))
    boxes = (
        "least(s.ax,s.bx) <= greatest(c.x2,c.x3) AND greatest(s.ax,s.bx) >= least(c.x1,c.x4) "
        "AND least(s.ay,s.by_) <= greatest(c.y3,c.y4) AND greatest(s.ay,s.by_) >= least(c.y1,c.y2)"
    )
    return f"{boxes} AND {' AND '.join(quad)} AND least({sides}) <= 0 AND greatest({sides}) >= 0"


@query(
    "o43_line_polygon",
    f"""WITH {SEGMENTS} SELECT DISTINCT s.line_id, c.parcel_id AS right_parcel_id
    FROM segments s JOIN geo_parcels c ON s.bx IS NOT NULL AND {_segment_meets_quad()}""",
)
def line_polygon(spark, sf_dir):
    return joins.spatial_join(
        layers.lines(spark, sf_dir),
        layers.parcels(spark, sf_dir),
        "intersects",
        left_columns=["line_id"],
        right_columns=["parcel_id"],
    )


@query(
    "o44_buffer_join",
    f"""WITH gon AS (SELECT i, cos(i*2*pi()/32)*0.02e0 AS dx, sin(i*2*pi()/32)*0.02e0 AS dy,
      cos((i+1)*2*pi()/32)*0.02e0 AS ex, sin((i+1)*2*pi()/32)*0.02e0 AS ey FROM range(32) t(i)),
    near AS (SELECT p.pt_id, p.category, p.lon, p.lat, c.* FROM geo_points p JOIN geo_parcels c
      ON least(c.x1,c.x4) <= p.lon+0.02e0 AND greatest(c.x2,c.x3) >= p.lon-0.02e0
      AND least(c.y1,c.y2) <= p.lat+0.02e0 AND greatest(c.y3,c.y4) >= p.lat-0.02e0),
    tested AS (SELECT c.pt_id, c.category, c.parcel_id,
      min(greatest({", ".join(f"((g.ex-g.dx)*(c.y{i}-c.lat-g.dy) - (g.ey-g.dy)*(c.x{i}-c.lon-g.dx))" for i in (1, 2, 3, 4))})) AS gon_side,
      {", ".join(f"max({_side(a, b, '(c.lon+g.dx)', '(c.lat+g.dy)')}) AS side{a}" for a, b in QUAD_EDGES)}
      FROM near c CROSS JOIN gon g GROUP BY c.pt_id, c.category, c.parcel_id)
    SELECT pt_id, category, count(*) AS overlapping_parcels FROM tested
    WHERE gon_side >= 0 AND side1 >= 0 AND side2 >= 0 AND side3 >= 0 AND side4 >= 0
    GROUP BY pt_id, category HAVING count(*) > 1""",
)
def buffer_join(spark, sf_dir):
    points = layers.points(spark, sf_dir)
    circle = shapes.circle(F.col("xmin"), F.col("ymin"), F.lit(0.02))
    buffers = Layer(with_box(points.df.withColumn(GEOM, circle)), "pt_id", "polygon")
    pairs = joins.spatial_pairs(
        buffers, layers.parcels(spark, sf_dir), "intersects", left_columns=["category"], right_columns=[]
    )
    counted = pairs.groupBy(F.col("l_pt_id").alias("pt_id"), F.col("l_category").alias("category")).agg(
        F.count("*").alias("overlapping_parcels")
    )
    return counted.filter(F.col("overlapping_parcels") > 1)


LINE_CENTROIDS = f"""{SEGMENTS}, mids AS (SELECT line_id, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS len,
      (ax+bx)/2 AS mx, (ay+by_)/2 AS my FROM segments WHERE bx IS NOT NULL),
    centroids AS (SELECT line_id, sum(len) AS len, CASE WHEN sum(len) > 0 THEN sum(len*mx)/sum(len) ELSE min(mx) END AS cx,
      CASE WHEN sum(len) > 0 THEN sum(len*my)/sum(len) ELSE min(my) END AS cy FROM mids GROUP BY line_id)"""


@query(
    "o45_nearest_join",
    f"""WITH {LINE_CENTROIDS}, pairs AS (SELECT c.line_id, p.pt_id,
      sqrt((c.cx-p.lon)*(c.cx-p.lon)+(c.cy-p.lat)*(c.cy-p.lat)) AS d FROM centroids c CROSS JOIN geo_points p)
    SELECT line_id, round(min(d) * 111.32e0, 4) AS dist_km FROM pairs GROUP BY line_id""",
)
def nearest_join(spark, sf_dir):
    found = nearest.nearest_join(
        layers.lines(spark, sf_dir), layers.points(spark, sf_dir), left_columns=["line_id"], right_columns=[]
    )
    return found.select("line_id", F.round(F.col("distance") * coords.KM_PER_DEGREE, 4).alias("dist_km"))


@query(
    "o45_nearest_join_k",
    f"""WITH pairs AS (SELECT e.event_id, z.zone_id AS right_zone_id, {{d}} AS d
      FROM geo_events e CROSS JOIN (SELECT zone_id, (xmin+xmax)/2 AS zx, (ymin+ymax)/2 AS zy FROM geo_zones) z),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, right_zone_id) AS rank FROM pairs)
    SELECT event_id, right_zone_id, rank, round(d, 3) AS distance FROM ranked WHERE rank <= 3""".replace(
        "{d}", mercator_sql("e.lon", "e.lat", "z.zx", "z.zy")
    ),
)
def nearest_join_k(spark, sf_dir):
    from geoloom.layer import point_layer

    zones = layers.view(spark, sf_dir, "geo_zones", "nation")
    middles = zones.select(
        "zone_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("lon"), ((F.col("ymin") + F.col("ymax")) / 2).alias("lat")
    )
    found = nearest.nearest_join(
        layers.events(spark, sf_dir),
        point_layer(middles, "zone_id"),
        k=3,
        metric="mercator",
        left_columns=["event_id"],
        right_columns=["zone_id"],
    )
    return found.select("event_id", "right_zone_id", F.col("rank").cast("long").alias("rank"), rounded("distance", 3))


@query(
    "o45_nearest_polygon",
    """WITH boxes AS (SELECT parcel_id, least(x1,x4) AS x0, least(y1,y2) AS y0, greatest(x2,x3) AS x1, greatest(y3,y4) AS y1
      FROM geo_parcels)
    SELECT p.pt_id, round(min(sqrt(greatest(b.x0-p.lon, p.lon-b.x1, 0)*greatest(b.x0-p.lon, p.lon-b.x1, 0)
      + greatest(b.y0-p.lat, p.lat-b.y1, 0)*greatest(b.y0-p.lat, p.lat-b.y1, 0))), 8) AS distance
    FROM geo_points p CROSS JOIN boxes b GROUP BY p.pt_id""",
)
def nearest_polygon(spark, sf_dir):
    """Nearest parcel envelope of every point, by distance to the shape and not to its centre."""
    parcels = layers.parcels(spark, sf_dir)
    envelopes = box_layer(parcels.df.select("parcel_id", *BOX), "parcel_id")
    found = nearest.nearest_join(
        layers.points(spark, sf_dir), envelopes, left_columns=["pt_id"], right_columns=[]
    )
    return found.select("pt_id", rounded("distance", 8))


@query(
    "o46_left_join",
    f"""SELECT z.zone_id, z.zone_name, p.pt_id AS right_pt_id FROM {POINTS_IN_ZONES} AND p.val < -500""",
)
def left_join(spark, sf_dir):
    points = layers.points(spark, sf_dir)
    return joins.spatial_join(
        layers.zones(spark, sf_dir),
        points.with_df(points.df.filter(F.col("val") < -500)),
        "contains",
        how="left",
        left_columns=["zone_id", "zone_name"],
        right_columns=["pt_id"],
    )


@query(
    "o46_points_per_parcel",
    f"""SELECT c.parcel_id, count(p.pt_id) AS points_inside FROM geo_parcels c LEFT JOIN geo_points p ON {IN_QUAD}
    GROUP BY c.parcel_id HAVING count(p.pt_id) > 0""",
)
def points_per_parcel(spark, sf_dir):
    found = aggregate.aggregate_within(
        layers.points(spark, sf_dir), layers.parcels(spark, sf_dir), {"points_inside": ("count", None)}
    )
    return found.filter(F.col("points_inside") > 0)


NEAR_MACHINERY = f"""EXISTS (SELECT 1 FROM geo_points b WHERE b.category = 'MACHINERY'
    AND {mercator_sql("a.lon", "a.lat", "b.lon", "b.lat")} <= 8000e0)"""


def _near_machinery(spark, sf_dir, how):
    points = layers.points(spark, sf_dir)
    machinery = points.with_df(points.df.filter(F.col("category") == "MACHINERY"))
    return joins.spatial_join(points, machinery, "dwithin", distance=8000.0, how=how, left_columns=["pt_id", "category"])


@query("o46b_semi_join", f"SELECT a.pt_id, a.category FROM geo_points a WHERE {NEAR_MACHINERY}")
def semi_join(spark, sf_dir):
    return _near_machinery(spark, sf_dir, "left_semi")


@query("o46b_anti_join", f"SELECT a.pt_id, a.category FROM geo_points a WHERE NOT {NEAR_MACHINERY}")
def anti_join(spark, sf_dir):
    return _near_machinery(spark, sf_dir, "left_anti")


@query(
    "o46b_points_outside_parcels",
    f"SELECT p.pt_id FROM geo_points p WHERE NOT EXISTS (SELECT 1 FROM geo_parcels c WHERE {IN_QUAD})",
)
def points_outside_parcels(spark, sf_dir):
    points, parcels = layers.points(spark, sf_dir), layers.parcels(spark, sf_dir)
    return joins.spatial_join(points, parcels, "within", how="left_anti", left_columns=["pt_id"])


@query(
    "o57_overlay_area",
    """WITH boxes AS (SELECT parcel_id, least(x1,x4) AS x0, least(y1,y2) AS y0, greatest(x2,x3) AS x1, greatest(y3,y4) AS y1
      FROM geo_parcels)
    SELECT b.parcel_id, z.zone_id AS right_zone_id,
      round((least(b.x1,z.xmax)-greatest(b.x0,z.xmin))*(least(b.y1,z.ymax)-greatest(b.y0,z.ymin)), 10) AS shared_area
    FROM boxes b JOIN geo_zones z ON b.x0 <= z.xmax AND b.x1 >= z.xmin AND b.y0 <= z.ymax AND b.y1 >= z.ymin""",
)
def overlay_area(spark, sf_dir):
    parcels = layers.parcels(spark, sf_dir)
    envelopes = box_layer(parcels.df.select("parcel_id", *BOX), "parcel_id")
    found = joins.overlay(envelopes, layers.zones(spark, sf_dir))
    return found.select("parcel_id", "right_zone_id", rounded("shared_area", 10))


# What two convex polygons share is bounded by the stretches of either's edges inside the other one, and such a stretch is
# bounded by the other one's half-planes.
CONVEX_SHARED_SQL = """quads AS (SELECT parcel_id, i, x, y FROM geo_parcels c CROSS JOIN range(4) t(i),
      LATERAL (SELECT CASE i WHEN 0 THEN c.x1 WHEN 1 THEN c.x2 WHEN 2 THEN c.x3 ELSE c.x4 END AS x,
        CASE i WHEN 0 THEN c.y1 WHEN 1 THEN c.y2 WHEN 2 THEN c.y3 ELSE c.y4 END AS y) v),
    corners AS (SELECT zone_id, i, CASE WHEN i IN (1, 2) THEN xmax ELSE xmin END AS x, CASE WHEN i IN (2, 3) THEN ymax ELSE ymin END AS y
      FROM geo_zones CROSS JOIN range(4) t(i)),
    pe AS (SELECT a.parcel_id, a.i, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy FROM quads a JOIN quads b ON a.parcel_id = b.parcel_id AND b.i = (a.i + 1) % 4),
    ze AS (SELECT a.zone_id, a.i, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy FROM corners a JOIN corners b ON a.zone_id = b.zone_id AND b.i = (a.i + 1) % 4),
    near AS (SELECT parcel_id, zone_id FROM geo_parcels c JOIN geo_zones z ON least(c.x1,c.x4) <= z.xmax AND greatest(c.x2,c.x3) >= z.xmin
      AND least(c.y1,c.y2) <= z.ymax AND greatest(c.y3,c.y4) >= z.ymin),
    sides AS (SELECT n.parcel_id, n.zone_id, 0 AS side, e.i, e.x, e.y, e.dx, e.dy, h.dx*(e.y - h.y) - h.dy*(e.x - h.x) AS c0, h.dx*e.dy - h.dy*e.dx AS c1
      FROM near n JOIN pe e USING (parcel_id) JOIN ze h ON h.zone_id = n.zone_id
      UNION ALL SELECT n.parcel_id, n.zone_id, 1, e.i, e.x, e.y, e.dx, e.dy, h.dx*(e.y - h.y) - h.dy*(e.x - h.x), h.dx*e.dy - h.dy*e.dx
      FROM near n JOIN ze e USING (zone_id) JOIN pe h ON h.parcel_id = n.parcel_id),
    stretches AS (SELECT parcel_id, zone_id, any_value(x) AS x, any_value(y) AS y, any_value(dx) AS dx, any_value(dy) AS dy,
      greatest(0e0, max(CASE WHEN c1 > 0 THEN -c0/c1 WHEN c1 = 0 AND c0 < 0 THEN 2e0 END)) AS t0,
      least(1e0, min(CASE WHEN c1 < 0 THEN -c0/c1 END)) AS t1 FROM sides GROUP BY parcel_id, zone_id, side, i),
    shares AS (SELECT parcel_id, zone_id, sum((t1 - t0) * ((x + 105e0)*dy - (y - 39e0)*dx)/2) AS shared_area FROM stretches WHERE t1 > t0 GROUP BY parcel_id, zone_id)"""


@query(
    "o57_overlay_parcels",
    f"""WITH {CONVEX_SHARED_SQL} SELECT parcel_id, round(sum(shared_area), 9) AS shared_area FROM shares GROUP BY parcel_id HAVING sum(shared_area) > 1e-12""",
)
def overlay_parcels(spark, sf_dir):
    """The part of every parcel that lies in the zones, those that stick out of them included."""
    shares = joins.overlay(layers.parcels(spark, sf_dir), layers.zones(spark, sf_dir))
    return shares.groupBy("parcel_id").agg(F.round(F.sum("shared_area"), 9).alias("shared_area")).where("shared_area > 0")


@query(
    "o57_overlay_geometry",
    f"""WITH {CONVEX_SHARED_SQL},
    whole AS (SELECT parcel_id, sum((x + 105e0)*dy - (y - 39e0)*dx)/2 AS area FROM pe GROUP BY parcel_id)
    SELECT parcel_id, zone_id AS right_zone_id, round(shared_area, 10) AS shared_area, round(area - shared_area, 10) + 0e0 AS rest_area
    FROM shares JOIN whole USING (parcel_id) WHERE shared_area > 1e-12""",
)
def overlay_geometry(spark, sf_dir):
    """Areas of the clipped shapes themselves: what each parcel shares with each zone, and what of it lies outside."""
    found = joins.overlay_geometry(layers.parcels(spark, sf_dir), layers.zones(spark, sf_dir))
    rest = F.coalesce(kernels.measure(F.col("rest"))["area"], F.lit(0.0))
    return found.select("parcel_id", "right_zone_id", F.round(kernels.measure(F.col(GEOM))["area"], 10).alias("shared_area"), F.round(rest, 10).alias("rest_area"))


@query(
    "o57_overlay_corners",
    """WITH boxes AS (SELECT parcel_id, least(x1,x4) AS x0, least(y1,y2) AS y0, greatest(x2,x3) AS x1, greatest(y3,y4) AS y1 FROM geo_parcels),
    shares AS (SELECT b.parcel_id, z.zone_id, greatest(b.x0, z.xmin) AS x0, greatest(b.y0, z.ymin) AS y0, least(b.x1, z.xmax) AS x1, least(b.y1, z.ymax) AS y1,
      (b.x0 < z.xmin - 1e-9)::INT + (b.x1 > z.xmax + 1e-9)::INT AS h, (b.y0 < z.ymin - 1e-9)::INT + (b.y1 > z.ymax + 1e-9)::INT AS v
      FROM boxes b JOIN geo_zones z ON b.x0 < z.xmax - 1e-9 AND b.x1 > z.xmin + 1e-9 AND b.y0 < z.ymax - 1e-9 AND b.y1 > z.ymin + 1e-9)
    SELECT parcel_id, zone_id AS right_zone_id, concat_ws(' ', round(x0, 6), round(y0, 6), round(x1, 6), round(y0, 6), round(x1, 6), round(y1, 6), round(x0, 6), round(y1, 6)) AS corners,
      CASE WHEN h + v = 0 THEN 0 WHEN h = 0 OR v = 0 THEN 4 WHEN h + v = 2 THEN 6 ELSE 8 END AS rest_corners FROM shares""",
)
def overlay_corners(spark, sf_dir):
    """Corner lists of what the parcels' envelopes share with the zones, from the leftmost, lowest corner on."""
    parcels = layers.parcels(spark, sf_dir)
    envelopes = box_layer(parcels.df.select("parcel_id", *BOX), "parcel_id")
    found = joins.overlay_geometry(envelopes, layers.zones(spark, sf_dir))
    ring = F.col(f"{GEOM}.parts")[0][0]
    numbers = F.flatten(F.transform(F.slice(ring, 1, F.size(ring) - 1), lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6))))
    return found.select(
        "parcel_id",
        "right_zone_id",
        F.array_join(F.transform(numbers, lambda v: v.cast("string")), " ").alias("corners"),
        F.when(F.col("rest").isNull(), 0).otherwise(F.size(F.col("rest.parts")[0][0]) - 1).alias("rest_corners"),
    )


@query(
    "o59_nearest_k",
    f"""SELECT pt_id, category, round({mercator_sql("lon", "lat", "-104.99e0", "39.74e0")}, 4) AS distance_meters
    FROM geo_points ORDER BY {mercator_sql("lon", "lat", "-104.99e0", "39.74e0")}, pt_id LIMIT 10""",
)
def nearest_k(spark, sf_dir):
    found = nearest.nearest(layers.points(spark, sf_dir), -104.99, 39.74, k=10)
    return found.select("pt_id", "category", rounded("distance_meters", 4))


@query(
    "o59_nearest_k_filtered",
    f"""SELECT pt_id, round({mercator_sql("lon", "lat", "-105.08e0", "40.59e0")}, 4) AS distance_meters
    FROM geo_points WHERE category = 'BUILDING' AND {mercator_sql("lon", "lat", "-105.08e0", "40.59e0")} <= 60000e0
    ORDER BY distance_meters, pt_id LIMIT 100""",
)
def nearest_k_filtered(spark, sf_dir):
    found = nearest.nearest(
        layers.points(spark, sf_dir), -105.08, 40.59, k=500, max_distance=60000.0, where=F.col("category") == "BUILDING"
    )
    return found.select("pt_id", rounded("distance_meters", 4))


@query(
    "o59_nearest_polygon_k",
    f"""WITH d AS (SELECT zone_id, {mercator_sql("-112e0", "36e0", "greatest(least(-112e0, xmax), xmin)", "greatest(least(36e0, ymax), ymin)")} AS d
      FROM geo_zones) SELECT zone_id, round(d, 4) AS distance_meters FROM d ORDER BY d, zone_id LIMIT 4""",
)
def nearest_polygon_k(spark, sf_dir):
    found = nearest.nearest(layers.zones(spark, sf_dir), -112.0, 36.0, k=4)
    return found.select("zone_id", rounded("distance_meters", 4))


@query(
    "o62_grid_bins",
    """SELECT round((CAST(floor(lon/0.1e0) AS BIGINT)+0.5e0)*0.1e0, 6) AS lon, round((CAST(floor(lat/0.1e0) AS BIGINT)+0.5e0)*0.1e0, 6) AS lat,
    count(*) AS feature_count FROM geo_events GROUP BY CAST(floor(lon/0.1e0) AS BIGINT), CAST(floor(lat/0.1e0) AS BIGINT)""",
)
def grid_bins(spark, sf_dir):
    bins = aggregate.grid_bins(layers.events(spark, sf_dir), 0.1)
    return bins.select(rounded("lon", 6), rounded("lat", 6), "feature_count")


QUAD_CENTROID = """SELECT parcel_id, a, (x1+x2)*k12 + (x2+x3)*k23 + (x3+x4)*k34 + (x4+x1)*k41 AS sx,
      (y1+y2)*k12 + (y2+y3)*k23 + (y3+y4)*k34 + (y4+y1)*k41 AS sy, ox, oy FROM (
      SELECT *, k12+k23+k34+k41 AS a FROM (
        SELECT *, x1*y2-x2*y1 AS k12, x2*y3-x3*y2 AS k23, x3*y4-x4*y3 AS k34, x4*y1-x1*y4 AS k41 FROM (
          SELECT parcel_id, x1 AS ox, y1 AS oy, 0e0 AS x1, 0e0 AS y1, x2-x1 AS x2, y2-y1 AS y2, x3-x1 AS x3, y3-y1 AS y3,
            x4-x1 AS x4, y4-y1 AS y4 FROM geo_parcels) q0) q1) q2"""


@query(
    "o62_grid_bins_polygons",
    f"""WITH middles AS (SELECT parcel_id, ox + sx/(3*a) AS cx, oy + sy/(3*a) AS cy FROM ({QUAD_CENTROID}) q)
    SELECT round((CAST(floor(cx/0.25e0) AS BIGINT)+0.5e0)*0.25e0, 6) AS lon, round((CAST(floor(cy/0.25e0) AS BIGINT)+0.5e0)*0.25e0, 6) AS lat,
    count(*) AS feature_count FROM middles GROUP BY CAST(floor(cx/0.25e0) AS BIGINT), CAST(floor(cy/0.25e0) AS BIGINT)""",
)
def grid_bins_polygons(spark, sf_dir):
    bins = aggregate.grid_bins(layers.parcels(spark, sf_dir), 0.25)
    return bins.select(rounded("lon", 6), rounded("lat", 6), "feature_count")


@query(
    "o51_hull_by_category",
    """WITH pts AS (SELECT DISTINCT category, lon, lat FROM geo_points),
    edges AS (SELECT a.category, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by_ FROM pts a JOIN pts b
      ON a.category = b.category AND (a.lon <> b.lon OR a.lat <> b.lat)),
    hull AS (SELECT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM pts r WHERE r.category = e.category
      AND ((e.bx-e.ax)*(r.lat-e.ay) - (e.by_-e.ay)*(r.lon-e.ax) < -1e-13
        OR (abs((e.bx-e.ax)*(r.lat-e.ay) - (e.by_-e.ay)*(r.lon-e.ax)) <= 1e-13
          AND (r.lon < least(e.ax,e.bx) OR r.lon > greatest(e.ax,e.bx) OR r.lat < least(e.ay,e.by_) OR r.lat > greatest(e.ay,e.by_)))))),
    areas AS (SELECT category, sum((ax+105)*(by_-39) - (bx+105)*(ay-39))/2 AS area FROM hull GROUP BY category)
    SELECT a.category, n.point_count, round(a.area*111.32e0*111.32e0, 2) AS hull_area_sqkm FROM areas a
    JOIN (SELECT category, count(*) AS point_count FROM geo_points GROUP BY category) n ON a.category = n.category""",
)
def hull_by_category(spark, sf_dir):
    hulls = aggregate.hull_by(layers.points(spark, sf_dir), ["category"])
    return hulls.select("category", "point_count", rounded("hull_area_sqkm", 2))


@query(
    "o70_group_by",
    """SELECT split_part(o_orderpriority, '-', 1) AS priority, o_orderstatus AS status, count(*) AS n,
      round(avg(o_totalprice), 2) AS mean_price, round(min(o_totalprice), 0) AS low_price, round(max(o_totalprice), 0) AS high_price
    FROM orders GROUP BY 1, 2 HAVING count(*) > 3""",
)
def group_by(spark, sf_dir):
    orders = layers.table(spark, sf_dir, "orders")
    grouped = orders.groupBy(
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("priority"), F.col("o_orderstatus").alias("status")
    ).agg(
        F.count("*").alias("n"),
        F.round(F.avg("o_totalprice"), 2).alias("mean_price"),
        F.round(F.min("o_totalprice"), 0).alias("low_price"),
        F.round(F.max("o_totalprice"), 0).alias("high_price"),
    )
    return grouped.filter(F.col("n") > 3)


@query(
    "o71_zone_density",
    f"""SELECT z.zone_id, count(p.pt_id) AS n, round((z.xmax-z.xmin)*(z.ymax-z.ymin), 8) AS area,
      round(count(p.pt_id)/((z.xmax-z.xmin)*(z.ymax-z.ymin)), 4) AS density
    FROM {POINTS_IN_ZONES} GROUP BY z.zone_id, z.xmin, z.ymin, z.xmax, z.ymax""",
)
def zone_density(spark, sf_dir):
    found = aggregate.zone_density(layers.points(spark, sf_dir), layers.zones(spark, sf_dir))
    return found.select("zone_id", "n", rounded("area", 8), rounded("density", 4))


@query(
    "o71_busy_parcel_area",
    f"""WITH busy AS (SELECT c.parcel_id FROM geo_parcels c JOIN geo_points p ON {IN_QUAD}
      GROUP BY c.parcel_id HAVING count(*) >= 1)
    SELECT c.parcel_type, count(*) AS parcels, round(sum(0.5e0*abs((c.x2-c.x1)*(c.y3-c.y1)-(c.x3-c.x1)*(c.y2-c.y1)
      + (c.x3-c.x1)*(c.y4-c.y1)-(c.x4-c.x1)*(c.y3-c.y1))), 9) AS total_area
    FROM geo_parcels c JOIN busy b ON b.parcel_id = c.parcel_id GROUP BY c.parcel_type""",
)
def busy_parcel_area(spark, sf_dir):
    """Total area, by type, of the parcels that hold any point."""
    parcels = layers.parcels(spark, sf_dir)
    busy = joins.spatial_join(
        parcels, layers.points(spark, sf_dir), "contains", how="left_semi", left_columns=["parcel_id", "parcel_type", GEOM]
    )
    measured = busy.withColumn("_m", kernels.measure(F.col(GEOM)))
    return measured.groupBy("parcel_type").agg(
        F.count("*").alias("parcels"), F.round(F.sum("_m.area"), 9).alias("total_area")
    )


@query(
    "o72_geometry_kinds",
    """SELECT 'lines' AS table_name, 'LineString' AS kind, count(*) AS n FROM
      (SELECT line_id FROM geo_vertices GROUP BY line_id HAVING count(*) > 1) l
    UNION ALL SELECT 'parcels', 'Polygon', count(*) FROM geo_parcels
    UNION ALL SELECT 'points', 'Point', count(*) FROM geo_points""",
)
def geometry_kinds(spark, sf_dir):
    return profile.geometry_kinds(
        {
            "points": layers.points(spark, sf_dir),
            "lines": layers.lines(spark, sf_dir),
            "parcels": layers.parcels(spark, sf_dir),
        }
    )


@query(
    "o74_scorecard",
    """WITH cases AS (SELECT d.lang, d.source, coalesce(l.quality = 1, true) AND coalesce(l.toxic = 0, true) AS passed
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    sums AS (SELECT 'lang' AS dimension, lang AS value, count(*) AS total, count(*) FILTER (WHERE passed) AS passed FROM cases GROUP BY lang
      UNION ALL SELECT 'source', source, count(*), count(*) FILTER (WHERE passed) FROM cases GROUP BY source
      UNION ALL SELECT 'overall', 'all', count(*), count(*) FILTER (WHERE passed) FROM cases)
    SELECT dimension, value, total, passed, total - passed AS failed, CAST(round(passed*100.0e0/total, 0) AS BIGINT) AS rate FROM sums""",
)
def scorecard(spark, sf_dir):
    documents = layers.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = layers.table(spark, sf_dir, "labels")
    cases = documents.join(labels, "doc_id", "left").withColumns(
        {"good": F.col("quality") == 1, "clean": F.col("toxic") == 0}
    )
    return aggregate.scorecard(cases, ["good", "clean"], ["lang", "source"])
