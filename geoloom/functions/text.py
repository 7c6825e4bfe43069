"""Text and JSON forms of geometries and values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.shapes import let
from geoloom.layer import PARTS, geometry, vertex

# Geometry kinds by upper-case WKT keyword, and their nesting depth in GeoJSON.
KIND_OF_KEYWORD = {
    "POINT": "Point",
    "LINESTRING": "LineString",
    "POLYGON": "Polygon",
    "MULTIPOINT": "MultiPoint",
    "MULTILINESTRING": "MultiLineString",
    "MULTIPOLYGON": "MultiPolygon",
}
DEPTH = {
    "Point": 0,
    "LineString": 1,
    "MultiPoint": 1,
    "Polygon": 2,
    "MultiLineString": 2,
    "MultiPolygon": 3,
}


def _to_vertex(position: Column) -> Column:
    return vertex(F.get(position, F.lit(0)), F.get(position, F.lit(1)))


def _to_path(positions: Column) -> Column:
    return F.transform(positions, _to_vertex)


def parts_from_coordinates(kind: Column, coordinates: Column) -> Column:
    """Nested parts from the text of a GeoJSON ``coordinates`` member; null if malformed."""

    def parse(depth: int) -> Column:
        return F.from_json(coordinates, "array<" * depth + "array<double>" + ">" * depth)

    one = F.array
    parts = (
        F.when(kind == "Point", one(one(one(_to_vertex(parse(0))))))
        .when(kind == "LineString", one(one(_to_path(parse(1)))))
        .when(kind == "MultiPoint", F.transform(parse(1), lambda p: F.array(F.array(_to_vertex(p)))))
        .when(kind == "Polygon", one(F.transform(parse(2), _to_path)))
        .when(kind == "MultiLineString", F.transform(parse(2), lambda path: F.array(_to_path(path))))
        .when(
            kind == "MultiPolygon",
            F.transform(parse(3), lambda rings: F.transform(rings, _to_path)),
        )
    )
    return parts.cast(PARTS)


def _valid(geom: Column) -> Column:
    """A geometry, or null when any coordinate is missing or it has none."""

    def sound(g):
        points = F.flatten(F.flatten(g["parts"]))
        broken = F.exists(points, lambda v: v.isNull() | v["x"].isNull() | v["y"].isNull())
        return F.when(g["parts"].isNotNull() & (F.size(points) > 0) & ~F.coalesce(broken, F.lit(True)), g)

    return let(geom, sound)


def from_geojson(kind: Column, coordinates: Column) -> Column:
    member = F.struct(kind.alias("kind"), coordinates.alias("text"))
    return let(member, lambda m: _valid(geometry(m["kind"], parts_from_coordinates(m["kind"], m["text"]))))


def from_wkt(wkt: Column) -> Column:
    """Geometry from WKT (any case; extra ordinates are dropped); null if malformed."""
    clean = F.trim(F.regexp_replace(wkt, r"(?i)^\s*SRID=\d+;", ""))
    keyword = F.upper(F.regexp_extract(clean, r"(?i)^([a-z]+)", 1))
    kind = F.element_at(
        F.create_map(*[F.lit(v) for item in KIND_OF_KEYWORD.items() for v in item]), keyword
    )
    body = F.regexp_extract(clean, r"(\(.*\))", 1)
    # "1 2, 3 4" -> "[1,2], [3,4]", then brackets for parentheses.
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    listed = F.regexp_replace(body, rf"({number})\s+({number})(?:\s+{number})*", "[$1,$2]")
    listed = F.translate(listed, "()", "[]")
    # MULTIPOINT ((1 2), (3 4)) and MULTIPOINT (1 2, 3 4) mean the same.
    listed = F.when(
        keyword == "MULTIPOINT", F.regexp_replace(listed, r"\[(\[[^\[\]]*\])\](?=\s*[,\]])", "$1")
    ).otherwise(listed)
    # A point's single position carries one bracket pair too many.
    listed = F.when(keyword == "POINT", F.regexp_replace(listed, r"^\[(.*)\]$", "$1")).otherwise(listed)
    return from_geojson(kind, listed)


def _position(v: Column, separator: str) -> Column:
    return F.concat(_number(v["x"]), F.lit(separator), _number(v["y"]))


def _number(value: Column) -> Column:
    """Shortest text of a double, whole numbers without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def _nested_text(geom: Column, separator: str, opening: str, closing: str, point_wrap: bool) -> Column:
    def joined(items, f):
        return F.concat(
            F.lit(opening), F.array_join(F.transform(items, f), ", " if point_wrap else ","), F.lit(closing)
        )

    def position(v):
        text = _position(v, separator)
        return text if point_wrap else F.concat(F.lit("["), text, F.lit("]"))

    def path(p):
        return joined(p, position)

    def first_path(part):
        return F.get(part, F.lit(0))

    kind, parts = geom["kind"], geom["parts"]
    single = first_path(F.get(parts, F.lit(0)))
    point = position(F.get(single, F.lit(0)))
    if point_wrap:
        point = F.concat(F.lit(opening), point, F.lit(closing))
    return (
        F.when(kind == "Point", point)
        .when(kind == "LineString", path(single))
        .when(kind == "MultiPoint", joined(parts, lambda part: position(F.get(first_path(part), F.lit(0)))))
        .when(kind == "Polygon", joined(F.get(parts, F.lit(0)), path))
        .when(kind == "MultiLineString", joined(parts, lambda part: path(first_path(part))))
        .when(kind == "MultiPolygon", joined(parts, lambda part: joined(part, path)))
    )


def to_wkt(geom: Column) -> Column:
    return F.concat(F.upper(geom["kind"]), F.lit(" "), _nested_text(geom, " ", "(", ")", True))


def to_geojson(geom: Column) -> Column:
    return F.concat(
        F.lit('{"type":"'),
        geom["kind"],
        F.lit('","coordinates":'),
        _nested_text(geom, ",", "[", "]", False),
        F.lit("}"),
    )


def to_esri_json(geom: Column) -> Column:
    """``{x,y}``, ``{points}``, ``{paths}`` or ``{rings}``; rings of multipolygons in one list."""

    def pairs(path):
        return F.transform(path, lambda v: F.array(v["x"], v["y"]))

    kind = geom["kind"]
    point = F.flatten(F.flatten(geom["parts"]))[0]
    rings = F.transform(F.flatten(geom["parts"]), pairs)
    return (
        F.when(kind == "Point", F.to_json(F.struct(point["x"].alias("x"), point["y"].alias("y"))))
        .when(kind == "MultiPoint", F.to_json(F.struct(F.flatten(rings).alias("points"))))
        .when(kind.isin("LineString", "MultiLineString"), F.to_json(F.struct(rings.alias("paths"))))
        .when(kind.isin("Polygon", "MultiPolygon"), F.to_json(F.struct(rings.alias("rings"))))
    )


# Unit factors of the display formats.
FEET_PER_METRE = 3.28084
SQUARE_METRES_PER_ACRE = 4046.86


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals and no grouping; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def display_distance(metres: Column) -> Column:
    """``1.23 km (4035 ft)`` above a kilometre, else ``12.3 m (40 ft)``."""
    feet = F.concat(F.lit(" ("), fixed(metres * FEET_PER_METRE, 0), F.lit(" ft)"))
    return F.when(metres > 1000, F.concat(fixed(metres / 1000, 2), F.lit(" km"), feet)).otherwise(
        F.concat(fixed(metres, 1), F.lit(" m"), feet)
    )


def display_area(square_metres: Column) -> Column:
    """``1.234 km² (304.9 acres)`` above a square kilometre, else ``12 m² (0.003 acres)``."""
    acres = square_metres / SQUARE_METRES_PER_ACRE
    return F.when(
        square_metres > 1_000_000,
        F.concat(fixed(square_metres / 1_000_000, 3), F.lit(" km² ("), fixed(acres, 1), F.lit(" acres)")),
    ).otherwise(
        F.concat(fixed(square_metres, 0), F.lit(" m² ("), fixed(acres, 3), F.lit(" acres)"))
    )


def parse_lonlat(coordinate_text: Column) -> Column:
    """struct<lon, lat> from text holding exactly two numbers, separated by commas or blanks.

    Latitude comes first unless the first number can only be a longitude. Null otherwise.
    """
    numbers = F.filter(
        F.transform(F.split(F.trim(coordinate_text), r"[,\s]+"), lambda p: p.try_cast("double")),
        lambda v: v.isNotNull(),
    )
    a, b = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    lon_first = (F.abs(a) > 90) & (F.abs(b) <= 90)
    lon, lat = F.when(lon_first, a).otherwise(b), F.when(lon_first, b).otherwise(a)
    return F.when(F.size(numbers) == 2, F.struct(lon.alias("lon"), lat.alias("lat")))
