"""Writing layers: GeoJSON, CSV, GeoParquet, Esri-style features, quantised coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import codec, kernels, text
from geoloom.layer import BOX, GEOM, Layer
from geoloom.operators.profile import TEMPORAL_TYPES
from geoloom.operators.transform import flatten_structs
from geoloom.sources import geoparquet

# Fixed value: the quantisation grid.
RESOLUTION = 1e8


def geojson_features(
    layer: Layer, columns: list[str] | None = None, where: Column | str | None = None, limit: int | None = None
) -> DataFrame:
    """One GeoJSON Feature (text) per row, with the chosen or all attributes as properties."""
    rows = layer.df if where is None else layer.df.filter(where)
    if limit is not None:
        rows = rows.orderBy(layer.id).limit(limit)
    names = layer.attributes if columns is None else columns
    properties = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    shape = F.coalesce(text.to_geojson(F.col(GEOM)), F.lit("null"))
    feature = F.concat(
        F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")
    )
    return rows.select(F.col(layer.id), feature.alias("feature"))


def write_geojson(
    layer: Layer,
    path: str,
    source: str,
    columns: list[str] | None = None,
    where: Column | str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Write newline-delimited features in parallel; returns one row: source_table, feature_count,
    truncated. Everything is exported unless a ``limit`` of rows, the lowest ids, is given.
    """
    features = geojson_features(layer, columns, where, limit)
    seen = Observation()
    features.observe(seen, F.count(F.lit(1)).alias("n")).select("feature").write.mode("error").text(path)
    written = seen.get["n"]
    cut = False
    if limit is not None and written >= limit:
        rows = layer.df if where is None else layer.df.filter(where)
        cut = rows.limit(written + 1).count() > written
    return layer.df.sparkSession.createDataFrame(
        [(source, written, cut)], "source_table string, feature_count long, truncated boolean"
    )


def write_collections(layer: Layer, path: str, columns: list[str] | None = None, size: int = 10_000) -> int:
    """Write FeatureCollection documents of about ``size`` features, one per file; returns how many features."""
    n = layer.df.count()
    buckets = max(1, -(-n // size))
    bucket = F.pmod(F.xxhash64(layer.id), F.lit(buckets)).alias("_bucket")
    features = geojson_features(layer, columns).select(bucket, "feature").repartition(buckets, "_bucket")
    grouped = features.groupBy("_bucket").agg(F.concat_ws(",", F.collect_list("feature")).alias("features"))
    document = F.concat(F.lit('{"type":"FeatureCollection","features":['), "features", F.lit("]}"))
    grouped.select(document.alias("value")).write.mode("error").option("maxRecordsPerFile", 1).text(path)
    return n


def display(df: DataFrame, epoch_ms: list[str] | None = None) -> DataFrame:
    """Every column as the text a person reads: times to the second, dates as days, whole numbers
    plain, other numbers with four decimals, null as empty.
    """
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.name in (epoch_ms or []):
            shown = F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            shown = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, TEMPORAL_TYPES):
            shown = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            shown = F.when(whole, c.cast("long").cast("string")).otherwise(text.fixed(c.cast("double"), 4))
        else:
            shown = c.cast("string")
        columns.append(F.coalesce(shown, F.lit("")).alias(field.name))
    return df.select(*columns)


def csv_lines(layer: Layer, columns: list[str] | None = None) -> DataFrame:
    """One CSV line (text) per row, in no order; fields with commas, quotes or newlines are quoted."""
    names = layer.attributes if columns is None else columns
    shown = display(layer.df.select(*names))

    def quoted(c):
        needs = F.col(c).rlike('[,"\n]')
        return F.when(needs, F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(
            F.col(c)
        )

    return shown.select(F.concat_ws(",", *[quoted(c) for c in names]).alias("line"))


def write_csv(layer: Layer, path: str, columns: list[str] | None = None, order_by: list[Column] | None = None) -> None:
    """Write attributes (no geometry) as CSV files with headers, sorted across files if asked."""
    names = layer.attributes if columns is None else columns
    rows = layer.df.orderBy(*order_by) if order_by else layer.df
    display(rows.select(*names)).write.mode("error").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def write_geoparquet(layer: Layer, path: str, geometry_name: str = "geometry") -> None:
    """Write WKB geometry first, attributes flattened one level, and the boxes as a covering struct; the footer of
    every file describes them: geometry kinds and the box of that file's rows.
    """
    flat = flatten_structs(layer.df)
    names = [c for c in flat.columns if c not in (GEOM, *BOX)]
    if geometry_name in names:
        raise ValueError(f"{geometry_name!r} is an attribute already")
    covering = "bbox"
    while covering in (geometry_name, *names):
        covering += "_"
    box = F.when(F.col(GEOM).isNotNull(), F.struct(*BOX)).alias(covering)
    geoparquet.write(flat.select(codec.to_wkb(F.col(GEOM)).alias(geometry_name), *names, box), path, geometry_name, covering, layer.srid == 4326)


def esri_features(layer: Layer) -> DataFrame:
    """Id, attributes (JSON) and Esri-style geometry (JSON) per feature."""
    return layer.df.select(
        F.col(layer.id),
        F.to_json(F.struct(*layer.attributes)).alias("attributes"),
        text.to_esri_json(F.col(GEOM)).alias("geometry"),
    )


def quantize_layer(layer: Layer, resolution: float = RESOLUTION, tolerance: float | None = None) -> DataFrame:
    """Integer coordinates on a layer-wide grid, delta-encoded per ring.

    Columns: id, ``coords`` (dx, dy, dx, dy, ...; each ring starts again from zero), ``lengths``
    (vertices per ring), and the transform (translate and scale) that undoes it.
    """
    rows = layer.df
    if tolerance:
        rows = rows.withColumn(GEOM, kernels.simplify(F.col(GEOM), F.lit(float(tolerance))))
    frame = layer.df.agg(
        F.min("xmin").alias("translate_x"),
        F.min("ymin").alias("translate_y"),
        _scale(F.max("xmax") - F.min("xmin"), resolution).alias("scale_x"),
        _scale(F.max("ymax") - F.min("ymin"), resolution).alias("scale_y"),
    )
    transform = ["translate_x", "translate_y", "scale_x", "scale_y"]
    one = F.lit(1).alias("_one")
    # The frame is one row.
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(frame.select("*", one)), "_one")
    rings = F.flatten(F.col(f"{GEOM}.parts"))

    def deltas(ring):
        grid = F.transform(
            ring,
            lambda v: F.struct(
                F.rint((v["x"] - F.col("translate_x")) / F.col("scale_x")).cast("long").alias("x"),
                F.rint((v["y"] - F.col("translate_y")) / F.col("scale_y")).cast("long").alias("y"),
            ),
        )
        zero = F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
        shifted = F.concat(zero, F.slice(grid, 1, F.size(grid) - 1))
        return F.flatten(F.zip_with(grid, shifted, lambda q, p: F.array(q["x"] - p["x"], q["y"] - p["y"])))

    return rows.select(
        F.col(layer.id),
        F.flatten(F.transform(rings, deltas)).alias("coords"),
        F.transform(rings, lambda r: F.size(r)).alias("lengths"),
        *transform,
    )


def _scale(width: Column, resolution: float) -> Column:
    return F.when(width > 0, width).otherwise(F.lit(1.0)) / F.lit(float(resolution))


def dequantize(df: DataFrame, id: str) -> DataFrame:
    """Vertices (id, position, x, y) of a single-ring quantised layer."""
    steps = df.select("*", F.posexplode(F.sequence(F.lit(0), F.element_at("lengths", 1) - 1)).alias("position", "_k"))
    upto = F.slice("coords", 1, (F.col("_k") + 1) * 2)

    def total(parity):
        chosen = F.filter(upto, lambda _, i: F.pmod(i, F.lit(2)) == parity)
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, v: a + v)

    return steps.select(
        id,
        "position",
        (total(0) * F.col("scale_x") + F.col("translate_x")).alias("x"),
        (total(1) * F.col("scale_y") + F.col("translate_y")).alias("y"),
    )

