"""Reading files into layers: GeoJSON, GeoParquet, tables; preview, retype, split, append."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import codec, shapes, text
from geoloom.layer import BOX, GEOM, Layer, geometry_column, id_column, is_geometry_type, with_box
from geoloom.sources import geoparquet
from geoloom.sources.collections import feature_texts
from geoloom.sources.place import written_text

# The column types a user may pick.
ALLOWED_TYPES = ("VARCHAR", "INTEGER", "BIGINT", "DOUBLE", "FLOAT", "BOOLEAN", "DATE", "TIMESTAMP")
SPARK_TYPES = {
    "VARCHAR": T.StringType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
}
PREVIEW_ROWS = 5
PREVIEW_WIDTH = 80


def scan(spark: SparkSession, ref: str) -> DataFrame:
    """A catalog table (``db.table``) or a Parquet dataset (a path)."""
    return spark.read.parquet(ref) if "/" in ref else spark.table(ref)


def type_name(dtype: T.DataType) -> str:
    """User-facing name of a column type, exotic numeric types folded into the common ones."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return "INTEGER"
    if isinstance(dtype, T.LongType):
        return "BIGINT"
    if isinstance(dtype, (T.DoubleType, T.DecimalType)):
        return "DOUBLE"
    if isinstance(dtype, T.FloatType):
        return "FLOAT"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(dtype, T.StringType):
        return "VARCHAR"
    if is_geometry_type(dtype):
        return "GEOMETRY"
    return dtype.simpleString().upper()


def _canonical(df: DataFrame, geom: Column, source: str, id: str | None) -> tuple[Layer, DataFrame]:
    """Split rows into a layer (geometry first) and the quarantine of unreadable geometries."""
    parsed = df.withColumn(GEOM, geom)
    bad = F.col(GEOM).isNull() & F.col(source).isNotNull()
    quarantine = parsed.filter(bad).drop(GEOM)
    rows = with_box(parsed.filter(~bad).drop(*([source] if source != GEOM else [])))
    names = [c for c in rows.columns if c not in (GEOM, *BOX)]
    rows = rows.select(GEOM, *names, *BOX)
    return Layer(rows, id or id_column(rows)), quarantine


def normalize_layer(df: DataFrame, column: str | None = None, id: str | None = None) -> tuple[Layer, DataFrame]:
    """Layer and quarantine from WKB bytes, WKT or GeoJSON text, or the nested form."""
    column = column or geometry_column(df)
    dtype = df.schema[column].dataType
    source = "_source"
    df = df.withColumnRenamed(column, source)
    if isinstance(dtype, T.BinaryType):
        geom = codec.from_wkb(F.col(source))
    elif isinstance(dtype, T.StringType):
        is_json = F.startswith(F.trim(F.col(source)), F.lit("{"))
        member = F.from_json(F.col(source), "type string, coordinates string")
        geom = F.when(is_json, text.from_geojson(member["type"], member["coordinates"])).otherwise(
            text.from_wkt(F.col(source))
        )
    else:
        geom = F.col(source)
    return _canonical(df, geom, source, id)


def read_geojson(
    spark: SparkSession, paths: str | list[str], lines: bool = False, id: str | None = None
) -> tuple[Layer, DataFrame]:
    """Layer and quarantine from GeoJSON: feature collections, or one feature per line.

    Attribute types are inferred in a first distributed pass; coordinates are kept as text and
    parsed by kind, so mixed kinds do not confuse the inference. Collections of any size are cut at feature
    borders by many tasks and stored as lines first (``collections.feature_texts``).
    """
    if not lines:
        paths = written_text(feature_texts(spark, paths), "features")
    inferred = spark.read.json(paths).schema
    properties = inferred["properties"].dataType if "properties" in inferred.fieldNames() else T.StringType()
    shape = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    member = T.StructType([T.StructField("geometry", shape), T.StructField("properties", properties)])
    features = spark.read.schema(member).json(paths)
    attributes = "properties.*" if isinstance(properties, T.StructType) else "properties"
    source = F.when(F.col("geometry.type").isNotNull(), F.to_json("geometry"))
    geom = text.from_geojson(F.col("geometry.type"), F.col("geometry.coordinates"))
    rows = features.select(attributes, source.alias("_source"), geom.alias("_parsed"))
    layer, quarantine = _canonical(rows, F.col("_parsed"), "_source", id)
    return layer.with_df(layer.df.drop("_parsed")), quarantine.drop("_parsed")


def read_geoparquet(spark: SparkSession, path: str, id: str | None = None) -> tuple[Layer, DataFrame]:
    """Layer and quarantine from GeoParquet; the geometry column comes from the ``geo`` entry of the footer, whose
    covering column is left out (the layer has its own boxes).
    """
    df = spark.read.parquet(path)
    column, covering = geoparquet.primary_column(df)
    return normalize_layer(df.drop(covering) if covering else df, column, id)


def union_layers(layers: list[Layer]) -> Layer:
    """Rows of all layers; columns one lacks are null; a column of two types is an error."""
    types: dict[str, T.DataType] = {}
    for layer in layers:
        for field in layer.df.schema.fields:
            known = types.setdefault(field.name, field.dataType)
            if known.simpleString() != field.dataType.simpleString():
                raise ValueError(
                    f"column {field.name!r} is {known.simpleString()} and {field.dataType.simpleString()}"
                )
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [layer.df for layer in layers])
    families = {layer.family for layer in layers}
    return Layer(df, layers[0].id, families.pop() if len(families) == 1 else "mixed")


def preview(
    df: DataFrame, n: int = PREVIEW_ROWS, width: int = PREVIEW_WIDTH, id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(first n rows, by ``id`` if given, as text cut to ``width``, one row per column: type, null count, row count)."""
    names = [c for c in df.columns if c not in (GEOM, *BOX)]
    head = (df if id is None else df.orderBy(id)).limit(n).select(*[F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in names])
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(type_name(df.schema[c].dataType)).alias("data_type"),
            F.col(c).alias("null_count"),
            F.col("_rows").alias("row_count"),
        )
        for c in names
    ]
    return head, counts.select(F.inline(F.array(*rows)))


def cast_column(df: DataFrame, name: str, target: str) -> Column:
    """Safe cast: whole numbers to TIMESTAMP as epoch milliseconds, blank text to null, and null
    for whatever cannot be read.
    """
    source = type_name(df.schema[name].dataType)
    column, dtype = F.col(name), SPARK_TYPES[target]
    if source in ("BIGINT", "INTEGER") and target == "TIMESTAMP":
        micros = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return (micros + F.make_dt_interval(secs=(column / 1000).cast("decimal(18,6)"))).alias(name)
    if source == "VARCHAR" and target != "VARCHAR":
        column = F.nullif(F.trim(column), F.lit(""))
    if source in ("DOUBLE", "FLOAT") and target in ("INTEGER", "BIGINT"):
        column = F.rint(column)
    return column.try_cast(dtype).alias(name)


def retype(layer: Layer, overrides: dict[str, str]) -> tuple[Layer, DataFrame]:
    """(retyped layer, one row per changed column: nulls after the cast, and newly null ones)."""
    for name, target in overrides.items():
        if name not in layer.attributes:
            raise ValueError(f"no attribute column {name!r}")
        if target not in ALLOWED_TYPES:
            raise ValueError(f"type {target!r} is not one of {', '.join(ALLOWED_TYPES)}")
    casts = {name: cast_column(layer.df, name, target) for name, target in overrides.items()}
    rows = layer.df.select(*[casts.get(c, F.col(c)) for c in layer.df.columns])
    counts = layer.df.agg(
        *[F.count_if(cast.isNull()).alias(f"{n}.after") for n, cast in casts.items()],
        *[F.count_if(F.col(n).isNull()).alias(f"{n}.before") for n in casts],
    )
    warnings = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.col(f"`{n}.after`").alias("null_count"),
            (F.col(f"`{n}.after`") - F.col(f"`{n}.before`")).alias("newly_null"),
        )
        for n in casts
    ]
    return layer.with_df(rows), counts.select(F.inline(F.array(*warnings)))


def split_by_family(layer: Layer) -> dict[str, DataFrame]:
    """Rows per geometry family, keyed by suffix; a single family keeps the plain name (``""``)."""
    tagged = layer.df.withColumn("_family", F.coalesce(shapes.family(F.col(GEOM)), F.lit("other")))
    present = sorted(r[0] for r in tagged.select("_family").distinct().collect())  # at most four
    if len(present) <= 1:
        return {"": layer.df}
    suffix = {"point": "_points", "line": "_lines", "polygon": "_polygons", "other": "_other"}
    return {suffix[f]: tagged.filter(F.col("_family") == f).drop("_family") for f in present}


def write_layer(layer: Layer, ref: str, append: bool = False) -> int:
    """Create a table or Parquet dataset (an error if it exists) or append to it; returns the rows
    written, counted while writing.
    """
    seen = Observation()
    rows = layer.df.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = rows.write.mode("append" if append else "error")
    if "/" in ref:
        writer.parquet(ref)
    else:
        writer.saveAsTable(ref)
    return seen.get["n"]


def write_clustered(layer: Layer, path: str, level: int = 4, partitions: int | None = None) -> None:
    """Write so that neighbours share files and row groups: range-partitioned by grid cell, sorted
    inside. Box filters then skip most of the dataset by Parquet statistics.
    """
    from geoloom.functions import coords

    rows = layer.df.withColumn("cell", F.expr(coords.point_cell(level, *coords.CENTRE)))
    rows = rows.repartitionByRange(partitions, "cell", layer.id) if partitions else rows.repartitionByRange("cell", layer.id)
    rows.sortWithinPartitions("cell", layer.id).write.mode("error").parquet(path)
