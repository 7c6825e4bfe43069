"""Descriptions of layers: extents, statistics, categories, geometry kinds."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.layer import GEOM, Layer

# Columns whose values are worth listing, and how many.
CATEGORY_COLUMNS = ("class", "subtype", "basic_category", "type", "category")
CATEGORY_VALUES = 15

# How a whole-number column is recognised as epoch milliseconds.
EPOCH_NAME = r"(?i)timestamp|created|updated|modified|_at$|_time$|_date$|datetime|epoch"
EPOCH_MS_MIN = 631_152_000_000  # 1990-01-01
EPOCH_MS_MAX = 4_102_444_800_000  # 2100-01-01

TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def extent(layer: Layer) -> DataFrame:
    """One row: min_lon, min_lat, max_lon, max_lat."""
    return layer.df.agg(
        F.min("xmin").alias("min_lon"),
        F.min("ymin").alias("min_lat"),
        F.max("xmax").alias("max_lon"),
        F.max("ymax").alias("max_lat"),
    )


def namespace_extent(layers: dict[str, Layer]) -> DataFrame:
    """Extent over several tables; tables without data do not matter."""
    every = _stack([extent(layer) for layer in layers.values()])
    return every.agg(
        F.min("min_lon").alias("min_lon"),
        F.min("min_lat").alias("min_lat"),
        F.max("max_lon").alias("max_lon"),
        F.max("max_lat").alias("max_lat"),
    )


def layer_stats(layer: Layer) -> DataFrame:
    """One row: rows, columns, null and non-null geometries, extent."""
    return layer.df.agg(
        F.count("*").alias("row_count"),
        F.lit(len(layer.attributes) + 1).cast("long").alias("column_count"),
        F.count(GEOM).alias("non_null_geometries"),
        F.count_if(F.col(GEOM).isNull()).alias("null_geometries"),
        F.min("xmin").alias("min_lon"),
        F.min("ymin").alias("min_lat"),
        F.max("xmax").alias("max_lon"),
        F.max("ymax").alias("max_lat"),
    )


def geometry_kinds(layers: dict[str, Layer]) -> DataFrame:
    """Exact histogram of geometry kinds per table."""
    return _stack(
        [
            layer.df.groupBy(F.col(f"{GEOM}.kind").alias("kind"))
            .agg(F.count("*").alias("n"))
            .select(F.lit(name).alias("table_name"), "kind", "n")
            for name, layer in layers.items()
        ]
    )


def column_stats(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Per numeric column: min, max, mean, sample stddev, quartiles, distinct values.

    Quartiles are exact (interpolated): a sketch brackets each rank within a guaranteed error, and further sketches over the
    values inside narrow a bracket until it holds few; only those are counted and ordered. ``approximate`` takes the
    first sketches' answers as they are. NaN is no value, like null.
    """
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    if approximate:
        return _stats_rows(
            df.agg(*_moments(columns, values, "approx_count_distinct"), *_sketches(columns, values, QUARTILES)), columns
        )
    margin = 3.0 / SKETCH_ACCURACY
    bounds = [min(max(q + d, 0.0), 1.0) for q in QUARTILES for d in (-margin, margin)]
    facts = df.agg(*_sketches(columns, values, bounds)).first()  # six numbers per column
    brackets = {
        c: [(facts[c][2 * i], facts[c][2 * i + 1]) for i in range(len(QUARTILES))]
        for c in columns
        if facts[c] is not None
    }
    below = _counted(df, columns, values, brackets, _moments(columns, values, None))
    while wide := _too_wide(brackets, below):
        inner = [
            F.percentile_approx(F.when((v >= F.lit(brackets[c][i][0])) & (v <= F.lit(brackets[c][i][1])), v), probes, SKETCH_ACCURACY).alias(f"{c}.{i}")
            for c, v in zip(columns, values)
            for i, probes in wide.get(c, {}).items()
        ]
        found = df.agg(*inner).first()
        narrower = {c: [tuple(found[f"{c}.{i}"]) if i in wide.get(c, {}) else b for i, b in enumerate(brackets[c])] for c in brackets}
        if narrower == brackets:
            break  # one value fills a bracket
        brackets = narrower
        below = _counted(df, columns, values, brackets, _moments(columns, values, None))
    below = _one_row(df, below)
    inside = [
        F.when(
            (v >= F.lit(lo)) & (v <= F.lit(hi)),
            F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("quartile"), v.alias("value")),
        )
        for c, v in zip(columns, values)
        if c in brackets
        for i, (lo, hi) in enumerate(brackets[c])
    ]
    near = df.select(F.explode(F.array_compact(F.array(*inside))).alias("e")).select("e.*")
    near = near.groupBy("column_name", "quartile", "value").agg(F.count("*").alias("n"))
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), v.alias("value")) for c, v in zip(columns, values)])).alias("e")
    )
    distinct = (
        long.select("e.*").filter("value IS NOT NULL").distinct().groupBy("column_name").agg(F.count("*").alias("distinct_count"))
    )
    stats = _stats_rows(below, columns).join(distinct, "column_name", "left")
    return _pick_quartiles(near, stats).drop("below", "n")


def _counted(df: DataFrame, columns, values, brackets: dict, more: list) -> dict:
    """One pass: ``more``, and per column the rows below and inside each bracket."""
    counts = [
        F.array(*[F.count_if(test(v, lo, hi)) for lo, hi in brackets[c]]).alias(f"{c}.{name}")
        for c, v in zip(columns, values)
        if c in brackets
        for name, test in (("below", lambda v, lo, hi: v < F.lit(lo)), ("inside", lambda v, lo, hi: (v >= F.lit(lo)) & (v <= F.lit(hi))))
    ]
    return df.agg(*more, *counts).first().asDict()


def _too_wide(brackets: dict, counted: dict) -> dict:
    """{column: {quartile: probes}} of the brackets with more than FEW rows and more than one value: where in the bracket the
    wanted rank lies, less and more the sketch's error."""
    wide: dict = {}
    margin = 3.0 / SKETCH_ACCURACY
    for c, found in brackets.items():
        for i, (lo, hi) in enumerate(found):
            n = counted[f"{c}.inside"][i]
            if n > FEW and lo < hi:
                at = ((counted[f"{c}.n"] - 1) * QUARTILES[i] - counted[f"{c}.below"][i]) / n
                wide.setdefault(c, {})[i] = [min(max(at + d, 0.0), 1.0) for d in (-margin, margin)]
    return wide


def _one_row(df: DataFrame, facts: dict) -> DataFrame:
    """Facts already computed (a few numbers per column) as a table of one row."""
    kinds = {"n": "bigint", "below": "array<bigint>", "inside": "array<bigint>"}
    schema = ", ".join(f"`{name}` {kinds.get(name.rsplit('.', 1)[-1], 'double')}" for name in facts)
    return df.sparkSession.createDataFrame([tuple(facts.values())], schema)


# A bracket with more rows is narrowed by another sketch; so many are ordered in one task at most.
FEW = 100_000
# Fixed value: the ranks reported.
QUARTILES = (0.25, 0.5, 0.75)
# A sketch's rank error is at most the row count divided by this.
SKETCH_ACCURACY = 2000


def _moments(columns, values, distinct: str | None):
    counted = [getattr(F, distinct)(v).alias(f"{c}.distinct_count") for c, v in zip(columns, values)] if distinct else []
    return counted + [
        f.alias(f"{c}.{name}")
        for c, v in zip(columns, values)
        for name, f in (
            ("n", F.count(v)),
            ("min", F.min(v)),
            ("max", F.max(v)),
            ("mean", F.avg(v)),
            ("stddev", F.stddev_samp(v)),
        )
    ]


def _sketches(columns, values, probes):
    return [
        F.percentile_approx(v, list(probes), SKETCH_ACCURACY).alias(c) for c, v in zip(columns, values)
    ]


def _stats_rows(wide: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column from the single row of ``<column>.<fact>`` values."""
    names = set(wide.columns)

    def fact(c, name, empty):
        return (F.col(f"`{c}.{name}`") if f"{c}.{name}" in names else F.lit(None).cast(empty)).alias(name)

    rows = []
    for c in columns:
        cells = [F.lit(c).alias("column_name"), fact(c, "n", "long")]
        cells += [fact(c, m, "double") for m in ("min", "max", "mean", "stddev")]
        if c in names:
            cells += [F.col(f"`{c}`")[i].alias(q) for i, q in enumerate(("q25", "median", "q75"))]
            cells.append(fact(c, "distinct_count", "long"))
        else:
            cells.append(fact(c, "below", "array<bigint>"))
        rows.append(F.struct(*cells))
    stacked = wide.select(F.inline(F.array(*rows)))
    return stacked.drop("n") if "q25" in stacked.columns else stacked


def _pick_quartiles(near: DataFrame, stats: DataFrame) -> DataFrame:
    """The values at the wanted ranks, counted from the rows below each bracket."""
    names = ("q25", "median", "q75")
    facts = stats.select("column_name", F.col("n").alias("total"), "below")  # one row per column
    ranked = near.join(F.broadcast(facts), "column_name")
    order = Window.partitionBy("column_name", "quartile").orderBy("value")
    ranked = ranked.withColumn("upto", F.col("below")[F.col("quartile")] + F.sum("n").over(order))
    position = (F.col("total") - 1) * F.element_at(F.array(*[F.lit(q) for q in QUARTILES]), F.col("quartile") + 1)

    def at(rank):
        return F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")), F.col("value")))

    ranked = ranked.withColumn("position", position)
    found = ranked.groupBy("column_name", "quartile").agg(
        at(F.floor("position")).alias("low"), at(F.ceil("position")).alias("high"), F.first("position").alias("position")
    )
    share = F.col("position") - F.floor("position")
    found = found.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * share)
    wide = found.groupBy("column_name").agg(
        *[F.max(F.when(F.col("quartile") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    )
    return stats.join(wide, "column_name", "left")


def temporal_profile(df: DataFrame) -> DataFrame:
    """Per temporal column with data: min, max (text) and distinct count, in one pass."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL_TYPES)]
    return _profile_columns(df, columns)


def _profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    # Distinct values first (partial aggregation), so a column of few values stays small and
    # several columns do not multiply into one another.
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("value"))
        for c in columns
    ]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_name string, min string, max string, distinct_count long")
    long = df.select(F.explode(F.array(*pairs)).alias("e")).select("e.*").filter("value IS NOT NULL")
    return (
        long.groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("column_name")
        .agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("distinct_count"))
    )


def category_profile(df: DataFrame, columns: list[str] | None = None, n: int = CATEGORY_VALUES) -> DataFrame:
    """The n most frequent values (ties by value) of each categorical column."""
    if columns is None:
        columns = [c for c in df.columns if c.lower() in CATEGORY_COLUMNS]
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = (
        df.select(F.explode(F.array(*pairs)).alias("e"))
        .select("e.*")
        .filter("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def profile(layers: dict[str, Layer]) -> DataFrame:
    """One card per table: rows, extent, geometry kinds and its categorical values."""
    cards = []
    for name, layer in layers.items():
        kinds = layer.df.groupBy(F.col(f"{GEOM}.kind").alias("kind")).agg(
            F.count("*").alias("n"),
            F.min("xmin").alias("min_lon"),
            F.min("ymin").alias("min_lat"),
            F.max("xmax").alias("max_lon"),
            F.max("ymax").alias("max_lat"),
        )
        card = kinds.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.array_join(F.sort_array(F.collect_list("kind")), ",").alias("kinds"),  # few kinds
            F.min("min_lon").alias("min_lon"),
            F.min("min_lat").alias("min_lat"),
            F.max("max_lon").alias("max_lon"),
            F.max("max_lat").alias("max_lat"),
        )
        columns = [c for c in layer.attributes if c.lower() in CATEGORY_COLUMNS]
        values = (
            category_profile(layer.df, columns)
            .agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "column_name", "value"))), ",").alias("categories"))
            if columns
            else layer.df.sparkSession.range(1).select(F.lit("").alias("categories"))
        )
        # Both sides are single rows.
        card = card.withColumn("table_name", F.lit(name)).join(
            F.broadcast(values.withColumn("table_name", F.lit(name))), "table_name"
        )
        cards.append(card)
    return _stack(cards)


def detect_epoch_ms(df: DataFrame) -> DataFrame:
    """Whole-number columns whose name and every value look like epoch milliseconds."""
    columns = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.LongType) and _looks_temporal(f.name)
    ]
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, is_epoch_ms boolean")
    ranges = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(
                (F.col(f"`{c}`.lo") >= EPOCH_MS_MIN) & (F.col(f"`{c}`.hi") <= EPOCH_MS_MAX), F.lit(False)
            ).alias("is_epoch_ms"),
        )
        for c in columns
    ]
    return ranges.select(F.inline(F.array(*rows)))


def _looks_temporal(name: str) -> bool:
    return re.search(EPOCH_NAME, name) is not None

