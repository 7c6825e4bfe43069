"""Row ids, pages, samples and ordering over whole layers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.layer import BOX, GEOM, Layer
from geoloom.operators import ranks

# Default page sizes per family.
PAGE_POLYGONS = 500
PAGE_OTHER = 10_000

# Lists of wanted row ids up to this length are broadcast (8 bytes each); longer ones are joined.
BROADCAST_IDS = 100_000

# Numbering: rows one task numbers, and the most slices a table is cut into.
ROWS_PER_SLICE = 100_000
MAX_SLICES = 50_000
# Beyond this depth a page is found by rank instead of by a top-n that one task would hold.
DEEP_OFFSET = 200_000


def with_row_id(df: DataFrame, key: str, name: str = "oid", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the order of a unique, non-null ``key``.

    The key range is cut into slices at sampled keys that enter the plan as constants, so every
    recomputation of a task assigns the same slice. Rows are numbered within their slice and
    shifted by the rows of earlier slices: no step sorts the table in one place.
    """
    cuts = _cuts(df, key, rows_per_slice)
    sliced = df.withColumn("_slice", _slice_of(cuts)(F.col(key)) if len(cuts) else F.lit(0))
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))  # at most MAX_SLICES rows
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(key)) - 1
    numbered = sliced.withColumn("_within", within).join(F.broadcast(offsets), "_slice")
    return numbered.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop(
        "_slice", "_within", "_before"
    )


def _cuts(df: DataFrame, key: str, rows_per_slice: int, least: int = 1) -> list:
    """Keys that cut the table into slices of about the wanted size, at least so many, from a bounded sample."""
    keys = df.select(key)
    rows = keys.count()
    slices = min(max(-(-rows // rows_per_slice), min(least, rows // 4)), MAX_SLICES)
    if slices <= 1:
        return []
    wanted = 16 * slices
    seen = sorted(r[0] for r in keys.sample(min(1.0, 1.2 * wanted / rows), seed=7).limit(2 * wanted).collect())
    return sorted(set(seen[:: max(1, len(seen) // slices)][1:]))


def _slice_of(cuts: list):
    """Arrow function: how many cuts are at or below a key."""
    @F.arrow_udf(T.IntegerType())
    def slice_of(keys: pa.Array) -> pa.Array:
        bounds = pa.array(cuts, keys.type).to_numpy(zero_copy_only=False)
        values = keys.to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(bounds, values, side="right").astype(np.int32))

    return slice_of


def take_rows(layer: Layer, indices: list[int], key: str | None = None) -> DataFrame:
    """Rows at the given 0-based positions in key order; positions past the end have none."""
    return _at(layer, indices, key or layer.id).drop("oid")


def by_ids(layer: Layer, ids: list[int]) -> DataFrame:
    """Rows whose row id (``oid``) is in ``ids``, with it."""
    return _at(layer, ids, layer.id)


# Slices cut for each wanted row id: most slices then hold none and are neither ordered nor numbered.
SLICES_PER_ID = 8


def _at(layer: Layer, ids: list[int], key: str) -> DataFrame:
    """The rows of some row ids. A histogram of the keys finds the slices that hold them."""
    spark = layer.df.sparkSession
    wanted = spark.createDataFrame([(int(i),) for i in ids], "oid long").distinct()
    if len(ids) > BROADCAST_IDS:  # so many that most slices hold one
        return with_row_id(layer.df, key).join(wanted, "oid", "left_semi")
    wanted = F.broadcast(wanted)
    cuts = _cuts(layer.df, key, ROWS_PER_SLICE, min(MAX_SLICES, SLICES_PER_ID * len(set(ids))))
    in_slice = _slice_of(cuts)(F.col(key)) if len(cuts) else F.lit(0)
    counts = sorted(layer.df.select(in_slice.alias("s")).groupBy("s").count().collect())
    offsets, before = [], 0
    for s, n in counts:
        offsets.append((s, before))
        before += n
    return ranks.rows_at(layer.df, key, [int(i) for i in ids], "oid", in_slice, offsets).join(wanted, "oid", "left_semi")


def order_columns(order_by: list[str]) -> list[Column]:
    """``["a", "b desc"]`` as sort columns with nulls last in both directions."""
    return [k.order for k in sort_keys(order_by)]


def sort_keys(order_by: list[str]) -> list[ranks.Key]:
    found = []
    for item in order_by:
        name, _, direction = item.strip().partition(" ")
        found.append(ranks.Key(name, direction.strip().lower() == "desc"))
    return found


@dataclass(frozen=True)
class Page:
    """One page of rows and a one-row summary: total_count, returned, exceeded."""

    rows: DataFrame
    summary: DataFrame


def page(
    layer: Layer,
    order_by: list[str] | None = None,
    limit: int | None = None,
    offset: int = 0,
    where: Column | None = None,
    deep: int = DEEP_OFFSET,
) -> Page:
    """Filter, order (ties by id), cut. ``exceeded`` says rows remain after the page.

    A page that ends within ``deep`` rows is a top-n; a deeper one is found by rank, in any order, whatever its depth.
    """
    if limit is None:
        limit = PAGE_POLYGONS if layer.family == "polygon" else PAGE_OTHER
    rows = layer.df if where is None else layer.df.filter(where)
    keys = sort_keys(order_by or []) + [ranks.Key(layer.id)]
    if offset + limit > deep:
        cut = ranks.rows_between(rows, keys, offset, limit)
    else:
        cut = rows.orderBy(*[k.order for k in keys]).offset(offset).limit(limit)
    total = rows.agg(F.count("*").alias("total_count"))
    summary = total.select(
        "total_count",
        F.greatest(F.least(F.col("total_count") - offset, F.lit(limit)), F.lit(0)).cast("long").alias("returned"),
        (F.col("total_count") > offset + limit).alias("exceeded"),
    )
    return Page(cut, summary)


def count_only(layer: Layer, where: Column | None = None) -> DataFrame:
    rows = layer.df if where is None else layer.df.filter(where)
    return rows.agg(F.count("*").alias("count"))


def ids_only(layer: Layer, where: Column | None = None) -> DataFrame:
    """(oid, id) of every matching row; the row ids are those of the whole layer."""
    numbered = with_row_id(layer.df, layer.id)
    numbered = numbered if where is None else numbered.filter(where)
    return numbered.select("oid", layer.id)


def sample(layer: Layer, n: int = 10, geometry: bool = True) -> DataFrame:
    """The first n rows by id."""
    if n < 1:
        raise ValueError("n must be positive")
    rows = layer.df.orderBy(layer.id).limit(n)
    return rows if geometry else rows.drop(GEOM, *BOX)


def truncated(rows: DataFrame, limit: int) -> DataFrame:
    """One row: how many rows a cut at ``limit`` returns and whether it loses any (exactly)."""
    seen = rows.limit(limit + 1).agg(F.count("*").alias("_n"))
    return seen.select(
        F.least(F.col("_n"), F.lit(limit)).cast("long").alias("returned"),
        (F.col("_n") > limit).alias("truncated"),
    )
