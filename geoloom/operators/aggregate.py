"""Aggregations: points per zone, grid bins, densities, hulls, scorecards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import coords, kernels, shapes
from geoloom.layer import GEOM, Layer
from geoloom.operators.joins import spatial_pairs

# The aggregate functions on offer.
AGGREGATES = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "stddev": F.stddev_samp,
}


def aggregate_within(
    points: Layer,
    zones: Layer,
    aggregates: dict[str, tuple[str, str | None]],
    labels: list[str] | None = None,
    where_points: Column | None = None,
    where_zones: Column | None = None,
    limit: int | None = None,
    **options,
) -> DataFrame:
    """Aggregate the points strictly inside each zone; zones without points stay.

    ``aggregates`` maps an output name to (function, column), for example
    ``{"n": ("count", None), "total": ("sum", "val")}``. With ``limit``, the zones with the largest
    first aggregate, ties by zone id, empty values last.
    """
    if where_points is not None:
        points = points.with_df(points.df.filter(where_points))
    if where_zones is not None:
        zones = zones.with_df(zones.df.filter(where_zones))
    needed = [c for _, c in aggregates.values() if c]
    pairs = spatial_pairs(
        points, zones, "within", left_columns=list(dict.fromkeys(needed)), right_columns=[], **options
    )
    measures = [
        AGGREGATES[f](F.col(f"l_{c}") if c else F.lit(1)).alias(name) for name, (f, c) in aggregates.items()
    ]
    per_zone = pairs.groupBy(F.col(f"r_{zones.id}").alias("_zone")).agg(*measures)
    result = zones.df.select(zones.id, *(labels or [])).join(
        per_zone, F.col(zones.id) == F.col("_zone"), "left"
    )
    values = [
        F.coalesce(F.col(name), F.lit(0)).alias(name) if f == "count" else F.col(name)
        for name, (f, _) in aggregates.items()
    ]
    result = result.select(zones.id, *(labels or []), *values)
    if limit is not None:
        first = next(iter(aggregates))
        result = result.orderBy(F.col(first).desc_nulls_last(), zones.id).limit(limit)
    return result


def zone_density(points: Layer, zones: Layer, **options) -> DataFrame:
    """Points per square degree of each zone."""
    width, height = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    size = width * height if zones.boxes else kernels.measure(F.col(GEOM))["area"]
    counted = aggregate_within(points, zones, {"n": ("count", None)}, **options)
    sizes = zones.df.select(F.col(zones.id).alias("_zone"), size.alias("area"))
    joined = counted.join(sizes, F.col(zones.id) == F.col("_zone")).drop("_zone")
    return joined.withColumn("density", F.col("n") / F.col("area"))


def grid_bins(layer: Layer, resolution: float = 0.1) -> DataFrame:
    """Features per square bin of the centroid, at the centre of the bin."""
    if layer.family == "point":
        x, y = F.col("xmin"), F.col("ymin")
    else:
        layer = layer.with_df(layer.df.withColumn("_m", kernels.measure(F.col(GEOM))))
        x, y = F.col("_m.x"), F.col("_m.y")
    r = F.lit(float(resolution))
    bins = layer.df.groupBy(
        F.floor(x / r).cast("long").alias("ix"), F.floor(y / r).cast("long").alias("iy")
    ).agg(F.count("*").alias("feature_count"))
    return bins.select(
        ((F.col("ix") + 0.5) * r).alias("lon"), ((F.col("iy") + 0.5) * r).alias("lat"), "feature_count"
    )


def hull_by(layer: Layer, keys: list[str]) -> DataFrame:
    """Convex hull of the vertices of each group, with its point count and area in km^2.

    Hulls of hulls are hulls, so each input partition first reduces its rows to one small hull per
    group, then ``FAN_IN`` sub-groups per group do, and only their hulls meet in the last step: no
    task sees a whole group however large it is.
    """
    shape = GEOM in layer.df.columns and layer.family != "point"
    points = (
        layer.df.select(*keys, F.explode(F.flatten(F.flatten(F.col(f"{GEOM}.parts")))).alias("v")).select(
            *keys, F.col("v.x").alias("x"), F.col("v.y").alias("y")
        )
        if shape
        else layer.df.select(*keys, F.col("xmin").alias("x"), F.col("ymin").alias("y"))
    )
    points = points.withColumn("share", F.pmod(F.xxhash64("x", "y"), F.lit(FAN_IN)).cast("int"))
    schema = points.schema
    partial = points.mapInArrow(_hull_reducer(keys), schema)
    partial = partial.groupBy(*keys, "share").applyInArrow(_hull_group(keys), schema)
    final = partial.groupBy(*keys).applyInArrow(_hull_group(keys), schema)
    rings = final.groupBy(*keys).agg(_closed_ring(F.collect_list(F.struct("x", "y", "share"))).alias("ring"))
    area = F.abs(shapes.ring_signed_area(F.col("ring"))) * coords.KM_PER_DEGREE * coords.KM_PER_DEGREE
    counts = layer.df.groupBy(*keys).agg(F.count("*").alias("point_count"))
    return counts.join(
        rings.select(*keys, F.col("ring").alias("hull"), area.alias("hull_area_sqkm")), keys
    )


# Sub-groups per group between the partition hulls and the final hull.
FAN_IN = 64


def _closed_ring(points: Column) -> Column:
    """Ring in stored order (``share`` carries the position after the last reduction)."""
    ordered = F.array_sort(points, lambda a, b: F.sign(a["share"] - b["share"]).cast("int"))
    ring = F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return F.concat(ring, F.slice(ring, 1, 1))


def _hull_rows(table: pa.Table, keys: list[str], schema: pa.Schema) -> pa.Table:
    points = np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()])
    corners = kernels.hull(points)
    first = table.slice(0, 1)
    columns = [pa.array(first[k].to_pylist() * len(corners), schema.field(k).type) for k in keys]
    columns += [pa.array(corners[:, 0]), pa.array(corners[:, 1]), pa.array(range(len(corners)), pa.int32())]
    return pa.Table.from_arrays(columns, schema=schema)


def _hull_group(keys: list[str]):
    def reduce(table: pa.Table) -> pa.Table:
        return _hull_rows(table, keys, table.schema)

    return reduce


def _hull_reducer(keys: list[str]):
    """Reduce each Arrow batch to one hull per group, filed under the share of its first row."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            group = table.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order])) + 1
            share = table["share"][0].as_py()
            for rows in np.split(order, edges):
                reduced = _hull_rows(table.take(pa.array(rows)), keys, table.schema)
                at = reduced.schema.get_field_index("share")
                same = pa.array([share] * reduced.num_rows, pa.int32())
                yield from reduced.set_column(at, reduced.schema.field(at), same).to_batches()

    return reduce


def scorecard(cases: DataFrame, checks: list[str], by: list[str]) -> DataFrame:
    """Pass rate per value of each ``by`` column and overall, in one pass (grouping sets).

    A case passes when every check that applies to it passes; a null check does not apply.
    """
    passed = F.lit(True)
    for check in checks:
        passed = passed & F.coalesce(F.col(check), F.lit(True))
    scored = cases.withColumn("_passed", passed.cast("int"))
    sets = [[F.col(c)] for c in by] + [[]]
    grouped = scored.groupingSets(sets, *by).agg(
        F.grouping_id().alias("_gid"), F.count("*").alias("total"), F.sum("_passed").alias("passed")
    )
    dimension = F.lit("overall")
    value = F.lit("all")
    for i, c in enumerate(by):
        only = sum(1 << (len(by) - 1 - j) for j in range(len(by)) if j != i)
        dimension = F.when(F.col("_gid") == only, F.lit(c)).otherwise(dimension)
        value = F.when(F.col("_gid") == only, F.col(c).cast("string")).otherwise(value)
    return grouped.select(
        dimension.alias("dimension"),
        value.alias("value"),
        "total",
        "passed",
        (F.col("total") - F.col("passed")).alias("failed"),
        F.round(F.col("passed") * 100.0 / F.col("total"), 0).cast("long").alias("rate"),
    )
