"""Streams over layers: windows, zone counts, ingest, geofence notices.

Aggregations run in update mode and are written per micro-batch with ``foreachBatch``; a batch that
is run again after a failure overwrites its own folder, and ``latest`` reads the newest value of
each key, so results are exact after any restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geoloom.functions import shapes
from geoloom.layer import GEOM, Layer
from geoloom.operators import timeline


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    files_per_batch: int | None = None,
    event_time: str | None = None,
) -> DataFrame:
    """Parquet files that match a path or glob, as they arrive. ``event_time`` names a column of
    wall-clock times to turn into instants, which watermarks need.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(path)
    return rows if event_time is None else rows.withColumn(event_time, instant(event_time))


def instant(column: str) -> Column:
    """A wall-clock time as the instant it names in UTC, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp")


def wall_time(column: str) -> Column:
    """An instant as wall-clock time in UTC, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(column).cast("timestamp_ntz"))


def _store_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now; changed keys of each micro-batch go to ``path``."""
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(partial(_store_batch, path=path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_appends(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now, append-only rows."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key from what ``run_updates`` stored."""
    stored = spark.read.parquet(path)
    newest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return stored.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "batch")


def sliding_stream(
    stream: DataFrame, ts: str, width: str | int, aggregates: dict[str, Column], watermark: str, keys: list[str] | None = None
) -> DataFrame:
    """Sliding windows of a stream; rows later than the watermark are dropped by the aggregation."""
    return timeline.sliding_windows(stream.withWatermark(ts, watermark), ts, width, aggregates, keys)


def _ingest_batch(batch: DataFrame, batch_id: int, to_layer, root: str) -> None:
    layer = to_layer(batch)
    family = F.coalesce(shapes.family(F.col(GEOM)), F.lit("other"))
    rows = layer.df.withColumn("family", family)
    rows.write.mode("overwrite").partitionBy("family").parquet(f"{root}/batch={batch_id}")


def ingest_stream(stream: DataFrame, to_layer, root: str, checkpoint: str) -> None:
    """Append new files to a layer, split by geometry family. ``to_layer`` turns a micro-batch into
    a layer. Running a batch again replaces what it wrote.
    """
    query = (
        stream.writeStream.foreachBatch(partial(_ingest_batch, to_layer=to_layer, root=root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingested(spark: SparkSession, root: str, family: str | None = None) -> DataFrame:
    """What ``ingest_stream`` wrote (``batch`` and ``family`` are partitions)."""
    rows = spark.read.parquet(root)
    return rows if family is None else rows.filter(F.col("family") == family)


def live_zone_counts(
    events: Layer, zones: Layer, ts: str, width: str | int, value: str, watermark: str
) -> DataFrame:
    """Point events per zone and window, joined to static polygons as they arrive."""
    return timeline.zone_counts_by_window(events, zones, ts, width, value, watermark)


NOTICE = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("id", T.LongType()),
        T.StructField("left_zone", T.LongType()),
        T.StructField("entered_zone", T.LongType()),
    ]
)
LAST_ZONE = T.StructType([T.StructField("seen", T.BooleanType()), T.StructField("zone", T.LongType())])


def _notices(key, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["ts", "id"])
    seen, last = state.get if state.exists else (False, None)
    zone = rows["zone"].astype("Int64").reset_index(drop=True)
    before = zone.shift(1)
    if seen and last is not None:
        before.iloc[0] = last
    changed = ~((zone == before).fillna(False).astype(bool) | (zone.isna() & before.isna()))
    tail = zone.iloc[-1]
    state.update((True, None if pd.isna(tail) else int(tail)))
    if idle_ms is not None:
        newest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
    at = changed.to_numpy(bool)
    hit = rows[at]
    yield pd.DataFrame(
        {
            "key": key[0],
            "ts": hit["ts"].to_numpy(),
            "id": hit["id"].to_numpy(),
            "left_zone": before[at].array,
            "entered_zone": zone[at].array,
        }
    )


def geofence_stream(
    visits: DataFrame, key: str, ts: str, id: str, watermark: str, idle_ms: int | None = None
) -> DataFrame:
    """Notices when a key enters or leaves a zone; the only state is each key's last zone, kept for good, or
    dropped once the watermark is ``idle_ms`` past its last event if that is given. The size of a micro-batch (files per
    trigger) bounds what one key brings at a time.
    """
    rows = visits.select(
        F.col(key).cast("long").alias("key"),
        F.col(ts).alias("ts"),
        F.col(id).cast("long").alias("id"),
        F.col("zone").cast("long").alias("zone"),
    ).withWatermark("ts", watermark)
    return rows.groupBy("key").applyInPandasWithState(
        partial(_notices, idle_ms=idle_ms), NOTICE, LAST_ZONE, "append", GroupStateTimeout.EventTimeTimeout
    )
