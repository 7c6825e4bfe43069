"""Time windows and movements over timestamped features, batch and streaming alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import coords
from geoloom.layer import BOX, Layer
from geoloom.operators.joins import footprint, spatial_pairs

# Window widths in seconds, and the bounds of a step over a range of time.
WINDOW_SECONDS = {
    "hour": 3600,
    "day": 86400,
    "week": 604800,
    "month": 2592000,
    "year": 31536000,
}
MIN_STEP_SECONDS = 60
MAX_STEPS = 200
# Zones that a stream is joined with are broadcast up to this many bytes.
ZONE_BYTES = 256 << 20


def default_window(range_seconds: float) -> str:
    """The narrowest preset that holds the range; a year beyond 30 days."""
    for name in ("hour", "day", "week", "month"):
        if range_seconds <= WINDOW_SECONDS[name]:
            return name
    return "year"


@dataclass(frozen=True)
class TimeAxis:
    """Range of a time column, the preset that suits it, and the step of its slider."""

    range_seconds: float
    window: str
    step_seconds: float


def time_axis(df: DataFrame, ts: str) -> TimeAxis:
    """The range, and the distinct times as far as they matter: the slider has at most MAX_STEPS steps, so the
    count stops there; below it is exact.
    """
    facts = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    if facts["lo"] is None:
        return TimeAxis(0.0, "hour", 0.0)
    seconds = (facts["hi"] - facts["lo"]).total_seconds()
    times = df.select(ts).filter(F.col(ts).isNotNull()).distinct().limit(MAX_STEPS).count()
    step = min(max(seconds / max(times, 1), MIN_STEP_SECONDS), seconds)
    return TimeAxis(seconds, default_window(seconds), step)


def sliding_windows(
    df: DataFrame,
    ts: str,
    width: str | int,
    aggregates: dict[str, Column],
    keys: list[str] | None = None,
    step_seconds: int | None = None,
    origin: str | None = None,
) -> DataFrame:
    """Aggregate over windows of a preset (or seconds) width that start every half width.

    Works on a static DataFrame and on a stream with a watermark. ``origin`` shifts the first
    window's start (seconds past the epoch grid).
    """
    seconds = WINDOW_SECONDS[width] if isinstance(width, str) else int(width)
    step = step_seconds or seconds // 2
    start = {} if origin is None else {"startTime": origin}
    window = F.window(ts, f"{seconds} seconds", f"{step} seconds", **start)
    grouped = df.groupBy(window.alias("window"), *(keys or [])).agg(
        *[column.alias(name) for name, column in aggregates.items()]
    )
    return grouped.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *(keys or []),
        *aggregates,
    )


def zone_counts_by_window(
    events: Layer, zones: Layer, ts: str, width: str | int, value: str, watermark: str | None = None, **options
) -> DataFrame:
    """Events per zone and tumbling window: a stream of points against static polygons (or batch)."""
    if watermark:
        events = events.with_df(events.df.withWatermark(ts, watermark))
    pairs = spatial_pairs(events, zones, "within", left_columns=[ts, value], right_columns=[], **options)
    hits = pairs.select(F.col(f"r_{zones.id}").alias(zones.id), F.col(f"l_{ts}").alias(ts), F.col(f"l_{value}").alias("_v"))
    seconds = WINDOW_SECONDS[width] if isinstance(width, str) else int(width)
    return sliding_windows(
        hits, ts, seconds, {"n": F.count("*"), "total": F.sum("_v")}, [zones.id], step_seconds=seconds
    )


def with_zone(events: Layer, zones: Layer, columns: list[str], **options) -> DataFrame:
    """Events with the zone that strictly holds them (null outside every zone)."""
    pairs = spatial_pairs(events, zones, "within", left_columns=[], right_columns=[], **options)
    zone = pairs.select(F.col(f"l_{events.id}").alias("_eid"), F.col(f"r_{zones.id}").alias("zone"))
    rows = events.df.select(*dict.fromkeys([events.id, *columns]))
    return rows.join(zone, F.col(events.id) == F.col("_eid"), "left").drop("_eid")


def with_zone_column(events: Layer, zones: Layer, columns: list[str]) -> DataFrame:
    """``with_zone`` for streams: a left join of the stream with static rectangles.

    The zones must be boxes that do not overlap and few enough to broadcast (measured), since a
    stream can be joined from its own side only once.
    """
    size = footprint(zones)
    if not zones.boxes or size.bytes > ZONE_BYTES:
        raise ValueError("zones must be boxes of at most %d bytes" % ZONE_BYTES)
    level = size.levels[-1]
    x, y = F.col("xmin"), F.col("ymin")
    cells = zones.df.select(
        F.col(zones.id).alias("zone"),
        *[F.col(c).alias(f"_{c}") for c in BOX],
        F.expr(f"explode({coords.box_cells(level, *BOX)}) AS _cell"),
    )
    rows = events.df.select(*dict.fromkeys([events.id, *columns]), "xmin", "ymin")
    rows = rows.withColumn("_at", F.expr(coords.point_cell(level, "xmin", "ymin")))
    inside = (x > F.col("_xmin")) & (x < F.col("_xmax")) & (y > F.col("_ymin")) & (y < F.col("_ymax"))
    joined = rows.join(F.broadcast(cells), (F.col("_at") == F.col("_cell")) & inside, "left")
    return joined.select(*dict.fromkeys([events.id, *columns]), "zone")


def geofence_events(visits: DataFrame, key: str, ts: str, id: str, chunk: str = "day") -> DataFrame:
    """One row per change of ``zone`` between consecutive events of a key: left_zone, entered_zone.

    Each key's timeline is cut into chunks of time; a chunk's first event is compared with the last
    zone of the key's previous chunk, known from one small row per chunk. So a key that owns a third
    of all events is many window groups.
    """
    piece = F.date_trunc(chunk, F.col(ts))
    rows = visits.select(key, ts, id, "zone", piece.alias("_chunk"))
    inside = Window.partitionBy(key, "_chunk").orderBy(ts, id)
    stepped = rows.withColumns(
        {"_previous": F.lag(F.struct("zone")).over(inside)}
    )
    last = rows.groupBy(key, "_chunk").agg(F.max_by(F.struct("zone"), F.struct(ts, id)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_chunk")))
    joined = stepped.join(carried.select(key, "_chunk", "_carried"), [key, "_chunk"])
    before = F.coalesce(F.col("_previous"), F.col("_carried"))
    first_ever = before.isNull()
    changed = F.when(first_ever, F.col("zone").isNotNull()).otherwise(~F.col("zone").eqNullSafe(before["zone"]))
    return joined.filter(changed).select(
        key, ts, id, before["zone"].alias("left_zone"), F.col("zone").alias("entered_zone")
    )
