"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3; one
warm-up run before them). BENCH_NAIVE=1 also times the plain plan each operator replaces.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from geoloom import ship  # noqa: E402
from geoloom.functions import kernels  # noqa: E402
from geoloom.plans import all_queries, layers  # noqa: E402

HEADLINE = (
    "o61_aggregate_within",
    "o42_point_in_polygon",
    "o42_event_in_zone",
    "o43_line_polygon",
    "o45_nearest_join_k",
    "o60_row_id",
    "o75_page",
    "o62_grid_bins",
    "o59_nearest_k",
    "o66_column_stats",
    "o83_sliding_windows",
    "o86_geofence",
    "o50_dissolve_buffers",
)


def _pairs(spark, sf_dir, left, right, condition):
    return left(spark, sf_dir).df.alias("l").join(right(spark, sf_dir).df.alias("r"), F.expr(condition))


def naive_zones(spark, sf_dir):
    inside = "l.lon > r.xmin AND l.lon < r.xmax AND l.lat > r.ymin AND l.lat < r.ymax"
    return _pairs(spark, sf_dir, layers.points, layers.zones, inside).groupBy("zone_id").agg(F.count("*"), F.sum("val"))


def naive_parcels(spark, sf_dir):
    meets = "l.xmin <= r.xmax AND l.xmax >= r.xmin AND l.ymin <= r.ymax AND l.ymax >= r.ymin"
    pairs = _pairs(spark, sf_dir, layers.points, layers.parcels, meets)
    return pairs.filter(kernels.place(F.col("l.lon"), F.col("l.lat"), F.col("r.geom")) == 1).select("pt_id", "parcel_id")


def naive_row_id(spark, sf_dir):
    from pyspark.sql import Window

    orders = layers.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderkey")))


def naive_windows(spark, sf_dir):
    events = layers.table(spark, sf_dir, "events")
    starts = events.select(F.window("ts", "1 day", "12 hours").start.alias("s")).distinct()
    pairs = events.join(starts, F.expr("ts >= s AND ts < s + INTERVAL 1 DAY"))
    return pairs.groupBy("s", "event_type").agg(F.count("*"), F.sum("value"))


NAIVE = {
    "o61_aggregate_within": naive_zones,
    "o42_point_in_polygon": naive_parcels,
    "o60_row_id": naive_row_id,
    "o83_sliding_windows": naive_windows,
}


def timed(run, spark, sf_dir, runs: int) -> float:
    seconds = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    queries = all_queries()[0]
    result = {name: timed(queries[name], spark, sf_dir, runs) for name in HEADLINE}
    line = {
        "metric": "total seconds of the headline queries (median of runs after a warm-up)",
        "value": round(sum(result.values()), 3),
        "unit": "sec",
        "queries": result,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cores": int(cpus),
    }
    if os.environ.get("BENCH_NAIVE"):
        line["naive"] = {name: timed(run, spark, sf_dir, runs) for name, run in NAIVE.items()}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
