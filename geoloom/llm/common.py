"""Shared by the operators: tables in the shared folder, Arrow maps, connected components, seeded order."""

from __future__ import annotations

import atexit
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.llm import textbytes
from geoloom.shipping import ship
from geoloom.sources.place import fresh_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, as a Parquet table in the folder all executors share (``spark.checkpoint.dir``), and read it from
    there: lost executors then cost no earlier stage, and planning sees real sizes (a checkpoint keeps the
    estimate of its plan, which repeated joins square). The table goes when the application ends."""
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_written() -> None:
    for spark, path in _written:
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended first: its folder is the cluster's to clear
            return


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: str | None = None) -> DataFrame:
    """Apply a function from batch to batches; the package is sent to executors first. ``keeps`` names the ``process_cache``
    that the function uses."""
    ship(df.sparkSession)

    def run(batches):
        drop_caches(keeps)
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


_caches: dict[str, Callable] = {}
_kind: str | None = None


def process_cache(name: str, size: int):
    """An ``lru_cache`` that a task's process keeps for its next tasks of the same kind: Spark uses such a process again
    for other steps, and their tasks, by ``arrow_map``, drop it first."""

    def register(function):
        _caches[name] = lru_cache(maxsize=size)(function)
        return _caches[name]

    return register


def drop_caches(keeps: str | None) -> None:
    """Give back what this process keeps for steps other than ``keeps``, and unused memory with it."""
    global _kind
    full = [cache for name, cache in _caches.items() if name != keeps and cache.cache_info().currsize]
    for cache in full:
        cache.cache_clear()
    if full or keeps != _kind:
        textbytes.forget_powers()
        gc.collect()  # caches that compute by their owner's methods refer to it
        pa.default_memory_pool().release_unused()
    _kind = keeps


def seeded(seed: int, *columns: Column | str) -> Column:
    """A repeatable 64-bit random order of rows."""
    return F.xxhash64(F.lit(seed), *columns)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node that has one.

    Rounds of contraction: every node points at its smallest neighbour, pointers are followed twice, edges
    are redrawn between the targets and repeated ones merged, until no edge is left. Stars end in one
    round, chains in logarithmically many. All steps are joins and partial aggregations; a hub's edges are
    pre-aggregated and its join partition can be split.
    """
    live = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    maps = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")))
        up = first.toDF("p", "pp")
        second = first.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"))
        parent = cut(second.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p")))
        drawn = live.join(parent.toDF("a", "pa"), "a").join(parent.toDF("b", "pb"), "b")
        live = cut(drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct())
        if maps is None:
            maps = parent.toDF("node", "component")
        else:
            step = parent.toDF("component", "next")
            maps = cut(maps.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
    if maps is None:
        maps = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return maps
