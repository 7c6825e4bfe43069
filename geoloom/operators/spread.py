"""Equi-joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.sources.place import fresh_path

# A task should not receive more rows of one key than this from either side.
ROWS_PER_SHARE = 200_000
# Up to so many hot keys are broadcast to the dealing of both sides; more are joined to it.
BROADCAST_HOT_KEYS = 100_000


def _hot_keys(df: DataFrame, key: str, rows_per_share: int, name: str) -> DataFrame:
    """The keys with more rows than a share, and the number of shares they need."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_share)
    return counts.select(key, F.ceil(F.col("_n") / rows_per_share).cast("int").alias(name))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_salt: Column,
    right_salt: Column,
    rows_per_share: int = ROWS_PER_SHARE,
) -> DataFrame:
    """Inner equi-join on ``key`` where hot keys are split over several tasks.

    For a hot key the left rows are dealt into ``a`` shares and the right rows into ``b`` shares,
    and each share of one side is copied to every share of the other, so every pair still meets in
    exactly one task and no task holds a whole hot key. Ordinary keys are shuffled once, unsalted.
    The hint keeps the planner from broadcasting a side: it guesses from the size of compressed files, before copies.
    ``left_salt`` and ``right_salt`` must be columns (or hashes) that do not change on recomputation.
    """
    hot = (
        _hot_keys(left, key, rows_per_share, "_a")
        .join(_hot_keys(right, key, rows_per_share, "_b"), key, "full")
        .select(key, F.coalesce("_a", F.lit(1)).alias("_a"), F.coalesce("_b", F.lit(1)).alias("_b"))
    )
    path = fresh_path(left.sparkSession, "hot-keys")  # counted once, read by both sides
    hot.write.parquet(path)
    hot = left.sparkSession.read.parquet(path)
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_HOT_KEYS else hot

    def deal(df, salt, own, other, own_share, other_share):
        df = df.join(hot, key, "left")
        share = F.when(F.col(own) > 1, F.pmod(salt, F.col(own)).cast("int")).otherwise(F.lit(0))
        copies = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return df.withColumns({own_share: share, other_share: F.explode(copies)}).drop("_a", "_b")

    left = deal(left, left_salt, "_a", "_b", "_i", "_j")
    right = deal(right, right_salt, "_b", "_a", "_j", "_i")
    return left.join(right.hint("merge"), [key, "_i", "_j"]).drop("_i", "_j")
