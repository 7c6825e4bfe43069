"""Tables that carry their own history: a version number and commit time on every row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commits(df: DataFrame, version: str = "version", committed_at: str = "committed_at") -> DataFrame:
    """Every version with the rows it added and its time."""
    found = df.groupBy(F.col(version).alias("version")).agg(F.count("*").alias("rows"), F.max(committed_at).alias("committed_at"))
    return found.select("version", F.lit("append").alias("operation"), "rows", "committed_at")


def as_of(
    df: DataFrame,
    number: int | None = None,
    timestamp: datetime | None = None,
    version: str = "version",
    committed_at: str = "committed_at",
) -> DataFrame:
    """The rows that had been added at a version, or at a time (exactly one of them); the filter reaches the scan."""
    if (number is None) == (timestamp is None):
        raise ValueError("give either a version number or a timestamp")
    if number is not None:
        return df.filter(F.col(version) <= number)
    return df.filter(F.col(committed_at) <= F.lit(timestamp).cast(df.schema[committed_at].dataType))


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows, by unique key, that were added, removed or changed between two tables.

    Only a digest of each row is shuffled. A column that one table lacks counts as null there.
    """
    columns = sorted(set(before.columns) | set(after.columns))

    def digest(df, name):
        cells = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns if c != key]
        return df.select(key, F.xxhash64(F.to_json(F.struct(*cells))).alias(name))

    both = digest(before, "_old").join(digest(after, "_new"), key, "full")
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed")
    )
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")
