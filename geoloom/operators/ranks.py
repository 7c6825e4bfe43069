"""Rows by rank, without sorting or numbering a whole table.

A histogram over sampled sort keys tells which slices of the order hold the wanted ranks; only these slices are read,
ordered and numbered. Sort keys may have several columns, either direction and nulls, which always come last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slices a histogram round cuts a range into, and the keys it samples for that.
SLICES = 48
SAMPLED = 1_536
# A range is narrowed until it holds at most this many rows, or four times those wanted.
SMALL = 20_000


@dataclass(frozen=True)
class Key:
    """One sort column; nulls last in both directions."""

    name: str
    descending: bool = False

    @property
    def order(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.descending else F.col(self.name).asc_nulls_last()

    def before(self, value) -> Column:
        c = F.col(self.name)
        if value is None:
            return c.isNotNull()
        return F.coalesce(c > F.lit(value) if self.descending else c < F.lit(value), F.lit(False))


def before(keys: list[Key], bound: tuple) -> Column:
    """Whether a row comes strictly before a bound (one value per key)."""
    found = F.lit(False)
    for key, value in reversed(list(zip(keys, bound))):
        found = key.before(value) | (F.col(key.name).eqNullSafe(F.lit(value)) & found)
    return found


def slice_of(keys: list[Key], bounds: list[tuple], first: int = 0) -> Column:
    """How many of the ascending bounds are not after the row, by binary search."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    left, right = slice_of(keys, bounds[:middle], first), slice_of(keys, bounds[middle + 1 :], first + middle + 1)
    return F.when(before(keys, bounds[middle]), left).otherwise(right)


def narrowed(rows: DataFrame, keys: list[Key], first: int, last: int, small: int = SMALL) -> tuple[DataFrame, int]:
    """(the rows of a range of the order that holds the ranks first to last, how many rows come before the range).

    Each round samples keys of the range by a hash, counts the rows between them and keeps the slices with the wanted ranks, so
    the range shrinks some ten-fold or more with every scan. The driver sees SAMPLED keys and SLICES counts a round.
    """
    names = [k.name for k in keys]
    inside, below, held = rows, 0, rows.count()
    while held > max(small, 4 * (last - first + 1)):
        drawn = inside.select(*names).orderBy(F.xxhash64(*names), *names).limit(SAMPLED).orderBy(*[k.order for k in keys]).collect()
        bounds = list(dict.fromkeys(tuple(r) for r in drawn[len(drawn) // SLICES :: max(1, len(drawn) // SLICES)]))
        counts = dict(inside.groupBy(slice_of(keys, bounds).alias("s")).count().collect())
        at, lo, hi = below, None, None
        for s in range(len(bounds) + 1):
            n = counts.get(s, 0)
            if lo is None and at + n > first:
                lo, new_below = s, at
            at += n
            if at > last or s == len(bounds):
                hi = s
                break
        if lo is None:
            break  # beyond the end
        kept = sum(counts.get(s, 0) for s in range(lo, hi + 1))
        if kept == held:
            break  # one key only
        inside = inside.where(~before(keys, bounds[lo - 1])) if lo else inside
        inside = inside.where(before(keys, bounds[hi])) if hi < len(bounds) else inside
        below, held = new_below, kept
    return inside, below


def key_at(rows: DataFrame, keys: list[Key], rank: int) -> tuple | None:
    """The sort key of the row at a rank, counted from 0; None beyond the end."""
    inside, below = narrowed(rows, keys, rank, rank)
    found = inside.select(*[k.name for k in keys]).orderBy(*[k.order for k in keys]).offset(rank - below).limit(1).collect()
    return tuple(found[0]) if found else None


def rows_between(rows: DataFrame, keys: list[Key], offset: int, limit: int) -> DataFrame:
    """The rows at ranks offset to offset + limit - 1, in order; the keys together must be unique.

    A page of up to SMALL rows is cut from a narrowed range; a longer one lies between two exact keys and is sorted in parallel.
    """
    order = [k.order for k in keys]
    if limit <= SMALL:
        inside, below = narrowed(rows, keys, offset, offset + limit - 1)
        return inside.orderBy(*order).offset(offset - below).limit(limit)
    start, end = key_at(rows, keys, offset), key_at(rows, keys, offset + limit)
    if start is None:
        return rows.limit(0)
    inside = rows.where(~before(keys, start))
    return (inside if end is None else inside.where(before(keys, end))).orderBy(*order)


def rows_at(rows: DataFrame, key: str, ranks: list[int], name: str, slice_of_key, offsets: list[tuple[int, int]]) -> DataFrame:
    """The rows at the given ranks in the order of a unique key, numbered as ``name``; ``slice_of_key`` gives a row's slice and
    ``offsets`` the slices with the rows before each. Rows outside the slices that hold a wanted rank are not numbered."""
    wanted = sorted(set(ranks))
    starts = [b for _, b in offsets]
    needed = sorted({s for (s, b), e in zip(offsets, [*starts[1:], None]) if _any_within(wanted, b, e)})
    picked = rows.withColumn("_slice", slice_of_key).where(F.col("_slice").isin(needed)) if needed else rows.withColumn("_slice", slice_of_key).limit(0)
    shift = F.create_map(*[F.lit(v) for s, b in offsets if s in set(needed) for v in (s, b)]) if needed else F.create_map(F.lit(-1), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(key)) - 1
    return picked.withColumn(name, (shift[F.col("_slice")] + within).cast("long")).drop("_slice")


def _any_within(ascending: list[int], start: int, end: int | None) -> bool:
    from bisect import bisect_left

    k = bisect_left(ascending, start)
    return k < len(ascending) and (end is None or ascending[k] < end)
