"""Mixing sources to target weights (operator 3): subset-sum budget fitting by exact length counts.

Each source gets a target share of all words. Whole passes over a source are taken while they fit; the rest
of the budget is filled by documents chosen by their length: documents are counted per source and exact
length, every length gives its proportional share, rare lengths share cumulated places, and a bounded
knapsack over the remaining counts closes the last part exactly where that is possible. Which documents of
a length are taken is a seeded order, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import WORD, cut, seeded, table
from geoloom.llm.registry import query
from geoloom.shipping import ship

#: A source is repeated at most so often.
MOST = 3
#: Words the knapsack closes; larger gaps are narrowed by shares cumulated over neighbouring lengths first.
KNAPSACK = 1 << 15
#: Parts of a (source, length) group in the seeded order; only the part in which the choice ends is ranked.
PARTS = 4096


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target): sources in code-point order, null last, weigh 1, 2, 3 and so on again; shares of
    the total stop at ``most`` times the source's size, the excess is shared again by weight until none is above.

    ``sources`` has one row per source. A source is at its stop exactly when most * size / weight is at most the
    common share per weight, so rounds that only raise this share end at the answer; each is one aggregate of two
    numbers.
    """
    ranked = cut(
        sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .select("source", "source_size", ((F.col("_rank") - 1) % 3 + 1).cast("double").alias("w"))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stop = 0.0, F.col("source_size") * float(most)
    while True:
        full = stop <= F.col("w") * level
        fixed, weight = ranked.agg(F.coalesce(F.sum(F.when(full, stop)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        raised = (total - fixed) / weight if weight else level
        if raised <= level:
            break
        level = raised
    return ranked.select("source", "source_size", F.least(stop, F.col("w") * level).alias("target"))


def _reachable(budget: int, items: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(length, count) of a choice from bounded items whose total is the largest possible up to ``budget``.

    Bounded knapsack by bit sets: bit s of a row says that some choice of the first items adds up to s.
    """
    mask = (1 << (budget + 1)) - 1
    reach, rows, steps = 1, [], []
    for length, count in items:
        power, left = 1, min(count, budget // length)
        while left > 0:
            n = min(power, left)
            rows.append(reach)
            steps.append((length, n))
            reach |= (reach << (length * n)) & mask
            left, power = left - n, power * 2
        if reach >> budget & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for (length, n), before in zip(reversed(steps), reversed(rows)):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + n
            total -= length * n
    return list(taken.items())


def _cumulated(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The proportional share of lengths too rare for one of their own: shares add up from the longest length down, and
    whenever they make a whole document one is taken there. No more than ``budget`` words, and less by one longest document at most."""
    size = int((lengths * counts).sum())
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(object) * min(budget, size) // size
    return np.diff(upto).astype(np.int64)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below ``budget`` as can be."""
    size = int((lengths * counts).sum())
    if budget >= size:
        return counts.copy()
    share = budget / size if size else 0.0
    taken = np.floor(counts * share).astype(np.int64)
    gap = int(budget - (lengths * taken).sum())
    if gap > KNAPSACK:
        longest = np.argsort(-lengths, kind="stable")
        taken[longest] += _cumulated(lengths[longest], (counts - taken)[longest], gap - KNAPSACK // 2)
        gap = int(budget - (lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if gap <= KNAPSACK:
            break
        n = min(int(counts[i] - taken[i]), (gap - KNAPSACK // 2) // int(lengths[i]))
        if n > 0:
            taken[i] += n
            gap -= n * int(lengths[i])
    at = {int(x): i for i, x in enumerate(lengths)}
    free = [(int(x), int(c - t)) for x, c, t in zip(lengths, counts, taken) if 0 < x <= gap and c > t]
    for length, n in _reachable(min(gap, 2 * KNAPSACK), free) if gap > 0 else []:
        taken[at[length]] += n
    return taken


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` as a table read from files, whose rows have places (file, row number) that recomputed tasks agree on."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema
    except AnalysisException:
        return cut(docs)
    return docs


def _end(rows: DataFrame, goals: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(keys, by, _take): for each goal (keys, _take) the value of ``by`` at which the first ``_take`` of its rows in that order
    end, and how many rows of that value are still to be taken. Rows are counted before anything is ordered."""
    counts = rows.join(goals, keys).groupBy(*keys, "_take", *by).count()
    before = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counted = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ends = counted.where("_before < _take and _take <= _before + count")
    return ends.select(*keys, *by, (F.col("_take") - F.col("_before")).alias("_take"))


def mix_sources(docs: DataFrame, keep: list[str] | None = None, most: int = MOST, seed: int = 17, text: str = "text") -> DataFrame:
    """One row per input row: ``row`` (a struct of the columns ``keep``; all by default, whatever their names), size,
    source_size, target and ``times``: how often the mix takes the document (0 to ``most``); its words in the mix are
    size * times.

    A null or empty text has size 0 and is never taken (it adds no word). A null source is a source of its own, the last. A very
    long text is one document of its length: it is taken when the knapsack finds room for it. A table without words
    has targets of 0; an empty table gives an empty result. Rows that share id and source are ordered by a hash of the
    text; equal rows by their place in the files, so exactly as many of them are taken as the budget needs (which of
    them, makes no difference to the mix).

    What is gathered per source is its count of documents per exact length: one row for each length that occurs, not
    for each document. The seeded order is followed from coarse to fine: counts tell in which of PARTS hash parts of a (source,
    length) group the choice ends, then at which id and text in that part, then in which part of that text's copies, then at
    which copy. Only what is left after each step is counted on, so neither a group nor a repeated row that holds
    a third of all rows is ordered in one task.
    """
    docs = _identified(docs)
    place = docs.metadataColumn("_metadata")
    source, order = F.col("source"), seeded(seed, "doc_id", "source")
    tie = F.xxhash64(place["file_path"], place["row_index"])
    rows = docs.select(
        F.struct(*(keep or ["*"])).alias("row"),
        source.isNull().alias("_none"),
        F.coalesce(source, F.lit("")).alias("_source"),
        word_count(text).alias("size"),
        F.struct(
            F.pmod(F.shiftrightunsigned(order, 40), F.lit(PARTS)).alias("_part"),
            order.alias("_order"),
            F.xxhash64(F.col(text)).alias("_text"),
            F.pmod(F.shiftrightunsigned(tie, 40), F.lit(PARTS)).alias("_tie_part"),
            tie.alias("_tie"),
        ).alias("_at"),
    )
    if keep is not None:
        rows = cut(rows)  # narrow: texts are read once
    group = ["_none", "_source", "size"]
    parted = rows.select(*group, "_at.*")
    if keep is None:
        parted = cut(parted)
    lengths = cut(parted.groupBy(*group).agg(F.count("*").alias("n")))
    per_source = lengths.groupBy("_none", "_source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    aimed = cut(targets(per_source.select(F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_size"), most))
    aimed = aimed.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")

    def choose(group: pa.Table) -> pa.Table:
        size, n = group["size"].to_numpy(), group["n"].to_numpy()
        source_size, target = group["source_size"][0].as_py(), group["target"][0].as_py()
        passes = min(most, int(target // source_size)) if source_size else 0
        rest = int(round(target - passes * source_size)) if source_size and passes < most else 0
        word = size > 0
        extra = np.zeros(len(n), np.int64)
        extra[word] = fit_budget(size[word], n[word], rest)
        found = {"_none": group["_none"], "_source": group["_source"], "size": size, "passes": np.where(word, passes, 0), "extra": extra, "source_size": group["source_size"], "target": group["target"]}
        return pa.table(found)

    ship(docs.sparkSession)
    joined = lengths.join(aimed, ["_none", "_source"])
    plan = cut(joined.groupBy("_none", "_source").applyInArrow(choose, "_none boolean, _source string, size long, passes long, extra long, source_size long, target double"))

    ends, keys = plan.where("extra > 0").select(*group, F.col("extra").alias("_take")), group
    for by in (["_part"], ["_order", "_text"], ["_tie_part"], ["_tie"]):
        ends = _end(parted, ends, keys, by)
        keys = keys + by
    ends = ends.select(*group, F.struct("_part", "_order", "_text", "_tie_part", "_tie").alias("_cut"))
    plan = cut(plan.join(ends, group, "left").drop("extra"))

    found = rows.join(plan, group)
    more = F.coalesce(F.col("_at") <= F.col("_cut"), F.lit(False)).cast("long")
    return found.select("row", "size", "source_size", "target", (F.col("passes") + more).alias("times"))


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
