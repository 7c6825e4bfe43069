"""Line dedup (operator 1): maximal repeated line runs by prefix doubling, later copies deleted.

Lines with a word get ids; a document is its sequence of line ids, and a suffix starts at each of them. Round
k ranks the suffixes by their first 2**k lines: the pair (rank of the first half, rank of the suffix half
way) is grouped, and a class's rank is the position of its first suffix. A class is the interval of the suffix
array in which the longest common prefix is at least that long; a suffix alone in its class can repeat no
longer run and leaves. An interval of any other depth is the pair of ranks of two overlapping halves.

A run is worth deleting from MIN_WORDS words on. A maximal repeated run of that size is the union of the shortest
such windows that start or end at its lines, so those windows are all that must be looked up: a window whose
interval begins before it is a later copy. A line has a word at least, so windows have at most MIN_WORDS lines and
the doubling ends after log2(MIN_WORDS) rounds, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import WORD, cut, table
from geoloom.llm.registry import query

MIN_WORDS = 50
KEY = ["d", "h"]


def _lines(docs: DataFrame) -> DataFrame:
    """(d, h, i, line_no, n, a, b): the i-th line with a word of a document, its words, and its id (a, b) of 128 bits."""
    numbered = F.transform(F.split("_text", "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("line_no")))
    full = F.filter(numbered, lambda x: x["line"].rlike(WORD))
    lines = docs.where(F.col("_text").isNotNull()).select("d", "h", F.posexplode(full).alias("i", "x"))
    line = F.col("x.line")
    return lines.select("d", "h", "i", "x.line_no", F.regexp_count(line, F.lit(WORD)).alias("n"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _ranked(pairs: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Rows of ``pairs`` whose key occurs at two positions or more, with ``rank``: its first position. Grouping combines
    in each task first, and a frequent key's join partition can be split."""
    position = F.struct("d", "h", "i")
    classes = pairs.groupBy(*by).agg(F.min(position).alias("rank"), F.max(position).alias("_last")).where("rank < _last").drop("_last")
    return pairs.join(classes, by).select(*keep, "rank")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, line_no) of the lines that belong to a later copy of a run of at least ``min_words`` words; ``docs`` has
    d (id), h (hash of the text) and _text."""
    lines = cut(_ranked(_lines(docs), ["a", "b"], ["d", "h", "i", "line_no", "n"]).dropDuplicates(["d", "h", "i"]))

    # shortest windows of min_words words that start, or end, at a line; gaps are lines that occur once
    doc = Window.partitionBy(*KEY).orderBy("i")
    summed = lines.withColumn("e", F.sum("n").over(doc.rowsBetween(Window.unboundedPreceding, 0))).withColumn("c", F.col("e") - F.col("n"))
    ahead = F.collect_list(F.struct("i", "e")).over(doc.rangeBetween(0, min_words - 1))
    behind = F.collect_list(F.struct("i", "c")).over(doc.rangeBetween(1 - min_words, 0))
    summed = summed.select("d", "h", "i", "c", "e", ahead.alias("ahead"), behind.alias("behind"))
    ahead = F.filter("ahead", lambda x, k: x["i"] == F.col("i") + k)
    behind = F.filter(F.reverse("behind"), lambda x, k: x["i"] == F.col("i") - k)
    short_ahead = F.size(F.filter(ahead, lambda x: x["e"] < F.col("c") + min_words))
    short_behind = F.size(F.filter(behind, lambda x: x["c"] > F.col("e") - min_words))
    windows = summed.select(
        "d", "h",
        F.explode(F.array(
            F.when(short_ahead < F.size(ahead), F.struct(F.col("i").alias("i"), (short_ahead + 1).alias("m"))),
            F.when(short_behind < F.size(behind), F.struct((F.col("i") - short_behind).alias("i"), (short_behind + 1).alias("m"))),
        )).alias("w"),
    ).where("w is not null").select("d", "h", "w.i", "w.m").distinct()
    windows = cut(windows)

    ranks, later, k = lines.select("d", "h", "i", "rank"), None, 0
    while True:
        half = 1 << k
        mine = windows.where((F.col("m") >= half) & (F.col("m") < 2 * half))
        first = ranks.withColumnRenamed("rank", "r1")
        second = ranks.select("d", "h", F.col("i").alias("_at"), F.col("rank").alias("r2"))
        known = mine.join(first, ["d", "h", "i"]).withColumn("_at", F.col("i") + F.col("m") - half).join(second, ["d", "h", "_at"]).drop("_at")
        # one job a round: a plan of all rounds would cost the driver more memory than the rows do
        copies = cut(_ranked(known, ["m", "r1", "r2"], ["d", "h", "i", "m"]).where(F.col("rank") < F.struct("d", "h", "i")).drop("rank"))
        later = copies if later is None else later.unionByName(copies)
        if 2 * half > min_words:
            break
        ahead = ranks.withColumn("_next", F.lead("rank", half).over(doc)).withColumn("_at", F.lead("i", half).over(doc)).where(F.col("_at") == F.col("i") + half)
        ranks = cut(_ranked(ahead.withColumnRenamed("rank", "_rank"), ["_rank", "_next"], ["d", "h", "i"]))
        k += 1

    covered = later.select("d", "h", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("m") - 1)).alias("i")).distinct()
    return covered.join(lines.select("d", "h", "i", "line_no"), ["d", "h", "i"]).select("d", "h", "line_no")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``row`` (a struct of all its columns, whatever their names), ``deduped`` (the text without
    the deleted lines), n_lines (with a word), n_removed.

    Lines are what stands between \\n; two are equal when all their characters are. Lines without a word are never deleted
    and do not break a run. Runs do not cross documents. The first copy, by id and then line, stays. Copies
    may overlap, as in a line that is repeated over and over. A null text stays null, an empty one empty, both with 0 lines. Rows
    that share id and text are one document and get the same result; rows that share only the id are documents of
    their own, ordered by a hash of the text. Null ids come first, as the least integer. An empty table gives an empty result.
    """
    key = [F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("_text")]
    removed = repeated_lines(docs.select(*key), min_words).groupBy(*KEY).agg(F.collect_list("line_no").alias("_gone"))
    rows = docs.select(F.struct("*").alias("row"), *key)
    r, g = rows.alias("r"), removed.alias("g")
    joined = r.join(g, F.expr("r.d = g.d and r.h = g.h"), "left").select("row", "_text", F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    lines = F.split("_text", "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains("_gone", i))
    return joined.select(
        "row",
        F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.concat_ws("\n", left)).alias("deduped"),
        F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(WORD))), F.lit(0)).alias("n_lines"),
        F.size("_gone").alias("n_removed"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL),
full_lines AS (
  SELECT doc_id, line_no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs AS (
  SELECT a.doc_id AS da, b.doc_id AS db, b.i AS ib, b.line_no, b.n, b.i - a.i AS diagonal
  FROM full_lines a JOIN full_lines b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i)),
islands AS (SELECT *, ib - row_number() OVER (PARTITION BY da, db, diagonal ORDER BY ib) AS island FROM pairs),
runs AS (SELECT *, sum(n) OVER (PARTITION BY da, db, diagonal, island) AS words FROM islands),
gone AS (SELECT DISTINCT db AS doc_id, line_no FROM runs WHERE words >= 50),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM lines l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.line_no = l.line_no) GROUP BY doc_id)
SELECT d.doc_id,
  (SELECT count(*) FROM full_lines f WHERE f.doc_id = d.doc_id) AS n_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


@query("op1_line_dedup", ORACLE)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.col("deduped").alias("text"))
