"""Periodic run detection (operator 13): an online sparse diagonal DP over the words of a text.

A diagonal is a lag q; on it word i matches if it equals word i - q, and m matches in a row are a stretch of m + q words
with period q. Reading from left to right, each word's earlier occurrences name the lags whose match lengths grow; a
diagonal without a match ends, and if it was long enough, its run is emitted at once.

Frequent words would make that quadratic, so it is kept sparse by the lag's own scale: for lags from w to 2w - 1 (w = 1, 2,
4, ...) the unit of occurrence is an aligned block of w words instead of a word. A run is at least four periods long, so its
matches fill two blocks in a row or more; only those diagonals are followed to their exact ends. Blocks that lie
with all their lags in a run of a smaller period are skipped: there a longer period is a multiple of the smaller one. A text
of n words thus costs at most about n comparisons a scale, whatever it repeats.

All texts of an Arrow batch are read as one sequence of words numbered by text, so that no match crosses two texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import WORD, arrow_map, table
from geoloom.llm.registry import query
from geoloom.llm.textbytes import BASE, U64, chunks, mix

LEAST = 6  # words of a run
PERIODS = 4  # periods of a run
CELLS = 1 << 20  # comparisons made at once
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _agreeing(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on agree, to the right (step 1) or to the left (step -1); b is the smaller place."""
    done, size = 0, 64
    while True:
        room = min(size, len(ids) - a - done if step == 1 else b + 1 - done)
        if room <= 0:
            return done
        if step == 1:
            same = ids[a + done : a + done + room] == ids[b + done : b + done + room]
        else:
            same = (ids[a - done - room + 1 : a - done + 1] == ids[b - done - room + 1 : b - done + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, size = done + room, size * 4


def _matching(windows: np.ndarray, blocks: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(block number, lag) of every earlier occurrence of a block at a lag from w to 2w - 1, by lag, then block."""
    lags = np.arange(w, 2 * w)
    found, rows = [], max(1, CELLS // w)
    for at in range(0, len(blocks), rows):
        here = blocks[at : at + rows] * w
        row, lag = np.nonzero(windows[here[:, None] - lags] == windows[here][:, None])
        inside = here[row] >= lags[lag]  # an index below 0 means nothing
        found.append((blocks[at + row[inside]], lags[lag[inside]]))
    block, lag = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(lag, kind="stable")
    return block[order], lag[order]


def find_runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start, then period. ``words`` are hashes of the words of several texts in a
    row, ``lengths`` the number of words of each; places count over all texts."""
    total, longest = len(words), int(lengths.max(initial=0))
    ids = mix(words + np.repeat(np.arange(len(lengths)).astype(U64), lengths) * U64(BASE))
    room = np.repeat(lengths, lengths)
    runs: dict[tuple[int, int], int] = {}
    windows, w = ids, 1
    while PERIODS * w <= longest:
        blocks = np.arange(1, total // w)
        blocks = blocks[room[blocks * w] >= PERIODS * w]
        if runs:
            spans = np.array(sorted(runs))
            reach = np.maximum.accumulate(spans[:, 1])
            before = np.searchsorted(spans[:, 0], (blocks - 2) * w + 1, "right") - 1
            blocks = blocks[(before < 0) | (reach[before] < (blocks + 1) * w)]
        if len(blocks):
            block, lag = _matching(windows, blocks, w)
            opens = np.ones(len(block), bool)
            opens[1:] = (np.diff(block) != 1) | (np.diff(lag) != 0)
            first = np.flatnonzero(opens)
            size = np.diff(np.append(first, len(block)))
            period = lag[first]
            needed = np.maximum(LEAST - period, (PERIODS - 1) * period)
            for k in np.flatnonzero((size >= 2) & ((size + 2) * w - 2 >= needed)):
                q, left = int(period[k]), int(block[first[k]]) * w
                right = left + int(size[k]) * w
                left -= _agreeing(ids, left - 1, left - 1 - q, -1)
                right += _agreeing(ids, right, right - q, 1)
                if right - left >= needed[k]:
                    span = (left - q, right)
                    runs[span] = min(q, runs.get(span, q))
        shorter = windows[: max(0, len(windows) - w)]
        windows = mix(shorter * U64(BASE) + windows[w:]) if len(shorter) else windows[:0]
        w *= 2
    found = np.array(sorted((s, q, e) for (s, e), q in runs.items()), np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 2], found[:, 1]


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) for every row of ``docs``.

    ``runs`` are all maximal stretches of words with smallest period q and at least max(6, 4 * q) words, as (start,
    length, period) by start, then period; words are numbered from 0. ``collapsed`` is the text's words joined by one
    space, without those that any run contains after that run's first q words.

    A null or empty text, or one without words, has 0 words, no runs and an empty ``collapsed``; null ids and repeated rows
    keep their rows, each on its own; an empty table gives an empty result; other columns are ignored, whatever their names.
    Texts are read whole: a very long one is a batch of its own, at about 100 bytes of memory for each of its words. There is
    no shuffle, so neither sources nor copies can be hot. Words are told apart by 64-bit hashes.
    """

    def run(batch: pa.RecordBatch):
        for row, to, texts in chunks(batch.column(1)):
            words = texts.words()
            start, end, period = find_runs(words.hashes(), words.counts)
            owner = np.searchsorted(words.first, start, "right") - 1
            dropped = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, end, -1)
            keep = np.cumsum(dropped)[:-1] == 0
            collapsed = []
            touched = set(owner.tolist())
            for k in range(texts.n):
                found = texts.data[texts.at[k] : texts.at[k + 1]].tobytes().split()  # at 0x20 and 0x09-0x0D
                if k in touched:
                    found = [x for x, stays in zip(found, keep[words.first[k] : words.first[k + 1]].tolist()) if stays]
                collapsed.append(b" ".join(found))
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (start - words.first[owner], end - start, period)], ["start", "length", "period"])
            offsets = np.searchsorted(owner, np.arange(texts.n + 1)).astype(np.int32)
            columns = [batch.column(0).slice(row, to - row), pa.array(words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return arrow_map(rows, run, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id)


def looped(text: Column, doc_id: Column) -> Column:
    """The text with a loop planted in every tenth document: with h = crc32 of the decimal id and g = h div 10, where h % 10 = 0
    the words from a = g % n on repeat the first p = 1 + (n - a) div (3 + g % 8) of them. Other texts stay; so do those without
    words and rows without an id. SQL functions only, evaluated for the chosen documents."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def loop(found: Column) -> Column:
        n = F.size(found).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(found, i.cast("int"))), " ")

    planted = F.element_at(F.transform(F.array(words), loop), 1)  # the words are split once
    return F.when((h % 10 == 0) & text.rlike(WORD), planted).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = periodic_runs(docs).withColumn("_longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.start")).alias("start"),
        F.col("_longest.length").alias("length"),
        (-F.col("_longest.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("_longest.length") / -F.col("_longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
