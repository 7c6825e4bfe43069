"""Feature collections read by many tasks: a JSON document has no line breaks to split at, so its features are found
by two passes over pieces that end in ``}``.

Spark's text reader cuts a file into splits at any closing brace. Whether a brace lies in a string, and how deep it is nested,
depends on everything before it. The first pass therefore sums every split up twice, as if it began outside and inside
a string; one small window per file over one row per split tells which of the two holds and at which depth the split
begins. The second pass walks each split from there and closes a feature wherever a brace leads back into an array
of the outermost object. Features that cross a split's border are put together by their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.shipping import ship
from geoloom.sources.place import written

#: Splits whose starting states (about 150 bytes each) are sent to every task; those of more splits are joined by a shuffle.
SENT_SPLITS = 200_000

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}\[\]]', re.DOTALL)


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text up to each closing brace, with its number of quotes (0 even, 1 odd) and the change of depth in braces and
    brackets if it begins outside (0) or inside (1) a string."""
    text = spark.read.option("lineSep", "}").text(paths)
    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    odd = (_count(plain, '"') % 2).cast("byte")

    def bare(text: Column) -> Column:
        return F.regexp_replace(text, r'"[^"]*+(?:"|\z)', "")

    outside, inside = bare(plain), bare(F.concat(F.lit('"'), plain))
    deeper = [_count(t, "{") - (odd == k).cast("int") for k, t in enumerate((outside, inside))]
    lists = [_count(t, "[") - _count(t, "]") for t in (outside, inside)]
    return rows.withColumns({"odd": odd, "c0": deeper[0], "c1": deeper[1], "s0": lists[0], "s1": lists[1]})


def _walk(batch: pa.RecordBatch, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inside a string after each record, changes in braces, in brackets) if the first begins with ``inside``."""
    odd, c0, c1, s0, s1 = (batch.column(n).to_numpy() for n in ("odd", "c0", "c1", "s0", "s1"))
    after = (np.cumsum(odd, dtype=np.int64) + inside) % 2
    before = np.concatenate([[inside], after[:-1]])
    return after, np.where(before == 0, c0, c1), np.where(before == 0, s0, s1)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(a split begins, rows of one split), in order."""
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        file, block = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = (batch.column("file")[a].as_py(), block[a])
            yield key != last, batch.slice(a, b - a)
            last = key


SUMS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("odd", pa.int64()), *[(n, pa.int64()) for n in ("c0", "s0", "c1", "s1")]])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: what it changes from either start."""
    held: dict | None = None
    for begins, rows in _by_split(batches):
        if begins:
            if held:
                yield pa.RecordBatch.from_pylist([held], SUMS)
            held = {"file": rows.column("file")[0].as_py(), "block": rows.column("block")[0].as_py(), "odd": 0, "c0": 0, "s0": 0, "c1": 0, "s1": 0}
        for k in (0, 1):
            after, braces, brackets = _walk(rows, (k + held["odd"]) % 2)
            held[f"c{k}"] += int(braces.sum())
            held[f"s{k}"] += int(brackets.sum())
        held["odd"] = int(after[-1] + 1) % 2  # the last walk began inside
    if held:
        yield pa.RecordBatch.from_pylist([held], SUMS)


PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("whole", pa.bool_()), ("ended", pa.bool_()), ("text", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each split; what lies before its first end and behind its last one are fragments (``whole`` is false), but
    for the first piece of a file."""
    key, waiting, state, ends = None, [], (0, 0, 0), 0

    def fragment():
        return {"file": key[0], "block": key[1], "part": 1 if ends else 0, "whole": False, "ended": False, "text": "".join(waiting)}

    for begins, rows in _by_split(batches):
        if begins:
            if waiting:
                yield pa.RecordBatch.from_pylist([fragment()], PIECE)
            key, waiting, ends = (rows.column("file")[0].as_py(), rows.column("block")[0].as_py()), [], 0
            state = tuple(rows.column(n)[0].as_py() for n in ("inside", "curly", "square"))
        after, braces, brackets = _walk(rows, state[0])
        braces, brackets = state[1] + np.cumsum(braces), state[2] + np.cumsum(brackets)
        state = (int(after[-1]), int(braces[-1]), int(brackets[-1]))
        closed = np.flatnonzero((after == 0) & (braces == 1) & (brackets == 1)).tolist()
        values, found, at = rows.column("value").to_pylist(), [], 0
        for end in closed:
            text = "".join(waiting) + "".join(v + "}" for v in values[at : end + 1])
            whole = ends > 0 or key[1] == 0
            found.append({"file": key[0], "block": key[1], "part": 0, "whole": whole, "ended": True, "text": text})
            waiting, at, ends = [], end + 1, ends + 1
        waiting += [v + "}" for v in values[at:]]
        if found:
            yield pa.RecordBatch.from_pylist(found, PIECE)
    if waiting:
        yield pa.RecordBatch.from_pylist([fragment()], PIECE)


def _object(text: str) -> str:
    """The object that ends a piece, without the comma or whatever else is before it."""
    head = text.lstrip("﻿ \t\r\n")
    if head.startswith(","):
        return head[1:].lstrip()
    curly, square = (1, 1) if head.startswith("]") else (0, 0)
    start = 0
    for token in _TOKEN.finditer(head):
        mark = token.group()
        if mark == "{":
            curly += 1
            if (curly, square) == (2, 1):
                start = token.start()
        elif mark == "}":
            curly -= 1
        elif mark in "[]":
            square += 1 if mark == "[" else -1
    return head[start:]


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_object(t) for t in batch.column(0).to_pylist()], pa.string())], ["value"])


def feature_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value): every feature of the collections as one line of JSON, in no order.

    Features are the objects in arrays of the outermost object whose ``type`` is Feature, or that have a geometry and no type.
    Strings may hold braces, brackets and escaped quotes; other members may stand before and behind the features. Empty
    collections and empty files give no row.
    """
    ship(spark)
    rows = _records(spark, paths)
    narrow = rows.select("file", "block", "odd", "c0", "s0", "c1", "s1")
    sums = written(narrow.mapInArrow(_sums, "file string, block long, odd long, c0 long, s0 long, c1 long, s1 long"), "split-sums")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    taken = sums.withColumn("inside", inside)
    changes = {"curly": ("c0", "c1"), "square": ("s0", "s1")}
    for name, (out, within) in changes.items():
        taken = taken.withColumn(f"_{name}", F.when(F.col("inside") == 0, F.col(out)).otherwise(F.col(within)))
    starts = taken.select("file", "block", "inside", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(n) for n in changes])

    if sums.count() <= SENT_SPLITS:
        placed = rows.join(F.broadcast(starts), ["file", "block"])
    else:
        placed = rows.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    placed = placed.select("file", "block", "inside", "curly", "square", "value", "odd", "c0", "c1", "s0", "s1")
    pieces = written(placed.mapInArrow(_pieces, "file string, block long, part int, whole boolean, ended boolean, text string"), "pieces")

    # fragments up to an ended one make a feature; only their places are ordered, their texts are joined to them
    loose = pieces.filter("not whole")
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = loose.select("file", "block", "part", F.coalesce(F.sum(F.col("ended").cast("long")).over(order), F.lit(0)).alias("feature"))
    grouped = loose.join(numbered, ["file", "block", "part"]).groupBy("file", "feature")
    joined = grouped.agg(F.bool_or("ended").alias("ended"), F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("p"))
    crossing = joined.filter("ended").select(F.concat_ws("", F.transform("p", lambda p: p["text"])).alias("text"))

    found = pieces.filter("whole").select("text").unionByName(crossing).mapInArrow(_objects, "value string")
    kind = F.get_json_object("value", "$.type")
    feature = (kind == "Feature") | (kind.isNull() & F.get_json_object("value", "$.geometry").isNotNull())
    return found.filter(feature).select(F.regexp_replace("value", r"[\r\n]+", " ").alias("value"))
