"""Document fingerprints (operator 12): threshold-scaled sketches.

A text's shingles are its windows of WIDTH code points (a shorter text is one shingle). Each is hashed to 40 bits, and every
hash below the fixed fraction 1 / SCALE is retained, so a sketch grows with its text. Sketches are therefore sets over one
common sample of all shingles: the union of two is the sketch of both texts together, and the share of one sketch found in
another estimates how much of the one text the other contains, however unequal they are.

A fingerprint is a string: the retained hashes in ascending order, as six letters each. Where a short text retains none, its
smallest hash stands in, as "~" and seven letters; two such fingerprints are equal with the probability of the texts'
likeness. A text without a character has the empty fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.llm.common import arrow_map, cut, seeded, table
from geoloom.llm.registry import query
from geoloom.llm.textbytes import BASE, U64, chunks, mix
from geoloom.shipping import ship

WIDTH = 16  # code points of a shingle, a power of two
SCALE = 16
BITS = 40  # of a hash
LIMIT = (1 << BITS) // SCALE  # 36 bits: six letters of six bits
PIECE = 1 << 20  # bytes of a very long text hashed at once
LETTERS = np.frombuffer(b"-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", np.uint8)  # ascending, as strings compare

SLICE_BYTES = 16 << 20  # text in a slice of neighbours
SAMPLED = 20_000  # keys from which the slices' bounds are taken; at most a quarter as many slices
COPIES = 1_000  # equal rows given out by one task at once


def _windows(codes: np.ndarray) -> np.ndarray:
    """The hash of the WIDTH code points from each on."""
    out, width = mix(codes.astype(U64) + U64(BASE)), 1
    while width < WIDTH:
        out = mix(out[:-width] * U64(BASE) + out[width:]) if len(out) > width else out[:0]
        width *= 2
    return out >> U64(64 - BITS)


def _whole(codes: np.ndarray) -> int:
    """The hash of a text shorter than a window: it is filled up with a code that no text holds."""
    return int(_windows(np.concatenate([codes, np.full(WIDTH - len(codes), 0xFFFFFFFF, np.uint32)]))[0])


def _letters(values: np.ndarray, n: int) -> bytes:
    shifts = np.arange(6 * (n - 1), -1, -6).astype(U64)
    return LETTERS[((values[:, None] >> shifts) & U64(63)).astype(np.intp)].tobytes()


def _codes(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)


def _pieces(data: bytes) -> Iterator[np.ndarray]:
    """The code points of a text in pieces that overlap by a window less one."""
    at, tail = 0, np.zeros(0, np.uint32)
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to += 1
        codes = np.concatenate([tail, _codes(data[at:to])])
        yield codes
        at, tail = to, codes[max(0, len(codes) - WIDTH + 1) :]


def sketch(texts: list[bytes]) -> list[np.ndarray]:
    """The ascending retained hashes of each text; the smallest one, though LIMIT or above, where none is retained."""
    out: list[np.ndarray] = [np.zeros(0, U64)] * len(texts)
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            low = [(v[v < LIMIT], v.min(initial=1 << BITS)) for v in map(_windows, _pieces(texts[at]))]
            kept = np.unique(np.concatenate([v for v, _ in low]))
            out[at] = kept if len(kept) else np.array([min(m for _, m in low)], U64)
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE):
            size += len(texts[to])
            to += 1
        group = texts[at:to]
        codes = _codes(b"".join(group))
        starts = np.zeros(len(group) + 1, np.int64)
        np.cumsum([len(t.decode()) for t in group], out=starts[1:])
        values = _windows(codes)
        place = np.flatnonzero(values < LIMIT)
        owner = np.searchsorted(starts, place, "right") - 1
        inside = place + WIDTH <= starts[owner + 1]
        place, owner = place[inside], owner[inside]
        bounds = np.searchsorted(owner, np.arange(len(group) + 1))
        for k in range(len(group)):
            s, e = int(starts[k]), int(starts[k + 1])
            if 0 < e - s < WIDTH:
                out[at + k] = np.array([_whole(codes[s:e])], U64)
            elif bounds[k] < bounds[k + 1]:
                out[at + k] = np.unique(values[place[bounds[k] : bounds[k + 1]]])
            elif e > s:
                out[at + k] = values[s : e - WIDTH + 1].min(keepdims=True)
        at = to
    return out


def encode(hashes: np.ndarray) -> str:
    if len(hashes) and hashes[0] >= LIMIT:
        return "~" + _letters(hashes, 7).decode()
    return _letters(hashes, 6).decode()


def shared_part(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that b holds; two texts without any are alike."""
    if len(a) == 0 or len(b) == 0:
        return 1.0 if len(a) == len(b) else 0.0
    return float(np.isin(a, b, assume_unique=True).mean())


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) for every row of ``docs``; equal texts have equal fingerprints.

    A null text counts as empty and has the empty fingerprint. Null ids and repeated rows keep their rows; an empty table
    gives an empty result; other columns are ignored, whatever their names. Texts are read whole, very long ones in pieces
    of about a megabyte. There is no shuffle.
    """

    def run(batch: pa.RecordBatch):
        for row, to, texts in chunks(batch.column(1)):
            found = [encode(x) for x in sketch([texts.data[s:e].tobytes() for s, e in zip(texts.at[:-1], texts.at[1:])])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), pa.array(found, pa.string())], ["_id", "fingerprint"])

    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    return arrow_map(rows, run, f"_id {rows.schema['_id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("_id", id)


def hashes_of(fingerprint: Column) -> Column:
    """The fingerprint's hashes as an array of their letters."""
    return F.when(fingerprint.startswith("~"), F.array(fingerprint)).otherwise(F.regexp_extract_all(fingerprint, F.lit("(?s).{6}"), 0))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b holds, by SQL functions; null for a null fingerprint."""
    size = F.size(hashes_of(a))
    empty = F.when(b == "", 1.0).otherwise(0.0)
    return F.when(a == "", empty).when(b.isNotNull(), F.size(F.array_intersect(hashes_of(a), hashes_of(b))) / size)


def merge_fingerprints(prints: DataFrame, by: list[str], fingerprint: str = "fingerprint") -> DataFrame:
    """(by, fingerprint): the fingerprint of each group's texts together, as far as they retain hashes.

    Equal hashes merge in the map tasks and before a group is put together, so a group's cost is that of its distinct hashes.
    Where no text of the group retains a hash, the smallest stand-in is the group's; a group without any has the empty one.
    """
    parts = prints.select(*by, F.explode_outer(hashes_of(F.col(fingerprint))).alias("_h")).distinct()
    retained = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("_h").startswith("~"), F.col("_h")))), "")
    merged = parts.groupBy(*by).agg(retained.alias("_all"), F.min(F.when(F.col("_h").startswith("~"), F.col("_h"))).alias("_least"))
    return merged.select(*by, F.when(F.col("_all") != "", F.col("_all")).otherwise(F.coalesce("_least", F.lit(""))).alias(fingerprint))


# --- each text beside its neighbour -----------------------------------------------------------------------


def _slices(keys: DataFrame) -> np.ndarray:
    """The first key of each slice: slices of about SLICE_BYTES of text along the keys (z, r, h), all of them
    keys of the table. Bounds are taken from a seeded sample of at most SAMPLED keys, so the driver holds no more."""
    total, first = keys.agg(F.sum("bytes"), F.min(F.struct("z", "r", "h"))).first()
    kind = [("z", "i8"), ("r", "i8"), ("h", "i8")]
    if first is None:
        return np.zeros(0, kind)
    drawn = keys.orderBy(seeded(11, "z", "r", "h")).limit(SAMPLED).collect()
    sizes = {tuple(first): 0} | {(k.z, k.r, k.h): k.bytes for k in drawn}
    inner = sorted(sizes)
    slices = max(1, min(len(inner) // 4, total // SLICE_BYTES))
    share = np.cumsum([sizes[k] for k in inner]) * slices // (sum(sizes.values()) + 1)
    opens = np.append(True, np.diff(share) > 0)
    return np.array([k for k, o in zip(inner, opens) if o], kind)


def _beside(rows: DataFrame) -> DataFrame:
    """Rows (id, text, times) by (z, r, h), dealt so that every slice of the order lies in one partition, sorted, and
    ends with a guest: the first row of the next slice (of the first one after the last)."""
    keyed = rows.select("id", "text", "times", *_order(F.col("id"), F.col("text")))
    bounds = _slices(cut(keyed.select("z", "r", "h", F.octet_length("text").alias("bytes"))))
    n = max(1, len(bounds))
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    def place(batches):
        for batch in batches:
            key = np.zeros(batch.num_rows, shared.value.dtype)
            for name in ("z", "r", "h"):
                key[name] = batch.column(name).to_numpy(zero_copy_only=False)
            at = np.searchsorted(shared.value, key, "right") - 1
            guest = np.where(shared.value[np.maximum(at, 0)] == key, (at - 1) % n, -1)
            columns = dict(zip(batch.schema.names, batch.columns))
            yield pa.RecordBatch.from_pydict(columns | {"slice": pa.array(at, pa.int64()), "guest_of": pa.array(guest, pa.int64())})

    schema = StructType([*keyed.schema.fields]).add("slice", "long").add("guest_of", "long")
    placed = keyed.mapInArrow(place, schema)
    dealt = placed.select("*", F.explode(F.array_compact(F.array(F.struct(F.col("slice").alias("s"), F.lit(False).alias("guest")), F.when(F.col("guest_of") >= 0, F.struct(F.col("guest_of").alias("s"), F.lit(True).alias("guest")))))).alias("d"))
    laid = dealt.select(F.col("d.s").alias("s"), F.col("d.guest").alias("guest"), "z", "r", "h", "id", "text", "times")
    return laid.repartitionById(n, F.col("s").cast("int")).sortWithinPartitions("s", "guest", "z", "r", "h").select("guest", "id", "text", "times")


def _order(id: Column, text: Column) -> list[Column]:
    """Descending id, nulls last; equal ids by a hash of the text."""
    return [F.when(id.isNull(), 1).otherwise(0).cast("long").alias("z"), F.coalesce(F.bitwise_not(id.cast("long")), F.lit(0).cast("long")).alias("r"), F.xxhash64(text).alias("h")]


def _bytes_to(data: bytes, n: int) -> int:
    """The byte at which the n-th code point from 0 begins, or the end."""
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return int(starts[n]) if n < len(starts) else len(data)


def _edited(text: bytes, n: int, following: bytes) -> bytes:
    """The text whose last third is replaced by the beginning of the following one."""
    k = n // 3
    return text[: _bytes_to(text, n - k)] + following[: _bytes_to(following[: 4 * k], k)]


OUT = "id long, times long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    The next document is the one of the next lower id (after the lowest: of the highest); the edited text is a text whose last
    third of code points is replaced by the first as many (or all) of the next document. ``near_edited`` and ``near_next``
    estimate the share of the text's shingles that the edited text and the next document hold.

    A null text counts as empty. Null ids come last, rows of one id in the order of a hash of their texts. Rows that share id
    and text are one document: its rows are equal, and its next is the next other one. One document alone is its own next. An
    empty table gives an empty result; other columns are ignored. Texts are used whole; at no time are more than a
    batch and one text more held. The texts are shuffled once, in slices of the order; repeated rows, if there are any, merge in
    a shuffle before that.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeated = rows.groupBy("id", F.xxhash64("text").alias("h")).count().where("count > 1")
    if repeated.isEmpty():
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    else:
        rows = rows.groupBy("id", "text").agg(F.count("*").alias("times"))

    def run(batches):
        held = None
        for batch in batches:
            guests, ids, texts, times = (batch.column(k).to_pylist() for k in range(4))
            texts = [t.encode() for t in texts]
            prints = sketch(texts)
            lines = list(zip(guests, ids, texts, times, prints))
            if held is not None:
                lines.insert(0, held)
            held = lines[-1]
            pairs = [(a, b) for a, b in zip(lines, lines[1:]) if not a[0]]
            if not pairs:
                continue
            lengths = [len(a[2].decode()) for a, _ in pairs]
            edits = [_edited(a[2], n, b[2]) for (a, b), n in zip(pairs, lengths)]
            of_edits = sketch(edits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[1] for a, _ in pairs], pa.int64()),
                    pa.array([a[3] for a, _ in pairs], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edits]),
                    pa.array([encode(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([encode(x) for x in of_edits], pa.string()),
                    pa.array([shared_part(a[4], x) for (a, _), x in zip(pairs, of_edits)], pa.float64()),
                    pa.array([shared_part(a[4], b[4]) for a, b in pairs], pa.float64()),
                ],
                [f.split()[0] for f in OUT.split(", ")],
            )

    found = _beside(rows).mapInArrow(run, OUT)
    parts = found.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES))))
    if not repeated.isEmpty():
        parts = parts.repartition("id", "_part")
    each = parts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("times") - F.lit(COPIES) * F.col("_part")))))
    return each.select(F.col("id").alias(id), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op12_fingerprints")
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
