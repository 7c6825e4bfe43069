"""LM scoring (operator 7): online logistic context mixing over hashed byte contexts.

A text is the byte stream of its lower-cased words, a blank after each, and an end byte. Every byte is eight
binary decisions in two nibbles. For each order the last n bytes, hashed, name a slot of 16 counts per nibble;
corpus counts of the training texts fill these tables once, and a node's log odds are a predictor. A text's
predictors are combined by weights kept per decision (the gate is the bit's place in the byte), which follow the
error of every coded bit. Costs add up to the text's bits.

The unigram base counts every word exactly: frequent words through a bounded broadcast table, the others by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import cut, remainder, table
from geoloom.llm.registry import query
from geoloom.llm.textbytes import U64, Texts, chunks, powers
from geoloom.llm.toxicity import spaced
from geoloom.shipping import ship

ORDERS = (2, 3, 5, 0)  # bytes of context; 0: the whole word so far
BITS = (18, 20, 22, 22)
CELLS = [1 << b for b in BITS]
OFFSET = np.concatenate([[0], np.cumsum(CELLS)])
BLOCK = 1 << 16
END_BYTE = 10
PAD = max(ORDERS)
SEGMENT = 1024
#: Steps whose bytes and log odds are brought together at once.
TILE = 16
SCALE = 12.0
PRIOR = 0.05
RATE = 0.004
#: Words in the broadcast table at most; the rest is joined.
FREQUENT = 1 << 18
HELD_OUT, REST = 7, 2
#: Rates at which the starting weights are learnt, and what they start from themselves.
RATES = (0.02, 0.006, 0.002)
START = np.full((len(ORDERS), 8), 0.25 / SCALE)
FOLDS = 2
END_WORD = int(np.array([0x5EED0E4D], U64).view(np.int64)[0])
CHUNK = 1 << 20
PIECE = 1 << 18

_ODD = U64(0x9E3779B97F4A7C15)
_BYTE = np.arange(256)
_SIGN = (2.0 * ((_BYTE[:, None] >> (7 - np.arange(8))) & 1) - 1).astype(np.float32)
#: The four nodes that a nibble meets, by its upper three bits.
_PATH = np.stack([(1 << k) | (np.arange(8) >> (3 - k)) for k in range(4)], 1)


def streams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first, end): every text's bytes to code, PAD end bytes of context before each."""
    part = spaced(texts)
    blank = part.data == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # a blank right behind a word
    keep[0] = False
    kept = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    # the blank before text t belongs to the word that ends text t - 1
    bound = kept[np.minimum(part.at + 1, len(keep))]
    bound[0] = 0
    size = np.diff(bound) + 1
    first = np.cumsum(size + PAD) - size
    out = np.full(int((size + PAD).sum()), END_BYTE, np.uint8)
    body = part.data[keep]
    place = np.arange(len(body)) + np.repeat(first - bound[:-1], np.diff(bound))
    out[place] = body
    return out, first, first + size


def slots(data: np.ndarray):
    """Per order: the first cells of the high and of the low nibble's 16 counts, for every position."""
    nibble = ((data >> 4).astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F)
    wide, value = data.astype(U64), np.zeros(len(data), U64)
    places = {}
    for k in range(1, PAD + 1):
        value[k:] |= wide[:-k] << U64(8 * (k - 1))
        if k in ORDERS:
            places[k] = value + U64(k)
    # a polynomial of the word so far, from one prefix sum; the multiplication below mixes it
    opens = np.flatnonzero((data == 32) | (data == END_BYTE)) + 1
    opens = np.concatenate([[0], opens[opens < len(data)]])[: len(data)]
    length = np.diff(opens, append=len(data))
    prefix = Texts(data, np.array([0, len(data)])).prefix()
    places[0] = prefix[:-1] - np.repeat(prefix[opens], length)
    places[0] *= np.repeat(powers(len(data) + 1)[1][opens], length)
    for order, bits in zip(ORDERS, BITS):
        shift = U64(64 - (bits - 4))
        h = places.pop(order)
        h *= _ODD
        high = (h >> shift).astype(np.int32) << 4
        h += nibble
        h *= U64(0xD6E8FEB86659FD93)
        h >>= shift
        yield high, h.astype(np.int32) << 4


def pieces(texts: Texts):
    """(bytes, first, end) of some whole texts after the other, small enough that a step's arrays stay in the cache."""
    row = 0
    while row < texts.n:
        to = max(row + 1, int(np.searchsorted(texts.at, texts.at[row] + PIECE, "right")) - 1)
        to = min(to, texts.n)
        yield streams(Texts(texts.data[texts.at[row] : texts.at[to]], texts.at[row : to + 1] - texts.at[row]))
        row = to


def count_cells(texts: Texts, total: np.ndarray) -> None:
    views = [total[OFFSET[o] : OFFSET[o + 1]] for o in range(len(ORDERS))]
    one = total.dtype.type(1)
    for data, first, _ in pieces(texts):
        inside = np.ones(len(data), bool)
        for p in range(PAD):
            inside[first - PAD + p] = False
        at = np.flatnonzero(inside)
        nibbles = (data >> 4)[at], (data & 15)[at]
        for view, cells in zip(views, slots(data)):
            for k in range(2):
                np.add.at(view, cells[k][at] + nibbles[k], one)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Eight entries a slot of 16 counts, by the upper three bits of a nibble: the scaled log odds of a 1 at the four nodes
    the nibble meets, as four signed bytes."""
    out = np.zeros(len(counts) // 2, np.uint32)
    node = np.arange(1, 16)
    for a in range(0, len(counts), BLOCK):
        leaf = counts[a : a + BLOCK].reshape(-1, 16)
        heap = np.zeros((len(leaf), 32), np.float32)
        heap[:, 16:] = leaf
        for k in range(15, 0, -1):
            heap[:, k] = heap[:, 2 * k] + heap[:, 2 * k + 1]
        odds = np.zeros((len(leaf), 16), np.int8)
        exact = np.log((heap[:, 2 * node + 1] + PRIOR) / (heap[:, 2 * node] + PRIOR))
        odds[:, 1:] = np.clip(np.rint(exact * SCALE), -127, 127)
        out[a // 2 : (a + BLOCK) // 2] = odds[:, _PATH].reshape(-1).view(np.uint32)
    return out


def bits_of(texts: Texts, odds: np.ndarray, start_weight: np.ndarray, rate: float = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, coded bytes) of every text, and the mean weights in the end; long streams are coded in segments
    whose weights start anew. Segments of a chunk advance together, byte by byte."""
    parts = [(*part, np.empty((len(ORDERS), len(part[0]), 2), np.uint32)) for part in pieces(texts)]
    for data, _, _, halves in parts:
        nibbles = data >> 5, (data & 15) >> 1
        for o, cells in enumerate(slots(data)):
            for k in range(2):
                halves[o, :, k] = odds.take((cells[k] >> 1) + nibbles[k] + np.int32(OFFSET[o] // 2))
    shift = np.cumsum([0] + [len(p[0]) for p in parts])
    data, first, end = (np.concatenate([p[k] + (s if k else np.uint8(0)) for p, s in zip(parts, shift)] or [np.zeros(0, np.int64)]) for k in range(3))
    found = np.concatenate([p[3].view(np.uint64)[..., 0] for p in parts], 1) if parts else None  # the eight log odds of a byte
    parts.clear()
    size = end - first
    n = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(n)), n)
    start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
    length = np.minimum(end[text] - start, SEGMENT)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    # (orders, segments, bits): the loops that numpy runs are long, and no step needs new memory for its large arrays.
    # Weights are kept divided by the root of the step, so that one table of signs serves predictions and updates.
    root = np.float32(np.sqrt(rate) / SCALE)
    weight = np.repeat((start_weight / root)[:, None].astype(np.float32), len(start), 1)
    away = -root * _SIGN
    cost, inverse = np.zeros(len(start)), np.ones((len(start), 8), np.float32)  # of the chances
    x_all, z_all = np.empty_like(weight), np.empty_like(inverse)
    s_all, d_all = np.empty_like(inverse), np.empty_like(inverse)
    active = np.searchsorted(-length, -np.arange(SEGMENT), "left")  # segments longer than t
    low, high = np.float32(-10), np.float32(10)
    for t in range(int(length.max(initial=0))):
        if t % TILE == 0:  # order by order, so that these steps' bytes are near; those behind a segment's end mean nothing
            at = np.arange(t, t + TILE)[:, None] + start[: active[t]]
            tile, codes = found.take(at, 1, mode="clip"), data.take(at, mode="clip")
        m = int(active[t])
        x, w, z, s, d = x_all[:, :m], weight[:, :m], z_all[:m], s_all[:m], d_all[:m]
        x[...] = tile[:, t % TILE, :m].view(np.int8).reshape(len(ORDERS), m, 8)
        away.take(codes[t % TILE, :m], 0, out=s, mode="clip")
        np.einsum("omb,omb->mb", w, x, out=z)
        z *= s
        np.clip(z, low, high, out=z)
        np.exp(z, out=z)
        np.add(z, 1, out=d)
        inverse[:m] *= d
        if t % 8 == 7:  # eight factors of 1 + e**10 fit a float
            cost[:m] += np.log2(inverse[:m]).sum(1)
            inverse[:m] = 1
        z /= d
        z *= s
        x *= z
        w -= x
    cost += np.log2(inverse).sum(1)
    mean = (weight * length[:, None]).sum(1) * root / max(1, length.sum())
    return np.bincount(text[order], cost, len(size)), size, mean


def _parts(batches, max_bytes: int):
    """(fold, whole texts) of batches (text, fold)."""
    for batch in batches:
        for fold in range(FOLDS):
            for _, _, texts in chunks(batch.column(0).filter(pc.equal(batch.column(1), fold)), max_bytes):
                yield fold, texts


def _start_weights(docs: DataFrame, odds: list[np.ndarray]) -> np.ndarray:
    """Weights to start from, learnt on every row of ``docs`` (text, fold) under the counts of the other fold, so that contexts
    of a single text do not look certain; copies of a text are in one fold.

    Each task goes on from the weights of the chunk before, at falling rates in its first CHUNK bytes; the mean over all
    chunks of all tasks counts by bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    ship(docs.sparkSession)

    def run(batches):
        weight, total, seen = START, np.zeros(START.shape), 0
        for fold, texts in _parts(batches, CHUNK):
            for rate in RATES if seen < CHUNK else RATES[-1:]:
                _, size, weight = bits_of(texts, shared.value[1 - fold], weight, rate)
            total += weight * size.sum()
            seen += int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["size", "total"])

    found = docs.mapInArrow(run, "size long, total binary").collect()
    shared.destroy()
    size = sum(r[0] for r in found)
    return sum(np.frombuffer(r[1]) for r in found).reshape(START.shape) / size if size else START


def _sum_cells(docs: DataFrame) -> np.ndarray:
    """For each fold the counts of all tables (some 10 million cells, a fixed number) over its rows of ``docs`` (text, fold).

    Each task counts into tables of its own and sends them in blocks; blocks are summed one after the
    other in the tasks they are dealt to, and only the sums come to the driver.
    """
    ship(docs.sparkSession)

    def count(batches):
        totals = np.zeros(FOLDS * OFFSET[-1], np.int32)
        for fold, texts in _parts(batches, 2 * CHUNK):
            count_cells(texts, totals[fold * OFFSET[-1] : (fold + 1) * OFFSET[-1]])
        for block in range(0, len(totals), BLOCK):
            part = totals[block : block + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])

    def add(batches):
        now, total = None, None
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != now:
                    if now is not None:
                        yield out(now, total)
                    now, total = block, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(counts.as_buffer(), np.int32)
        if now is not None:
            yield out(now, total)

    def out(block, total):
        narrow = np.minimum(total, np.iinfo(np.int32).max // FOLDS).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([narrow.tobytes()], pa.binary())], ["block", "counts"])

    sums = docs.mapInArrow(count, "block int, counts binary").repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary")
    totals = np.zeros(FOLDS * OFFSET[-1], np.int32)
    for block, found in sums.toLocalIterator():
        totals[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(found, np.int32)
    return totals.reshape(FOLDS, -1)


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): the 64-bit key and count of every word of every text, and of the end word."""
    ship(docs.sparkSession)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            words, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            found, where = np.unique(words, return_inverse=True)
            return found, np.bincount(where, counts, len(found)).astype(np.int64)

        def out(words, counts):
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "c"])

        ends = 0
        for batch in batches:
            ends += batch.num_rows
            for _, _, texts in chunks(batch.column(0)):
                held.append(np.unique(texts.lowered().words().hashes(), return_counts=True))
            if sum(len(h[0]) for h in held) > 1_500_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield out(*held.pop())
        if held:
            yield out(*merged())
        if ends:
            yield out(np.array([END_WORD]), np.array([ends], np.int64))

    return docs.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(words, their counts, floor): every word with ``floor`` occurrences or more, the floor being the least power of two
    that leaves at most FREQUENT of them."""
    sizes = dict(counts.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).count().collect())
    floor, n = 0, 0
    for k in sorted(sizes, reverse=True):
        n += sizes[k]
        if n > FREQUENT:
            floor = k + 1
            break
    found = counts.where(F.col("c") >= 2**floor).toArrow()
    words, c = found["word"].to_numpy().view(U64), found["c"].to_numpy()
    order = np.argsort(words)
    return words[order], c[order], 2**floor


def lm_scores(docs: DataFrame, held_out: int = HELD_OUT, rest: int = REST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs`` (doc_id,
    text; other columns are ignored, whatever their names).

    Learns from every row whose crc32(doc_id) modulo ``held_out`` is not ``rest``; a row without an id is scored, never learnt
    from, and has a null held_out. A null or empty text is one end token. score is the log10 probability of the whole
    text's stream (words, blanks, end) under the mixed model, base_score that of its words and end under add-one
    unigram counts. Repeated rows are learnt from and scored each. With nothing to learn from all counts are 0. An empty
    table gives an empty result.

    Starting weights are learnt on all these rows too, each under the counts of the half of the texts that it is not in.

    Words are known by 64-bit keys. The model's tables and the frequent words (some 24 MB together, fixed bounds; 40 MB of
    tables while the weights are learnt) are broadcast; the words below the floor are joined on their key, in whichever number they come.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    learn = rows.where(remainder("doc_id", held_out) != rest).select("text")
    folds = learn.withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(FOLDS)).cast("int"))
    cells = _sum_cells(folds)
    weight = _start_weights(folds, [log_odds(c) for c in cells])
    odds = log_odds(cells.sum(0, dtype=np.int32))
    del cells
    counts = cut(_word_counts(learn))
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == END_WORD, F.col("c"))), F.lit(0))).first()
    words, c, floor = _frequent(counts)
    shared = spark.sparkContext.broadcast((odds, weight, words, c))
    below = float(np.log10(n + v + 1.0))
    end_score = float(np.log10(ends + 1.0)) - below
    ship(spark)

    def score(batches):
        done = TaskContext.get().partitionId() << 40  # numbers rows alike when a task runs again
        for batch in batches:
            yield from score_batch(batch, done)
            done += batch.num_rows

    def score_batch(batch: pa.RecordBatch, done: int):
        odds, weight, words, c = shared.value
        logs = np.log10(c + 1.0) - below
        for row, to, texts in chunks(batch.column(1), CHUNK):
            found = texts.lowered().words()
            keys = found.hashes()
            at = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1))
            known = words[at] == keys if len(words) else np.zeros(len(keys), bool)
            base, seen = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1, np.int64)
            if len(words):
                np.cumsum(np.where(known, logs[at], 0.0), out=base[1:])
            np.cumsum(known, out=seen[1:])
            first = found.first
            left = np.concatenate([[0], np.cumsum(~known)])[first].astype(np.int32)
            bits, size, _ = bits_of(texts, odds, weight)
            columns = [
                pa.array(np.arange(done + row, done + to)),
                batch.column(0).slice(row, to - row),
                pa.array(found.counts.astype(np.int64) + 1),
                pa.array(seen[first[1:]] - seen[first[:-1]] + (1 if ends else 0)),
                pa.array(base[first[1:]] - base[first[:-1]] + end_score),
                pa.array(-bits * np.log10(2.0)),
                pa.array(bits / size),
                pa.ListArray.from_arrays(pa.array(left), pa.array(keys[~known].view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte", "rare"])

    scored = cut(rows.mapInArrow(score, f"_row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, bits_per_byte double, rare array<long>"))
    rare = scored.select("_row", F.explode("rare").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("k"))
    rare = rare.join(counts.where(F.col("c") < floor), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("_row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_k"), F.sum(F.col("k") * (F.log10(F.col("c") + 1.0) - below)).alias("_b"))
    return scored.drop("rare").join(rare, "_row", "left").select(
        "doc_id",
        (remainder("doc_id", held_out) == rest).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_k", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_b", F.lit(0.0))).alias("base_score"),
        "score",
        "bits_per_byte",
    )


@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
