"""Toxicity (operator 5): subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A window of WINDOW words is the bag of its words' byte 3- to 5-grams (with word boundaries) and whole words,
hashed into one embedding table; the mean embedding goes through a linear softmax. A text scores its worst
window, so a short passage in a long text still counts, and a misspelt word shares most n-grams with the
words learnt from. Labels belong to texts, so training first spreads a toxic label over all windows and then
keeps it only on each text's worst window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import arrow_map, remainder, table
from geoloom.llm.labelled import labelled_texts
from geoloom.llm.registry import query
from geoloom.llm.textbytes import LOWER, SPACE, U64, Texts, chunks

BITS = 16
DIM = 8
WINDOW = 6
GRAMS = (3, 4, 5)
PER_CLASS = 1_200
HELD_OUT = 5


def spaced(texts: Texts) -> Texts:
    """Lower-cased, every separator a blank, and a blank before and after each text."""
    data = LOWER[texts.data]
    data[SPACE[data]] = 32
    data = np.append(np.insert(data, texts.at[:-1], 32), np.uint8(32))
    return Texts(data, texts.at + np.arange(texts.n + 1))


def grams(texts: Texts, words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, cells): every n-gram inside a word and its two boundary blanks, and every word."""
    data, blank = texts.data, texts.data == 32
    value = np.zeros(len(data), U64)
    broken = np.zeros(len(data), bool)  # a blank strictly inside the n-gram
    out = []
    for k in range(max(GRAMS)):
        size = len(data) - k
        if size <= 0:
            break
        value = value[:size] | (data[k:].astype(U64) << U64(8 * k))
        if k >= 2:
            broken = broken[:size] | blank[k - 1 : k - 1 + size]
        if k + 1 in GRAMS:
            at = np.flatnonzero(~broken[:size])
            cells = ((value[at] + U64(k + 1)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)
            out.append((at, cells.astype(np.uint32)))
    out.append((words.start, ((words.hashes() * U64(0xD6E8FEB86659FD93)) >> U64(64 - BITS)).astype(np.uint32)))
    return out


def drop_repeats(words):
    """Without words equal to the one before them in their text (a run of one word says no more than the word);
    returns a mask of the bytes of the words left out."""
    same = np.zeros(len(words.start), bool)
    h = words.hashes()
    same[1:] = h[1:] == h[:-1]
    opening = words.first[:-1][words.counts > 0]
    same[opening] = False
    edge = np.zeros(len(words.texts.data) + 1, np.int8)
    edge[words.start[same] - 1] += 1
    edge[words.end[same] - 1] -= 1
    keep = ~same
    kept = np.zeros(len(same) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    words.start, words.end, words._hash = words.start[keep], words.end[keep], h[keep]
    words.first = kept[words.first]
    words.counts = np.diff(words.first)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def windows(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, text) of consecutive windows of WINDOW words; texts without words have none."""
    n = -(-words.counts // WINDOW)
    text = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = words.first[:-1][text] + step * WINDOW
    last = np.minimum(first + WINDOW, words.first[1:][text]) - 1
    if not len(text):
        return text, text, text
    return words.start[first] - 1, words.end[last], text


def _bags(texts: list[str]):
    """All n-gram cells of the sample's windows in window order, and each window's text."""
    cells, owner, text_of, base = [], [], [], 0
    for row, _, part in chunks(pa.array(texts, pa.large_string()), 1 << 20):
        part = spaced(part)
        words = part.words()
        out = drop_repeats(words)
        start, stop, text = windows(words)
        found = []
        for at, cell in grams(part, words):
            w = np.searchsorted(start, at, "right") - 1
            inside = (w >= 0) & (at < stop[np.maximum(w, 0)]) & ~out[at]
            found.append((cell[inside].astype(np.uint16), w[inside].astype(np.int32)))
        cell, w = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(w, kind="stable")
        cells.append(cell[order])
        owner.append(w[order] + np.int32(base))
        text_of.append(text + row)
        base += len(start)
    return np.concatenate(cells), np.concatenate(owner), np.concatenate(text_of)


class _Adam:
    def __init__(self, *shapes):
        self.m, self.v, self.t = [np.zeros(s, np.float32) for s in shapes], [np.zeros(s, np.float32) for s in shapes], 0

    def step(self, values, gradients, rate):
        self.t += 1
        for p, g, m, v in zip(values, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def train(sample: list[tuple[str, int]], epochs: int = 8, parts: int = 20, seed: int = 3) -> tuple[np.ndarray, float]:
    """(score of every table cell, bias): a window's log odds are the mean score of its cells plus the bias."""
    rng = np.random.default_rng(seed)
    y = np.array([s[1] for s in sample])
    cells, owner, text_of = _bags([s[0] for s in sample])
    size = np.maximum(np.bincount(owner, minlength=len(text_of)), 1)
    first = np.searchsorted(owner, np.arange(len(text_of) + 1))
    table_, out, bias = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    adam = _Adam(table_.shape, out.shape, bias.shape)
    toxic = y[text_of] == 1
    target, weight = toxic.astype(int), np.ones(len(text_of), np.float32)
    for epoch in range(epochs):
        if epoch >= 2:  # only the worst window of a toxic text is toxic for sure
            score = table_ @ (out[:, 1] - out[:, 0])
            z = np.add.reduceat(np.append(score[cells], np.float32(0)), first[:-1]) / size
            order = np.lexsort((-z, text_of))
            worst = order[np.flatnonzero(np.append(True, text_of[order][1:] != text_of[order][:-1]))]
            target, weight = np.zeros(len(text_of), int), (~toxic).astype(np.float32)
            worst = worst[toxic[worst]]
            target[worst], weight[worst] = 1, 1
            weight[worst] = max(1.0, (~toxic).sum() / max(1, len(worst)) / 20)
        group = rng.permutation(len(text_of)) % parts
        for part in range(parts):
            chosen = np.flatnonzero((group == part) & (weight > 0))
            if not len(chosen):
                continue
            mine = np.full(len(text_of), -1, np.int32)
            mine[chosen] = np.arange(len(chosen), dtype=np.int32)
            of = mine[owner]
            used = of >= 0
            c, o = cells[used], of[used]
            n = size[chosen].astype(np.float32)[:, None]
            at = np.searchsorted(o, np.arange(len(chosen)))
            h = np.add.reduceat(np.append(table_[c], np.zeros((1, DIM), np.float32), 0), at, axis=0) / n
            z = h @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), target[chosen]] -= 1
            p *= (weight[chosen] / weight[chosen].sum())[:, None]
            gh = (p @ out.T / n).astype(np.float32)
            g = np.stack([np.bincount(c, gh[o, k], 1 << BITS) for k in range(DIM)], 1).astype(np.float32)
            adam.step((table_, out, bias), (g, h.T @ p, p.sum(0)), 0.05)
    return (table_ @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(texts: Texts, cell_score: np.ndarray, bias: float) -> np.ndarray:
    """The probability of each text's worst window; that of an empty window where there is no word."""
    part = spaced(texts)
    words = part.words()
    out = drop_repeats(words)
    start, stop, text = windows(words)
    total, n = np.zeros(len(part.data) + 1), np.zeros(len(part.data) + 1, np.int64)
    for at, cell in grams(part, words):
        total[at + 1] += cell_score[cell]
        n[at + 1] += 1
    total[1:][out] = n[1:][out] = 0
    np.cumsum(total, out=total)
    np.cumsum(n, out=n)
    z = (total[stop] - total[start]) / np.maximum(n[stop] - n[start], 1) + bias
    worst = np.full(texts.n, -np.inf)
    np.maximum.at(worst, text, z)
    worst[np.isinf(worst)] = bias
    return 1 / (1 + np.exp(-np.clip(worst, -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Learns from labelled rows whose crc32(doc_id) modulo ``held_out`` is not 0, at most about 2 * per_class of them, and
    only from their text. A null or empty text, or one of blanks, has the score of an empty window; a null doc_id
    is never learnt from and has a null held_out. Repeated rows score alike; an empty table gives an empty
    result; without labels of both classes every score is 0. No shuffle; the table (256 KB) is broadcast.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    learn = docs.select("doc_id", "text").where(remainder("doc_id", held_out) != 0)
    sample = labelled_texts(learn, labels, "toxic", per_class)
    model = train(sample) if len({s[1] for s in sample}) == 2 else (np.zeros(1 << BITS, np.float32), -30.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch):
        for row, to, texts in chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), pa.array(score_texts(texts, *shared.value))], ["doc_id", "score"])

    scored = arrow_map(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder("doc_id", held_out) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
