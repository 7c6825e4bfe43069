"""Quality rules (operator 2): fixed repetition rules and a hashed n-gram logistic regression.

Word unigrams and bigrams and byte 3- and 4-grams are hashed into tables; a text's features are the shares
of its n-grams per table cell. The regression is fitted by Adam on a bounded sample of labelled rows, its
probability is calibrated on held-back rows (a second one-variable regression at the labels' own rates),
and whole texts are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.llm.common import arrow_map, table
from geoloom.llm.labelled import labelled_texts
from geoloom.llm.registry import query
from geoloom.llm.textbytes import U64, Texts, chunks, mix

BITS = 15
CELLS = 1 << BITS
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: A document stays when its calibrated probability of good quality is at least this.
THRESHOLD = 0.5
PER_CLASS = 1_500
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def gram_cells(data: np.ndarray, n: int) -> np.ndarray:
    """The table cell of the n bytes (3 or 4) from each position on."""
    size = max(0, len(data) - n + 1)
    value = np.zeros(size, np.uint32)
    for k in range(n):
        value |= data[k : k + size].astype(np.uint32) << np.uint32(8 * k)
    return (value * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def features(texts: Texts, words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of n-gram: cell of each occurrence, and the range of occurrences of each text."""
    out = []
    for n in (3, 4):
        cells = gram_cells(texts.data, n)
        start = np.minimum(texts.at[:-1], len(cells))
        out.append((cells, start, np.clip(texts.at[1:] - n + 1, start, len(cells))))
    for k in (1, 2):
        cells = (mix(words.windows(k)) >> U64(64 - BITS)).astype(np.uint32)
        start = words.first[:-1]
        out.append((cells, start, np.maximum(words.first[1:] - k + 1, start)))
    return out


def _mean(weight: np.ndarray, cells: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.zeros(len(cells) + 1)
    np.cumsum(weight[cells], out=total[1:])
    return (total[stop] - total[start]) / np.maximum(stop - start, 1)


def repeated_words(words, k: int = 8) -> np.ndarray:
    """Words of each text in windows of k words that the text holds twice or more."""
    n = len(words.start)
    text_of = words.text_of()
    valid = np.arange(n) <= words.first[1:][text_of] - k
    keys = (words.windows(k) ^ mix(text_of.astype(U64) + U64(1)))[valid]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(words.texts.n, np.int64)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = np.flatnonzero(valid)[twice[at] == keys]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    covered = np.zeros(n + 1, np.int64)
    np.cumsum(np.cumsum(edge)[:-1] > 0, out=covered[1:])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def duplicate_lines(texts: Texts, words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    breaks = np.flatnonzero(texts.data == 10)
    doc = np.searchsorted(texts.at, breaks, "right") - 1
    start = np.concatenate([texts.at[:-1], breaks + 1])
    stop = np.concatenate([breaks, texts.at[1:]])
    doc = np.concatenate([np.arange(texts.n), doc])
    start, stop = np.sort(start, kind="stable"), np.sort(stop, kind="stable")
    doc = np.sort(doc, kind="stable")
    first = np.searchsorted(words.start, start)
    full = (first < len(words.start)) & (np.append(words.start, len(texts.data))[first] < stop)
    start, stop, doc = start[full], stop[full], doc[full]
    keys = texts.hashes(start, stop) ^ mix(doc.astype(U64) + U64(1))
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    return np.bincount(doc[order][1:][again], minlength=texts.n)


def base_figures(texts: Texts, words) -> dict[str, np.ndarray]:
    inside = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=inside[1:])
    chars = np.zeros(len(words.start) + 1, np.int64)
    np.cumsum(inside[words.end] - inside[words.start], out=chars[1:])
    out = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": chars[words.first[1:]] - chars[words.first[:-1]],
        "n_symbols": texts.per_text(SYMBOL[texts.data]),
        "n_dup_lines": duplicate_lines(texts, words).astype(np.int64),
        "n_repeat_words": repeated_words(words),
    }
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    return out


class Grams:
    """The n-gram cells of some texts, text by text: int32 cells, float32 shares and where each text's begin. Sums go over
    BLOCK_CELLS entries at once, so a step needs little more memory than the entries themselves."""

    def __init__(self, column: pa.Array):
        cells, shares, sizes = [], [], []
        for _, _, part in chunks(column, 1 << 18):
            kinds = features(part, part.words())
            for i in range(part.n):
                sizes.append(0)
                for kind, (cell, start, stop) in enumerate(kinds):
                    found, times = np.unique(cell[start[i] : stop[i]], return_counts=True)
                    cells.append((found + kind * CELLS).astype(np.int32))
                    shares.append((times / max(1, times.sum())).astype(np.float32))
                    sizes[-1] += len(found)
        self.n = len(sizes)
        self.start = np.append(0, np.cumsum(sizes)).astype(np.int64)
        self.cells, self.shares = np.empty(self.start[-1], np.int32), np.empty(self.start[-1], np.float32)
        for whole, parts in ((self.cells, cells), (self.shares, shares)):
            at = 0
            for part in parts:
                whole[at : at + len(part)] = part
                at += len(part)
            parts.clear()

    def blocks(self):
        """(from text, to text) of about BLOCK_CELLS entries each."""
        row = 0
        while row < self.n:
            to = max(row + 1, int(np.searchsorted(self.start, self.start[row] + BLOCK_CELLS, "right")) - 1)
            yield row, to
            row = to

    def scores(self, weight: np.ndarray, row: int, to: int) -> np.ndarray:
        a, b = self.start[row], self.start[to]
        total = np.append(0.0, np.cumsum(weight[self.cells[a:b]] * self.shares[a:b]))
        return total[self.start[row + 1 : to + 1] - a] - total[self.start[row:to] - a]

    def gradient(self, off: np.ndarray, row: int, to: int) -> np.ndarray:
        a, b = self.start[row], self.start[to]
        each = np.repeat(off, np.diff(self.start[row : to + 1])) * self.shares[a:b]
        return np.bincount(self.cells[a:b], each, 4 * CELLS)


BLOCK_CELLS = 1 << 19


def _fit(x: Grams, y: np.ndarray, learnt: np.ndarray, rounds: int = 60, rate: float = 2.0, decay: float = 1e-6):
    """Adam on all ``learnt`` texts at every step."""
    weight, bias = np.zeros(4 * CELLS), 0.0
    m, v = np.zeros(4 * CELLS + 1), np.zeros(4 * CELLS + 1)
    good, bad = max(1, (y[learnt] == 1).sum()), max(1, (y[learnt] == 0).sum())
    share = np.where(y == 1, 0.5 / good, 0.5 / bad) * learnt
    for t in range(1, rounds + 1):
        g = np.append(decay * weight, 0.0)
        for row, to in x.blocks():
            z = x.scores(weight, row, to) + bias
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[row:to]) * share[row:to]
            g[:-1] += x.gradient(off, row, to)
            g[-1] += off.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weight -= step[:-1]
        bias -= 0.1 * step[-1]
    return weight, bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Tables, bias and calibration, learnt from at most about 2 * per_class labelled rows. Without labels of both
    classes every text gets probability 1."""
    sample = labelled_texts(docs, labels, "quality", per_class)
    y = np.array([s[1] for s in sample], float)
    if len(set(y)) < 2:
        return {"weight": np.zeros((4, CELLS), np.float32), "bias": 0.0, "slope": 0.0, "shift": 30.0}
    column = pa.array([s[0] for s in sample], pa.large_string())
    sample.clear()
    x = Grams(column)
    held = np.arange(len(y)) % 4 == 0
    weight, bias = _fit(x, y, ~held)
    z = np.concatenate([x.scores(weight, row, to) for row, to in x.blocks()]) + bias
    natural = labels.where("quality in (0, 1)").agg(F.avg("quality")).first()[0]
    slope, shift = _calibrate(z[held], y[held], natural)
    return {"weight": weight.reshape(4, CELLS).astype(np.float32), "bias": bias, "slope": slope, "shift": shift}


def _calibrate(z: np.ndarray, y: np.ndarray, natural: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve from scores to probabilities at the labels' own rates (Newton steps)."""
    w = np.where(y == 1, natural / max(1, y.sum()), (1 - natural) / max(1, (1 - y).sum()))
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    scale = z.std() + 1e-9
    a, b = 1.0, float(np.log(natural / (1 - natural)))
    x = np.stack([z / scale, np.ones(len(z))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        g = x.T @ (w * (p - target)) + 1e-6 * np.array([a, b])
        h = (x.T * (w * p * (1 - p))) @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(a / scale), float(b)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS, text: str = "text") -> DataFrame:
    """One row per input row: ``row`` (a struct of all its columns, whatever their names), the base figures,
    ``base_failed``, the calibrated ``probability`` of good quality and ``kept``.

    Null and empty texts have no words and fail the base rules. Repeated rows get equal results; an empty table gives
    an empty result. Nothing is shuffled; the model (a few hundred KB, fixed) is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", F.col(text).alias("text")), labels, per_class))
    schema = StructType().add("row", docs.schema)
    place = docs.columns.index(text)
    for field in COLUMNS.split(", "):
        schema = schema.add(*field.split())

    def score(batch: pa.RecordBatch):
        m = model.value
        for row, to, texts in chunks(batch.column(0).field(place), 1 << 20):
            words = texts.words()
            out = base_figures(texts, words)
            z = np.full(texts.n, m["bias"])
            for weight, found in zip(m["weight"], features(texts, words)):
                z += _mean(weight, *found)
            p = 1 / (1 + np.exp(-np.clip(m["slope"] * z + m["shift"], -30, 30)))
            out |= {"probability": p, "kept": ~out["base_failed"] & (p >= threshold)}
            columns = [batch.column(0).slice(row, to - row), *(pa.array(c) for c in out.values())]
            yield pa.RecordBatch.from_arrays(columns, ["row", *out])

    return arrow_map(docs.select(F.struct("*").alias("row")), score, schema)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).select("row.doc_id", *[c.split()[0] for c in COLUMNS.split(", ")])
