"""Language identification (operator 10): a byte convolutional network over fixed-length windows.

Bytes are embedded, filters of several widths slide over a window, each filter keeps its maximum, and a
softmax over the pooled filters gives the languages. Trained by Adam in numpy on windows of labelled texts;
a text's probabilities are the geometric mean over all its windows, weighted by their letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import arrow_map, remainder, table
from geoloom.llm.labelled import MAX_BYTES, sample_by_class
from geoloom.llm.registry import query
from geoloom.llm.textbytes import LOWER, SPACE, Texts, chunks

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
DIM = 8
STEP = LENGTH - max(WIDTHS) + 1
PER_LANGUAGE = 800
WINDOWS_PER_TEXT = 4
HELD_OUT = 5

_CLEAN = LOWER.copy()
_CLEAN[SPACE] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0xC3, 256)]] = True
_MAYBE_LETTER = _LETTER.copy()  # first bytes of letters: 0xC2 begins three of them
_MAYBE_LETTER[0xC2] = True


def cut_windows(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of every window, the text of each): windows start every STEP bytes, the last is filled up with zeros."""
    size = np.diff(texts.at)
    n = -(-size // STEP)
    text = np.repeat(np.arange(texts.n), n)
    start = texts.at[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    at = start[:, None] + np.arange(LENGTH)
    inside = at < texts.at[1:][text][:, None]
    return np.where(inside, _CLEAN[np.append(texts.data, np.uint8(0))[np.where(inside, at, 0)]], np.uint8(0)), text


def patches(window: np.ndarray, embed: np.ndarray) -> np.ndarray:
    e = embed[window]
    return np.concatenate([e[:, k : k + STEP] for k in range(max(WIDTHS))], 2).reshape(-1, max(WIDTHS) * DIM)


class Network:
    """One matrix holds the filters of all widths, zero beyond each filter's width."""

    def __init__(self, classes: int, rng):
        size = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.3, (256, DIM)).astype(np.float32)
        self.mask = np.zeros((max(WIDTHS) * DIM, size), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.shift = np.zeros(size, np.float32)
        self.out = rng.normal(0, 0.1, (size, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def values(self):
        return [self.embed, self.filters, self.shift, self.out, self.bias]

    def log_probabilities(self, window: np.ndarray) -> np.ndarray:
        out = np.empty((len(window), len(self.bias)), np.float32)
        for a in range(0, len(window), 256):
            part = window[a : a + 256]
            top = (patches(part, self.embed) @ self.filters).reshape(len(part), STEP, -1).max(1)
            z = np.maximum(top + self.shift, 0) @ self.out + self.bias
            z -= z.max(1, keepdims=True)
            out[a : a + 256] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def gradients(self, window: np.ndarray, y: np.ndarray):
        n = len(window)
        x = patches(window, self.embed)
        a = (x @ self.filters).reshape(n, STEP, -1)
        at = a.argmax(1)
        top = np.take_along_axis(a, at[:, None], 1)[:, 0] + self.shift
        h = np.maximum(top, 0)
        z = h @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        gh = (p @ self.out.T) * (top > 0)
        rows = (np.arange(n)[:, None] * STEP + at).ravel()  # the patch each filter chose
        chosen = x[rows].reshape(n, at.shape[1], -1)
        gf = np.einsum("nfd,nf->df", chosen, gh) * self.mask
        ge = np.zeros_like(self.embed)
        back = (gh[:, :, None] * self.filters.T[None]).reshape(n, at.shape[1], max(WIDTHS), DIM)
        for k in range(max(WIDTHS)):
            byte = np.take_along_axis(window, at + k, 1)
            for d in range(DIM):
                ge[:, d] += np.bincount(byte.ravel(), back[:, :, k, d].ravel(), 256)
        return [ge, gf, gh.sum(0), h.T @ p, p.sum(0)]


def train(window: np.ndarray, y: np.ndarray, classes: int, epochs: int = 8, batch: int = 128, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(classes, rng)
    values = net.values()
    m, v, t = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            t += 1
            chosen = order[a : a + batch]
            for p, g, mm, vv in zip(values, net.gradients(window[chosen], y[chosen]), m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= 0.004 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    return net


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def fit(docs: DataFrame, held_out: int, per_language: int) -> tuple[list[str], Network | None]:
    """The languages of the learning rows and the network, from at most about per_language texts of at most MAX_BYTES
    bytes each, and WINDOWS_PER_TEXT windows of every text."""
    learn = docs.where((remainder("doc_id", held_out) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    learn = learn.where(F.octet_length("text").between(1, MAX_BYTES))
    found = sample_by_class(learn, "lang", "doc_id", per_language, 11).select("doc_id", "lang", "text").collect()
    found = sorted((r for r in found if has_letter(r[2])), key=lambda r: (r[0], r[1], r[2]))
    languages = sorted({r[1] for r in found})
    if len(languages) < 2:
        return languages, None
    rng = np.random.default_rng(1)
    window, y = [], []
    for row, _, part in chunks(pa.array([r[2] for r in found], pa.large_string())):
        w, text = cut_windows(part)
        order = rng.permutation(len(text))
        order = order[np.argsort(text[order], kind="stable")]
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        keep = order[rank < WINDOWS_PER_TEXT]
        window.append(w[keep])
        y.append(np.array([languages.index(found[row + i][1]) for i in text[keep]]))
    return languages, train(np.concatenate(window), np.concatenate(y), len(languages))


def language_id(docs: DataFrame, held_out: int = HELD_OUT, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang; other columns are ignored).

    Learns only from text and lang of rows whose crc32(doc_id) modulo ``held_out`` is not 0. A text that is null or has no
    letter is ``und`` with score 0; so is every text when no labelled row can be learnt from. Where there is one language
    only, it is predicted with score 1. Ties go to the first language by code point. A null doc_id is never learnt from
    and has a null held_out. Repeated rows score alike; an empty table gives an empty result. No shuffle;
    the network (some KB) is broadcast.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang"), held_out, per_language))

    def score(batch: pa.RecordBatch):
        languages, net = shared.value
        for row, to, texts in chunks(batch.column(1)):
            lettered = texts.per_text(_MAYBE_LETTER[texts.data]) > 0
            plain = texts.per_text((texts.data | 32) - np.uint8(97) < 26) > 0
            for i in np.flatnonzero(lettered & ~plain):
                lettered[i] = has_letter(texts.data[texts.at[i] : texts.at[i + 1]].tobytes().decode())
            p = np.ones((texts.n, max(1, len(languages))))
            if net is not None:
                window, text = cut_windows(texts)
                weight = _LETTER[window].sum(1) + 1e-3
                logs = net.log_probabilities(window) * weight[:, None]
                z = np.stack([np.bincount(text, logs[:, k], texts.n) for k in range(len(languages))], 1).astype(float)  # integers where all are empty
                z /= np.maximum(np.bincount(text, weight, texts.n), 1e-9)[:, None]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            known = lettered & bool(languages)
            names = [languages[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), pa.array(names, pa.string()), pa.array(np.where(known, p.max(1), 0.0))], ["doc_id", "lang_pred", "score"])

    scored = arrow_map(docs.select("doc_id", "text"), score, f"doc_id {kind}, lang_pred string, score double")
    return scored.select("doc_id", (remainder("doc_id", held_out) == 0).alias("held_out"), "lang_pred", "score")


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
