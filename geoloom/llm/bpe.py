"""BPE encoding and decoding by dynamic programming over prefixes (operator 9).

For every prefix of a word exactly one token can come last in that prefix's encoding. An Aho-Corasick
automaton (the suffix automaton of the vocabulary) lists the tokens ending at each prefix; the one whose
pair with the last token of the remaining shorter prefix is stable under the merges is stored. Following
the stored tokens back from the word's end gives exactly the ids that merging would have given.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import arrow_map, process_cache, table
from geoloom.llm.registry import query
from geoloom.llm.textbytes import chunks
from geoloom.llm.token_counts import _byte_letters

END = "\ue000"
#: A word pattern that ends so takes a run of letters whole, whatever contractions come before it.
PLAIN = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries of a generation of the word caches of a task's process; two generations are held.
CACHE_WORDS = 50_000
#: Longer words are encoded each time, so that a cache's bytes are bounded too.
CACHE_LETTERS = 64
#: Pairs of tokens whose compatibility such a process remembers.
CACHE_PAIRS = 300_000
#: Bytes of text that are encoded before their rows go on.
CHUNK = 1 << 20


class Recent(dict):
    """key -> compute(key), remembering at least the last ``size`` computed keys, at most twice as many, and none of more than
    CACHE_LETTERS characters."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.older = compute, size, {}

    def __missing__(self, key):
        if len(key) > CACHE_LETTERS:
            return self.compute(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


class PrefixBpe:
    """Encoder of one tokenizer file: byte-level BPE, with or without an end-of-word mark."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex

        model = spec["model"]
        normal = spec.get("normalizer")
        kinds = [n["type"] for n in normal["normalizers"]] if normal else []
        if model["type"] != "BPE" or kinds not in ([], ["NFC", "Replace", "Lowercase"]) or spec.get("decoder") is not None:
            raise ValueError("this encoder knows byte-level BPE files with the word pattern of their own, without a decoder")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"]:
            raise ValueError("this encoder knows a split by pattern that keeps the matches, then bytes")
        self.fold = bool(kinds)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: w for w, i in [*model["vocab"].items(), *self.special.items()]}
        self.names = pa.array([(names.get(i, "") + " ").encode() for i in range(max(names, default=-1) + 1)], pa.large_binary())
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.controls = regex.compile("[\x1c-\x1f]")
        self.blank = regex.compile(r"\p{White_Space}+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain = steps[0]["pattern"]["Regex"].endswith(PLAIN)
        self.letter = {b: c for c, b in _byte_letters().items()}

        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a.removesuffix(self.suffix) + b if self.suffix else a + b]
            if made in self.parts:
                raise ValueError("a token made by two merges is not supported")
            self.rank[left, right], self.parts[made], self.born[made] = r, (left, right), r
        self.stable: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in vocab.items():
            text = name.removesuffix(self.suffix) + END if self.suffix and name.endswith(self.suffix) and name != self.suffix else name
            atom = len(text.removesuffix(END)) == 1
            if atom or (i in self.parts and self.joins(*self.parts[i], self.born[i])):
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.words = Recent(self._word, CACHE_WORDS)
        self.piece = Recent(self._piece, 2 * CACHE_WORDS)

    def joins(self, left: int, right: int, until: int) -> bool:
        """Whether two neighbours meet unmerged before the merge of rank ``until``: walk back through their
        states at the boundary; at none of them may the pair there have been merged while both lived.
        Equal ranks are applied from left to right, so the left one's own merge comes first."""
        rank, parts, born = self.rank, self.parts, self.born
        end_a = end_b = until
        while True:
            a, b = born.get(left, -1), born.get(right, -1)
            r = rank.get((left, right))
            if r is not None and r < end_a and r <= end_b and r > a and r > b and r < until:
                return False
            if a < 0 and b < 0:
                return True
            if a > b:
                end_a, left = a, parts[left][1]
            else:
                end_b, right = b, parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 24 | right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= CACHE_PAIRS:
                self.stable.clear()
            known = self.stable[key] = self.joins(left, right, 1 << 60)
        return known

    def ids(self, piece: str) -> list[int]:
        """The ids of one piece of a word, given as byte letters."""
        text = piece + END if self.suffix else piece
        size = len(text)
        last, back = [-1] * (size + 1), [0] * (size + 1)
        known, compatible = self.stable.get, self.compatible
        for stop, (token, length) in self.automaton.iter(text):
            stop += 1
            if last[stop] >= 0:
                continue
            start = stop - length
            if start:
                left = last[start]
                if left < 0:
                    continue
                fits = known(left << 24 | token)
                if fits is None:
                    fits = compatible(left, token)
                if not fits:
                    continue
            last[stop], back[stop] = token, start
        out = []
        while size:
            out.append(last[size])
            size = back[size]
        out.reverse()
        return out

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letter)
        return array("i", self.ids(letters)).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids, as int32 bytes, of what stands between blanks."""
        if self.fold:
            if not word.isascii():
                word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
            word = word.lower()
        if self.plain:  # letters, and perhaps one mark behind them, need no pattern
            if word.isalpha():
                return self.piece[word]
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return self.piece[word[:-1]] + self.piece[word[-1]]
        return b"".join([self.piece[p] for p in self.pieces.findall(word)])

    def encode_ids(self, text: str) -> bytes:
        """The ids, as int32 bytes."""
        if self.specials is None or "<|" not in text and not self.specials.search(text):
            return self._run(text)
        return b"".join([array("i", [self.special[part]]).tobytes() if k % 2 else self._run(part) for k, part in enumerate(self.specials.split(text))])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The decoded texts of ids[at[0]:at[1]], ids[at[1]:at[2]], ...: names of tokens with blanks between them."""
        if not len(ids):
            return pa.array([""] * (len(at) - 1), pa.string())
        names = self.names.take(pa.array(ids))
        bounds = np.frombuffer(names.buffers()[1], np.int64)[at]
        texts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(bounds), names.buffers()[2]])
        return pc.binary_slice(texts, 0, -1).cast(pa.string())

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as int32 bytes, the decoded text)."""
        body = self.encode_ids(text)
        return body, self.decode(np.frombuffer(body, "<i4"), np.array([0, len(body) // 4]))[0].as_py()

    def _run(self, text: str) -> bytes:
        parts = text.split() if not self.controls.search(text) else [p for p in self.blank.split(text) if p]
        return b"".join([self.words[p] for p in parts])


@process_cache("bpe", 2)
def _encoder(body: str) -> PrefixBpe:
    return PrefixBpe(json.loads(body))


def bpe_encode(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for every row, as the tokenizer file's own library encodes the whole
    text without added begin or end tokens and decodes the ids again without skipping any.

    A null or empty text gives no ids and an empty string; special strings inside a text count as their
    token. Repeated rows are encoded each. Other columns are ignored, whatever their names; an empty table gives an
    empty result. No shuffle; per process the caches hold a bounded number of words, until it runs tasks of another step.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batch: pa.RecordBatch):
        encoder = _encoder(shared.value)
        texts, keys = batch.column(1), batch.column(0)
        for row, to, _ in chunks(texts, CHUNK):
            found = [encoder.encode_ids(t) for t in texts.slice(row, to - row).to_pylist()]
            at = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in found], out=at[1:])
            ids = np.frombuffer(b"".join(found), "<i4")
            columns = [keys.slice(row, to - row), pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), encoder.decode(ids, at)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "ids", "decoded"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return arrow_map(rows, encode, f"_id {kind}, ids array<int>, decoded string", keeps="bpe").withColumnRenamed("_id", id)


def digests(encoded: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what bpe_encode returns."""
    return encoded.select(
        id,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
