"""Token counts with a digest cache (operator 6).

Counts are stored by (digest of the normalised content, digest of the tokenizer). Documents are joined to
the cache, only distinct contents without a stored count are encoded, and those counts are appended.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import arrow_map, table
from geoloom.llm.registry import query
from geoloom.sources.place import fresh_path

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
LIMIT = 512


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


def _rank_encoder(spec: dict):
    """An equal encoder by ranks for a plain byte-level BPE whose ids are in merge order; None for others."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "ignore_merges"))
        and spec.get("normalizer") is None
        and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )
    if not plain:
        return None
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {w: i for w, i in model["vocab"].items() if w not in special}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(b <= a for a, b in zip(merged, merged[1:])) or any(not set(w) <= set(letters) for w in vocab):
        return None
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def _counter(kind: str, body: bytes):
    """text -> number of tokens, without added begin or end tokens."""
    if kind == "model":
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=body)
        return lambda text: len(processor.encode(text, num_threads=1))
    ranks = _rank_encoder(json.loads(body))
    if ranks is None:
        return lambda text: _by_library(body, text)

    def count(text: str) -> int:
        try:
            return len(ranks.encode(text, allowed_special="all"))
        except ValueError:  # the encoder's pattern cannot pass a run of about a million blanks
            return _by_library(body, text)

    return count


@lru_cache(maxsize=2)
def _library(body: bytes):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(body.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _by_library(body: bytes, text: str) -> int:
    return len(_library(body).encode(text, add_special_tokens=False).ids)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of ``docs``; ``cache`` is a Parquet folder in shared storage.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and texts keep their rows; a text is encoded
    once however often it occurs. Other columns are ignored, whatever their names. An empty table gives an
    empty result. The vocabulary file (a few MB, fixed) is read where the job starts and sent to the tasks. Very long
    texts, runs of millions of blanks included, are encoded whole.
    Equal content is found by SHA-256; copies merge in each task before the shuffle, so a text that fills a
    third of the table costs one row per task. A run that dies while appending leaves no partial rows, and
    running twice at once can at worst store a count twice, which the join's side removes.
    """
    spark = docs.sparkSession
    body = open(tokenizer, "rb").read()
    version = hashlib.sha256(body).hexdigest()
    shared = spark.sparkContext.broadcast(("model" if tokenizer.endswith(".model") else "json", body))
    schema = spark.createDataFrame([], CACHE_SCHEMA).schema
    stored = spark.createDataFrame([], schema)
    if _exists(spark, cache):
        stored = spark.read.schema(schema).parquet(cache)
    stored = stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))

    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("_id"), content.alias("_text"))
    rows = rows.withColumn("content", F.sha2("_text", 256))
    misses = rows.groupBy("content").agg(F.first("_text").alias("_text")).join(stored, "content", "left_anti")

    def encode(batch: pa.RecordBatch):
        count = _counter(*shared.value)
        n = [count(t) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"content": batch.column("content").cast(pa.string()), "tokenizer": pa.array([version] * len(n), pa.string()), "n_tokens": pa.array(n, pa.int64())})

    arrow_map(misses, encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))
    return (
        rows.select("_id", "content", F.octet_length("_text").cast("long").alias("n_bytes"))
        .join(counts, "content")
        .select(F.col("_id").alias(id), "n_bytes", "n_tokens")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
