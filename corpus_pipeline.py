"""The corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last
return the columns of ``docs``. Their results are written as Parquet and read again between the stages.

Every stage takes null and empty texts, null ids and sources, repeated rows, empty tables and extra columns of any
name; what each does with them is stated in the operator it calls and below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.bpe import bpe_encode
from geoloom.llm.line_dedup import line_dedup
from geoloom.llm.mixing import mix_sources
from geoloom.llm.near_dup import near_duplicates
from geoloom.llm.quality import quality_rules
from geoloom.sources.place import fresh_path

NEAR_WORDS, NEAR_PERCENT = 5, 80

#: SQL can state neither a trained model's verdicts nor an encoding; the stages are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; texts without words go."""
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs, n_chars with them; documents of which no line with a word is left go."""
    found = line_dedup(docs).where("n_removed < n_lines or n_lines = 0")
    new = {"text": F.col("deduped"), "n_chars": F.char_length("deduped").cast("long")}
    changed = F.col("n_removed") > 0
    return found.select(*[F.when(changed, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates; of rows that share an id one stays, rows without an
    id all stay."""
    kept = near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = mix_sources(docs).where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return taken.select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row."""
    encoded = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near),
    ("mixing", mixing),
    ("BPE encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between the stages the kept rows go through Parquet in the shared folder; a folder is
    deleted as soon as the next one is written, so one is left."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
