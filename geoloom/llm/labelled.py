"""Bounded, seeded samples of labelled rows, for classifiers fitted where the job starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import seeded

#: Rows longer than this are not learnt from (they are scored like all others).
MAX_BYTES = 16_384


def sample_by_class(rows: DataFrame, label: str, key: str, per_class: int, seed: int) -> DataFrame:
    """About ``per_class`` rows of every class (all of a smaller one), chosen by a seeded hash of the key:
    one counting pass over key and label, then a filter; a rerun chooses the same rows."""
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    chosen: Column = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, per_class / n)
        chosen = chosen | ((F.col(label) == value) & (F.pmod(seeded(seed, key), F.lit(1_000_000)) < int(share * 1_000_000) + 1))
    return rows.where(chosen)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 7) -> list[tuple[str, int]]:
    """(text, 0 or 1) of a sample of labelled documents, on the driver: about ``per_class`` rows of either class,
    each of at most MAX_BYTES bytes, so at most about 2 * per_class * MAX_BYTES bytes however large the tables.

    Labels that are null, not 0 or 1, without id or contradictory are ignored. The sampled ids (bounded as well) are
    broadcast to the scan of documents.
    """
    clean = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    ids = sample_by_class(clean, "_y", "_id", per_class, seed).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.octet_length("_text").between(1, MAX_BYTES))
    found = rows.join(F.broadcast(ids), "_id").select("_id", "_text", "_y").collect()
    return [(r[1], r[2]) for r in sorted(found, key=lambda r: (r[0], r[1]))]
