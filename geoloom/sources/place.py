"""Where jobs put intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local session, where one machine is the whole cluster, may fall back to a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="geoloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once, as a Parquet table in the shared folder, and read it from there: later steps neither repeat the
    work nor depend on the executors that did it. The table goes when the application ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written_text(df: DataFrame, name: str) -> str:
    """The same for one text column, as lines; returns the folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.text(path)
    _written.append((df.sparkSession, path))
    return path


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_written() -> None:
    for spark, path in _written:
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session ended first: the folder is the cluster's to clear
            return
