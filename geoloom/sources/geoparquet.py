"""GeoParquet files: a writer that puts the ``geo`` description into every footer, and readers of footers.

Spark's own Parquet writer has no place for further footer entries, so tasks write their Arrow batches themselves:
each into a file of its own in a staging folder; the commit moves the files of successful attempts in and drops
the rest, so lost executors and repeated attempts leave nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from geoloom.functions.codec import KIND_OF_CODE
from geoloom.layer import BOX
from geoloom.shipping import ship

FORMAT = "geoloom_geoparquet"
#: Rows gathered before a row group is written.
ROW_GROUP = 1 << 17


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def described(primary: str, covering: str, kinds: list[str], bbox: list[float] | None, known_crs: bool) -> str:
    """The ``geo`` entry of a footer."""
    column: dict = {"encoding": "WKB", "geometry_types": kinds}
    column["covering"] = {"bbox": {side: [covering, side] for side in BOX}}
    if bbox is not None:
        column["bbox"] = bbox
    if not known_crs:
        column["crs"] = None
    return json.dumps({"version": "1.1.0", "primary_column": primary, "columns": {primary: column}})


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class GeoParquetWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: pa.Schema):
        self.path = options["path"].rstrip("/")
        self.primary, self.covering = options["primary"], options["covering"]
        self.known_crs = options["crs"] == "known"
        self.schema = schema
        self.job = uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.job}"

    def _open(self, name: str):
        system, folder = filesystem(self.staging)
        system.create_dir(folder, recursive=True)
        return system.open_output_stream(f"{folder}/{name}")

    def _describe(self, writer: pq.ParquetWriter, kinds: set[str], low: np.ndarray, high: np.ndarray) -> None:
        bbox = [*low.tolist(), *high.tolist()] if np.isfinite(low).all() else None
        writer.add_key_value_metadata({"geo": described(self.primary, self.covering, sorted(kinds), bbox, self.known_crs)})

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file of this task's rows; a task without rows writes none."""
        name = f"part-{uuid.uuid4().hex}.parquet"
        writer, out, waiting = None, None, []
        kinds: set[str] = set()
        low, high = np.full(2, np.inf), np.full(2, -np.inf)
        for batch in iterator:
            if batch.num_rows == 0:
                continue
            if writer is None:
                out = self._open(name)
                writer = pq.ParquetWriter(out, batch.schema, compression="snappy")
            kinds |= _kinds(batch.column(self.primary))
            box = batch.column(self.covering)
            sides = [pc.min_max(box.field(side)).as_py() for side in BOX]
            if sides[0]["min"] is not None:
                low = np.minimum(low, [sides[0]["min"], sides[1]["min"]])
                high = np.maximum(high, [sides[2]["max"], sides[3]["max"]])
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= ROW_GROUP:
                writer.write_table(pa.Table.from_batches(waiting))
                waiting = []
        if writer is None:
            return Written([])
        if waiting:
            writer.write_table(pa.Table.from_batches(waiting))
        self._describe(writer, kinds, low, high)
        writer.close()
        out.close()
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        files = [name for message in messages if message for name in message.files]
        if not files:  # the table's columns are kept by a file without rows
            files = ["part-empty.parquet"]
            with self._open(files[0]) as out, pq.ParquetWriter(out, self.schema) as writer:
                self._describe(writer, set(), np.full(2, np.inf), np.full(2, -np.inf))
        system, folder = filesystem(self.path)
        for name in files:
            system.move(f"{folder}/_staging-{self.job}/{name}", f"{folder}/{name}")
        system.delete_dir(f"{folder}/_staging-{self.job}")
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = filesystem(self.staging)
        if system.get_file_info(folder).type != pafs.FileType.NotFound:
            system.delete_dir(folder)


def _kinds(wkb: pa.Array) -> set[str]:
    """Kinds in a column of WKB values as ``to_wkb`` writes them."""
    wkb = wkb.drop_null().cast(pa.large_binary())
    starts = np.frombuffer(wkb.buffers()[1], np.int64)[wkb.offset : wkb.offset + len(wkb)] if len(wkb) else np.zeros(0, np.int64)
    codes = np.frombuffer(wkb.buffers()[2], np.uint8)[starts + 1] if len(wkb) else starts
    return {KIND_OF_CODE[c] for c in np.unique(codes).tolist()}


class GeoParquetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> GeoParquetWriter:
        return GeoParquetWriter(dict(self.options), to_arrow_schema(schema))


def write(df: DataFrame, path: str, primary: str, covering: str, known_crs: bool = True) -> None:
    """Write ``df``, with WKB in column ``primary`` and boxes in the struct column ``covering``; an error if the path exists."""
    spark = df.sparkSession
    ship(spark)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileExistsError(path)
    spark.dataSource.register(GeoParquetSource)
    options = {"primary": primary, "covering": covering, "crs": "known" if known_crs else "unknown"}
    df.write.format(FORMAT).options(**options).mode("append").save(path)


def declared(spark: SparkSession, file: str) -> dict | None:
    """The ``geo`` entry of one file; only the footer is read, by Spark's own file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        entry = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return json.loads(entry) if entry else None


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: file, n_rows, primary_column, version, kinds, and the box its footer states (null without one)."""
    ship(spark)
    files = spark.read.parquet(path).inputFiles()
    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 1000) or 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                system, place = filesystem(file)
                with system.open_input_file(place) as source:
                    footer = pq.read_metadata(source)
                geo = json.loads((footer.metadata or {}).get(b"geo", b"{}"))
                column = geo.get("columns", {}).get(geo.get("primary_column"), {})
                box = dict(zip(BOX, column.get("bbox") or [None] * 4))
                rows.append({"file": file, "n_rows": footer.num_rows, "primary_column": geo.get("primary_column"), "version": geo.get("version"), "kinds": column.get("geometry_types"), **box})
            yield pa.RecordBatch.from_pylist(rows, FOOTER)

    return named.mapInArrow(read, "file string, n_rows long, primary_column string, version string, kinds array<string>, xmin double, ymin double, xmax double, ymax double")


FOOTER = pa.schema(
    [("file", pa.string()), ("n_rows", pa.int64()), ("primary_column", pa.string()), ("version", pa.string()), ("kinds", pa.list_(pa.string())), *[(side, pa.float64()) for side in BOX]]
)


def primary_column(df: DataFrame) -> tuple[str | None, str | None]:
    """(geometry column, covering column) that the footers of a dataset name; (None, None) without ``geo`` entries. A footer
    that names a column the table lacks is an error."""
    files = df.select(F.col("_metadata.file_path")).limit(1).collect()
    file = files[0][0] if files else next(iter(df.inputFiles()), None)
    geo = declared(df.sparkSession, file) if file else None
    if geo is None:
        return None, None
    name = geo.get("primary_column", "geometry")
    if name not in df.columns:
        raise ValueError(f"the footer names {name!r} as geometry, the table has {df.columns}")
    sides = geo.get("columns", {}).get(name, {}).get("covering", {}).get("bbox", {})
    covering = sides.get("xmin", [None])[0]
    return name, covering if covering in df.columns else None
