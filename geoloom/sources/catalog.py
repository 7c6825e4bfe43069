"""Catalog jobs: inventories, search, scratch tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import codec
from geoloom.layer import GEOMETRY_NAMES, is_geometry_type
from geoloom.sources.ingest import type_name

# Fixed value: what marks a scratch namespace.
SCRATCH_PREFIX = "_scratch"

INVENTORY = "namespace string, table_name string, position int, column_name string, data_type string, is_geometry boolean"


def inventory_of(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """One row per column of the given ``namespace.table`` DataFrames (schemas only)."""
    rows = []
    for ref, df in tables.items():
        namespace, _, table = ref.rpartition(".")
        for i, field in enumerate(df.schema.fields):
            geometry = field.name.lower() in GEOMETRY_NAMES or is_geometry_type(field.dataType)
            rows.append((namespace, table, i, field.name, type_name(field.dataType), geometry))
    return spark.createDataFrame(rows, INVENTORY)


def inventory(spark: SparkSession, include_scratch: bool = False) -> DataFrame:
    """One row per column of every catalog table; scratch namespaces only on request."""
    tables = {}
    for database in spark.catalog.listDatabases():
        if database.name.startswith(SCRATCH_PREFIX) and not include_scratch:
            continue
        for table in spark.catalog.listTables(database.name):
            if not table.isTemporary:
                ref = f"{database.name}.{table.name}"
                tables[ref] = spark.table(ref)
    return inventory_of(tables, spark)


def list_tables(inv: DataFrame) -> DataFrame:
    return inv.groupBy("namespace", "table_name").agg(
        F.count("*").alias("column_count"), F.max("is_geometry").alias("has_geometry")
    )


def describe(inv: DataFrame, namespace: str, table: str) -> DataFrame:
    return inv.filter((F.col("namespace") == namespace) & (F.col("table_name") == table))


def search(inv: DataFrame, pattern: str = "", column_pattern: str = "", geometry_only: bool = False) -> DataFrame:
    """Tables whose name, or some column's name, contains the text, ignoring case."""
    found = inv.filter(F.contains(F.lower("table_name"), F.lit(pattern.lower())))
    found = found.groupBy("namespace", "table_name").agg(
        F.count("*").alias("column_count"),
        # A table's columns, in order: schema-sized.
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda c: c["column_name"]
        ).alias("column_names"),
        F.max("is_geometry").alias("has_geometry"),
    )
    if column_pattern:
        term = F.lit(column_pattern.lower())
        found = found.filter(F.exists("column_names", lambda c: F.contains(F.lower(c), term)))
    return found.filter("has_geometry") if geometry_only else found


def inventory_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables that appeared or went away between two inventories."""
    key = ["namespace", "table_name"]
    old, new = before.select(key).distinct(), after.select(key).distinct()
    added = new.join(old, key, "left_anti").withColumn("change", F.lit("added"))
    removed = old.join(new, key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of the tables' row counts."""
    counts = None
    for ref, df in tables.items():
        namespace, _, table = ref.rpartition(".")
        one = df.agg(F.count("*").alias("row_count")).select(
            F.lit(namespace).alias("namespace"), F.lit(table).alias("table_name"), "row_count"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


def first_of_each_name(df: DataFrame) -> DataFrame:
    """Drop later columns that repeat an earlier name (ignoring case)."""
    seen, keep = set(), []
    for name in df.columns:
        keep.append(name.lower() not in seen)
        seen.add(name.lower())
    if all(keep):
        return df
    names = [f"_c{i}" for i in range(len(keep))]
    return df.toDF(*names).select(*[F.col(n).alias(c) for n, c, k in zip(names, df.columns, keep) if k])


def materialize(
    df: DataFrame,
    name: str,
    db: str = SCRATCH_PREFIX,
    overwrite: bool = True,
    location: str | None = None,
    as_wkb: str | None = None,
) -> int:
    """Save a result as a table in a scratch namespace; returns its row count.

    ``location`` is the namespace's folder when it is created; ``as_wkb`` names a nested geometry
    column to store as WKB.
    """
    spark = df.sparkSession
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`{place}")
    rows = first_of_each_name(df)
    if as_wkb:
        rows = rows.withColumn(as_wkb, codec.to_wkb(F.col(as_wkb)))
    ref = f"`{db}`.`{name}`"
    if overwrite:
        spark.sql(f"DROP TABLE IF EXISTS {ref}")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("error").saveAsTable(ref)
    return seen.get["n"]


def promote(spark: SparkSession, source: str, target: str) -> int:
    """Copy a scratch table to a permanent one that must not exist yet; returns its row count."""
    source_db, target_db = source.split(".")[0], target.split(".")[0]
    if not source_db.startswith(SCRATCH_PREFIX):
        raise ValueError(f"{source!r} is not a scratch table")
    if target_db.startswith(SCRATCH_PREFIX):
        raise ValueError(f"{target!r} is in a scratch namespace")
    seen = Observation()
    rows = spark.table(source).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("error").saveAsTable(target)
    return seen.get["n"]


def drop_scratch(spark: SparkSession, db: str, idle: timedelta | None = None) -> list[str]:
    """Drop a scratch namespace and its tables; with ``idle`` only tables older than that, and the
    namespace once it is empty. Returns the dropped tables.
    """
    if not db.startswith(SCRATCH_PREFIX):
        raise ValueError(f"{db!r} is not a scratch namespace")
    dropped, kept = [], 0
    for table in spark.catalog.listTables(db):
        if table.isTemporary:
            continue
        ref = f"`{db}`.`{table.name}`"
        if idle is not None and _age(spark, ref) < idle:
            kept += 1
            continue
        spark.sql(f"DROP TABLE {ref}")
        dropped.append(table.name)
    if not kept:
        spark.sql(f"DROP DATABASE `{db}` CASCADE")
    return dropped


def _age(spark: SparkSession, ref: str) -> timedelta:
    facts = spark.sql(f"DESCRIBE TABLE EXTENDED {ref}").filter("col_name = 'Created Time'").first()
    created = datetime.strptime(facts["data_type"], "%a %b %d %H:%M:%S %Z %Y").replace(tzinfo=timezone.utc)
    return datetime.now(timezone.utc) - created
