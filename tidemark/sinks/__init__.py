"""Sinks and table maintenance.

Parquet has neither MERGE nor DELETE, so keyed upserts are staged: the affected
partitions are merged into a staging folder under the shared checkpoint folder,
then swapped in with dynamic partition overwrite. A plan never reads and
overwrites the same path, and a failed job leaves the target untouched (the
staging write either completes or is discarded). Where Delta Lake is installed the
same calls can use ``fmt="delta"`` and its MERGE/DELETE instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.monitor import merge_rows
from tidemark.session import checkpoint_root


def append_results(df: DataFrame, table: str, fmt: str = "parquet") -> None:
    """K1: append with schema evolution (new result columns are added to the table).

    Delta merges the schema itself; for parquet tables the new columns are added
    with ``ALTER TABLE ... ADD COLUMNS`` and the rows are appended aligned by name
    (missing columns as NULL).
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        df.write.format(fmt).saveAsTable(table)
        return
    have = {c.lower() for c in spark.table(table).columns}
    new = [f for f in df.schema.fields if f.name.lower() not in have]
    if new and fmt != "delta":
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS (" + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new) + ")")
    target = spark.table(table).schema
    mine = {c.lower(): c for c in df.columns}
    aligned = df.select(*[(F.col(f"`{mine[f.name.lower()]}`") if f.name.lower() in mine else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields])
    aligned.write.format(fmt).mode("append").option("mergeSchema", "true").saveAsTable(table)


def replace_results(df: DataFrame, table: str, fmt: str = "parquet") -> None:
    """K2/K3/K8: atomic overwrite with the frame's schema (no empty-table window)."""
    df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)


def ensure_partitioned(spark: SparkSession, table: str, ddl: str, by: str, fmt: str = "parquet") -> None:
    """K4: create a partitioned table if it does not exist."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ddl}) USING {fmt} PARTITIONED BY ({by})")


def swap_table(spark: SparkSession, df: DataFrame, table: str, fmt: str = "parquet") -> None:
    """K8: copy-swap rewrite: write ``<table>__new``, drop the old table, rename the new one.

    The derived frame may read ``table`` itself: it is fully written before the old
    table is dropped, so a plan never reads and overwrites the same table.
    """
    new = f"{table}__new"
    spark.sql(f"DROP TABLE IF EXISTS {new}")
    df.write.format(fmt).saveAsTable(new)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {table}")


def register_view(df: DataFrame, name: str) -> DataFrame:
    """K7: publish as a temporary view."""
    df.createOrReplaceTempView(name)
    return df


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in any store that Spark reads; none if it isn't there."""
    fs, p = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote."""
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def merge_into(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], part_col: str = "run_date") -> None:
    """K5/M9: keyed upsert of ``batch`` into a parquet folder partitioned by ``part_col``.

    Only partitions present in the batch are read, merged (batch rows win), written
    to a staging folder and swapped in by dynamic partition overwrite. Re-running
    with the same batch gives the same table (idempotent).
    """
    parts = [r[0] for r in batch.select(part_col).distinct().collect()]  # partition values only (days)
    if not parts:
        return
    merged = batch
    if _exists(spark, path):
        known = [p for p in parts if p is not None]
        touched = F.col(part_col).isin(known) | F.col(part_col).isNull() if None in parts else F.col(part_col).isin(known)
        # Columns that the table alone has stay; the batch's schema keeps a partition value like '001' a text.
        stored = spark.read.parquet(path).schema
        mine = {f.name: f for f in batch.schema.fields}
        existing = spark.read.schema(T.StructType([mine.get(f.name, f) for f in stored.fields])).parquet(path).where(touched)
        merged = merge_rows(existing, batch.select(*existing.columns), keys)
    stage = stage_path(spark, "merge")
    merged.write.mode("overwrite").partitionBy(part_col).parquet(stage)
    staged = spark.read.schema(merged.schema).parquet(stage)
    (
        staged.select(*merged.columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(part_col)
        .parquet(path)
    )
    remove(spark, stage)


def drop_older_folders(spark: SparkSession, path: str, part_col: str, cutoff: str) -> list[str]:
    """K6 on a partitioned folder: removes the folders of days before ``cutoff`` (ISO), without reading or rewriting rows."""
    old = [x for x in children(spark, path) if x.startswith(f"{part_col}=") and x.partition("=")[2] < cutoff]
    for x in old:
        remove(spark, f"{path}/{x}")
    return old


def drop_older_partitions(spark: SparkSession, table: str, part_col: str, cutoff: str) -> list[str]:
    """K6 on a catalog table: drop partitions with ``part_col < cutoff`` (metadata command, no rewrite)."""
    dropped = []
    for r in spark.sql(f"SHOW PARTITIONS {table}").collect():
        spec = dict(kv.split("=", 1) for kv in r[0].split("/"))
        if spec.get(part_col, "") < cutoff:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({part_col} = '{spec[part_col]}')")
            dropped.append(spec[part_col])
    return dropped


def rewrite_table(df: DataFrame, path: str, casts: Mapping[str, str] | None = None, files: int | None = None, part_col: str | None = None) -> None:
    """K9: widen column types and compact files in one rewrite (OPTIMIZE / ALTER TYPE without Delta).

    Rewrites into ``path`` which must differ from the source path; swap by name afterwards (K8).
    ``files`` is how many the rows are dealt to while each stays within the advisory size of a partition. Adaptive execution cuts
    longer ones, so a value of ``part_col`` that a third of all rows have isn't sorted and written by one task.
    """
    out = df
    for c, t in (casts or {}).items():
        out = out.withColumn(c, F.col(c).cast(t))
    if files:
        out = out.hint("rebalance", files, *([F.col(part_col)] if part_col else []))
    w = out.write.mode("overwrite")
    if part_col:
        w = w.partitionBy(part_col)
    w.parquet(path)


def export_tsv(df: DataFrame, path: str, by: str | None = None) -> None:
    """Tab-separated export with header, one write for all columns (optionally partitioned)."""
    w = df.write.mode("overwrite").option("sep", "\t").option("header", "true")
    if by:
        w = w.partitionBy(by)
    w.csv(path)
