"""Helpers that the operators share: staged tables, a global order, words, and sizes of batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root

#: \x20, \x09-\x0D
BLANK_CHARS = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hidden(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns numbered, so that no name of theirs meets one that an operator uses inside."""
    return docs.toDF(*[f"__{i}" for i, _ in enumerate(docs.columns)])


def hidden_name(docs: DataFrame, name: str) -> str:
    """What ``hidden`` calls a column, found whatever its case."""
    return f"__{[c.lower() for c in docs.columns].index(name.lower())}"


def shown(out: DataFrame, docs: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """``out`` with the columns of ``docs`` under their names again (without ``but``), before those that were added."""
    names = {f"__{i}": c for i, c in enumerate(docs.columns)}
    mine = [F.col(h).alias(c) for h, c in names.items() if c not in but]
    return out.select(*mine, *[c for c in out.columns if c not in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of the cluster."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: Spark removes those of a write when it ends, and not when the driver
    happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """What runs inside sends rows to the workers in batches of about ``most`` bytes: by default it is 10,000 rows, however long,
    which the executor and the worker both hold."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors,
    frees the shuffles behind it, and gives the planner the true size of what follows."""
    path = stage_dir(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(expr: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of ``expr`` with ``expr`` computed once for each row, however often ``fn`` names it."""
    return F.transform(F.array(expr), fn)[0]


def blank_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(text, BLANKS), ""), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def in_global_order(df: DataFrame, by: list[str], parts: int, sums: dict[str, str] | None = None, name: str = "ordered") -> DataFrame:
    """Adds ``pos`` (0, 1, ... in the order of ``by``, which should tell rows apart) and, for each ``new: column`` of
    ``sums``, the running sum up to and with the row.

    Rows are dealt by ranges of ``by``; positions run within a range, and only one row for each range meets in
    one task to give the ranges' offsets. The ranges are staged, so that both passes see the same ones.
    """
    sums = sums or {}
    cut = staged(df.repartitionByRange(parts, *by).withColumn("__pid", F.spark_partition_id()), name)
    inside = Window.partitionBy("__pid").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    starts = totals.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums])
    out = cut.withColumn("pos", F.row_number().over(inside).cast("long") - 1).withColumns({n: F.sum(c).over(inside) for n, c in sums.items()} or {})
    out = out.join(starts, "__pid")
    return out.select(*df.columns, (F.col("pos") + F.col("__n0")).alias("pos"), *[(F.col(n) + F.col(f"__s_{n}")).alias(n) for n in sums])


def by_bytes(batches: Iterable, column: int, most: int = 4 << 20) -> Iterator:
    """Arrow batches cut into runs of rows whose texts have about ``most`` bytes together (one row at least)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column).cast(pa.large_binary())), 0)).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, upto - at)
            at = upto
