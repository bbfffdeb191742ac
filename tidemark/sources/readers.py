"""Sources (S1-S9): catalog tables, paths, CSV, inline rows, column metadata,
table listings, parameterised SQL, file listings and latest-run scans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

META_SCHEMA = "table_name string, column_name string, data_type string, is_nullable string, ordinal_position int"


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table scan (filters and column pruning reach the scan)."""
    return spark.table(name)


def read_path(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Scan of a table stored at a path (parquet, delta where installed, orc, json...)."""
    return spark.read.format(fmt).options(**options).load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """S3: CSV with header. Without a schema every column is a string (no inference pass)."""
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def rows(spark: SparkSession, data: Iterable, ddl: str | T.StructType) -> DataFrame:
    """Inline rows; a schema is always required so all-NULL columns keep their type."""
    return spark.createDataFrame(list(data), schema=ddl)


def _meta_rows(name: str, schema: T.StructType):
    for pos, field in enumerate(schema.fields, start=1):
        yield (name.lower(), field.name.lower(), field.dataType.simpleString(), "YES" if field.nullable else "NO", pos)


def table_columns(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Column metadata ``(table_name, column_name, data_type, is_nullable, ordinal_position)``.

    OSS Spark has no ``information_schema``; the metadata comes from each frame's
    analysed schema (no data is scanned). One small frame for all tables, so the
    comparisons downstream are joins instead of driver dictionaries.
    """
    data = [r for name, df in frames.items() for r in _meta_rows(name, df.schema)]
    return literal_rows(spark, data, META_SCHEMA)


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_rows(spark: SparkSession, data, ddl: str) -> DataFrame:
    """Small literal table as an inline ``VALUES`` relation.

    Spark folds it into a LocalRelation at analysis time: no Python is needed to
    scan it and the optimizer knows it is tiny, so joins against it broadcast.
    """
    schema = T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl
    names = [f.name for f in schema.fields]
    if not data:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in data)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def catalog_columns(spark: SparkSession, database: str, prefixes: Iterable[str] = ()) -> DataFrame:
    """S5 over a catalog database: every table whose name starts with one of the prefixes."""
    frames = {}
    for t in spark.catalog.listTables(database):
        if not prefixes or any(t.name.lower().startswith(p.lower()) for p in prefixes):
            frames[t.name] = spark.table(f"{database}.{t.name}")
    return table_columns(spark, frames)


def list_tables(spark: SparkSession, database: str | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """Table listing with name-pattern exclusion (regular expressions)."""
    df = spark.sql(f"SHOW TABLES IN {database}") if database else spark.sql("SHOW TABLES")
    for pattern in exclude:
        df = df.where(~F.col("tableName").rlike(pattern))
    return df


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def run_sql(spark: SparkSession, sql: str, args: Mapping | None = None) -> DataFrame:
    """Parameterised SQL with named markers (``:start_date``), never string templating."""
    return spark.sql(sql, args=dict(args or {}))


def file_inventory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Recursive listing with size and modification time.

    Uses the binaryFile source but selects only metadata columns, so file
    contents are never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df.select(
        F.col("path"),
        F.element_at(F.split(F.col("path"), "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_update_date"),
    )


def latest_run(df: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Rows of the latest run (``run_col = max(run_col)``) via a scalar-subquery style join."""
    latest = df.agg(F.max(run_col).alias("__latest__"))
    return df.join(F.broadcast(latest), F.col(run_col) == F.col("__latest__"), "left_semi")


def col_ci(df: DataFrame, name: str) -> Column:
    """P2 helper: case-insensitive column lookup."""
    lookup = {c.lower(): c for c in df.columns}
    return F.col(f"`{lookup.get(name.lower(), name)}`")
