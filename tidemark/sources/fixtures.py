"""Test-table bindings: reference-shaped inputs derived from the driver tables.

Every fixture is a lazy DataFrame over the parquet tables, so its size grows with
the scale factor. The SQL twins in ``tidemark.plans.oracle_sql`` compute the same
rows in DuckDB.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixtures (not taken from any reference data).
BRAND_NAME_MAP = {"Alpha": "B1", "Beta": "B2"}
GEN_CODE_MAP = {"G1": "B1", "G2": "B2"}
STATUS_CODES = ["QUOTED", "BOUND", "DECLINED"]


@lru_cache(maxsize=256)
def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy reader of one driver table; cached per session so footers are read once."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def src_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(*ORDER_COLS)


def tgt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target copy with injected drift: FORMAT every 31st key, VALUE every 53rd,
    NULL every 41st, missing every 97th, extra rows for every 89th key."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kept = o.where(k % 97 != 0).select(
        k,
        "o_custkey",
        F.when(k % 31 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 53 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 41 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    extra = o.where(k % 89 == 0).select((k + 100000000).alias("o_orderkey"), *ORDER_COLS[1:])
    return kept.unionByName(extra)


def third_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tgt_orders(spark, sf_dir).where(F.col("o_orderkey") % 7 != 0)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    u = F.col("user_id") % 4
    return e.select(
        "event_id",
        F.col("ts").alias("enqueued_time"),
        F.to_date("ts").alias("queued_date"),
        F.col("event_type").alias("message_type"),
        F.when(u.isin(0, 1), "B1").when(u == 2, "B2").when(F.col("event_id") % 2 == 0, "ZZ").alias("brand_raw"),
        "value",
        "props",
    )


def bronze_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze layer: the same feed with every 7th event lost."""
    return feed(spark, sf_dir).where(F.col("event_id") % 7 != 0)


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction flow events: JSON payload with timestamp, status, ids and brand fields."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_CODES]), (k % 3 + 1).cast("int"))
    u5 = F.col("user_id") % 5
    brand_name = F.when(u5 == 0, "Alpha").when(u5 == 1, "Beta").when(u5 == 2, "Gamma")
    gen_code = F.when(u5 == 3, F.element_at(F.array(F.lit("G1"), F.lit("G2"), F.lit("G9")), (F.col("event_id") % 3 + 1).cast("int")))
    inter = F.to_json(
        F.struct(
            status.alias("status"),
            F.col("user_id").cast("string").alias("mqsQuoteId"),
            F.col("event_id").cast("string").alias("_id"),
            brand_name.alias("brandName"),
            gen_code.alias("generationCode"),
        )
    )
    payload = F.concat(
        F.lit('{"timestamp":"'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit('","interaction":'),
        inter,
        F.lit("}"),
    )
    return e.select("event_id", F.to_date("ts").alias("queued_date"), payload.alias("payload"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry (MTR) stream: quote id and interaction id of every event not divisible by 5."""
    e = load(spark, sf_dir, "events")
    return e.where(F.col("event_id") % 5 != 0).select(
        F.col("ts").alias("enqueued_time"),
        F.col("user_id").cast("string").alias("mqs_quote_id"),
        F.col("event_id").cast("string").alias("interaction_id"),
    )


def bool_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean-coded text column ('t'/'f'/NULL) next to ordinary string columns."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "t").when(F.col("o_orderstatus") == "O", "f").alias("o_isfinal"),
        F.when(F.col("o_orderstatus") == "F", "T").when(F.col("o_orderstatus") == "O", "f").otherwise("f").alias("o_flag_upper"),
        F.when(F.col("o_orderstatus") == "F", "t").alias("o_t_only"),
        F.lit(None).cast("string").alias("o_unused"),
        "o_orderstatus",
        "o_orderpriority",
    )


def typed_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target copy whose types drifted: price as text, customer key as double."""
    t = tgt_orders(spark, sf_dir)
    return t.withColumn("o_totalprice", F.col("o_totalprice").cast("string")).withColumn("o_custkey", F.col("o_custkey").cast("double"))


def decimal_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with money columns stored as decimals."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_extendedprice").cast("decimal(15,2)").alias("l_extendedprice"),
        F.col("l_discount").cast("decimal(4,2)").alias("l_discount"),
        "l_quantity",
    )


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-result rows: one run per day of events, one row per message type (table)."""
    f = feed(spark, sf_dir)
    g = f.groupBy(F.col("queued_date"), F.col("message_type").alias("table_name")).agg(
        F.count(F.lit(1)).alias("src_count"),
        F.count(F.when(F.col("event_id") % 7 != 0, 1)).alias("tgt_count"),
    )
    return g.select(
        F.date_format("queued_date", "yyyyMMdd").alias("run_id"),
        "table_name",
        "src_count",
        "tgt_count",
        F.when(F.col("src_count") == F.col("tgt_count"), "PASS")
        .when(F.col("tgt_count") * 10 >= F.col("src_count") * 9, "WARN")
        .otherwise("FAIL")
        .alias("status"),
    )


def val_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation source: boolean-coded text column and a source-only note column."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") == "F", "t").when(F.col("o_orderstatus") == "O", "f").alias("o_isfinal"),
        "o_totalprice", "o_orderdate", "o_orderpriority",
        F.concat(F.lit("note-"), F.col("o_custkey").cast("string")).alias("o_note"),
    )


def val_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation target: 1/0 flag, decimal price (changed every 37th key), load-date and
    target-only columns, and every 50th order loaded twice."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    t = o.select(
        k, "o_custkey",
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("o_isfinal"),
        F.when(k % 37 == 0, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice")).cast("decimal(12,2)").alias("o_totalprice"),
        "o_orderdate", "o_orderpriority",
        F.col("o_orderdate").alias("azure_load_date"),
        (F.col("o_custkey") % 10).alias("o_target_only"),
    )
    return t.unionByName(t.where(k % 50 == 0))
