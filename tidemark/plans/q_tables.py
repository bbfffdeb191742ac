"""Sources and sinks at work (S1, S3, S4, S6, S7, K1-K10, T6), and column helpers on tables.

Every query derives a table from the given ones, puts it through a sink, and returns what a reader finds there.
Catalog tables get a name of their own and are dropped once their rows have been staged.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import sinks
from tidemark.functions import columns as C
from tidemark.functions.timefn import ts_lit
from tidemark.operators import monitor as M
from tidemark.operators.aggs import distinct_tables as distinct_tables_op
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx
from tidemark.sources import readers
from tidemark.streaming import streams as S


@contextmanager
def _table(spark):
    name = f"t_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _kept(spark, df):
    """The rows as they are now, in the shared folder."""
    path = sinks.stage_path(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query("sink_append", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS o_totalprice FROM orders")
def sink_append(spark, sf):
    """A table made by its first append; the second brings a new column."""
    o = fx.load(spark, sf, "orders")
    with _table(spark) as name:
        sinks.append_results(o.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderkey"), name)
        sinks.append_results(o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", "o_totalprice"), name)
        assert readers.table_exists(spark, name)
        return _kept(spark, readers.read_table(spark, name).select("o_orderkey", "o_custkey", "o_totalprice"))


@query("sink_replace", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 5")
def sink_replace(spark, sf):
    """K2/K3: overwritten with another schema."""
    with _table(spark) as name:
        sinks.replace_results(fx.load(spark, sf, "nation"), name)
        sinks.replace_results(fx.load(spark, sf, "customer").where("c_nationkey < 5").select("c_custkey", "c_name"), name)
        return _kept(spark, readers.read_table(spark, name))


@query("sink_retention", "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders WHERE year(o_orderdate) >= 1995")
def sink_retention(spark, sf):
    """K4/K6: a partitioned table is made, filled, and loses its old partitions."""
    with _table(spark) as name:
        sinks.ensure_partitioned(spark, name, "o_orderkey bigint, y string", "y")
        fx.load(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("y")).write.insertInto(name)
        sinks.drop_older_partitions(spark, name, "y", "1995")
        return _kept(spark, readers.read_table(spark, name))


@query("sink_swap", "SELECT s_suppkey, round(s_acctbal * 2, 2) AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def sink_swap(spark, sf):
    """K8: a table rewritten from itself by copy and rename."""
    with _table(spark) as name:
        sinks.replace_results(fx.load(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), name)
        derived = readers.read_table(spark, name).where("s_suppkey % 2 = 0").select("s_suppkey", F.round(F.col("s_acctbal") * 2, 2).alias("s_acctbal"))
        sinks.swap_table(spark, derived, name)
        return _kept(spark, readers.read_table(spark, name))


@query("sink_rewrite", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag FROM lineitem")
def sink_rewrite(spark, sf):
    """K9: a narrow type widened and files compacted by partition."""
    out = sinks.stage_path(spark, "rewritten")
    sinks.rewrite_table(fx.load(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int"), "l_returnflag"), out, casts={"l_linenumber": "bigint"}, files=4, part_col="l_returnflag")
    return readers.read_path(spark, out).select("l_orderkey", "l_linenumber", F.col("l_returnflag").cast("string").alias("l_returnflag"))


@query("sink_tsv", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def sink_tsv(spark, sf):
    """A tab-separated export, read back with its schema."""
    out = sinks.stage_path(spark, "tsv")
    p = fx.load(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice", "p_brand")
    sinks.export_tsv(p, out, by="p_brand")
    return readers.read_csv(spark, out, T.StructType(p.schema.fields), sep="\t").select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query("sink_view", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1 HAVING count(*) > 10")
def sink_view(spark, sf):
    """A published view, asked by parameterised SQL."""
    sinks.register_view(fx.load(spark, sf, "events"), "published_events")
    sql = "SELECT event_type, count(*) AS n FROM published_events WHERE ts >= CAST(:start_date AS TIMESTAMP_NTZ) AND ts < CAST(:end_date AS TIMESTAMP_NTZ) GROUP BY 1 HAVING count(*) > :least"
    return readers.run_sql(spark, sql, {"start_date": "2024-01-10 00:00:00", "end_date": "2024-01-20 00:00:00", "least": 10})


@query("inline_rows", "SELECT r_regionkey, r_name, CASE r_regionkey WHEN 1 THEN 'west' END AS side FROM region")
def inline_rows(spark, sf):
    """Configuration as inline rows (an all-NULL column keeps its type) beside a table."""
    sides = readers.rows(spark, [(1, "west"), (2, None)], "k long, side string")
    return fx.load(spark, sf, "region").join(sides, F.col("r_regionkey") == F.col("k"), "left").select("r_regionkey", "r_name", "side")


@query("stream_ingest", "SELECT event_id, event_type, value FROM events")
def stream_ingest(spark, sf):
    """New files of a folder copied exactly once, in two runs of one checkpoint."""
    folder, out, ck = (sinks.stage_path(spark, f"ingest-{x}") for x in ("in", "out", "ck"))
    e = fx.load(spark, sf, "events").select("event_id", "event_type", "value")
    for i in (0, 1):
        e.where(F.col("event_id") % 2 == i).write.parquet(f"{folder}/{i}")
        S.ingest_files(spark, folder, e.schema, out, ck, glob="*.parquet", recursive=True).awaitTermination()
    return spark.read.schema(e.schema).parquet(out)


@query("stream_dedup", "SELECT event_id, enqueued_time FROM feed", ("feed",))
def stream_dedup(spark, sf):
    """T4: an event that arrives again in a later run, within the watermark, is dropped."""
    folder, out = sinks.stage_path(spark, "dedup-in"), sinks.stage_path(spark, "dedup-out")
    f = fx.feed(spark, sf).select("event_id", "enqueued_time")
    for i in (0, 1):
        (f if i == 0 else f.where(F.col("event_id") % 3 == 0)).write.parquet(f"{folder}/{i}")
        events = S.dedup_stream(S.event_time(S.read_files(spark, folder, f.schema, recursive=True), "enqueued_time"), ["event_id"], "enqueued_time", "3650 days")
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", F.col("enqueued_time").cast("timestamp_ntz").alias("enqueued_time"))


# ---------------------------------------------------------------------- the monitor's run modes (M8, L3)
_NOW = "SELECT max(enqueued_time) AS now FROM feed"
_MODES = """SELECT CASE m WHEN 0 THEN 'BACKFILL' WHEN 1 THEN CASE WHEN hour(now) = 0 AND minute(now) < 30 THEN 'REPROCESS_YESTERDAY' ELSE 'INCREMENTAL' END END AS mode, f.*
FROM (SELECT 0 AS m UNION ALL SELECT 1), n JOIN feed_fact f ON TRUE
WHERE CASE WHEN m = 0 THEN interval_start >= date_trunc('day', now) - INTERVAL 2 DAY AND interval_end <= time_bucket(INTERVAL 30 MINUTE, now)
  WHEN hour(now) = 0 AND minute(now) < 30 THEN interval_start >= date_trunc('day', now) - INTERVAL 1 DAY AND interval_start < date_trunc('day', now)
  ELSE interval_start >= date_trunc('day', now) AND interval_end <= time_bucket(INTERVAL 30 MINUTE, now) END"""


@query("monitor_runs", f"WITH n AS ({_NOW})\n{_MODES}", ("feed", "feed_fact"))
def monitor_runs(spark, sf):
    """M8/L3: two runs with the last event's time for a clock: the table is empty first, then it isn't."""
    feed, path, out = fx.feed(spark, sf), sinks.stage_path(spark, "runs"), None
    now = feed.agg(F.max("enqueued_time")).first()[0]
    for _ in range(2):
        empty = not sinks.children(spark, path) or spark.read.parquet(path).isEmpty()
        mode, start, end = M.run_bounds(now, empty)
        batch = _kept(spark, M.feed_counts(spark, feed.where(F.col("enqueued_time") < ts_lit(end)), start, end))
        sinks.merge_into(spark, path, batch, S.FACT_KEYS)
        part = batch.select(F.lit(mode).alias("mode"), *M.FACT_COLS)
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------------- column helpers


@query("column_texts", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders")
def column_texts(spark, sf):
    """Columns found, dropped and turned into text whatever their case."""
    o = fx.load(spark, sf, "orders").withColumn("Y", F.year("o_orderdate"))
    kept = C.drop_columns(o, [c.upper() for c in o.columns if c.lower() not in ("o_orderkey", "o_custkey", "o_orderpriority", "y")])
    return C.lower_columns(C.stringify(kept, ["O_ORDERKEY", "y"])).select(C.resolve_col(kept, "O_OrderKey"), "o_custkey", "o_orderpriority", "y")


@query(
    "column_presence",
    "SELECT 'both' AS place, 'o_custkey' AS column_name, count(*) AS row_count FROM orders UNION ALL SELECT 'both', 'o_orderkey', count(*) FROM orders "
    "UNION ALL SELECT 'first', 'o_totalprice', count(*) FROM orders UNION ALL SELECT 'second', 'price_text', count(*) FROM orders",
)
def column_presence(spark, sf):
    """Columns that two tables share or have alone, with the rows that carry them."""
    o = fx.load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    other = o.select(F.col("o_custkey").alias("O_CUSTKEY"), "o_orderkey", F.col("o_totalprice").cast("string").alias("price_text"), "o_orderdate")
    places = dict(zip(("both", "first", "second"), C.column_overlap(o, other, exclude=["O_ORDERDATE"]), strict=True))
    named = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(c).alias("column_name")) for p, cs in places.items() for c in cs])).alias("c")
    return o.select(named).groupBy("c.place", "c.column_name").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "name_filters",
    "SELECT p_partkey, p_type FROM part WHERE (p_type LIKE 'S%' OR p_type LIKE 'L%') AND (p_type LIKE '%L' OR p_type LIKE '%R') AND NOT regexp_matches(p_type, 'COPPER') "
    "UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#2')",
)
def name_filters(spark, sf):
    """Names chosen by prefixes, suffixes, a rejected pattern, or a list."""
    p = fx.load(spark, sf, "part")
    a = p.where(C.filter_names(F.col("p_type"), prefixes=["S", "L"], suffixes=["L", "R"], reject_regex="COPPER")).select("p_partkey", "p_type")
    b = p.where(C.filter_names(F.col("p_brand"), names=["Brand#1", "Brand#11", "Brand#2"])).select("p_partkey", F.col("p_brand").alias("p_type"))
    return a.unionByName(b)


@query("route_names", "SELECT c_custkey, CASE lower(left(c_mktsegment, 1)) WHEN 'a' THEN 'auto.' || c_mktsegment WHEN 'b' THEN 'build.' || c_mktsegment ELSE 'rest' END AS routed FROM customer")
def route_names(spark, sf):
    """Names sent to a domain by their first letter."""
    return fx.load(spark, sf, "customer").select("c_custkey", C.route_name(F.col("c_mktsegment"), {"a": "auto.", "B": "build."}, "rest").alias("routed"))


@query(
    "field_fallbacks",
    "SELECT event_id, message_type AS a, message_type AS b, 'UNKNOWN' AS c, enqueued_time AS t, CAST(queued_date AS TIMESTAMP) AS d FROM feed",
    ("feed",),
)
def field_fallbacks(spark, sf):
    """A field from a struct, from a dotted column, or its default; event time from a timestamp, or from a date at midnight."""
    f = fx.feed(spark, sf)
    nested = f.withColumn("headers", F.struct(F.col("message_type").alias("messageType")))
    dotted = f.withColumn("Headers.MessageType", F.col("message_type"))
    pick = lambda df: C.field_or(df, "headers", "messageType", "UNKNOWN")
    a = nested.select("event_id", pick(nested).alias("a"), C.pick_event_time(nested, "Enqueued_Time", "queued_date")[0].alias("t"))
    b = dotted.select("event_id", pick(dotted).alias("b"), C.pick_event_time(dotted, "no_such", "queued_date")[0].alias("d"), pick(f).alias("c"))
    return a.join(b, "event_id").select("event_id", "a", "b", "c", "t", "d")


@query("distinct_tables", "SELECT DISTINCT run_id AS source, table_name FROM run_results", ("run_results",))
def distinct_tables(spark, sf):
    """Tables seen by each run."""
    return distinct_tables_op(fx.run_results(spark, sf).withColumnRenamed("run_id", "source"), by="source")


@query(
    "scope_rows",
    "SELECT DISTINCT lower(o_orderpriority) AS table_name, lower(o_orderstatus) AS column_name FROM orders WHERE o_orderkey % 3 = 0 AND NOT regexp_matches(lower(o_orderpriority), '[^a-z0-9_ -]') AND o_orderstatus <> 'P'",
)
def scope_rows(spark, sf):
    """Rows of a listing kept by their flag, allowed names, and excluded columns."""
    from tidemark.operators.schema import in_scope

    o = fx.load(spark, sf, "orders")
    listing = o.select(F.col("o_orderpriority").alias("table_name"), F.col("o_orderstatus").alias("column_name"), F.when(F.col("o_orderkey") % 3 == 0, "TRUE").otherwise("no").alias("in_scope"))
    return in_scope(listing, exclude_columns=["p"], name_pattern=r"[^a-z0-9_ -]").select("table_name", "column_name").distinct()
