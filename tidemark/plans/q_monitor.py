"""Feed-monitoring queries over the ``feed`` / ``flow`` / ``registry`` fixtures.

The monitored window is the whole data range (midnight before the first event to
midnight after the last), found by one two-scalar aggregate.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from tidemark.functions.timefn import day_bounds, slot_floor, slots, ts_lit
from tidemark.operators import monitor as M
from tidemark.operators.aggs import counts_with_total, slot_counts
from tidemark.operators.joins import spine, zero_fill
from tidemark.plans.oracle_fixtures import register
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx
from tidemark.sources.readers import latest_run as latest_run_op

CFG = M.FeedConfig()
TYPES = CFG.expected_types
BRANDS = CFG.expected_brands
SPINE = CFG.spine_brands


def _in(vals) -> str:
    return ", ".join(f"'{v}'" for v in vals)


def _values(vals, name: str) -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in vals) + f") AS {name}_v({name})"


# ---------------------------------------------------------------- SQL twins of the monitor facts
register(
    "fbounds",
    """SELECT CAST(date_trunc('day', min(enqueued_time)) AS TIMESTAMP) AS ws,
       CAST(date_trunc('day', max(enqueued_time)) AS TIMESTAMP) + INTERVAL 1 DAY AS we FROM feed""",
    ("feed",),
)
register(
    "slots",
    """SELECT s AS interval_start, s + INTERVAL 30 MINUTE AS interval_end, CAST(s AS DATE) AS run_date
FROM (SELECT unnest(generate_series(ws, we - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS s FROM fbounds WHERE we > ws)""",
    ("fbounds",),
)
register(
    "grid",
    f"SELECT run_date, interval_start, interval_end, message_type, brand FROM slots, {_values(TYPES, 'message_type')}, {_values(SPINE, 'brand')}",
    ("slots",),
)


def _fact_sql(src: str) -> str:
    return f"""SELECT g.run_date, g.interval_start, g.interval_end, g.message_type, g.brand,
  CAST(coalesce(a.message_count, 0) AS BIGINT) AS message_count,
  CASE WHEN coalesce(a.message_count, 0) = 0 AND g.brand IN ({_in(BRANDS)}) THEN 1 ELSE 0 END AS is_sla_breach,
  CASE WHEN g.brand = 'OTHER' AND coalesce(a.message_count, 0) > 0 THEN 1 ELSE 0 END AS is_unexpected_brand
FROM grid g LEFT JOIN (
  SELECT time_bucket(INTERVAL 30 MINUTE, enqueued_time) AS interval_start, message_type,
         CASE WHEN brand_raw IN ({_in(BRANDS)}) THEN brand_raw ELSE 'OTHER' END AS brand, count(*) AS message_count
  FROM {src}, fbounds
  WHERE queued_date >= CAST(ws AS DATE) AND queued_date <= CAST(we AS DATE)
    AND enqueued_time >= ws AND enqueued_time < we AND message_type IN ({_in(TYPES)})
  GROUP BY 1, 2, 3) a
ON g.interval_start = a.interval_start AND g.message_type = a.message_type AND g.brand = a.brand"""


register("feed_fact", _fact_sql("feed"), ("grid", "feed"))
register("bronze_fact", _fact_sql("bronze_feed"), ("grid", "bronze_feed", "fbounds"))

_FLOW_PARSED = """SELECT event_id, queued_date,
  CAST(TRY_CAST(json_extract_string(payload, '$.timestamp') AS TIMESTAMP) AS DATE) AS run_date,
  TRY_CAST(json_extract_string(payload, '$.timestamp') AS TIMESTAMP) AS event_ts,
  json_extract_string(payload, '$.interaction.status') AS status,
  json_extract_string(payload, '$.interaction.mqsQuoteId') AS mqs_quote_id,
  json_extract_string(payload, '$.interaction._id') AS interaction_id,
  json_extract_string(payload, '$.interaction.brandName') AS brand_name,
  json_extract_string(payload, '$.interaction.generationCode') AS generation_code,
  CASE WHEN json_extract_string(payload, '$.interaction.brandName') IS NOT NULL
         THEN coalesce(CASE json_extract_string(payload, '$.interaction.brandName') WHEN 'Alpha' THEN 'B1' WHEN 'Beta' THEN 'B2' END, 'OTHER')
       WHEN json_extract_string(payload, '$.interaction.generationCode') IS NOT NULL
         THEN coalesce(CASE json_extract_string(payload, '$.interaction.generationCode') WHEN 'G1' THEN 'B1' WHEN 'G2' THEN 'B2' END, 'OTHER')
       ELSE 'MISSING_INTERACTION_BRAND' END AS brand
FROM flow"""
register("flow_parsed", _FLOW_PARSED, ("flow",))
register(
    "interaction_rows",
    """SELECT f.run_date, time_bucket(INTERVAL 30 MINUTE, f.event_ts) AS interval_start, f.status, f.brand, f.mqs_quote_id
FROM flow_parsed f, fbounds
JOIN (SELECT DISTINCT mqs_quote_id, interaction_id FROM registry, fbounds WHERE CAST(enqueued_time AS DATE) >= CAST(ws AS DATE)) m
  ON f.mqs_quote_id = m.mqs_quote_id AND f.interaction_id = m.interaction_id
WHERE f.queued_date >= CAST(ws AS DATE) AND f.queued_date <= CAST(we AS DATE) AND f.event_ts >= ws AND f.event_ts < we""",
    ("flow_parsed", "registry", "fbounds"),
)
register(
    "interaction_agg",
    """SELECT interval_start, brand, CASE WHEN grouping(status) = 1 THEN 'ALL' ELSE status END AS status, count(mqs_quote_id) AS total_count
FROM interaction_rows GROUP BY GROUPING SETS ((interval_start, brand, status), (interval_start, brand))""",
    ("interaction_rows",),
)
register(
    "interaction_fact",
    f"""SELECT s.run_date, s.interval_start, s.interval_end, st.status, b.brand,
  CAST(coalesce(a.total_count, 0) AS BIGINT) AS total_count,
  CASE WHEN st.status = 'ALL' AND coalesce(a.total_count, 0) = 0 AND b.brand IN ({_in(BRANDS)}) THEN 1 ELSE 0 END AS is_sla_breach,
  CASE WHEN b.brand = 'OTHER' AND coalesce(a.total_count, 0) > 0 THEN 1 ELSE 0 END AS is_unexpected_brand
FROM slots s,
  (SELECT DISTINCT status FROM interaction_rows UNION SELECT 'ALL') st,
  {_values((*SPINE, CFG.missing_brand), 'brand')[:-len(' AS brand_v(brand)')]} AS b(brand)
LEFT JOIN interaction_agg a ON a.interval_start = s.interval_start AND a.status = st.status AND a.brand = b.brand""",
    ("slots", "interaction_rows", "interaction_agg"),
)


# ---------------------------------------------------------------- Spark builders of the facts


@lru_cache(maxsize=8)
def _bounds_cached(key):
    spark, sf = key
    return day_bounds(fx.feed(spark, sf), "enqueued_time")


def bounds(spark, sf):
    return _bounds_cached((spark, sf))


def feed_fact(spark, sf):
    s, e = bounds(spark, sf)
    return M.feed_counts(spark, fx.feed(spark, sf), s, e, CFG)


def bronze_fact(spark, sf):
    s, e = bounds(spark, sf)
    return M.feed_counts(spark, fx.bronze_feed(spark, sf), s, e, CFG)


def interaction_fact(spark, sf):
    s, e = bounds(spark, sf)
    return M.interaction_counts(spark, fx.flow(spark, sf), fx.registry(spark, sf), s, e, CFG)


# ---------------------------------------------------------------- queries


@query("explode_sequence", "SELECT * FROM slots", ("slots",))
def explode_sequence(spark, sf):
    """M1: slot spine over the data range."""
    s, e = bounds(spark, sf)
    return slots(spark, s, e, CFG.minutes)


@query(
    "scalar_time_bucket",
    """SELECT event_id, time_bucket(INTERVAL 30 MINUTE, enqueued_time) AS interval_start,
  time_bucket(INTERVAL 30 MINUTE, enqueued_time) + INTERVAL 30 MINUTE AS interval_end,
  strftime(enqueued_time, '%H:%M') AS event_time, CAST(enqueued_time AS DATE) AS run_date FROM feed""",
    ("feed",),
)
def scalar_time_bucket(spark, sf):
    """M2 and time scalars: slot floor, slot end, HH:mm, date."""
    f = fx.feed(spark, sf)
    start = slot_floor(F.col("enqueued_time"), 30)
    return f.select(
        "event_id",
        start.alias("interval_start"),
        (start + F.expr("INTERVAL 30 MINUTES")).alias("interval_end"),
        F.date_format("enqueued_time", "HH:mm").alias("event_time"),
        F.to_date("enqueued_time").alias("run_date"),
    )


@query("spine_cross", "SELECT * FROM grid", ("grid",))
def spine_cross(spark, sf):
    """Slots x types x brands (generated, no join)."""
    s, e = bounds(spark, sf)
    return spine(slots(spark, s, e, CFG.minutes), {"message_type": TYPES, "brand": SPINE})


@query(
    "agg_count",
    f"""SELECT time_bucket(INTERVAL 30 MINUTE, enqueued_time) AS interval_start, message_type,
  CASE WHEN brand_raw IN ({_in(BRANDS)}) THEN brand_raw ELSE 'OTHER' END AS brand, count(*) AS message_count
FROM feed GROUP BY 1, 2, 3""",
    ("feed",),
)
def agg_count(spark, sf):
    """A1: count per (slot, type, brand bucket) over the whole feed."""
    f = fx.feed(spark, sf)
    return slot_counts(
        f,
        [slot_floor(F.col("enqueued_time")).alias("interval_start"), F.col("message_type"), M.bucket_brand(F.col("brand_raw"), BRANDS).alias("brand")],
    )


@query(
    "spine_zero_fill",
    f"""SELECT g.interval_start, g.message_type, g.brand, CAST(coalesce(a.message_count, 0) AS BIGINT) AS message_count
FROM grid g LEFT JOIN (
  SELECT time_bucket(INTERVAL 30 MINUTE, enqueued_time) AS interval_start, message_type,
         CASE WHEN brand_raw IN ({_in(BRANDS)}) THEN brand_raw ELSE 'OTHER' END AS brand, count(*) AS message_count
  FROM feed GROUP BY 1, 2, 3) a
ON g.interval_start = a.interval_start AND g.message_type = a.message_type AND g.brand = a.brand""",
    ("grid", "feed"),
)
def spine_zero_fill(spark, sf):
    """Counts left-joined onto the spine, missing slots as 0."""
    s, e = bounds(spark, sf)
    grid = spine(slots(spark, s, e, CFG.minutes), {"message_type": TYPES, "brand": SPINE}).select("interval_start", "message_type", "brand")
    return zero_fill(grid, agg_count(spark, sf), ["interval_start", "message_type", "brand"], ["message_count"])


@query("feed_counts", "SELECT * FROM feed_fact", ("feed_fact",))
def feed_counts(spark, sf):
    """M3: the monitoring fact (zero-filled, breach and unexpected-brand flags)."""
    return feed_fact(spark, sf)


@query(
    "feed_counts_no_time",
    "SELECT run_date, interval_start, interval_end, message_type, brand, CAST(0 AS BIGINT) AS message_count, 1 AS is_sla_breach, 0 AS is_unexpected_brand FROM grid",
    ("grid",),
)
def feed_counts_no_time(spark, sf):
    """M4: feed without a time column and without a date column -> every slot is a breach."""
    s, e = bounds(spark, sf)
    return M.feed_counts(spark, fx.feed(spark, sf).drop("enqueued_time", "queued_date"), s, e, CFG)


@query(
    "window_filter",
    """SELECT event_id, enqueued_time, message_type, brand_raw FROM feed
WHERE queued_date >= DATE '2024-01-10' AND queued_date <= DATE '2024-01-12'
  AND enqueued_time >= TIMESTAMP '2024-01-10 00:00:00' AND enqueued_time < TIMESTAMP '2024-01-12 00:00:00'""",
    ("feed",),
)
def window_filter(spark, sf):
    """P5/M5: half-open window with date-partition pruning; both predicates reach the scan."""
    f = fx.feed(spark, sf)
    return M.prune(f, F.col("enqueued_time"), "2024-01-10 00:00:00", "2024-01-12 00:00:00", "queued_date").select(
        "event_id", "enqueued_time", "message_type", "brand_raw"
    )


@query(
    "window_filter_closed",
    "SELECT * FROM src_orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00'",
    ("src_orders",),
)
def window_filter_closed(spark, sf):
    """Closed BETWEEN range."""
    o = fx.src_orders(spark, sf)
    return o.where(F.col("o_orderdate").between(ts_lit("1996-01-01 00:00:00"), ts_lit("1996-12-31 00:00:00")))


@query("brand_resolve", "SELECT event_id, brand_name, generation_code, brand FROM flow_parsed", ("flow_parsed",))
def brand_resolve(spark, sf):
    """Brand by name map, then code map, else OTHER / MISSING."""
    return M.parse_flow(fx.flow(spark, sf), CFG).select("event_id", "brand_name", "generation_code", "brand")


@query("scalar_json", "SELECT event_id, run_date, event_ts, status, mqs_quote_id, interaction_id FROM flow_parsed", ("flow_parsed",))
def scalar_json(spark, sf):
    """JSON paths out of the payload, tolerant timestamp parse."""
    return M.parse_flow(fx.flow(spark, sf), CFG).select("event_id", "run_date", "event_ts", "status", "mqs_quote_id", "interaction_id")


@query("interaction_join", "SELECT * FROM interaction_rows", ("interaction_rows",))
def interaction_join(spark, sf):
    """Flow x de-duplicated registry on (quote id, interaction id)."""
    s, e = bounds(spark, sf)
    return M.interaction_rows(fx.flow(spark, sf), fx.registry(spark, sf), s, e, CFG)


@query("agg_with_total", "SELECT * FROM interaction_agg", ("interaction_agg",))
def agg_with_total(spark, sf):
    """A2: per-status counts plus the ALL row, one pass with grouping sets."""
    rows = interaction_join(spark, sf)
    return counts_with_total(rows, ["interval_start", "brand", "status"], "status", "ALL", "mqs_quote_id", "total_count")


@query("interaction_counts", "SELECT * FROM interaction_fact", ("interaction_fact",))
def interaction_counts(spark, sf):
    """M7: interaction status fact with dynamic status spine and ALL-row breaches."""
    return interaction_fact(spark, sf)


_UPSERT_KEYS = ["run_date", "interval_start", "interval_end", "message_type", "brand"]


@query(
    "monitor_upsert",
    """WITH tgt AS (SELECT * FROM bronze_fact, fbounds WHERE interval_start < ws + INTERVAL 20 DAY),
bat AS (SELECT * FROM feed_fact, fbounds WHERE interval_start >= ws + INTERVAL 15 DAY)
SELECT run_date, interval_start, interval_end, message_type, brand, message_count, is_sla_breach, is_unexpected_brand FROM tgt t
WHERE NOT EXISTS (SELECT 1 FROM bat b WHERE b.run_date = t.run_date AND b.interval_start = t.interval_start
                  AND b.interval_end = t.interval_end AND b.message_type = t.message_type AND b.brand = t.brand)
UNION ALL
SELECT run_date, interval_start, interval_end, message_type, brand, message_count, is_sla_breach, is_unexpected_brand FROM bat""",
    ("bronze_fact", "feed_fact", "fbounds"),
)
def monitor_upsert(spark, sf):
    """K5/M9/Q-19: an earlier (lossy) fact upserted with a later recomputed batch."""
    import datetime as dt

    s, e = bounds(spark, sf)
    mid_t, mid_b = s + dt.timedelta(days=20), s + dt.timedelta(days=15)
    target = bronze_fact(spark, sf).where(F.col("interval_start") < ts_lit(mid_t))
    batch = feed_fact(spark, sf).where(F.col("interval_start") >= ts_lit(mid_b))
    return M.merge_rows(target, batch, _UPSERT_KEYS)


@query(
    "monitor_retention",
    "SELECT f.* EXCLUDE (ws, we) FROM (SELECT * FROM feed_fact, fbounds) f WHERE run_date >= CAST(we AS DATE) - INTERVAL 1 DAY - INTERVAL 2 DAY",
    ("feed_fact", "fbounds"),
)
def monitor_retention(spark, sf):
    """K6: keep the last ``retention_days`` days before 'today' (the last day of data)."""
    import datetime as dt

    s, e = bounds(spark, sf)
    today = (e - dt.timedelta(days=1)).date()
    return M.drop_older(feed_fact(spark, sf), "run_date", today, CFG.retention_days)


@query(
    "cycle_window",
    """SELECT CAST(enqueued_time - INTERVAL 3 HOUR AS DATE) AS cycle_date, count(*) AS row_count,
  min(enqueued_time) AS first_ts, max(enqueued_time) AS last_ts
FROM feed GROUP BY 1""",
    ("feed",),
)
def cycle_window(spark, sf):
    """R3 data form: rows per completed 03:00-to-03:00 business cycle."""
    from tidemark.operators.recon import business_cycle

    f = fx.feed(spark, sf)
    return f.groupBy(business_cycle(F.col("enqueued_time"), 3).alias("cycle_date")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("enqueued_time").alias("first_ts"), F.max("enqueued_time").alias("last_ts")
    )


@query("latest_run", "SELECT * FROM run_results WHERE run_id = (SELECT max(run_id) FROM run_results)", ("run_results",))
def latest_run(spark, sf):
    """Rows of the latest run."""
    return latest_run_op(fx.run_results(spark, sf), "run_id")


@query(
    "agg_count_distinct",
    """SELECT interval_end, brand, count(DISTINCT message_type) AS total_types,
  count(DISTINCT CASE WHEN is_sla_breach = 1 THEN message_type END) AS breached_types,
  CAST(sum(message_count) AS BIGINT) AS total_count
FROM feed_fact GROUP BY interval_end, brand""",
    ("feed_fact",),
)
def agg_count_distinct(spark, sf):
    """A3: count(distinct) and conditional count(distinct) per slot and brand."""
    f = feed_fact(spark, sf)
    return f.groupBy("interval_end", "brand").agg(
        F.countDistinct("message_type").alias("total_types"),
        F.countDistinct(F.when(F.col("is_sla_breach") == 1, F.col("message_type"))).alias("breached_types"),
        F.sum("message_count").cast("long").alias("total_count"),
    )
