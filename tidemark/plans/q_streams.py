"""Streaming queries: the feed monitor run as Structured Streaming jobs.

The builders run their streams to completion (``availableNow``) into a fresh table
folder under the shared checkpoint folder and return that table as a batch frame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.monitor import FACT_COLS, FeedConfig
from tidemark.plans.oracle_fixtures import register
from tidemark.plans.q_monitor import _fact_sql
from tidemark.plans.registry import query
from tidemark.sinks import stage_path
from tidemark.sources import fixtures as fx
from tidemark.streaming import streams as S

CFG = FeedConfig()


def _days_clock(spark, sf):
    """A calendar as a stream: a tick at midnight of every day that the events table knows, and one a day later."""
    day = F.date_trunc("day", "enqueued_time")
    return S.feed_stream(spark, sf).select(F.explode(F.array(day, day + F.expr("INTERVAL 1 DAY"))).alias("clock_time"))


def _streamed(spark, sf, events, clock):
    path = stage_path(spark, "stream-fact")
    S.upsert_counts(spark, S.dedup_stream(events, ["event_id"], "enqueued_time", "1 day"), path, CFG, checkpoint=path + "-ck", clock=clock).awaitTermination()
    return spark.read.parquet(path).select(*FACT_COLS)


@query("stream_feed_counts", "SELECT * FROM feed_fact", ("feed_fact",))
def stream_feed_counts(spark, sf):
    """Feed events streamed (de-duplicated within a 1-day watermark) into the zero-filled, upserted slot
    fact, with a clock stream: the same rows as the batch fact, edges of the days included."""
    return _streamed(spark, sf, S.feed_stream(spark, sf), _days_clock(spark, sf))


_OUTAGE = "day(enqueued_time) % 7 = 3 OR hour(enqueued_time) IN (0, 1, 23)"
register("outage_feed", f"SELECT * FROM feed WHERE NOT ({_OUTAGE})", ("feed",))
register("outage_fact", _fact_sql("outage_feed"), ("grid", "outage_feed"))


@query("stream_outage_counts", "SELECT * FROM outage_fact", ("outage_fact",))
def stream_outage_counts(spark, sf):
    """T5: a feed that is silent on whole days and around midnight: the clock alone writes those slots' zero rows."""
    return _streamed(spark, sf, S.feed_stream(spark, sf).where(f"NOT ({_OUTAGE})"), _days_clock(spark, sf))


@query(
    "stream_window_counts",
    f"""WITH w AS (SELECT date_trunc('millisecond', max(enqueued_time)) - INTERVAL 1 DAY AS mark FROM feed
  WHERE event_id % 11 <> 0 AND message_type IN {CFG.expected_types!r}),
c AS (SELECT time_bucket(INTERVAL 30 MINUTE, enqueued_time) AS interval_start, message_type,
    CASE WHEN brand_raw IN {CFG.expected_brands!r} THEN brand_raw ELSE 'OTHER' END AS brand, event_id
  FROM feed WHERE message_type IN {CFG.expected_types!r})
SELECT CAST(interval_start AS DATE) AS run_date, interval_start, interval_start + INTERVAL 30 MINUTE AS interval_end, message_type, brand, count(*) AS message_count
FROM c, w WHERE event_id % 11 <> 0 OR interval_start + INTERVAL 30 MINUTE > mark
GROUP BY 1, 2, 3, 4, 5""",
    ("feed",),
)
def stream_window_counts(spark, sf):
    """Watermarked window counts in update mode. Every 11th event comes only after all others, to a restarted
    job: of these, the ones beyond the watermark are left out, and the others are added to their slots."""
    path, folder = stage_path(spark, "stream-windows"), stage_path(spark, "stream-arrivals")
    feed = fx.feed(spark, sf).select("event_id", "enqueued_time", "message_type", "brand_raw")
    for i, arrives in enumerate((F.col("event_id") % 11 != 0, F.col("event_id") % 11 == 0)):
        feed.where(arrives).write.parquet(f"{folder}/{i}")
        events = S.event_time(S.read_files(spark, folder, feed.schema, recursive=True), "enqueued_time")
        S.upsert_windows(spark, events, path, CFG, "1 day", checkpoint=path + "-ck").awaitTermination()
    return spark.read.parquet(path).select(*S.FACT_KEYS, "message_count")
