"""Structured Streaming jobs for the feed monitor.

The reference emulates streaming with scheduled batches; here the same semantics
run as streams:

* T1/T2 ``windowed_counts``, ``upsert_windows``: stateful 30-minute tumbling counts with a
  watermark, in update mode into a table; rows beyond the watermark are left out, and the
  state of slots beyond it is evicted.
* T1/T2/T3/T5 ``upsert_counts``: ``foreachBatch`` writes each micro-batch's slot
  counts as an idempotent increment, recomputes the touched days, zero-fills their
  slots and upserts them into the partitioned fact. A clock stream says which slots are
  over, so silent hours and days get their zero rows although no event comes. Late rows
  of any age are counted, as in the batch job's reprocessing of whole days; a replayed
  batch is applied once.
* T4 ``dedup_stream``: duplicates removed within the watermark.
* T6 ``ingest_files``: new-file incremental ingest with ``availableNow``.

Checkpoints live under the shared ``spark.checkpoint.dir`` so a restarted job
resumes exactly where it stopped.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import spine
from tidemark.operators.monitor import FeedConfig, bucket_brand, breach_flags
from tidemark.session import checkpoint_root
from tidemark.sinks import children, merge_into, remove, stage_path

FACT_KEYS = ["run_date", "interval_start", "interval_end", "message_type", "brand"]


def read_files(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, fmt: str = "parquet", max_files: int | None = None, recursive: bool = False) -> DataFrame:
    """T6 source: new files of a folder, read once each (the file log lives in the checkpoint)."""
    r = spark.readStream.schema(schema).format(fmt)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP: cast a TIMESTAMP_NTZ event time (wall clock kept in UTC sessions)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def dedup_stream(stream: DataFrame, keys: list[str], ts_col: str, delay: str = "1 day") -> DataFrame:
    """T4: drop repeated events (same keys) that arrive within the watermark delay."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, cfg: FeedConfig = FeedConfig(), delay: str = "1 day", watermarked: bool = False) -> DataFrame:
    """Stateful tumbling slot counts per (expected type, brand bucket).

    The types are chosen below the watermark, so that unexpected events don't move it. A row is left out if its
    slot ended at or before the watermark that earlier batches set; its slot's state is evicted by then.
    """
    s = stream.where(F.col(cfg.type_col).isin(list(cfg.expected_types)))
    s = s if watermarked else s.withWatermark(cfg.time_col, delay)
    g = s.groupBy(
        F.window(cfg.time_col, f"{cfg.minutes} minutes").alias("w"),
        F.col(cfg.type_col).alias("message_type"),
        bucket_brand(F.col(cfg.brand_col), cfg.expected_brands, cfg.other_brand).alias("brand"),
    ).agg(F.count(F.lit(1)).alias("message_count"))
    return g.select(
        F.to_date(F.col("w.start")).alias("run_date"),
        F.col("w.start").cast("timestamp_ntz").alias("interval_start"),
        F.col("w.end").cast("timestamp_ntz").alias("interval_end"),
        "message_type",
        "brand",
        "message_count",
    )


def upsert_windows(spark: SparkSession, events: DataFrame, path: str, cfg: FeedConfig = FeedConfig(), delay: str = "1 day", checkpoint: str | None = None, available_now: bool = True):
    """``windowed_counts`` in update mode into the table at ``path``.

    Each batch sends the slots whose count changed, with their whole count, so an upsert by key is
    idempotent. Unlike ``upsert_counts`` this holds aggregation state of the slots within ``delay`` alone and needs
    no store beside the table; rows beyond ``delay`` are left out.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        changed = stage_path(spark, "windows")
        batch.write.parquet(changed)  # the batch is evaluated once
        merge_into(spark, path, spark.read.schema(batch.schema).parquet(changed), FACT_KEYS, "run_date")
        remove(spark, changed)

    return _started(spark, windowed_counts(events, cfg, delay).writeStream.outputMode("update").foreachBatch(upsert), path, checkpoint, available_now)


def _started(spark: SparkSession, writer, path: str, checkpoint: str | None, available_now: bool):
    ck = checkpoint or f"{checkpoint_root(spark)}/stream-{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    writer = writer.option("checkpointLocation", ck)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


# ------------------------------------------------------------------ zero-filled fact with a clock (T5)

INCREMENT = T.StructType(
    [
        T.StructField("run_date", T.DateType()),
        T.StructField("interval_start", T.TimestampNTZType()),
        T.StructField("message_type", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("tick", T.BooleanType()),
        T.StructField("message_count", T.LongType()),
    ]
)
COVERAGE = "lo timestamp_ntz, hi timestamp_ntz"


def rate_clock(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A clock for ``upsert_counts``: wall-clock ticks at a low rate."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("timestamp").alias("clock_time"))


def with_clock(events: DataFrame, clock: DataFrame | None, cfg: FeedConfig = FeedConfig()) -> DataFrame:
    """Events and ticks in one stream: ``(at, message_type, brand, tick)``. A tick says that all slots before its own are over."""
    brand = bucket_brand(F.col(cfg.brand_col), cfg.expected_brands, cfg.other_brand)
    out = events.select(F.col(cfg.time_col).cast("timestamp_ntz").alias("at"), F.col(cfg.type_col).alias("message_type"), brand.alias("brand"), F.lit(False).alias("tick"))
    if clock is None:
        return out
    none = F.lit(None).cast("string")
    return out.unionByName(clock.select(F.col("clock_time").cast("timestamp_ntz").alias("at"), none.alias("message_type"), none.alias("brand"), F.lit(True).alias("tick")))


def increment(rows: DataFrame, cfg: FeedConfig = FeedConfig()) -> DataFrame:
    """Counts of ``with_clock`` rows by slot, expected type and brand; ticks by slot. Rows of other types only say
    that their slot has begun."""
    from tidemark.functions.timefn import slot_floor

    known = F.col("message_type").isin(list(cfg.expected_types))
    g = rows.where(F.col("at").isNotNull()).groupBy(
        slot_floor(F.col("at"), cfg.minutes).alias("interval_start"),
        F.when(known, F.col("message_type")).alias("message_type"),
        F.when(known, F.col("brand")).alias("brand"),
        "tick",
    ).agg(F.count(F.lit(1)).alias("message_count"))
    return g.withColumn("run_date", F.to_date("interval_start")).select(*INCREMENT.fieldNames())


class IncrementStore:
    """The slot counts of every batch beside the fact, from which its days can be made anew.

    ``batch_id=N`` holds the counts of a batch (a replay writes the same), ``coverage/batch_id=N`` the slots known to
    be over by then. Batches before the present one can't be replayed; from ``compact_every`` of them on they are added
    up into ``upto=N`` by day and removed. So a batch reads a bounded number of small tables and the days it touches.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 50):
        self.spark, self.root, self.compact_every = spark, f"{path}__increments", compact_every

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        at = f"{self.root}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(INCREMENT).parquet(at)

    def ids(self, kind: str) -> list[int]:
        """Numbers of the complete tables of a kind (``batch_id``, ``upto``, ``coverage/batch_id``)."""
        folder, _, name = f"{self.root}/{kind}".rpartition("/")
        return sorted(int(x.partition("=")[2]) for x in children(self.spark, folder) if x.startswith(f"{name}=") and "_SUCCESS" in children(self.spark, f"{folder}/{x}"))

    def upto(self, batch_id: int) -> DataFrame:
        """All counts of batches up to this one."""
        base = max((n for n in self.ids("upto") if n < batch_id), default=None)
        later = [f"{self.root}/batch_id={n}" for n in self.ids("batch_id") if n <= batch_id and (base is None or n > base)]
        out = self.spark.read.schema(INCREMENT).parquet(*later)
        if base is None:
            return out
        return out.unionByName(self.spark.read.schema(INCREMENT).parquet(f"{self.root}/upto={base}").select(*INCREMENT.fieldNames()))

    def compact(self, batch_id: int) -> None:
        """Adds up the batches before ``batch_id`` if there are many."""
        before = [n for n in self.ids("batch_id") if n < batch_id]
        if len(before) >= self.compact_every:
            keys = [c for c in INCREMENT.fieldNames() if c != "message_count"]
            added = self.upto(before[-1]).groupBy(*keys).agg(F.sum("message_count").alias("message_count"))
            added.write.mode("overwrite").partitionBy("run_date").parquet(f"{self.root}/upto={before[-1]}")
        done = max((n for n in self.ids("upto") if n < batch_id), default=-1)
        for n in self.ids("batch_id"):
            if n <= done:
                remove(self.spark, f"{self.root}/batch_id={n}")
        for n in self.ids("upto"):
            if n < done:
                remove(self.spark, f"{self.root}/upto={n}")
        for n in self.ids("coverage/batch_id")[:-2]:
            if n < batch_id - 1:
                remove(self.spark, f"{self.root}/coverage/batch_id={n}")

    def covered(self, before: int):
        """``(lo, hi)`` as of the last batch before this one, or None."""
        n = max((n for n in self.ids("coverage/batch_id") if n < before), default=None)
        return None if n is None else tuple(self.spark.read.schema(COVERAGE).parquet(f"{self.root}/coverage/batch_id={n}").first())

    def cover(self, lo, hi, batch_id: int) -> None:
        from tidemark.functions.timefn import ts_lit

        self.spark.range(1).select(ts_lit(lo).alias("lo"), ts_lit(hi).alias("hi")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/coverage/batch_id={batch_id}")


def _apply_increment(spark: SparkSession, batch: DataFrame, batch_id: int, path: str, cfg: FeedConfig, ticks: bool = False, compact_every: int = 50) -> None:
    """One micro-batch of ``with_clock`` rows: keeps its counts, and makes the days anew whose counts changed or whose slots are newly over."""
    from tidemark.functions.timefn import slots

    store = IncrementStore(spark, path, compact_every)
    store.compact(batch_id)
    new = store.write(increment(batch, cfg), batch_id)
    over = F.col("interval_start") if ticks else F.col("interval_start") + F.expr(f"INTERVAL {cfg.minutes} MINUTES")
    said = new.agg(F.date_trunc("day", F.min("interval_start")).cast("timestamp_ntz").alias("lo"), F.max(F.when(F.col("tick") == ticks, over)).alias("hi")).first()
    if said["lo"] is None:
        return
    old = store.covered(batch_id)
    lo = min(x for x in (said["lo"], old and old[0]) if x)
    hi = max((x for x in (said["hi"], old and old[1]) if x), default=None) or lo
    store.cover(lo, hi, batch_id)
    days = {r[0] for r in new.where("NOT tick AND message_type IS NOT NULL").select("run_date").distinct().collect()}  # days that this batch touched
    gone = [(lo, old[0]), (old[1], hi)] if old else [(lo, hi)]
    days |= {a.date() + dt.timedelta(days=i) for a, b in gone if a < b for i in range((b - a).days + 2) if a.date() + dt.timedelta(days=i) <= b.date()}
    if not days:
        return
    held = store.upto(batch_id).where(F.col("run_date").isin(sorted(days)) & ~F.col("tick") & F.col("message_type").isNotNull())
    totals = held.groupBy("run_date", "interval_start", "message_type", "brand").agg(F.sum("message_count").cast("long").alias("message_count"))
    grid = spine(slots(spark, lo, hi, cfg.minutes), {"message_type": cfg.expected_types, "brand": cfg.spine_brands}).where(F.col("run_date").isin(sorted(days)))
    rows = grid.join(totals, ["run_date", "interval_start", "message_type", "brand"], "left").withColumn("message_count", F.coalesce(F.col("message_count"), F.lit(0).cast("long")))
    merge_into(spark, path, rows.select(*FACT_KEYS, "message_count", *breach_flags("message_count", "brand", cfg.expected_brands, cfg.other_brand)), FACT_KEYS, "run_date")


def upsert_counts(
    spark: SparkSession, events: DataFrame, path: str, cfg: FeedConfig = FeedConfig(), checkpoint: str | None = None, available_now: bool = True, clock: DataFrame | None = None, compact_every: int = 50
):
    """Stream feed events into the zero-filled, partitioned slot fact.

    ``clock`` is a second stream (``clock_time``) that ticks whether events come or not (``rate_clock``, or a calendar
    table): every slot from midnight of the first day up to the last tick's slot gets its rows, also where no event
    came at all, and a slot gets none before it is over. Without a clock the last event stands for it.

    Counting is per micro-batch (no aggregation state), so a late row of any age is
    counted into its slot, like the reference's reprocessing of whole days; the fact
    rows of the touched days are recomputed from the increments and upserted. A
    replayed batch (after a failure) overwrites its own increment: exactly once.
    De-duplicate upstream with ``dedup_stream`` (its state is bounded by the watermark).
    """
    w = with_clock(events, clock, cfg).writeStream.foreachBatch(lambda df, bid: _apply_increment(spark, df, bid, path, cfg, clock is not None, compact_every))
    return _started(spark, w, path, checkpoint, available_now)


def ingest_files(spark: SparkSession, folder: str, schema: T.StructType, out_path: str, checkpoint: str, glob: str | None = None, recursive: bool = False):
    """Copy new files into a parquet table exactly once (availableNow trigger)."""
    s = read_files(spark, folder, schema, glob, recursive=recursive)
    return s.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", max_files: int | None = None) -> DataFrame:
    """The driver's ``events`` files as a feed stream (same columns as the batch ``feed`` fixture)."""
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("props", T.StringType()),
        ]
    )
    e = read_files(spark, folder, schema, glob, max_files=max_files)
    u = F.col("user_id") % 4
    f = e.select(
        "event_id",
        F.col("ts").alias("enqueued_time"),
        F.to_date("ts").alias("queued_date"),
        F.col("event_type").alias("message_type"),
        F.when(u.isin(0, 1), "B1").when(u == 2, "B2").when(F.col("event_id") % 2 == 0, "ZZ").alias("brand_raw"),
    )
    return event_time(f, "enqueued_time")
