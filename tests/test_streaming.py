"""Streaming jobs: two file batches, late and duplicate rows, checkpoint restart; sinks."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.monitor import FeedConfig, feed_counts, merge_rows
from tidemark.sinks import merge_into, stage_path
from tidemark.sources import fixtures as fx
from tidemark.streaming import streams as S
from tests.conftest import SF_SMALL

CFG = FeedConfig()


def _write_batches(spark, folder):
    """Batch 1: events except held-back ones (event_id % 11 = 0); batch 2: the held-back
    (late) events plus repeats of event_id % 50 = 0 (duplicates)."""
    e = fx.load(spark, SF_SMALL, "events")
    e.where(F.col("event_id") % 11 != 0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/b1")
    late = e.where(F.col("event_id") % 11 == 0)
    dup = e.where(F.col("event_id") % 50 == 0)
    late.unionByName(dup).coalesce(1).write.mode("overwrite").parquet(f"{folder}/b2")


def _feed_stream(spark, folder, dedup):
    s = spark.readStream.schema(fx.load(spark, SF_SMALL, "events").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    u = F.col("user_id") % 4
    f = s.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("enqueued_time"),
        F.col("event_type").alias("message_type"),
        F.when(u.isin(0, 1), "B1").when(u == 2, "B2").when(F.col("event_id") % 2 == 0, "ZZ").alias("brand_raw"),
    )
    f = f.withWatermark("enqueued_time", "3650 days")
    return f.dropDuplicatesWithinWatermark(["event_id"]) if dedup else f


def test_stream_equals_batch_with_late_and_duplicate_rows(spark):
    folder = stage_path(spark, "src")
    _write_batches(spark, folder)
    out = stage_path(spark, "fact")
    q = S.upsert_counts(spark, _feed_stream(spark, folder, dedup=True), out, CFG, checkpoint=out + "-ck")
    q.awaitTermination()
    got = spark.read.parquet(out).where("message_count > 0")
    feed = fx.feed(spark, SF_SMALL)
    s, e = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)
    want = feed_counts(spark, feed, s, e, CFG).where("message_count > 0")
    cols = ["interval_start", "message_type", "brand", "message_count"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_checkpoint_restart_reads_only_new_files(spark):
    folder = stage_path(spark, "ingest")
    e = fx.load(spark, SF_SMALL, "events")
    e.where("event_id < 500").coalesce(1).write.parquet(f"{folder}/p1")
    out, ck = stage_path(spark, "copy"), stage_path(spark, "ck")
    S.ingest_files(spark, folder, e.schema, out, ck, glob="*.parquet", recursive=True).awaitTermination()
    assert spark.read.parquet(out).count() == 500
    e.where("event_id >= 500").coalesce(1).write.parquet(f"{folder}/p2")
    S.ingest_files(spark, folder, e.schema, out, ck, glob="*.parquet", recursive=True).awaitTermination()
    assert spark.read.parquet(out).count() == e.count()


def test_merge_into_is_idempotent(spark):
    path = stage_path(spark, "merge-target")
    t = spark.createDataFrame([(dt.date(2024, 1, 1), 1, "a"), (dt.date(2024, 1, 2), 2, "b")], "run_date date, k int, v string")
    merge_into(spark, path, t, ["run_date", "k"])
    b = spark.createDataFrame([(dt.date(2024, 1, 2), 2, "B"), (dt.date(2024, 1, 2), 3, "C")], "run_date date, k int, v string")
    merge_into(spark, path, b, ["run_date", "k"])
    once = sorted(spark.read.parquet(path).select("run_date", "k", "v").collect())
    merge_into(spark, path, b, ["run_date", "k"])
    twice = sorted(spark.read.parquet(path).select("run_date", "k", "v").collect())
    assert once == twice == sorted(merge_rows(t, b, ["run_date", "k"]).collect())


def test_publish_upserts_then_applies_retention(spark):
    from tidemark.operators.monitor import publish

    cfg = FeedConfig(retention_days=1)
    path = stage_path(spark, "publish")
    rows = lambda day, n: (dt.date(2024, 1, day), dt.datetime(2024, 1, day), dt.datetime(2024, 1, day, 0, 30), "x", "B1", n, 0, 0)
    schema = "run_date date, interval_start timestamp_ntz, interval_end timestamp_ntz, message_type string, brand string, message_count long, is_sla_breach int, is_unexpected_brand int"
    publish(spark, path, spark.createDataFrame([rows(1, 5), rows(2, 6)], schema), cfg, "2024-01-02")
    publish(spark, path, spark.createDataFrame([rows(2, 7), rows(3, 8)], schema), cfg, "2024-01-03")
    got = sorted((r.run_date.day, r.message_count) for r in spark.read.parquet(path).collect())
    assert got == [(2, 7), (3, 8)]


def test_catalog_sinks(spark):
    from tidemark import sinks

    df = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.replace_results(df, "t_results")
    sinks.append_results(spark.createDataFrame([(2, "b", 1.5)], "k int, v string, extra double"), "t_results")
    assert spark.table("t_results").count() == 2
    sinks.swap_table(spark, spark.table("t_results").where("k = 2"), "t_results")
    assert [r.k for r in spark.table("t_results").collect()] == [2]
    sinks.ensure_partitioned(spark, "t_part", "k int, d string", "d")
    spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-05")], "k int, d string").write.insertInto("t_part")
    assert sinks.drop_older_partitions(spark, "t_part", "d", "2024-01-03") == ["2024-01-01"]
    assert [r.k for r in spark.table("t_part").collect()] == [2]


def test_late_rows_of_any_age_are_counted_once(spark):
    # T2/Q-19: a late batch updates old slots (like reprocessing a day), a replay changes nothing.
    folder = stage_path(spark, "late")
    schema = "event_id long, enqueued_time timestamp_ntz, message_type string, brand_raw string"
    b1 = [(1, dt.datetime(2024, 1, 2, 10, 5), "click", "B1"), (2, dt.datetime(2024, 1, 2, 12, 40), "click", "B1")]
    b2 = [(3, dt.datetime(2024, 1, 2, 12, 10), "click", "B1"), (4, dt.datetime(2024, 1, 2, 10, 20), "click", "B1")]
    spark.createDataFrame(b1, schema).coalesce(1).write.parquet(f"{folder}/b1")
    spark.createDataFrame(b2, schema).coalesce(1).write.parquet(f"{folder}/b2")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    cfg = FeedConfig(expected_types=("click",))
    out = stage_path(spark, "late-fact")
    S.upsert_counts(spark, S.event_time(s, "enqueued_time"), out, cfg, checkpoint=out + "-ck").awaitTermination()
    fact = spark.read.parquet(out).where("brand = 'B1'")
    got = {(r.interval_start.hour, r.interval_start.minute): r.message_count for r in fact.where("message_count > 0").collect()}
    assert got == {(10, 0): 2, (12, 0): 1, (12, 30): 1}
    assert fact.count() == 26  # 00:00 .. 12:30 zero-filled
    # Replaying the last batch (same batch id) leaves the fact unchanged.
    S._apply_increment(spark, S.with_clock(S.event_time(spark.createDataFrame(b2, schema), "enqueued_time"), None, cfg), 1, out, cfg)
    again = {(r.interval_start.hour, r.interval_start.minute): r.message_count for r in spark.read.parquet(out).where("brand = 'B1' AND message_count > 0").collect()}
    assert again == got


EVENTS = "event_id long, enqueued_time timestamp_ntz, message_type string, brand_raw string"
ONE = FeedConfig(expected_types=("click",), spine_brands=("B1",), expected_brands=("B1",))


def at(day: int, hour: int = 0, minute: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, day, hour, minute)


def batch(spark, events=(), ticks=()):
    e = S.event_time(spark.createDataFrame([(i, t, "click", "B1") for i, t in enumerate(events)], EVENTS), "enqueued_time")
    return S.with_clock(e, spark.createDataFrame([(t,) for t in ticks], "clock_time timestamp_ntz"), ONE)


def counts_of(spark, path):
    return {r.interval_start: r.message_count for r in spark.read.parquet(path).collect()}


def test_clock_fills_silent_slots_and_days(spark):
    out = stage_path(spark, "clock-fact")
    S._apply_increment(spark, batch(spark, [at(1, 10, 5), at(1, 10, 40)], [at(1, 10, 10)]), 0, out, ONE, True)
    assert counts_of(spark, out) == {at(1, h, m): 0 for h in range(10) for m in (0, 30)}  # 10:00 isn't over yet
    S._apply_increment(spark, batch(spark, [], [at(1, 10, 59), at(1, 11, 1)]), 1, out, ONE, True)
    assert {k: v for k, v in counts_of(spark, out).items() if k >= at(1, 10)} == {at(1, 10): 1, at(1, 10, 30): 1}
    S._apply_increment(spark, batch(spark, [], [at(4, 0, 5)]), 2, out, ONE, True)  # two and a half days without an event
    got = counts_of(spark, out)
    assert len(got) == 3 * 48 and sum(got.values()) == 2
    S._apply_increment(spark, batch(spark, [at(2, 7, 0)], []), 3, out, ONE, True)  # a late event of a silent day
    S._apply_increment(spark, batch(spark, [], []), 4, out, ONE, True)
    got = counts_of(spark, out)
    assert len(got) == 3 * 48 and got[at(2, 7)] == 1 and sum(got.values()) == 3


def test_compacted_increments_give_the_same_fact(spark):
    from tidemark.sinks import children

    facts = []
    for every in (2, 100):
        out = stage_path(spark, "compact-fact")
        for i in range(7):
            S._apply_increment(spark, batch(spark, [at(1 + i % 3, 3, j) for j in range(i + 1)], [at(1 + i, 12)]), i, out, ONE, True, every)
            if i == 5:  # a replay after a lost commit
                S._apply_increment(spark, batch(spark, [at(1 + i % 3, 3, j) for j in range(i + 1)], [at(1 + i, 12)]), i, out, ONE, True, every)
        facts.append(counts_of(spark, out))
        if every == 2:
            assert len([x for x in children(spark, out + "__increments") if x.startswith("batch_id=")]) <= 3
    assert facts[0] == facts[1] and sum(facts[0].values()) == 28


def test_windows_drop_rows_beyond_the_watermark(spark):
    folder, out = stage_path(spark, "late-src"), stage_path(spark, "late-windows")
    parts = [[at(1, 10, 5), at(3, 12, 10)], [at(1, 10, 6), at(2, 12, 5), at(2, 11, 59), at(3, 12, 20)], [at(3, 12, 25), at(3, 9)]]
    for i, events in enumerate(parts):  # each to a restarted job
        spark.createDataFrame([(10 * i + k, t, "click", "B1") for k, t in enumerate(events)], EVENTS).coalesce(1).write.parquet(f"{folder}/{i}")
        stream = S.event_time(S.read_files(spark, folder, spark.read.parquet(f"{folder}/0").schema, recursive=True), "enqueued_time")
        q = S.upsert_windows(spark, stream, out, ONE, "1 day", checkpoint=out + "-ck")
        q.awaitTermination()
    # Mark after the first part: the 2nd, 12:10, so slots that ended by then are closed; 12:00 of the 2nd is open.
    assert counts_of(spark, out) == {at(1, 10): 1, at(3, 12): 3, at(2, 12): 1, at(3, 9): 1}
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert state[-1] <= 3  # the slots of the 1st are evicted


def test_merge_keeps_text_partitions(spark):
    from tidemark.sinks import children

    path = stage_path(spark, "text-parts")
    for v in ("a", "b"):
        merge_into(spark, path, spark.createDataFrame([("001", 1, v), ("1", 1, v + "1")], "run_date string, k int, v string"), ["run_date", "k"])
    assert [x for x in children(spark, path) if "=" in x] == ["run_date=001", "run_date=1"]
    assert sorted(tuple(r) for r in spark.read.schema("k int, v string, run_date string").parquet(path).collect()) == [(1, "b", "001"), (1, "b1", "1")]


def test_retention_removes_folders_only(spark):
    from tidemark.sinks import children, drop_older_folders

    path = stage_path(spark, "retention")
    spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 2, 3)], "run_date date, k int").write.partitionBy("run_date").parquet(path)
    kept = children(spark, f"{path}/run_date=2024-01-03")
    assert drop_older_folders(spark, path, "run_date", "2024-01-02") == ["run_date=2024-01-01"]
    assert children(spark, f"{path}/run_date=2024-01-03") == kept and spark.read.parquet(path).count() == 2
