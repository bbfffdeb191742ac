
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.timefn import slots
from tidemark.operators import monitor as M
from tidemark.operators import recon as R
from tidemark.operators import windows as W
from tidemark.sources.readers import literal_rows

FLAGS = [1, 1, 0, 1, 1, 1, 0, 0, 1]


def _series(spark):
    rows = [("a", i, f) for i, f in enumerate(FLAGS)]
    return spark.createDataFrame(rows, "k string, interval_end int, f int")


def _col(df, name):
    return [r[name] for r in df.orderBy("interval_end").collect()]


def test_streak_reference_form_keeps_recovery_quirk(spark):
    # The first healthy row after a run still shows the run length.
    out = W.streak_reference(_series(spark), ["k"], ["interval_end"], F.col("f") == 1, "s")
    assert _col(out, "s") == [1, 2, 2, 1, 2, 3, 3, 0, 1]


def test_streak_rownum_form_is_null_before_first_healthy_row(spark):
    # No COALESCE, a run from the first row gives NULL.
    out = W.streak_rownum(_series(spark), ["k"], ["interval_end"], F.col("f") == 1, "s")
    assert _col(out, "s") == [None, None, 0, 1, 2, 3, 0, 0, 1]


def test_breach_streak_corrected(spark):
    out = W.breach_streak(_series(spark), ["k"], ["interval_end"], F.col("f") == 1, "s")
    assert _col(out, "s") == [1, 2, 0, 1, 2, 3, 0, 0, 1]


def counts(spark, s, t, schema="id long, v string", cols=("v",)):
    return R.KeyedCompare(spark.createDataFrame(s, schema), spark.createDataFrame(t, schema), "id", list(cols)).counts().first()


def test_null_and_duplicate_keys(spark):
    # NULL keys never match (counted on both sides); a key's rows are matched one to one, the surplus has no partner.
    r = counts(spark, [(1, "x"), (2, "y"), (2, "y"), (None, "n")], [(2, "y"), (3, "z"), (None, "n")])
    assert (r.source_row_count, r.target_row_count, r.rows_only_in_source, r.rows_only_in_target) == (4, 3, 3, 2)
    assert r.matched_row_count == 1 and r.duplicate_keys == 1 and r.mismatched_rows == 0


def test_surplus_and_pairs_of_repeated_keys(spark):
    r = counts(spark, [(1, "a"), (1, "b"), (2, "x")], [(1, "a"), (1, "b"), (1, "c"), (2, "x")])
    assert (r.matched_row_count, r.rows_only_in_source, r.rows_only_in_target, r.mismatched_rows) == (3, 0, 1, 0)
    r = counts(spark, [(1, "a"), (1, "b")], [(1, "ZZZ"), (1, "YYY")])
    assert (r.matched_row_count, r.mismatched_rows) == (2, 2)


def multiset_pairs(s, t):
    """Brute force: equal rows cancel, the rest of a key is sorted by digest and paired, within digests that begin alike first."""
    import hashlib
    from collections import Counter

    digest = lambda row: hashlib.md5("".join("N;" if v is None else f"{len(str(v))}:{v};" for v in row[1:]).encode()).hexdigest()
    left, right = (Counter(r for r in x if r[0] is not None) for x in (s, t))
    left, right = left - right, right - left
    pairs, rest = [], ([], [])
    for k, run in {(r[0], digest(r)[:2]) for x in (left, right) for r in x}:
        a, b = (sorted((r for r in x.elements() if (r[0], digest(r)[:2]) == (k, run)), key=digest) for x in (left, right))
        n = min(len(a), len(b))
        pairs += zip(a[:n], b[:n], strict=True)
        rest[0].extend(a[n:])
        rest[1].extend(b[n:])
    for k in {r[0] for r in rest[0]}:
        pairs += zip(*[sorted((r for r in x if r[0] == k), key=digest) for x in rest], strict=False)
    return sorted(((str(x[0]), i, x[i], y[i]) for x, y in pairs for i in range(1, len(x)) if x[i] != y[i]), key=str)


def test_mismatches_of_repeated_keys_are_those_of_the_multisets(spark):
    import random

    r = random.Random(3)
    rows = lambda n: [(r.choice([1, 1, 1, 1, 2, 3, None]), r.choice("ABCD") * 3, r.choice([None, "x", "y", "z"])) for _ in range(n)]
    for a, b in ((rows(400), rows(300)), (rows(5), rows(40)), ([], rows(3))):
        both = R.KeyedCompare(*[spark.createDataFrame(x, "id long, v string, w string") for x in (a, b)], "id", ["v", "w"])
        got = sorted(((m.key, {"v": 1, "w": 2}[m.column_name], m.source_value, m.target_value) for m in both.mismatches().collect()), key=str)
        assert got == multiset_pairs(a, b)
        c = both.counts().first()
        n = lambda x, k: sum(y[0] == k for y in x)
        pairs = sum(min(n(a, k), n(b, k)) for k in (1, 2, 3))
        assert (c.matched_row_count, c.rows_only_in_source, c.rows_only_in_target) == (pairs, len(a) - pairs, len(b) - pairs)
        assert c.mismatched_rows == both.unequal_pairs().count()


def test_compare_is_clean_on_itself(spark):
    s = [(i, f"v{i}", float(i)) for i in range(50)]
    r = counts(spark, s, s, "id long, a string, b double", ("a", "b"))
    assert (r.rows_only_in_source, r.rows_only_in_target, r.mismatched_rows, r.matched_row_count) == (0, 0, 0, 50)


def test_swap_mirrors_only_in_counts(spark):
    s, t = [(i, "a") for i in range(0, 30)], [(i, "a") for i in range(20, 45)]
    a, b = counts(spark, s, t), counts(spark, t, s)
    assert (a.rows_only_in_source, a.rows_only_in_target) == (b.rows_only_in_target, b.rows_only_in_source) == (20, 15)


def test_row_hash_is_unambiguous(spark):
    # ("a||b","c") and ("a","b||c") must hash differently.
    s = spark.createDataFrame([("a||b", "c")], "x string, y string")
    t = spark.createDataFrame([("a", "b||c")], "x string, y string")
    r = R.hash_diff(s, t, ["x", "y"]).first()
    assert (r.rows_only_in_source, r.rows_only_in_target) == (1, 1)


def test_replace_chars_in_all_string_columns(spark):
    # regexp_replace based, works on every string column, leaves others alone.
    df = spark.createDataFrame([("a�b", "c�", 1)], "x string, y string, z int")
    r = C.replace_chars(df, {"�": "-"}).first()
    assert (r.x, r.y, r.z) == ("a-b", "c-", 1)


def test_examples_are_ordered_by_key(spark):
    # The first examples per column are the smallest keys, whatever the partitioning.
    m = spark.createDataFrame([(str(k), "c", "a", "b", "VALUE") for k in (5, 3, 9, 1)], "key string, column_name string, source_value string, target_value string, mismatch_type string")
    got = [r.key for r in R.mismatch_examples(m.repartition(3), 2).orderBy("example_rank").collect()]
    assert got == ["1", "3"]


def test_sample_is_deterministic(spark):
    # Hash-bucket sampling does not depend on partitioning.
    s = spark.range(5000).withColumnRenamed("id", "k")
    thr = R.sample_share(500, 5000)
    a = {r.k for r in s.where(R.key_bucket(F.col("k")) < thr).collect()}
    b = {r.k for r in s.repartition(7).where(R.key_bucket(F.col("k")) < thr).collect()}
    assert a == b and 350 < len(a) < 650


def test_sample_size_rule():
    rule = R.SampleRule()
    assert rule.size(15000, 15014) == 3000
    assert rule.size(100, 5000) == 100
    assert rule.size(30_000_000, 30_000_000) == 500_000


def test_ddl_exclusion_case_insensitive_and_null_safe_precision(spark):
    # X9
    from tidemark.operators.schema import ddl_compare

    a = spark.createDataFrame([("t", "c1", "decimal", "10", "2"), ("t", "AZURE_LOAD_DATE", "string", None, None), ("t", "c2", "number", None, None)],
                              "table_name string, column_name string, data_type string, precision string, scale string")
    b = spark.createDataFrame([("t", "c1", "decimal", "10", None), ("t", "c2", "number", None, None)],
                              "table_name string, column_name string, data_type string, precision string, scale string")
    out = {r.source_column_name: r.comparison_result for r in ddl_compare(a, b, exclude=["azure_load_date"]).collect()}
    assert out == {"c1": "PRECISION OR SCALE MISMATCH", "c2": "MATCH"}


def test_all_null_result_rows_keep_their_types(spark):
    # An explicit schema even when every value is NULL.
    df = literal_rows(spark, [("t", None, None)], "name string, n long, note string")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "bigint", "string"]
    assert df.first().n is None


def test_empty_slot_range(spark):
    # X11: end before start gives an empty spine instead of an error.
    assert slots(spark, "2024-01-02 00:00:00", "2024-01-01 00:00:00").count() == 0
    assert slots(spark, "2024-01-01 00:00:00", "2024-01-01 02:00:00").count() == 4


def test_lifecycle_single_spelling(spark):
    # The state written is the state read.
    from tidemark.operators.quality import DELETABLE, DELETED, file_lifecycle

    inv = spark.createDataFrame([("p1", dt.datetime(2024, 1, 1)), ("p2", dt.datetime(2024, 3, 1))], "path string, last_update_date timestamp")
    gone = spark.createDataFrame([("p1",)], "path string")
    out = {r.path: r.del_status for r in file_lifecycle(inv, "2024-03-05 00:00:00", 30, gone).collect()}
    assert out == {"p1": DELETED, "p2": "active"}
    assert DELETABLE == "deletable"


def test_metric_recompute_reports_difference(spark):
    # A reported value that does not follow from its formula is flagged.
    from tidemark.operators.quality import reconcile_metrics

    df = spark.createDataFrame([(112.52, 371.74, 30.56)], "a double, b double, reported double")
    r = reconcile_metrics(df, {"ratio": "a / b * 100"}, {"ratio": "reported"}, 0.05).first()
    assert r.recomputed_value == pytest.approx(30.2685, abs=1e-4) and not r.matches


def test_boolean_recode_modes(spark):
    # Explicit NULL handling; detection is case-sensitive, recoding is not.
    df = spark.createDataFrame([("t",), ("F",), (None,)], "b string")
    assert [r.b for r in C.recode_booleans(df, ["b"], "keep_null").collect()] == [1, 0, None]
    assert [r.b for r in C.recode_booleans(df, ["b"], "null_as_zero").collect()] == [1, 0, 0]
    pats = {r.column_name: r.pattern for r in C.boolean_patterns(df).collect()}
    assert pats == {"b": None}
    pats = {r.column_name: r.pattern for r in C.boolean_patterns(df, case_sensitive=False).collect()}
    assert pats == {"b": "tf"}


def mismatches(left, right, cols):
    return {(r.key, r.column_name): r.mismatch_type for r in R.KeyedCompare(left, right, "id", cols).mismatches().collect()}


def test_decimal_text_is_format_not_value(spark):
    # 1.50 vs 1.5 and case/whitespace are FORMAT differences of texts.
    s = spark.createDataFrame([(1, "1.50", "Active"), (2, "2.0", "x")], "id long, a string, b string")
    t = spark.createDataFrame([(1, "1.5", " active "), (2, "3.0", "x")], "id long, a string, b string")
    assert mismatches(s, t, ["a", "b"]) == {("1", "a"): "FORMAT", ("1", "b"): "FORMAT", ("2", "a"): "VALUE"}


@pytest.mark.parametrize(
    ("left", "right", "equal", "other"),
    [
        ("CAST(10000000 AS DOUBLE)", "CAST(10000000 AS DECIMAL(12, 2))", True, "CAST(10000000.01 AS DECIMAL(12, 2))"),
        ("CAST(1.50 AS DECIMAL(10, 2))", "CAST(1.5 AS DECIMAL(20, 1))", True, "CAST(1.6 AS DECIMAL(20, 1))"),
        ("CAST(7 AS INT)", "CAST(7 AS BIGINT)", True, "CAST(8 AS BIGINT)"),
        ("CAST(7 AS BIGINT)", "CAST(7.00 AS DECIMAL(10, 2))", True, "CAST(7.01 AS DECIMAL(10, 2))"),
        ("CAST(0.1 AS FLOAT)", "CAST(0.1 AS DOUBLE)", True, "CAST(0.1000001 AS DOUBLE)"),
        ("CAST('-0.0' AS DOUBLE)", "CAST(0 AS DECIMAL(3, 1))", True, "CAST(0.1 AS DECIMAL(3, 1))"),
        ("CAST('12345678901234567890123456789012345678' AS DECIMAL(38, 0))", "CAST('12345678901234567890123456789012345678' AS DECIMAL(38, 0))", True, "CAST('12345678901234567890123456789012345679' AS DECIMAL(38, 0))"),
        ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DECIMAL(10, 2))", True, "CAST(0 AS DECIMAL(10, 2))"),
        ("'123.50'", "CAST(123.5 AS DECIMAL(10, 1))", False, "CAST(123.4 AS DECIMAL(10, 1))"),
        ("'1e7'", "CAST(10000000 AS DOUBLE)", False, "CAST(10000001 AS DOUBLE)"),
        ("' 2 '", "CAST(2 AS INT)", False, "CAST(3 AS INT)"),
    ],
)
def test_numbers_of_other_types(spark, left, right, equal, other):
    # Numeric pairs by value; a number beside a text that reads as it differs in format alone.
    a, b, c = (spark.range(1).selectExpr("id", f"{x} AS v") for x in (left, right, other))
    assert mismatches(a, b, ["v"]) == ({} if equal else {("0", "v"): "FORMAT"})
    assert mismatches(b, a, ["v"]) == ({} if equal else {("0", "v"): "FORMAT"})
    assert mismatches(a, c, ["v"]) == {("0", "v"): "VALUE"}


def test_keys_of_other_types_meet(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(1.0, "x"), (2.0, "z")], "ID double, v string")
    r = R.KeyedCompare(a, b, "id", ["v"]).counts().first()
    assert (r.matched_row_count, r.mismatched_rows, r.rows_only_in_source) == (2, 1, 0)


def cycle_pair(spark):
    s = [(1, "a", "2024-05-09 10:00:00"), (2, "b", "2024-05-10 02:59:59"), (3, "c", "2024-05-08 00:00:00"), (4, "d", "2024-05-09 03:00:00"), (6, "f", "2024-05-10 03:00:00"), (7, "g", None)]
    t = [(1, "a", "2024-05-09 10:00:00"), (2, "B", "2024-05-10 03:00:00"), (3, "C", "2024-05-08 00:00:00"), (5, "e", "2024-05-09 12:00:00"), (6, "f", "2024-05-10 02:00:00"), (7, "h", "2024-05-09 05:00:00")]
    schema = "id long, v string, UpdateTime string"
    return [spark.createDataFrame(x, schema).withColumn("UpdateTime", F.col("UpdateTime").cast("timestamp_ntz")) for x in (s, t)]


def test_cycle_looks_up_keys_that_straddle_it(spark):
    from tidemark.operators import recon_run as RR

    # In the cycle: 1, 2, 4 in the source; 1, 5, 6, 7 in the target. 2, 6 and 7 are on the other side too, but outside.
    cfg = R.ReconConfig(cycle=R.Cycle(cutoff_hour=3))
    run = RR.Run("r", dt.datetime(2024, 5, 10, 4))
    r = RR.reconcile_many(spark, [RR.PairSpec("s", "t", *cycle_pair(spark))], cfg, run).first()
    assert (r.filter_applied, r.filter_column, r.filter_start, r.filter_end) == (True, "updatetime", "2024-05-09 03:00:00", "2024-05-10 03:00:00")
    assert (r.source_row_count, r.target_row_count, r.matched_row_count, r.rows_only_in_source, r.rows_only_in_target, r.straddling_keys) == (3, 4, 4, 1, 1, 3)
    assert r.value_mismatch_columns == "UpdateTime, v" and "updatetime from 2024-05-09 03:00:00 to 2024-05-10 03:00:00" in r.comments
    whole = RR.reconcile_many(spark, [RR.PairSpec("s", "t", *cycle_pair(spark))], R.ReconConfig(), run).first()
    assert (whole.filter_applied, whole.source_row_count, whole.straddling_keys) == (False, 6, 0) and whole.comments.startswith("whole tables")


def test_cycle_filter_reaches_the_scan(spark):
    from tidemark.sinks import stage_path

    paths = [stage_path(spark, "cycle") for _ in range(2)]
    for frame, path in zip(cycle_pair(spark), paths, strict=True):
        frame.write.parquet(path)
    both = R.KeyedCompare(*[spark.read.parquet(x) for x in paths], "id", ["v"], window=("updatetime", "2024-05-09 03:00:00", "2024-05-10 03:00:00"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = both.counts()._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("GreaterThanOrEqual(UpdateTime,2024-05-09T03:00") >= 2 and plan.count("LessThan(UpdateTime,2024-05-10T03:00") >= 2


def test_bad_json_timestamp_is_null(spark):
    # X19
    df = spark.createDataFrame([(1, '{"timestamp":"not a time","interaction":{"status":"S"}}')], "event_id long, payload string")
    r = M.parse_flow(df).first()
    assert r.event_ts is None and r.status == "S"


def test_outcome_modes(spark):
    # X22
    from tidemark.operators.quality import outcome

    df = spark.createDataFrame([("pass",), ("fail",), ("blocked",)], "s string")
    got = df.select(outcome(F.col("s"), "binary").alias("b"), outcome(F.col("s"), "three_way").alias("t")).collect()
    assert [(r.b, r.t) for r in got] == [("Passed", "Passed"), ("Failed", "Failed"), ("Failed", "NotExecuted")]


@pytest.mark.parametrize(
    ("now", "expected"),
    [
        (dt.datetime(2024, 5, 10, 3, 15), ("2024-05-09 03:00:00", "2024-05-10 03:00:00")),
        (dt.datetime(2024, 5, 10, 2, 59), ("2024-05-08 03:00:00", "2024-05-09 03:00:00")),
        (dt.datetime(2024, 3, 31, 4, 0), ("2024-03-30 03:00:00", "2024-03-31 03:00:00")),  # DST change in London
        (dt.datetime(2024, 6, 1, 2, 30, tzinfo=dt.timezone.utc), ("2024-05-31 03:00:00", "2024-06-01 03:00:00")),  # 03:30 there
    ],
)
def test_cycle_bounds(now, expected):
    assert R.Cycle(zone="Europe/London").bounds(now) == expected


def test_given_cycle():
    assert R.Cycle(given=("2024-01-01", "2024-01-02")).bounds(dt.datetime(2024, 1, 1)) == ("2024-01-01", "2024-01-02")


@pytest.mark.parametrize(
    "now,empty,mode,start,end",
    [
        (dt.datetime(2024, 1, 10, 9, 47), True, "BACKFILL", dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 10, 9, 30)),
        (dt.datetime(2024, 1, 10, 0, 10), False, "REPROCESS_YESTERDAY", dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 10)),
        (dt.datetime(2024, 1, 10, 9, 47), False, "INCREMENTAL", dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 10, 9, 30)),
    ],
)
def test_run_bounds(now, empty, mode, start, end):
    assert M.run_bounds(now, empty) == (mode, start, end)


def test_merge_twice_equals_merge_once(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = M.merge_rows(t, b, ["k"])
    twice = M.merge_rows(once, b, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "B"), (3, "C")]


def test_feed_counts_zero_fill_and_flags(spark):
    cfg = M.FeedConfig(expected_types=("x",), expected_brands=("B1",), spine_brands=("B1", "OTHER"))
    ev = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 0, 5), dt.date(2024, 1, 1), "x", "B1"), (dt.datetime(2024, 1, 1, 0, 40), dt.date(2024, 1, 1), "x", "Q")],
        "enqueued_time timestamp_ntz, queued_date date, message_type string, brand_raw string",
    )
    out = M.feed_counts(spark, ev, "2024-01-01 00:00:00", "2024-01-01 01:00:00", cfg)
    got = {(r.interval_start.minute, r.brand): (r.message_count, r.is_sla_breach, r.is_unexpected_brand) for r in out.collect()}
    assert got == {(0, "B1"): (1, 0, 0), (0, "OTHER"): (0, 0, 0), (30, "B1"): (0, 1, 0), (30, "OTHER"): (1, 0, 1)}


def test_chunks_cover_whole_text(spark):
    from tidemark.operators.docs import chunk

    text = "".join(chr(ord("a") + i % 26) for i in range(1234))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "short")], "doc_id long, text string")
    rows = chunk(df, size=500, overlap=50).orderBy("doc_id", "chunk_no").collect()
    d1 = [r for r in rows if r.doc_id == 1]
    rebuilt = d1[0].chunk_text + "".join(r.chunk_text[50:] for r in d1[1:])
    assert rebuilt == text and [r.chunk_start for r in d1] == [1, 451, 901]
    assert [r.chunk_text for r in rows if r.doc_id == 3] == ["short"] and not [r for r in rows if r.doc_id == 2]


def test_field_resolution_and_event_time(spark):
    # Struct field, dotted column, literal; timestamp column else date at midnight.
    nested = spark.createDataFrame([((("quote", "B1")),)], "headers struct<messageType:string, brand:string>")
    flat = spark.createDataFrame([("quote",)], "`headers.messageType` string")
    assert nested.select(C.field_or(nested, "headers", "messageType")).first()[0] == "quote"
    assert flat.select(C.field_or(flat, "headers", "messageType")).first()[0] == "quote"
    assert flat.select(C.field_or(flat, "headers", "brand", "UNKNOWN")).first()[0] == "UNKNOWN"
    d = spark.createDataFrame([(dt.date(2024, 1, 2),)], "eHubQueuedDatestamp date")
    ts, has_date = C.pick_event_time(d, "enqueuedTime", "ehubqueueddatestamp")
    assert has_date and d.select(ts).first()[0] == dt.datetime(2024, 1, 2)


def test_scope_filter_and_routing(spark):
    # D7 (X9: exclusion is case-insensitive) and P9.
    from tidemark.operators.schema import in_scope

    m = spark.createDataFrame(
        [("TRUE", "T_A", "Azure_Load_Date"), ("true", "t_a", "c1"), ("false", "t_b", "c2"), ("true", "t$c", "c3")],
        "in_scope string, table_name string, column_name string",
    )
    got = [(r.table_name, r.column_name) for r in in_scope(m, exclude_columns=["AZURE_LOAD_DATE"]).collect()]
    assert got == [("t_a", "c1")]
    r = spark.createDataFrame([("account",), ("bill",), ("zeta",)], "n string")
    out = [x[0] for x in r.select(C.route_name(F.col("n"), {"a": "pc_", "b": "bc_"})).collect()]
    assert out == ["pc_account", "bc_bill", "zeta"]


def test_csv_tsv_roundtrip_listing_and_sql(spark):
    # S3, K10, S6, S7, R2
    from tidemark import sinks
    from tidemark.sources import readers as S

    path = sinks.stage_path(spark, "tsv")
    df = spark.createDataFrame([("t1", "c1", "YES"), ("t2", "c2", "NO")], "table_name string, column_name string, is_nullable string")
    sinks.export_tsv(df, path)
    back = spark.read.option("header", True).option("sep", "\t").csv(path)
    assert sorted(map(tuple, back.collect())) == [("t1", "c1", "YES"), ("t2", "c2", "NO")]
    assert S.read_csv(spark, path, "x string").count() == 2
    df.createOrReplaceTempView("tm_meta")
    assert S.run_sql(spark, "SELECT count(*) AS n FROM tm_meta WHERE is_nullable = :v", {"v": "YES"}).first().n == 1
    spark.sql("CREATE TABLE IF NOT EXISTS tm_keep (a int) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS tm_skip__apply (a int) USING parquet")
    names = {r.tableName for r in S.list_tables(spark, "default", exclude=["__apply"]).collect()}
    assert "tm_keep" in names and "tm_skip__apply" not in names
    assert R.pick_first(["ID", "PublicID", "x"], ["id", "publicid"]) == "id"
    assert R.pick_first(["x"], ["id"]) is None


def test_quantiles_equal_percentile(spark):
    # A14/Q-17: whatever the distribution and the number of bins: ties, one value, outliers, NULL groups.
    from tidemark.operators.quantiles import exact_quantiles

    rows = [(g, float((i * 37) % 101) if i % 9 else None, float(i % 5)) for g in ("a", None) for i in range(400)] + [("c", 7.0, 1.0)]
    rows += [("d", 1e300 * (-1) ** i / (i + 1), 1e-300 * 2.0**i) for i in range(90)] + [("e", None, float("nan")), ("e", None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    clean = df.withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    want = {(r.g, c, p): r[c][i] for r in clean.groupBy("g").agg(*[F.percentile(c, probs).alias(c) for c in ("x", "y")]).collect() for c in ("x", "y") if r[c] for i, p in enumerate(probs)}
    for bins, rounds in ((3, 1), (16, 3), (2048, 2)):
        out = exact_quantiles(df, ["x", "y"], probs, by=["g"], bins=bins, rounds=rounds)
        got = {(r.g, r.column_name, r.prob): r.quantile for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    assert exact_quantiles(df.where("g = 'nobody'"), ["x"], probs).count() == 0


def jobs_of(spark, build):
    """Number of jobs that building a frame starts."""
    group = f"build-{build.__name__}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")


def test_building_the_status_spine_runs_no_job(spark):
    from tests.conftest import SF_SMALL
    from tidemark.sources import fixtures as fx

    flow, registry = fx.flow(spark, SF_SMALL), fx.registry(spark, SF_SMALL)

    def interactions():
        return M.interaction_counts(spark, flow, registry, "2024-01-01 00:00:00", "2024-01-05 00:00:00")

    assert jobs_of(spark, interactions) == 0
    assert "ALL" in {r.status for r in interactions().select("status").distinct().collect()}


def test_profile_takes_two_exchanges(spark):
    from tidemark.operators import aggs as A

    t = spark.range(100).selectExpr("id", "id % 3 AS m", "CAST(id % 7 AS DOUBLE) AS d", "IF(id % 4 = 0, NULL, CAST(id % 5 AS STRING)) AS s", "CAST(id % 2 AS DECIMAL(5, 1)) AS c", "date_add(DATE '2024-01-01', CAST(id % 6 AS INT)) AS day")
    out = A.profile_tables({"a": t, "b": t.where("id < 50")})
    got = {(r.table_name, r.column_name): (r.row_count, r.null_count, r.distinct_count) for r in out.collect()}
    assert [got["a", c] for c in t.columns] == [(100, 0, 100), (100, 0, 3), (100, 0, 7), (100, 25, 5), (100, 0, 2), (100, 0, 6)]
    assert got["b", "id"] == (50, 0, 50)
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 2


def test_merged_sketches_estimate_the_whole(spark):
    from tidemark.operators import aggs as A

    t = spark.range(20_000).selectExpr("id % 5000 AS k", "id % 10 AS day", "IF(id % 2 = 0, NULL, 'x') AS v")
    got = {r.column_name: r for r in A.merge_sketches(A.distinct_sketches(t, ["k", "v"], by=["day"])).collect()}
    assert abs(got["k"].distinct_estimate - 5000) < 250 and (got["k"].row_count, got["v"].null_count, got["v"].distinct_estimate) == (20_000, 10_000, 1)


def test_isolated_run_turns_a_failing_pair_into_an_error_row(spark):
    # Retry, ERROR row, error-rate gate.
    from tidemark.operators import recon_run as RR

    good = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    bad_src = spark.createDataFrame([(1, "x")], "id long, v string").withColumn("v", F.col("v").cast("int"))  # fails at run time (ANSI)
    specs = [RR.PairSpec("good", "good_tgt", good, good), RR.PairSpec("bad", "bad_tgt", bad_src, good)]
    cfg = R.ReconConfig(key_priority=("id",))
    rows = {r.source_table: r for r in RR.reconcile_many(spark, specs, cfg, isolate=True, max_workers=2).collect()}
    assert rows["good"].overall_status == "PASS" and rows["good"].matched_row_count == 2
    assert (rows["bad"].table_status, rows["bad"].overall_status) == ("ERROR", "ERROR")
    assert "CAST_INVALID_INPUT" in rows["bad"].comments and rows["bad"].duration_seconds >= 0 and rows["good"].duration_seconds > 0
    with pytest.raises(RuntimeError):
        RR.reconcile_many(spark, specs, cfg, isolate=True, max_error_rate=0.25)


def test_recent_rows_with_timestamp_millis_and_no_time_column(spark):
    # Q-5: a timestamp column, an epoch-millis candidate, or the total when neither exists.
    from tidemark.operators.quality import recent_row_count

    ts = spark.createDataFrame([(dt.datetime(2024, 1, 9),), (dt.datetime(2023, 1, 1),)], "updated timestamp_ntz")
    ms = spark.createDataFrame([(1704758400000,), (1672531200000,)], "updatetime long")  # 2024-01-09 and 2023-01-01 UTC
    none = spark.createDataFrame([("a",), ("b",)], "x string")
    got = {r.table_name: (r.time_column, r.recent_rows, r.total_rows) for r in recent_row_count({"ts": ts, "ms": ms, "none": none}, "2024-01-10 00:00:00", 7, ["updatetime"]).collect()}
    assert got == {"ts": ("updated", 1, 2), "ms": ("updatetime", 1, 2), "none": (None, 2, 2)}


def test_catalog_columns(spark):
    # S5 over the catalog: prefix-filtered tables, lower-cased names, one metadata frame.
    from tidemark.sources.readers import catalog_columns

    spark.sql("CREATE TABLE IF NOT EXISTS pc_alpha (ID bigint, Name string) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS zz_other (a int) USING parquet")
    m = catalog_columns(spark, "default", ["pc_"])
    assert sorted((r.table_name, r.column_name, r.data_type, r.ordinal_position) for r in m.collect()) == [("pc_alpha", "id", "bigint", 1), ("pc_alpha", "name", "string", 2)]


def test_rewrite_widens_types_and_compacts(spark):
    # K9: ALTER COLUMN TYPE + OPTIMIZE as one rewrite into a new path.
    from tidemark import sinks

    src = spark.range(100).select(F.col("id").cast("int").alias("k"), (F.col("id") % 3).cast("string").alias("d")).repartition(10)
    out = sinks.stage_path(spark, "rewrite")
    sinks.rewrite_table(src, out, casts={"k": "bigint"}, files=2)
    back = spark.read.parquet(out)
    assert dict(back.dtypes)["k"] == "bigint" and back.count() == 100 and back.rdd.getNumPartitions() <= 2


def test_a_long_partition_is_rewritten_by_many_tasks(spark):
    # a value that most rows have isn't sorted and written by one task.
    from tidemark import sinks

    src = spark.range(0, 40_000, 1, 8).select(F.xxhash64("id").alias("v"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("d"))
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        out = sinks.stage_path(spark, "rewrite")
        sinks.rewrite_table(src, out, files=2, part_col="d")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    back = spark.read.parquet(out).select("v", "d")
    assert back.where("d = 'a'").select(F.input_file_name()).distinct().count() > 2
    assert sorted(back.collect()) == sorted(src.collect())


def test_the_plan_has_all_pairs_in_full(spark, tmp_path):
    # the filtered pair is planned too, and no pair is planned as a sample that nobody asked for.
    from tidemark.plans import q_recon

    orders = spark.range(2000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice", "DATE'2024-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    tables = {"orders": orders, "customer": spark.range(9).toDF("c_custkey"), "part": spark.range(0).toDF("p_partkey"), "supplier": spark.range(3).toDF("s_suppkey")}
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["pair"]: r for r in q_recon.recon_plan(spark, str(tmp_path)).collect()}
    assert {"orders", "orders_filtered", "customer", "supplier", "orders_empty"} <= set(got)
    assert [got[p]["has_filter"] for p in ("orders", "orders_filtered", "orders_empty")] == [False, True, True]
    assert {p: r["comparison_mode"] for p, r in got.items()} == {p: "FULL_HASH" if p == "supplier" else "FULL_KEYED" for p in got}
    assert all(r["sample_size"] is None for r in got.values())
    assert (got["orders_filtered"]["source_row_count"], got["orders_filtered"]["asked_mode"], got["orders_filtered"]["asked_sample_size"]) == (2000, "SAMPLE_KEYED", 1000)
    assert (got["customer"]["asked_sample_size"], got["orders_empty"]["asked_mode"]) == (9, "FULL_KEYED")


def test_quarantine_split(spark):
    # Q-13: valid rows and invalid rows with the failed rule names.
    from tidemark.operators.quality import quarantine

    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "id int, q double")
    valid, invalid = quarantine(df, {"positive": "q > 0", "present": "q IS NOT NULL"})
    assert [r.id for r in valid.collect()] == [1]
    assert sorted((r.id, r.reasons) for r in invalid.collect()) == [(2, "positive"), (3, "positive;present")]


def test_run_level_column_exclusion(spark):
    # Audit columns excluded by the run configuration are neither compared nor reported as mismatches.
    from tidemark.operators import recon_run as RR

    s = spark.createDataFrame([(1, "a", "2024-01-01")], "id long, v string, load_date string")
    t = spark.createDataFrame([(1, "a", "2024-02-02")], "id long, v string, load_date string")
    cfg = R.ReconConfig(key_priority=("id",), excluded_columns=("LOAD_DATE",))
    r = RR.reconcile_many(spark, [RR.PairSpec("t", "t_tgt", s, t)], cfg).first()
    assert (r.overall_status, r.mismatched_columns) == ("PASS", "")


def _pair(spark, s, t):
    from tidemark.operators import recon_run as RR

    src, tgt = (spark.createDataFrame(x, "id int, v string") for x in (s, t))
    return RR.reconcile_many(spark, [RR.PairSpec("s", "t", src, tgt)]).first()


def test_duplicate_keys_are_compared(spark):
    r = _pair(spark, [(1, "a"), (1, "b"), (2, "x")], [(1, "ZZZ"), (1, "YYY"), (2, "x")])
    assert (r.overall_status, r.duplicate_keys, r.value_mismatch_columns, r.matched_row_count) == ("FAIL", 1, "v", 3)
    r = _pair(spark, [(1, "a"), (1, "a"), (2, "x")], [(1, "a"), (2, "x")])
    assert (r.overall_status, r.rows_only_in_source) == ("FAIL", 1)
    assert _pair(spark, [(1, "a"), (1, "b")], [(1, "b"), (1, "a")]).overall_status == "PASS"


def test_differences_of_duplicate_keys_are_told(spark):
    from tidemark.operators import recon_run as RR

    src, tgt, same = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (1, "b"), (2, "x")], [(1, "ZZZ"), (1, "YYY"), (2, "x")], [(1, "b"), (1, "a"), (2, "x")]))
    differ, match = (RR.comments_many(spark, [RR.PairSpec("s", "t", src, t)]).first().comments for t in (tgt, same))
    assert differ.startswith("whole tables; by id, 3 pairs; keys with several rows: 1; v differs in 2 (2 in value, 0 in format; 1: [")
    assert match == "whole tables; by id, 3 pairs; keys with several rows: 1; no difference"
    kinds = [(r.kind, r.rows) for r in RR.findings_many(spark, [RR.PairSpec("s", "t", src, tgt)]).orderBy("position").collect()]
    assert kinds == [("WHOLE_TABLES", None), ("FULL_KEYED", 3), ("REPEATED_KEYS", 1), ("COLUMN", 2)]


def test_all_columns_that_differ_are_told(spark):
    from tidemark.operators import recon_run as RR

    cols = [f"c{i}" for i in range(20)]
    s, t = (spark.range(5).select("id", *[(F.col("id") + d).cast("string").alias(c) for c in cols]) for d in (0, 1))
    r = RR.reconcile_many(spark, [RR.PairSpec("s", "t", s, t)]).first()
    assert r.mismatched_column_count == 20 and all(f"{c} differs in 5" in r.comments for c in cols)
    assert "c7 differs in 5 (5 in value, 0 in format; 0: [0] / [1], 1: [1] / [2], 2: [2] / [3])" in r.comments


def test_a_pair_that_cannot_be_planned_is_an_error_row(spark):
    from tidemark.operators import recon_run as RR

    good = spark.createDataFrame([(1, "a")], "id long, v string")

    class Broken:
        columns = ["id"]

        @property
        def schema(self):
            raise RuntimeError("no such store")

    rows = {r.source_table: r for r in RR.reconcile_many(spark, [RR.PairSpec("good", "t", good, good), RR.PairSpec("bad", "t", Broken(), good)]).collect()}
    assert rows["good"].overall_status == "PASS" and (rows["bad"].overall_status, rows["bad"].comments) == ("ERROR", "RuntimeError: no such store")
    assert RR.reconcile_many(spark, []).count() == 0


def test_no_size_is_sampled(spark):
    from tidemark.operators import recon as R, recon_run as RR

    src = spark.range(20_000).selectExpr("id", "'a' AS v")
    for tgt, status in ((spark.range(25_000).selectExpr("id", "'a' AS v"), "FAIL"), (src.selectExpr("id", "if(id = 77, 'b', v) AS v"), "FAIL"), (src, "PASS")):
        assert RR.reconcile_many(spark, [RR.PairSpec("s", "t", src, tgt)]).first().overall_status == status
    r = RR.reconcile_many(spark, [RR.PairSpec("s", "t", src, src)], R.ReconConfig(sample=R.SampleRule())).first()
    assert (r.comparison_mode, r.data_status, r.overall_status) == ("SAMPLE_KEYED", "SAMPLE_MATCH", "WARN")


def test_null_texts_and_null_keys(spark):
    from tidemark.operators import docs, monitor

    a = spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, "y")], "doc_id int, text string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "y"), (5, None)], "doc_id int, text string")
    assert {(r[0], r[1]) for r in docs.changed(a, b).select("doc_id", "change").collect()} == {(2, "UPDATE"), (3, "DELETE"), (5, "INSERT")}
    t = spark.createDataFrame([(None, 1), (1, 1)], "k int, n int")
    assert sorted(monitor.merge_rows(t, spark.createDataFrame([(None, 9)], "k int, n int"), ["k"]).collect(), key=str) == [(1, 1), (None, 9)]


def test_validation_window_holds_for_any_size(spark):
    from tidemark.operators import recon_run as RR

    for n in (100, 3_000, 3_001):
        src, tgt = (spark.range(n).selectExpr("id", "if(id < 10, '2024-01-01', '2024-02-01') AS creationtime", "'u' AS updatetime", v) for v in ("if(id = 5, 'b', 'a') AS v", "if(id >= 10, 'c', 'a') AS v"))
        r = RR.validate_table(spark, "t", src, tgt, window=("2024-01-01", "2024-01-31")).first()
        assert (r.source_count, r.target_full_count, r.target_filter_count, r.source_only_count, r.target_only_count) == (10, n, 10, 1, 1)


def test_equal_tables_are_validated_without_a_shuffle(spark):
    from tidemark.operators import recon_run as RR

    s = spark.range(1000).selectExpr("id", "CAST(id % 7 AS STRING) AS v", "'2024-01-01' AS creationtime", "'u' AS updatetime")
    out = RR.validate_table(spark, "t", s, s.repartition(3))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert (out.first().source_count, out.first().comment, out.first().differing_columns) == (1000, "All checks passed", [])
    swapped = s.withColumn("v", F.expr("CAST((id + 1) % 7 AS STRING)"))
    r = RR.validate_table(spark, "t", s.where("id < 994"), swapped.where("id < 994")).first()
    assert r.differing_columns == [] and r.source_only_count == 994  # each column alone holds the same values


def test_fingerprints_add_up(spark):
    from tidemark.operators.setops import fingerprints, merge_fingerprints, same_fingerprints

    df = spark.range(300).selectExpr("id", "id % 5 AS day", "IF(id % 9 = 0, NULL, CAST(id % 11 AS STRING)) AS v")
    forms = {"v": "v", "id": "CAST(id AS STRING)"}
    key = lambda f: sorted((str(r.column_name), r.row_count, r.h1, r.h2) for r in f.collect())
    assert key(merge_fingerprints(fingerprints(df.repartition(7), forms, by=["day"]))) == key(fingerprints(df, forms))
    other = df.withColumn("v", F.when(F.col("id") == 8, "x").otherwise(F.col("v")))
    assert {r.column_name: r.same for r in same_fingerprints(fingerprints(df, forms), fingerprints(other, forms)).collect()} == {"v": False, "id": True, None: False}
    empty = fingerprints(df.where("id < 0"), forms)
    assert {r.same for r in same_fingerprints(empty, empty).collect()} == {True}
