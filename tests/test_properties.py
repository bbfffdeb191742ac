"""Property tests on generated tables (few examples: each one runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import recon as R
from tidemark.operators.monitor import merge_rows

rows = st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["a", "b", "C", None]), st.integers(-3, 3)), min_size=0, max_size=30, unique_by=lambda r: r[0])
SET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "id long, s string, n long"


@SET
@given(rows)
def test_self_compare_is_clean(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    r = R.KeyedCompare(df, df, "id", ["s", "n"]).counts().first()
    assert (r.rows_only_in_source, r.rows_only_in_target, r.mismatched_rows) == (0, 0, 0)
    h = R.hash_diff(df, df, ["id", "s", "n"]).first()
    assert (h.rows_only_in_source, h.rows_only_in_target) == (0, 0)


@SET
@given(rows, st.sets(st.integers(0, 40), max_size=10))
def test_injected_changes_are_found(spark, data, changed):
    src = spark.createDataFrame(data, SCHEMA)
    tgt = spark.createDataFrame([(i, s, n + 100 if i in changed else n) for i, s, n in data], SCHEMA)
    r = R.KeyedCompare(src, tgt, "id", ["s", "n"]).counts().first()
    assert r.mismatched_rows == len({i for i, _, _ in data} & changed)


@SET
@given(rows, rows)
def test_merge_is_idempotent(spark, a, b):
    t = spark.createDataFrame(a, SCHEMA)
    bt = spark.createDataFrame(b, SCHEMA)
    once = merge_rows(t, bt, ["id"])
    assert sorted(merge_rows(once, bt, ["id"]).collect()) == sorted(once.collect())
    assert once.count() == len({r[0] for r in a} | {r[0] for r in b})
