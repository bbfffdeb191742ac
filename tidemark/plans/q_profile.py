"""Profiling and EDA queries (A6-A18, Q-1...Q-4, U5, Q-22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggs as A
from tidemark.operators.quality import outcome
from tidemark.operators.setops import dedup_rows as dedup_op
from tidemark.plans import sqlgen as G
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_NUM = LINEITEM[:8]


def _profile_sql(table: str, cols, numeric, extra_select: str = "") -> str:
    aggs = ["count(*) AS r"]
    for i, c in enumerate(cols):
        aggs.append(f"count(CASE WHEN {c} IS NULL THEN 1 END) AS n{i}")
        aggs.append(f"count(DISTINCT {c}) AS d{i}")
        if c in numeric:
            aggs.append(f"avg(CAST({c} AS DOUBLE)) AS m{i}")
            aggs.append(f"stddev_samp(CAST({c} AS DOUBLE)) AS s{i}")
    parts = []
    for i, c in enumerate(cols):
        m = f"round(m{i}, 4)" if c in numeric else "CAST(NULL AS DOUBLE)"
        sd = f"round(s{i}, 4)" if c in numeric else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {extra_select}'{c}' AS column_name, r AS row_count, n{i} AS null_count, d{i} AS distinct_count, "
            f"{G.pct_round(f'n{i}', 'r', 2)} AS null_pct, {G.pct_round(f'r - n{i}', 'r', 2)} AS density_pct, "
            f"{G.pct_round(f'd{i}', 'r', 2)} AS distinct_pct, {m} AS mean, {sd} AS stddev FROM a_{table}"
        )
    return f"a_{table} AS (SELECT {', '.join(aggs)} FROM {table})", "\nUNION ALL\n".join(parts)


_cte, _body = _profile_sql("lineitem", LINEITEM, set(LI_NUM))


@query("profile_columns", f"WITH {_cte}\n{_body}")
def profile_columns(spark, sf):
    """Q-1/A6/A8-A10: column profile of a whole table in one aggregate."""
    return A.profile(fx.load(spark, sf, "lineitem"))


_PD_TABLES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}
_pd_ctes, _pd_bodies = [], []
for _t, _cols in _PD_TABLES.items():
    c, b = _profile_sql(_t, _cols, set(), f"'{_t}' AS table_name, ")
    _pd_ctes.append(c)
    _pd_bodies.append(b)
_PD_SQL = f"WITH {', '.join(_pd_ctes)}\nSELECT table_name, column_name, row_count, distinct_count, distinct_pct FROM (\n{chr(10).join(['UNION ALL'] * 0)}" + "\nUNION ALL\n".join(_pd_bodies) + ")"


@query("profile_distinct", _PD_SQL)
def profile_distinct(spark, sf):
    """Q-2/A9: distinct count and distinct share per column for a list of tables, in one grouping."""
    out = A.profile_tables({t: fx.load(spark, sf, t).select(*cols) for t, cols in _PD_TABLES.items()})
    return out.select("table_name", "column_name", "row_count", "distinct_count", "distinct_pct")


_SK = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "profile_sketches",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, TRUE AS close FROM tgt_orders" for c in _SK),
    ("tgt_orders",),
)
def profile_sketches(spark, sf):
    """A9 approximate: sketches by month, merged, against the exact counts (within 5 %)."""
    t = fx.tgt_orders(spark, sf)
    merged = A.merge_sketches(A.distinct_sketches(t.withColumn("month", F.date_trunc("month", "o_orderdate")), _SK, by=["month"]))
    exact = A.profile_tables({"": t.select(*_SK)}).select(F.col("column_name").alias("name"), "distinct_count")
    close = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= 0.05 * F.col("distinct_count")
    return merged.join(exact, F.col("column_name") == F.col("name")).select("column_name", "row_count", "null_count", close.alias("close"))


_TV = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_TV_SQL = (
    "WITH u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM part" for c in _TV)
    + """),
g AS (SELECT column_name, value, count(*) AS value_count FROM u GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value_count DESC, value ASC NULLS FIRST) AS value_rank FROM g"""
)


@query("profile_top_values", _TV_SQL)
def profile_top_values(spark, sf):
    """Q-3/A11: all values of all columns with their frequency, most frequent first."""
    return A.top_values(fx.load(spark, sf, "part"), _TV)


_DESC_SQL = "WITH a AS (SELECT " + ", ".join(
    f"count(CAST({c} AS DOUBLE)) AS c{i}, avg(CAST({c} AS DOUBLE)) AS a{i}, stddev_samp(CAST({c} AS DOUBLE)) AS s{i}, min(CAST({c} AS DOUBLE)) AS l{i}, max(CAST({c} AS DOUBLE)) AS h{i}"
    for i, c in enumerate(LI_NUM)
) + " FROM lineitem)\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, c{i} AS count, round(a{i}, 4) AS mean, round(s{i}, 4) AS stddev, l{i} AS min, h{i} AS max FROM a"
    for i, c in enumerate(LI_NUM)
)


@query("eda_describe", _DESC_SQL)
def eda_describe(spark, sf):
    """Describe (count, mean, stddev, min, max) of every numeric column, typed."""
    return A.describe(fx.load(spark, sf, "lineitem"))


_TGT_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_NULLS_SQL = "WITH a AS (SELECT " + ", ".join(f"count(CASE WHEN {c} IS NULL THEN 1 END) AS n{i}" for i, c in enumerate(_TGT_COLS)) + " FROM tgt_orders)\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, n{i} AS null_count FROM a" for i, c in enumerate(_TGT_COLS)
)


@query("eda_nulls", _NULLS_SQL, ("tgt_orders",))
def eda_nulls(spark, sf):
    """NULL count per column."""
    return A.null_counts(fx.tgt_orders(spark, sf))


_CORR = LI_NUM
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]
_CORR_SQL = "WITH a AS (SELECT " + ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r{i}" for i, (a, b) in enumerate(_PAIRS)) + " FROM lineitem)\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(r{i}, 6) AS correlation FROM a" for i, (a, b) in enumerate(_PAIRS)
)


@query("eda_correlation", _CORR_SQL)
def eda_correlation(spark, sf):
    """Pearson correlation of every numeric pair in one aggregate."""
    return A.correlation(fx.load(spark, sf, "lineitem"))


@query(
    "eda_histogram",
    """WITH b AS (SELECT min(CAST(l_extendedprice AS DOUBLE)) AS lo, max(CAST(l_extendedprice AS DOUBLE)) AS hi FROM lineitem),
x AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem WHERE l_extendedprice IS NOT NULL)
SELECT CAST(least(10, floor((x - lo) / (hi - lo) * 10) + 1) AS INTEGER) AS bucket, count(*) AS bucket_count,
       min(x) AS bucket_min, max(x) AS bucket_max
FROM x, b GROUP BY 1""",
)
def eda_histogram(spark, sf):
    """Ten equal-width buckets of extended price."""
    return A.histogram(fx.load(spark, sf, "lineitem"), "l_extendedprice", 10)


_Q = LI_NUM
_Q_SQL = "WITH a AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS q{i}" for i, c in enumerate(_Q)) + " FROM lineitem)\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, round(q{i}[1], 4) AS q1, round(q{i}[2], 4) AS median, round(q{i}[3], 4) AS q3 FROM a" for i, c in enumerate(_Q)
)


@query("eda_quartiles", _Q_SQL)
def eda_quartiles(spark, sf):
    """Exact quartiles (box-plot numbers)."""
    return A.quartiles(fx.load(spark, sf, "lineitem"), _Q)


@query("eda_categories", "SELECT l_returnflag, l_linestatus, count(*) AS row_count FROM lineitem GROUP BY 1, 2")
def eda_categories(spark, sf):
    """Category frequencies."""
    return fx.load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "result_summary",
    f"""SELECT status, row_count, table_count, {G.pct_round('row_count', 'sum(row_count) OVER ()', 2)} AS pct
FROM (SELECT status, count(*) AS row_count, count(DISTINCT table_name) AS table_count FROM run_results GROUP BY status)""",
    ("run_results",),
)
def result_summary(spark, sf):
    """Results per status with share and distinct tables."""
    return A.result_summary(fx.run_results(spark, sf), "status", "table_name")


@query(
    "duplicate_count",
    """SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
  count(CASE WHEN n > 1 THEN 1 END) AS duplicated_keys
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
)
def duplicate_count(spark, sf):
    """Rows minus distinct keys, in one grouped pass."""
    return A.duplicate_count(fx.load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_LI_REST = [c for c in LINEITEM if c not in ("l_orderkey", "l_linenumber")]


@query(
    "dedup_rows",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"m.{c} AS {c}" for c in _LI_REST)
    + " FROM (SELECT l_orderkey, l_linenumber, min(struct_pack("
    + ", ".join(f"{c} := {c}" for c in _LI_REST)
    + ")) AS m FROM lineitem GROUP BY 1, 2)",
)
def dedup_rows(spark, sf):
    """One deterministic row per key (smallest remaining row), aggregated map-side."""
    return dedup_op(fx.load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "outcome_map",
    """SELECT run_id, table_name, status,
  CASE WHEN lower(status) = 'pass' THEN 'Passed' ELSE 'Failed' END AS outcome_binary,
  CASE WHEN lower(status) = 'pass' THEN 'Passed' WHEN lower(status) = 'fail' THEN 'Failed' ELSE 'NotExecuted' END AS outcome_three_way,
  (CASE WHEN lower(status) = 'pass' THEN 'Passed' WHEN lower(status) = 'fail' THEN 'Failed' ELSE 'NotExecuted' END) = 'Failed' AS defect_required
FROM run_results""",
    ("run_results",),
)
def outcome_map(spark, sf):
    """Q-22: both outcome mappings and the defect selection."""
    r = fx.run_results(spark, sf)
    three = outcome(F.col("status"), "three_way")
    return r.select(
        "run_id", "table_name", "status",
        outcome(F.col("status"), "binary").alias("outcome_binary"),
        three.alias("outcome_three_way"),
        (three == "Failed").alias("defect_required"),
    )
