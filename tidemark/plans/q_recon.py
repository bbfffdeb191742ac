"""Reconciliation queries on src_orders x tgt_orders (and friends)."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import recon as R
from tidemark.operators import setops
from tidemark.plans import sqlgen as G
from tidemark.plans.oracle_fixtures import register
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx

KEY = "o_orderkey"
COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ALL_COLS = [KEY, *COLS]
FX = ("src_orders", "tgt_orders")
SIDES = G.multiset_ctes("src_orders", "tgt_orders", KEY, COLS)


def _compare(spark, sf):
    return R.KeyedCompare(fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), KEY, COLS)


@query("recon_full_keyed", f"WITH {SIDES}\n{G.keyed_counts_sql('j')}", FX)
def recon_full_keyed(spark, sf):
    """Full keyed compare, one result row."""
    return _compare(spark, sf).counts()


@query("mismatch_rows", f"WITH {SIDES}\n{G.mismatch_rows_sql('j', COLS)}", FX)
def mismatch_rows(spark, sf):
    """One row per (pair, differing column) with VALUE/FORMAT class."""
    return _compare(spark, sf).mismatches()


def _summary_sql(sides: str) -> str:
    return f"""WITH {sides},
m AS ({G.mismatch_rows_sql('j', COLS)}),
c AS (SELECT column_name, count(*) AS mismatch_count,
             count(CASE WHEN mismatch_type = 'VALUE' THEN 1 END) AS value_mismatch_count,
             count(CASE WHEN mismatch_type = 'FORMAT' THEN 1 END) AS format_mismatch_count
      FROM m GROUP BY column_name)
SELECT *, row_number() OVER (ORDER BY mismatch_count DESC, column_name) AS column_rank FROM c"""


@query("mismatch_columns", _summary_sql(SIDES), FX)
def mismatch_columns(spark, sf):
    """Per-column totals ranked by count (rank 1 = most differing column)."""
    from pyspark.sql import Window

    summary = R.mismatch_summary(_compare(spark, sf).mismatches())
    # The summary has one row per column (bounded by the schema width): a global rank is cheap.
    w = Window.orderBy(F.col("mismatch_count").desc(), F.col("column_name"))
    return summary.withColumn("column_rank", F.row_number().over(w).cast("long"))


_FIRST = "ORDER BY key, source_value NULLS FIRST, target_value NULLS FIRST"


def _examples_sql(sides: str) -> str:
    return f"""WITH {sides},
m AS ({G.mismatch_rows_sql('j', COLS)})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name {_FIRST}) AS example_rank FROM m) WHERE example_rank <= 3"""


@query("mismatch_examples", _examples_sql(SIDES), FX)
def mismatch_examples(spark, sf):
    """First three examples per column, ordered by key."""
    return R.mismatch_examples(_compare(spark, sf).mismatches(), 3)


# ---------------------------------------------------------------------- keys that repeat, unequally often on both sides
register(
    "dup_source",
    """SELECT * FROM src_orders UNION ALL SELECT * FROM src_orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT o_orderkey, o_custkey, 'S' || o_custkey % 3, o_totalprice, o_orderdate, o_orderpriority FROM src_orders WHERE o_orderkey % 26 = 0
UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN 7 END, o_custkey % 50, o_orderstatus, 1.5, NULL, NULL FROM src_orders WHERE o_orderkey % 5 = 0""",
    ("src_orders",),
)
register(
    "dup_target",
    """SELECT * FROM tgt_orders UNION ALL SELECT * FROM tgt_orders WHERE o_orderkey % 17 = 0
UNION ALL SELECT o_orderkey, o_custkey, 'T' || o_custkey % 4, o_totalprice, o_orderdate, o_orderpriority FROM tgt_orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 7 END, o_custkey % 51, lower(o_orderstatus), 1.5, NULL, NULL FROM tgt_orders WHERE o_orderkey % 7 = 0""",
    ("tgt_orders",),
)
DUP = ("dup_source", "dup_target")
DUP_SIDES = G.multiset_ctes("dup_source", "dup_target", KEY, COLS)


def _dup(spark, sf):
    """Both sides with keys that repeat: copies, rows that differ, one key that holds a ninth of a side's rows, NULL keys."""
    k = F.col(KEY)

    def side(df, copies, others, status, parts, hot, cust, when):
        copied = df.where(copies)
        other = df.where(others).withColumn("o_orderstatus", F.concat(F.lit(status), (F.col("o_custkey") % parts).cast("string")))
        flat = df.where(hot).select(
            F.when(when, F.lit(7)).cast("long").alias(KEY), (F.col("o_custkey") % cust).alias("o_custkey"), F.expr("lower(o_orderstatus)" if status == "T" else "o_orderstatus").alias("o_orderstatus"),
            F.lit(1.5).alias("o_totalprice"), F.lit(None).cast("timestamp_ntz").alias("o_orderdate"), F.lit(None).cast("string").alias("o_orderpriority"),
        )
        return df.unionByName(copied).unionByName(other).unionByName(flat)

    return (
        side(fx.src_orders(spark, sf), k % 13 == 0, k % 26 == 0, "S", 3, k % 5 == 0, 50, k % 3 == 0),
        side(fx.tgt_orders(spark, sf), k % 17 == 0, k % 13 == 0, "T", 4, k % 7 == 0, 51, k % 2 == 0),
    )


@query("recon_duplicates_keyed", f"WITH {DUP_SIDES}\n{G.keyed_counts_sql('j')}", DUP)
def recon_duplicates_keyed(spark, sf):
    """R4/J3 where keys repeat: rows of a key are matched one to one, the surplus has no partner."""
    return R.KeyedCompare(*_dup(spark, sf), KEY, COLS).counts()


@query("mismatch_rows_duplicates", f"WITH {DUP_SIDES}\n{G.mismatch_rows_sql('j', COLS)}", DUP)
def mismatch_rows_duplicates(spark, sf):
    """R6 where keys repeat: equal rows cancel, the rest of a key is paired by number."""
    return R.KeyedCompare(*_dup(spark, sf), KEY, COLS).mismatches()


@query("mismatch_examples_duplicates", _examples_sql(DUP_SIDES), DUP)
def mismatch_examples_duplicates(spark, sf):
    """R8 where keys repeat."""
    return R.mismatch_examples(R.KeyedCompare(*_dup(spark, sf), KEY, COLS).mismatches(), 3)


# ---------------------------------------------------------------------- columns whose types differ
register(
    "typed_left",
    """SELECT o_orderkey, CAST(o_custkey AS DECIMAL(20, 2)) AS cust, round(o_totalprice * 1000) AS price, CAST(o_totalprice AS DECIMAL(12, 2)) || CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '' END AS paid,
  CAST(o_custkey AS INTEGER) AS n FROM src_orders""",
    ("src_orders",),
)
register(
    "typed_right",
    """SELECT CAST(o_orderkey AS DECIMAL(20, 0)) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS cust, CAST(round(o_totalprice * 1000) AS DECIMAL(18, 3)) AS price, CAST(o_totalprice AS DECIMAL(14, 4)) AS paid,
  CASE WHEN o_orderkey % 19 = 0 THEN CAST(o_custkey AS VARCHAR) || '.0' ELSE CAST(o_custkey AS VARCHAR) END AS n FROM tgt_orders""",
    ("tgt_orders",),
)


@query(
    "mismatch_types",
    """SELECT CAST(a.o_orderkey AS VARCHAR) AS key, x.column_name, x.mismatch_type FROM typed_left a JOIN typed_right b ON a.o_orderkey = b.o_orderkey,
LATERAL (SELECT 'cust' AS column_name, 'VALUE' AS mismatch_type WHERE CAST(a.cust AS DOUBLE) <> b.cust
  UNION ALL SELECT 'price', 'VALUE' WHERE a.price <> CAST(b.price AS DOUBLE)
  UNION ALL SELECT 'paid', CASE WHEN CAST(a.paid AS DECIMAL(18, 6)) = b.paid THEN 'FORMAT' ELSE 'VALUE' END WHERE a.paid <> CAST(b.paid AS VARCHAR)
  UNION ALL SELECT 'n', CASE WHEN a.n = CAST(b.n AS DECIMAL(18, 6)) THEN 'FORMAT' ELSE 'VALUE' END WHERE CAST(a.n AS VARCHAR) <> b.n) x""",
    ("typed_left", "typed_right"),
)
def mismatch_types(spark, sf):
    """Numeric pairs of other types by value, numbers against texts by value and format; the key's types differ too."""
    s, t = fx.src_orders(spark, sf), fx.tgt_orders(spark, sf)
    left = s.selectExpr(
        KEY, "CAST(o_custkey AS DECIMAL(20, 2)) AS cust", "round(o_totalprice * 1000) AS price",
        "concat(CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS STRING), IF(o_orderkey % 2 = 0, '0', '')) AS paid", "CAST(o_custkey AS INT) AS n",
    )
    right = t.selectExpr(
        "CAST(o_orderkey AS DECIMAL(20, 0)) AS o_orderkey", "CAST(o_custkey AS DOUBLE) AS cust", "CAST(round(o_totalprice * 1000) AS DECIMAL(18, 3)) AS price",
        "CAST(o_totalprice AS DECIMAL(14, 4)) AS paid", "IF(o_orderkey % 19 = 0, concat(CAST(o_custkey AS STRING), '.0'), CAST(o_custkey AS STRING)) AS n",
    )
    return R.KeyedCompare(left, right, KEY, ["cust", "price", "paid", "n"]).mismatches().select("key", "column_name", "mismatch_type")


_FO = G.keyed_join_ctes("src_orders", "tgt_orders", KEY, ["o_totalprice"])


@query(
    "join_full_outer",
    f"""WITH {_FO}
SELECT k AS o_orderkey, s__o_totalprice AS source_totalprice, t__o_totalprice AS target_totalprice,
  CASE WHEN __s_n IS NULL THEN 'TARGET_ONLY' WHEN __t_n IS NULL THEN 'SOURCE_ONLY' ELSE 'BOTH' END AS presence
FROM j""",
    FX,
)
def join_full_outer(spark, sf):
    """Full outer join with a coalesced key and presence flags."""
    j = R.keyed_join(fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), KEY, ["o_totalprice"])
    return j.select(
        F.col(R.KEY).alias("o_orderkey"),
        F.col("s__o_totalprice").alias("source_totalprice"),
        F.col("t__o_totalprice").alias("target_totalprice"),
        F.when(F.col("__s_n").isNull(), "TARGET_ONLY").when(F.col("__t_n").isNull(), "SOURCE_ONLY").otherwise("BOTH").alias("presence"),
    )


@query(
    "join_full_outer_3way",
    """WITH a AS (SELECT DISTINCT o_orderkey AS k FROM src_orders),
b AS (SELECT DISTINCT o_orderkey AS k FROM tgt_orders),
c AS (SELECT DISTINCT o_orderkey AS k FROM third_orders),
ab AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_source, b.k IS NOT NULL AS in_target FROM a FULL OUTER JOIN b ON a.k = b.k)
SELECT coalesce(ab.k, c.k) AS o_orderkey, coalesce(ab.in_source, FALSE) AS in_source, coalesce(ab.in_target, FALSE) AS in_target,
       c.k IS NOT NULL AS in_third
FROM ab FULL OUTER JOIN c ON ab.k = c.k""",
    ("src_orders", "tgt_orders", "third_orders"),
)
def join_full_outer_3way(spark, sf):
    """Chained full outer joins keyed on the coalesced key (fixes X4)."""
    from tidemark.operators.joins import full_outer_three

    return full_outer_three(
        fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), fx.third_orders(spark, sf), KEY, ("in_source", "in_target", "in_third")
    )


@query("join_semi", "SELECT * FROM src_orders WHERE o_orderkey IN (SELECT o_orderkey FROM tgt_orders)", FX)
def join_semi(spark, sf):
    """Source rows whose key exists in the target (left semi join)."""
    return fx.src_orders(spark, sf).join(fx.tgt_orders(spark, sf).select(KEY), KEY, "left_semi")


@query(
    "join_anti",
    "SELECT * FROM src_orders s WHERE NOT EXISTS (SELECT 1 FROM tgt_orders t WHERE t.o_orderkey = s.o_orderkey)",
    FX,
)
def join_anti(spark, sf):
    """Source rows missing in the target (left anti join)."""
    return fx.src_orders(spark, sf).join(fx.tgt_orders(spark, sf).select(KEY), KEY, "left_anti")


_HASH = f"""WITH hs AS (SELECT {G.row_hash(ALL_COLS)} AS h, count(*) AS sn FROM src_orders GROUP BY 1),
ht AS (SELECT {G.row_hash(ALL_COLS)} AS h, count(*) AS tn FROM tgt_orders GROUP BY 1),
hj AS (SELECT coalesce(sn, 0) AS sn, coalesce(tn, 0) AS tn FROM hs FULL OUTER JOIN ht ON hs.h = ht.h)
SELECT CAST(sum(sn) AS BIGINT) AS source_row_count, CAST(sum(tn) AS BIGINT) AS target_row_count,
       CAST(sum(greatest(sn - tn, 0)) AS BIGINT) AS rows_only_in_source,
       CAST(sum(greatest(tn - sn, 0)) AS BIGINT) AS rows_only_in_target
FROM hj"""


@query("recon_hash", _HASH, FX)
def recon_hash(spark, sf):
    """Keyless compare by row-hash multiset difference."""
    return R.hash_diff(fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), ALL_COLS)


@query(
    "except_distinct",
    """SELECT 'source_only' AS side, * FROM (SELECT * FROM src_orders EXCEPT SELECT * FROM tgt_orders)
UNION ALL
SELECT 'target_only' AS side, * FROM (SELECT * FROM tgt_orders EXCEPT SELECT * FROM src_orders)""",
    FX,
)
def except_distinct(spark, sf):
    """EXCEPT DISTINCT both ways, labelled by side."""
    return setops.except_both(fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), distinct=True)


@query(
    "except_all",
    """SELECT 'source_only' AS side, * FROM (SELECT * FROM src_orders EXCEPT ALL SELECT * FROM tgt_orders)
UNION ALL
SELECT 'target_only' AS side, * FROM (SELECT * FROM tgt_orders EXCEPT ALL SELECT * FROM src_orders)""",
    FX,
)
def except_all(spark, sf):
    """EXCEPT ALL (multiset) both ways, labelled by side."""
    return setops.except_both(fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), distinct=False)


@query(
    "recon_counts",
    """SELECT CAST(sum(s) AS BIGINT) AS source_row_count, CAST(sum(t) AS BIGINT) AS target_row_count
FROM (SELECT 1 AS s, 0 AS t FROM src_orders UNION ALL SELECT 0 AS s, 1 AS t FROM tgt_orders)""",
    FX,
)
def recon_counts(spark, sf):
    """Both row counts in one job (tagged union, one aggregate)."""
    from tidemark.operators.aggs import row_counts

    return row_counts(fx.src_orders(spark, sf), fx.tgt_orders(spark, sf))


@query(
    "normalize_format",
    f"""SELECT o_orderkey, {G.norm('o_orderstatus')} AS status_norm, {G.norm(G.s('o_totalprice'))} AS price_norm,
  {G.norm("'  ' || o_orderpriority || '  X  Y'")} AS priority_norm,
  {G.norm(G.s('o_totalprice') + " || '00'")} AS padded_norm
FROM tgt_orders""",
    ("tgt_orders",),
)
def normalize_format_q(spark, sf):
    """P20: format normaliser on text and number-like strings."""
    from tidemark.functions.columns import normalize_format

    t = fx.tgt_orders(spark, sf)
    return t.select(
        KEY,
        normalize_format(F.col("o_orderstatus")).alias("status_norm"),
        normalize_format(F.col("o_totalprice").cast("string")).alias("price_norm"),
        normalize_format(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("  X  Y"))).alias("priority_norm"),
        normalize_format(F.concat(F.col("o_totalprice").cast("string"), F.lit("00"))).alias("padded_norm"),
    )


# ====================================================================== multi-table run
from tidemark.operators import recon_run as RR  # noqa: E402

CFG = R.ReconConfig(key_priority=("o_orderkey", "c_custkey", "p_partkey"), source_label="SRC", target_label="TGT")
RUN = RR.Run("run-1", dt.datetime(1997, 7, 1, 2, 30))
CYCLE = R.Cycle(columns=("updated",), cutoff_hour=3, days=90)

register("customer_fmt", "SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
register("supplier_chg", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 10 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier")
register("tgt_empty", "SELECT * FROM tgt_orders WHERE o_orderkey < 0", ("tgt_orders",))
register("timed_source", "SELECT *, o_orderdate AS updated FROM src_orders", ("src_orders",))
register("timed_target", "SELECT *, CASE WHEN o_orderkey % 29 = 0 THEN o_orderdate + INTERVAL 40 DAY WHEN o_orderkey % 59 = 0 THEN NULL ELSE o_orderdate END AS updated FROM tgt_orders", ("tgt_orders",))
#: The cycle that RUN's clock gives (1997-06-30 isn't complete at 02:30 of the next day).
_FROM, _TO = "1997-04-01 03:00:00", "1997-06-30 03:00:00"


def _pairs(spark, sf):
    cust = fx.load(spark, sf, "customer")
    sup = fx.load(spark, sf, "supplier")
    reg = fx.load(spark, sf, "region")
    return [
        RR.PairSpec("orders", "orders_tgt", fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), domain="sales"),
        RR.PairSpec("customer", "customer_tgt", cust, cust.withColumn("c_name", F.when(F.col("c_custkey") % 17 == 0, F.upper("c_name")).otherwise(F.col("c_name")))),
        RR.PairSpec("part", "part_tgt", fx.load(spark, sf, "part"), fx.load(spark, sf, "part"), excluded=("P_SIZE",)),
        RR.PairSpec("supplier", "supplier_tgt", sup, sup.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 10 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))),
        RR.PairSpec("nation", "nation_tgt", fx.load(spark, sf, "nation"), None),
        RR.PairSpec("region", "region_tgt", reg, reg.select(F.col("r_regionkey").alias("x_regionkey"), F.col("r_name").alias("x_name"))),
    ]


def _timed(spark, sf):
    k = F.col(KEY)
    late = F.when(k % 29 == 0, F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS")).when(k % 59 == 0, F.lit(None)).otherwise(F.col("o_orderdate"))
    return RR.PairSpec("timed", "timed_tgt", fx.src_orders(spark, sf).withColumn("updated", F.col("o_orderdate")), fx.tgt_orders(spark, sf).withColumn("updated", late))


# (name, source SQL, target SQL, key or None, compared non-key columns, domain, columns left out)
_SQL_PAIRS = [
    ("orders", "src_orders", "tgt_orders", "o_orderkey", sorted(COLS), "sales", ""),
    ("customer", "customer", "customer_fmt", "c_custkey", ["c_acctbal", "c_mktsegment", "c_name", "c_nationkey"], None, ""),
    ("part", "part", "part", "p_partkey", ["p_brand", "p_name", "p_retailprice", "p_type"], None, "left out by request: p_size; "),
    ("supplier", "supplier", "supplier_chg", None, ["s_acctbal", "s_name", "s_nationkey", "s_suppkey"], None, ""),
]
_RUN_FX = ("src_orders", "tgt_orders", "customer_fmt", "supplier_chg")
_NULL = lambda kind: f"CAST(NULL AS {kind})"


def _window_ctes(p: str, src: str, tgt: str, key: str) -> str:
    """``<p>_ws`` and ``<p>_wt``: rows in the cycle, and all rows of keys that are in it on the other side alone."""
    out = []
    for a, b in ((src, tgt), (tgt, src)):
        held = lambda t: f"SELECT {key} FROM {t} WHERE updated >= '{_FROM}' AND updated < '{_TO}'"
        side = "s" if a == src else "t"
        out.append(
            f"{p}_b{side} AS (SELECT * FROM {a} WHERE {key} IN ({held(b)}) AND {key} NOT IN ({held(a)})), "
            f"{p}_w{side} AS (SELECT * FROM {a} WHERE updated >= '{_FROM}' AND updated < '{_TO}' UNION ALL SELECT * FROM {p}_b{side})"
        )
    return ",\n".join(out)


def _keyed_row_ctes(p: str, src: str, tgt: str, key: str, cols, domain=None, left_out="", cycle=False) -> str:
    """``<p>_row``: the result row of a keyed pair."""
    ctes, straddling, beyond = "", "0", ("0", "0")
    if cycle:
        ctes = _window_ctes(p, src, tgt, key) + ",\n"
        src, tgt = f"{p}_ws", f"{p}_wt"
        beyond = (f"(SELECT count(*) FROM {p}_bs)", f"(SELECT count(*) FROM {p}_bt)")
        straddling = f"((SELECT count(DISTINCT {key}) FROM {p}_bs) + (SELECT count(DISTINCT {key}) FROM {p}_bt))"
    scope = f"'updated from {_FROM} to {_TO}, keys with rows on one side only: ' || straddling_keys" if cycle else "'whole tables'"
    shown = "coalesce(key, 'NULL') || ': ' || coalesce('[' || source_value || ']', 'NULL') || ' / ' || coalesce('[' || target_value || ']', 'NULL')"
    worst = "ORDER BY v + f DESC, column_name"
    return f"""{ctes}{G.multiset_ctes(src, tgt, key, cols, p)},
{p}_n AS ({G.keyed_counts_sql(p, straddling, *beyond)}),
{p}_m AS ({G.mismatch_rows_sql(p, cols)}),
{p}_e AS (SELECT column_name, string_agg({shown}, ', ' {_FIRST}) AS e FROM (SELECT *, row_number() OVER (PARTITION BY column_name {_FIRST}) AS r FROM {p}_m) WHERE r <= 3 GROUP BY 1),
{p}_c AS (SELECT column_name, count(*) FILTER (WHERE mismatch_type = 'VALUE') AS v, count(*) FILTER (WHERE mismatch_type = 'FORMAT') AS f FROM {p}_m GROUP BY 1),
{p}_l AS (SELECT coalesce(string_agg(column_name, ', ' {worst}), '') AS mismatched_columns, count(*) AS mismatched_column_count,
  coalesce(string_agg(column_name, ', ' {worst}) FILTER (WHERE v > 0), '') AS value_mismatch_columns,
  coalesce(string_agg(column_name, ', ' {worst}) FILTER (WHERE v = 0), '') AS format_only_mismatch_columns,
  string_agg(column_name || ' differs in ' || (v + f) || ' (' || v || ' in value, ' || f || ' in format; ' || e || ')', '; ' {worst}) AS differing
  FROM {p}_c JOIN {p}_e USING (column_name)),
{p}_row AS (SELECT '{RUN.run_id}' AS run_id, TIMESTAMP '{RUN.now}' AS run_timestamp, {f"'{domain}'" if domain else _NULL('VARCHAR')} AS domain, '{p}' AS source_table, '{p}_tgt' AS target_table,
  'OK' AS table_status, CASE WHEN rows_only_in_source + rows_only_in_target > 0 OR value_mismatch_columns <> '' THEN 'DATA_MISMATCH'
    WHEN mismatched_column_count > 0 THEN 'FORMAT_VARIANCE' ELSE 'DATA_MATCH' END AS data_status,
  source_row_count, target_row_count, 'FULL_KEYED' AS comparison_mode, '{key}' AS key_column, {'TRUE' if cycle else 'FALSE'} AS filter_applied, {"'updated'" if cycle else _NULL('VARCHAR')} AS filter_column,
  matched_row_count, rows_only_in_source, rows_only_in_target, {_NULL('BIGINT')} AS sample_size, mismatched_columns, mismatched_column_count, value_mismatch_columns, format_only_mismatch_columns,
  {_NULL('DOUBLE')} AS duration_seconds,
  concat_ws('; ', '{left_out}' || {scope}, 'by {key}, ' || matched_row_count || ' pairs',
    CASE WHEN source_row_count <> target_row_count THEN 'sizes differ: SRC ' || source_row_count || ', TGT ' || target_row_count END,
    CASE WHEN rows_only_in_source > 0 THEN 'rows that SRC alone has: ' || rows_only_in_source END, CASE WHEN rows_only_in_target > 0 THEN 'rows that TGT alone has: ' || rows_only_in_target END,
    CASE WHEN duplicate_keys > 0 THEN 'keys with several rows: ' || duplicate_keys END, differing,
    CASE WHEN differing IS NULL AND rows_only_in_source + rows_only_in_target = 0 THEN 'no difference' END) AS comments,
  duplicate_keys, straddling_keys, {f"'{_FROM}'" if cycle else _NULL('VARCHAR')} AS filter_start, {f"'{_TO}'" if cycle else _NULL('VARCHAR')} AS filter_end
  FROM {p}_n, {p}_l)"""


def _hash_row_ctes(p: str, src: str, tgt: str, cols) -> str:
    return f"""{p}_hs AS (SELECT {G.row_hash(cols)} AS h, count(*) AS sn FROM {src} GROUP BY 1),
{p}_ht AS (SELECT {G.row_hash(cols)} AS h, count(*) AS tn FROM {tgt} GROUP BY 1),
{p}_h AS (SELECT CAST(sum(coalesce(sn, 0)) AS BIGINT) AS s, CAST(sum(coalesce(tn, 0)) AS BIGINT) AS t, CAST(sum(greatest(coalesce(sn, 0) - coalesce(tn, 0), 0)) AS BIGINT) AS os,
  CAST(sum(greatest(coalesce(tn, 0) - coalesce(sn, 0), 0)) AS BIGINT) AS ot FROM {p}_hs FULL OUTER JOIN {p}_ht ON {p}_hs.h = {p}_ht.h),
{p}_row AS (SELECT '{RUN.run_id}' AS run_id, TIMESTAMP '{RUN.now}' AS run_timestamp, {_NULL('VARCHAR')} AS domain, '{p}' AS source_table, '{p}_tgt' AS target_table, 'OK' AS table_status,
  CASE WHEN os + ot > 0 THEN 'DATA_MISMATCH' ELSE 'DATA_MATCH' END AS data_status, s AS source_row_count, t AS target_row_count, 'FULL_HASH' AS comparison_mode, {_NULL('VARCHAR')} AS key_column,
  FALSE AS filter_applied, {_NULL('VARCHAR')} AS filter_column, CAST(0 AS BIGINT) AS matched_row_count, os AS rows_only_in_source, ot AS rows_only_in_target, {_NULL('BIGINT')} AS sample_size,
  '' AS mismatched_columns, CAST(0 AS BIGINT) AS mismatched_column_count, '' AS value_mismatch_columns, '' AS format_only_mismatch_columns, {_NULL('DOUBLE')} AS duration_seconds,
  concat_ws('; ', 'whole tables', 'no key, so whole rows were compared', CASE WHEN s <> t THEN 'sizes differ: SRC ' || s || ', TGT ' || t END,
    CASE WHEN os > 0 THEN 'rows that SRC alone has: ' || os END, CASE WHEN ot > 0 THEN 'rows that TGT alone has: ' || ot END, CASE WHEN os + ot = 0 THEN 'no difference' END) AS comments,
  CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS straddling_keys, {_NULL('VARCHAR')} AS filter_start, {_NULL('VARCHAR')} AS filter_end FROM {p}_h)"""


_OVERALL = "CASE data_status WHEN 'DATA_MISMATCH' THEN 'FAIL' WHEN 'DATA_MATCH' THEN 'PASS' ELSE 'WARN' END"
_COLS_OUT = RR.RESULT_SCHEMA.fieldNames()


def _result(row: str, overall: str = _OVERALL) -> str:
    return "SELECT " + ", ".join(f"{overall} AS overall_status" if c == "overall_status" else c for c in _COLS_OUT) + f" FROM {row}"


def _literal(said: dict[str, str]) -> str:
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    said = {"run_id": f"'{RUN.run_id}'", "run_timestamp": f"'{RUN.now}'", "filter_applied": "FALSE", "data_status": "'NOT_COMPARED'", "comparison_mode": "'SKIPPED'", **said}
    return "SELECT " + ", ".join(f"CAST({said.get(f.name, 'NULL')} AS {kinds[f.dataType.simpleString()]}) AS {f.name}" for f in RR.RESULT_SCHEMA.fields)


def _run_sql() -> str:
    ctes = [_keyed_row_ctes(name, src, tgt, key, cols, domain, out) if key else _hash_row_ctes(name, src, tgt, cols) for name, src, tgt, key, cols, domain, out in _SQL_PAIRS]
    rows = [_result(f"{n}_row") for n, *_ in _SQL_PAIRS]
    rows.append(_literal({"source_table": "'nation'", "target_table": "'nation_tgt'", "table_status": "'MISSING_IN_TARGET'", "overall_status": "'FAIL'", "comments": "'nation_tgt doesn''t exist'"}))
    none = dict.fromkeys(("source_row_count", "target_row_count", "matched_row_count", "rows_only_in_source", "rows_only_in_target", "mismatched_column_count", "duplicate_keys", "straddling_keys"), "0")
    empty = dict.fromkeys(("mismatched_columns", "value_mismatch_columns", "format_only_mismatch_columns"), "''")
    said = "'SRC alone has r_name, r_regionkey; TGT alone has x_name, x_regionkey; no common column is left to compare'"
    rows.append(_literal({"source_table": "'region'", "target_table": "'region_tgt'", "table_status": "'OK'", "overall_status": "'WARN'", "comments": said, **none, **empty}))
    return "WITH " + ",\n".join(ctes) + ",\nrun AS (" + "\nUNION ALL\n".join(rows) + ")\n"


_RUN = _run_sql()


def recon_results(spark, sf):
    return RR.reconcile_many(spark, _pairs(spark, sf), CFG, RUN)


@query("recon_run", _RUN + "SELECT * FROM run", _RUN_FX)
def recon_run(spark, sf):
    """One result row per table pair (keyed, hash, missing, skipped), with its comment."""
    return recon_results(spark, sf)


@query("recon_status", _RUN + "SELECT source_table, comparison_mode, data_status, overall_status FROM run", _RUN_FX)
def recon_status(spark, sf):
    """Data status and overall status per pair."""
    return recon_results(spark, sf).select("source_table", "comparison_mode", "data_status", "overall_status")


@query(
    "triage_rows",
    _RUN + """SELECT *, row_number() OVER (ORDER BY overall_status DESC, mismatched_column_count DESC NULLS LAST, source_table) AS triage_rank
FROM run WHERE overall_status IN ('FAIL', 'WARN', 'ERROR')""",
    _RUN_FX,
)
def triage_rows(spark, sf):
    """L1/L4: flagged pairs in triage order."""
    return RR.triage(recon_results(spark, sf))


_TIMED_COLS = sorted([*COLS, "updated"])


@query("recon_cycle", "WITH " + _keyed_row_ctes("timed", "timed_source", "timed_target", KEY, _TIMED_COLS, cycle=True) + "\n" + _result("timed_row"), ("timed_source", "timed_target"))
def recon_cycle(spark, sf):
    """The rows of the completed cycle, with keys whose time lies in it on one side only; all result columns."""
    return RR.reconcile_many(spark, [_timed(spark, sf)], dataclasses.replace(CFG, cycle=CYCLE), RUN)


_EMPTY = "WITH " + _keyed_row_ctes("orders", "src_orders", "tgt_empty", KEY, sorted(COLS)) + "\n" + _result("orders_row")


@query("recon_empty_side", _EMPTY, ("src_orders", "tgt_empty"))
def recon_empty_side(spark, sf):
    """One side empty -> every row of the other side is unmatched."""
    spec = RR.PairSpec("orders", "orders_tgt", fx.src_orders(spark, sf), fx.tgt_orders(spark, sf).where(F.col(KEY) < 0))
    return RR.reconcile_many(spark, [spec], CFG, RUN)


_SIZE = """greatest(1, least(greatest(1000, CAST(floor(CAST(least(sc, tc) AS DOUBLE) * 0.2) AS BIGINT)), CASE WHEN greatest(sc, tc) > 20000000 THEN 500000 ELSE 50000 END, sc))"""
_SAMPLED = f"{G.key_bucket(KEY)} < (SELECT thr FROM o_thr)"
_SAMPLE = f"""WITH o_c AS (SELECT (SELECT count(*) FROM src_orders) AS sc, (SELECT count(*) FROM tgt_orders) AS tc),
o_n AS (SELECT sc, {_SIZE} AS n FROM o_c), o_thr AS (SELECT least(4294967296, (n * 4294967296) // greatest(sc, 1)) AS thr FROM o_n),
{G.multiset_ctes(f'(SELECT * FROM src_orders WHERE {_SAMPLED})', f'(SELECT * FROM tgt_orders WHERE {_SAMPLED})', KEY, COLS, 'o')}
SELECT CAST((SELECT n FROM o_n) AS BIGINT) AS sample_size, count(*) FILTER (WHERE s > 0) AS sampled_keys, CAST(sum(s) AS BIGINT) AS sampled_rows,
  CAST(sum(s - least(s, t)) AS BIGINT) AS rows_only_in_source, CAST(NULL AS BIGINT) AS rows_only_in_target, CAST(sum(least(s, t)) AS BIGINT) AS matched_row_count
FROM o_k"""


@query("recon_sample_keyed", _SAMPLE, FX)
def recon_sample_keyed(spark, sf):
    """Deterministic md5-bucket sample of keys, compared in full."""
    s, t = fx.src_orders(spark, sf), fx.tgt_orders(spark, sf)
    from tidemark.operators.aggs import row_counts

    c = row_counts(s, t).first()
    n = R.SampleRule().size(c["source_row_count"], c["target_row_count"])
    summary, _ = R.compare_sampled(s, t, KEY, COLS, R.sample_share(n, c["source_row_count"]))
    return summary.select(F.lit(n).cast("long").alias("sample_size"), "*")


_PLAN_PAIRS = [("orders", "src_orders", "tgt_orders", True, False), ("orders_filtered", "src_orders", "tgt_orders", True, True),
               ("customer", "customer", "customer_fmt", True, False), ("part", "part", "part", True, False),
               ("supplier", "supplier", "supplier_chg", False, False), ("orders_empty", "src_orders", "tgt_empty", True, True)]


def _plan_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS pair, (SELECT count(*) FROM {s}) AS source_row_count, (SELECT count(*) FROM {t}) AS target_row_count, {str(k).upper()} AS has_key, {str(h).upper()} AS has_filter"
        for n, s, t, k, h in _PLAN_PAIRS
    )
    size = _SIZE.replace("sc", "source_row_count").replace("tc", "target_row_count")
    return f"""WITH c AS ({parts}),
p AS (SELECT *, CASE WHEN has_key THEN 'FULL_KEYED' ELSE 'FULL_HASH' END AS comparison_mode, CAST(NULL AS BIGINT) AS sample_size,
  CASE WHEN NOT has_key THEN 'FULL_HASH' WHEN source_row_count = 0 OR target_row_count = 0 THEN 'FULL_KEYED' ELSE 'SAMPLE_KEYED' END AS asked_mode FROM c)
SELECT *, CAST(CASE WHEN asked_mode = 'SAMPLE_KEYED' THEN {size} END AS BIGINT) AS asked_sample_size FROM p"""


@query("recon_plan", _plan_sql(), ("src_orders", "tgt_orders", "customer_fmt", "supplier_chg", "tgt_empty"))
def recon_plan(spark, sf):
    """R10/R11 for many pairs in one pass: the mode, which is in full, and mode and size where a sample is asked for."""
    cust = fx.load(spark, sf, "customer")
    sup = fx.load(spark, sf, "supplier")
    frames = {
        "src_orders": fx.src_orders(spark, sf), "tgt_orders": fx.tgt_orders(spark, sf), "customer": cust,
        "customer_fmt": cust, "part": fx.load(spark, sf, "part"), "supplier": sup, "supplier_chg": sup,
        "tgt_empty": fx.tgt_orders(spark, sf).where(F.col(KEY) < 0),
    }
    u = None
    for n, s, t, k, h in _PLAN_PAIRS:
        for side, name in ((0, s), (1, t)):
            part = frames[name].select(F.lit(n).alias("pair"), F.lit(side).alias("side"), F.lit(k).alias("has_key"), F.lit(h).alias("has_filter"))
            u = part if u is None else u.unionByName(part)
    of_side = [F.count(F.when(F.col("side") == i, 1)).alias(f"{name}_row_count") for i, name in enumerate(("source", "target"))]
    g = u.groupBy("pair").agg(*of_side, F.max("has_key").alias("has_key"), F.max("has_filter").alias("has_filter"))
    asked = R.plan_compare(g, dataclasses.replace(CFG, sample=R.SampleRule())).withColumnsRenamed({"comparison_mode": "asked_mode", "sample_size": "asked_sample_size"})
    return R.plan_compare(asked, CFG).select(*g.columns, "comparison_mode", "sample_size", "asked_mode", "asked_sample_size")


_U3_SQL = (
    "WITH u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, 's' AS side FROM src_orders UNION ALL SELECT '{c}', CAST({c} AS VARCHAR), 't' FROM tgt_orders" for c in ALL_COLS)
    + """),
g AS (SELECT column_name, value, count(CASE WHEN side = 's' THEN 1 END) AS sn, count(CASE WHEN side = 't' THEN 1 END) AS tn FROM u GROUP BY 1, 2)
SELECT column_name, CAST(sum(CASE WHEN sn > 0 AND tn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS source_only_values,
       CAST(sum(CASE WHEN tn > 0 AND sn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS target_only_values
FROM g GROUP BY column_name"""
)


@query("mismatch_columns_distinct", _U3_SQL, FX)
def mismatch_columns_distinct(spark, sf):
    """Per column, distinct values present on one side only (one unpivot, one grouped count)."""
    return setops.column_multiset_diff(fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), ALL_COLS, distinct=True)


_LC = G.keyed_join_ctes("src_orders", "tgt_orders", KEY, COLS, how="INNER")


@query(
    "length_compare",
    f"WITH {_LC},\nx AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, length(CAST(s__{c} AS VARCHAR)) AS sl, length(CAST(t__{c} AS VARCHAR)) AS tl FROM j WHERE __s_n = 1 AND __t_n = 1" for c in COLS)
    + """)
SELECT column_name, count(CASE WHEN sl IS DISTINCT FROM tl THEN 1 END) AS length_mismatch_rows, CAST(max(sl) AS BIGINT) AS max_source_length,
  CAST(max(tl) AS BIGINT) AS max_target_length FROM x GROUP BY column_name""",
    FX,
)
def length_compare(spark, sf):
    """J10 re-aimed: keyed length comparison per column (no theta join)."""
    from tidemark.operators.joins import length_compare as lc

    return lc(fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), KEY, COLS)


# ---------------------------------------------------------------------- R15 validation
_VS = ["o_custkey", "o_isfinal", "o_note", "o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice"]
_VS_STR = {"o_isfinal", "o_note", "o_orderpriority"}
_VT = ["o_orderkey", "o_custkey", "o_isfinal", "o_totalprice", "o_orderdate", "o_orderpriority", "o_target_only"]
_VC = sorted(set(_VS) & set(_VT))


def _validate_sql() -> str:
    bp = ", ".join(
        (f"bool_and({c} IS NULL OR {c} IN ('t', 'f')) AS b_{c}" if c in _VS_STR else f"bool_and({c} IS NULL) AS b_{c}") for c in _VS
    )

    def s_expr(c):
        if c not in _VS_STR:  # a non-text column is boolean only when all NULL: both forms give NULL
            return f"CAST({c} AS VARCHAR) AS {c}"
        rec = f"CAST(CASE WHEN lower(trim({c})) = 't' THEN 1 WHEN lower(trim({c})) = 'f' THEN 0 END AS VARCHAR)"
        return f"CASE WHEN (SELECT b_{c} FROM bp) THEN {rec} ELSE CAST({c} AS VARCHAR) END AS {c}"

    cols = ", ".join(_VC)
    return f"""WITH bp AS (SELECT {bp} FROM val_source),
t AS (SELECT o_orderkey, o_custkey, o_isfinal, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate, o_orderpriority, o_target_only FROM val_target),
td AS (SELECT DISTINCT * FROM t),
ss AS (SELECT {', '.join(s_expr(c) for c in _VC)} FROM val_source),
ts AS (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _VC)} FROM td)
SELECT 'orders' AS table_name, (SELECT count(*) FROM val_source) AS source_count, (SELECT count(*) FROM t) AS target_full_count,
  (SELECT count(*) FROM td) AS target_filter_count, (SELECT count(*) FROM td) AS target_post_dedup_count,
  (SELECT count(*) FROM t) - (SELECT count(*) FROM td) AS duplicate_count,
  list_filter([{', '.join(f"CASE WHEN b_{c} THEN '{c}' END" for c in _VS)}], lambda x: x IS NOT NULL) AS converted_boolean_columns,
  ['o_totalprice'] AS decimal_columns,
  (SELECT count(*) FROM (SELECT {cols} FROM ss EXCEPT ALL SELECT {cols} FROM ts)) AS source_only_count,
  (SELECT count(*) FROM (SELECT {cols} FROM ts EXCEPT ALL SELECT {cols} FROM ss)) AS target_only_count,
  ['o_target_only'] AS missing_in_source, ['o_note'] AS missing_in_target, CAST(NULL AS VARCHAR[]) AS differing_columns
FROM bp"""


_VALIDATE = f"""WITH v AS ({_validate_sql()}),
w AS (SELECT *, concat_ws(' | ', CASE WHEN source_count <> target_post_dedup_count THEN 'count mismatch' END,
    CASE WHEN len(missing_in_source) > 0 THEN 'missing columns in source' END, CASE WHEN len(missing_in_target) > 0 THEN 'missing columns in target' END,
    CASE WHEN source_only_count + target_only_count > 0 THEN 'data mismatch' END, CASE WHEN duplicate_count > 0 THEN 'duplicates in target' END) AS c FROM v)
SELECT * EXCLUDE (c), CASE WHEN c = '' THEN 'All checks passed' ELSE c END AS comment FROM w"""


@query("validate_table", _VALIDATE, ("val_source", "val_target"))
def validate_table(spark, sf):
    """Boolean recode, decimal cast, dedup rule, EXCEPT ALL both ways, missing columns, comment."""
    return RR.validate_table(spark, "orders", fx.val_source(spark, sf), fx.val_target(spark, sf), drop_target=("azure_load_date",))


_WINDOW = ("1995-01-01 00:00:00", "1996-12-31 00:00:00")
_IN = f"creationtime BETWEEN TIMESTAMP '{_WINDOW[0]}' AND TIMESTAMP '{_WINDOW[1]}'"
_WCOLS = ["creationtime", "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice", "updatetime"]
register("win_source", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate AS creationtime, o_orderdate AS updatetime FROM src_orders", ("src_orders",))
register("win_target", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate AS creationtime, o_orderdate AS updatetime FROM tgt_orders", ("tgt_orders",))


def _except(a: str, b: str, cols: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {cols} FROM {a} WHERE {_IN} EXCEPT ALL SELECT {cols} FROM {b} WHERE {_IN}))"


def _validate_window_sql(name: str, a: str, b: str) -> str:
    cols = ", ".join(_WCOLS)
    differ = ", ".join(f"CASE WHEN {_except(a, b, c)} + {_except(b, a, c)} > 0 THEN '{c}' END" for c in _WCOLS)
    return f"""SELECT '{name}' AS table_name, (SELECT count(*) FROM {a} WHERE {_IN}) AS source_count, (SELECT count(*) FROM {b}) AS target_full_count,
  (SELECT count(*) FROM {b} WHERE {_IN}) AS target_filter_count, (SELECT count(*) FROM {b}) AS target_post_dedup_count, CAST(0 AS BIGINT) AS duplicate_count,
  CAST([] AS VARCHAR[]) AS converted_boolean_columns, CAST([] AS VARCHAR[]) AS decimal_columns, {_except(a, b, cols)} AS source_only_count, {_except(b, a, cols)} AS target_only_count,
  CAST([] AS VARCHAR[]) AS missing_in_source, CAST([] AS VARCHAR[]) AS missing_in_target, list_filter([{differ}], lambda x: x IS NOT NULL) AS differing_columns"""


@query(
    "validate_table_window",
    f"""WITH v AS ({_validate_window_sql('changed', 'win_source', 'win_target')} UNION ALL {_validate_window_sql('same', 'win_source', 'win_source')})
SELECT *, CASE WHEN source_only_count + target_only_count = 0 THEN 'All checks passed' ELSE concat_ws(' | ', CASE WHEN source_count <> target_filter_count THEN 'count mismatch' END, 'data mismatch') END AS comment FROM v""",
    ("win_source", "win_target"),
)
def validate_table_window(spark, sf):
    """R15 with a window, no de-duplication: fingerprints first, so the equal pair is never shuffled."""
    shaped = lambda df: df.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.col("o_orderdate").alias("creationtime"), F.col("o_orderdate").alias("updatetime"))
    s, t = shaped(fx.src_orders(spark, sf)), shaped(fx.tgt_orders(spark, sf))
    return RR.validate_table(spark, "changed", s, t, window=_WINDOW).unionByName(RR.validate_table(spark, "same", s, s, window=_WINDOW))


_FP = [("o_custkey", "o_custkey"), ("o_orderkey", "o_orderkey"), ("o_orderstatus", "o_orderstatus"), ("o_totalprice", "o_totalprice"), (None, "o_custkey, o_orderkey, o_orderstatus, o_totalprice")]


@query(
    "column_fingerprints",
    " UNION ALL ".join(
        f"""SELECT {f"'{n}'" if n else 'NULL'} AS column_name, (SELECT count(*) FROM src_orders) AS source_rows, (SELECT count(*) FROM changed) AS target_rows,
  (SELECT count(*) FROM (SELECT {c} FROM src_orders EXCEPT ALL SELECT {c} FROM changed)) + (SELECT count(*) FROM (SELECT {c} FROM changed EXCEPT ALL SELECT {c} FROM src_orders)) = 0 AS same"""
        for n, c in _FP
    ).join(["WITH changed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 53 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM src_orders) SELECT * FROM (", ")"]),
    ("src_orders",),
)
def column_fingerprints(spark, sf):
    """Additive fingerprints by month, merged, tell which columns differ; one scan a side."""
    from tidemark.operators.setops import fingerprints, merge_fingerprints, same_fingerprints

    s = fx.src_orders(spark, sf).withColumn("month", F.date_trunc("month", "o_orderdate"))
    changed = s.withColumn("o_custkey", F.when(F.col(KEY) % 53 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    texts = {c: f"CAST({c} AS STRING)" for c, _ in _FP if c}
    a, b = (merge_fingerprints(fingerprints(x, texts, by=["month"])) for x in (s, changed))
    return same_fingerprints(a, b)


# ---------------------------------------------------------------------- R16 database compare
from tidemark.plans import q_schema as _q_schema  # noqa: E402,F401  (registers the metadata fixtures)
_DB_SRC = ["orders", "customer", "part", "supplier", "nation", "region"]


def _db_frames(spark, sf):
    src = {t: fx.load(spark, sf, t) for t in _DB_SRC}
    src["orders"] = fx.src_orders(spark, sf)
    dst = {
        "orders": fx.tgt_orders(spark, sf),
        "customer": src["customer"].withColumn("c_acctbal", F.col("c_acctbal").cast("string")),
        "part": src["part"].drop("p_type"),
        "supplier": src["supplier"],
        "region": src["region"].where(F.col("r_regionkey") > 100),
    }
    return src, dst


register(
    "db_meta_src",
    """SELECT table_name, column_name, data_type, ordinal_position FROM meta_prod WHERE table_name IN ('customer', 'part', 'supplier', 'nation', 'region')
UNION ALL SELECT 'orders', column_name, data_type, ordinal_position FROM meta_prod WHERE table_name = 'orders'""",
    ("meta_prod",),
)
register(
    "db_meta_dst",
    """SELECT table_name, column_name, CASE WHEN table_name = 'customer' AND column_name = 'c_acctbal' THEN 'string' ELSE data_type END AS data_type, ordinal_position
FROM db_meta_src WHERE table_name IN ('orders', 'customer', 'part', 'supplier', 'region') AND NOT (table_name = 'part' AND column_name = 'p_type')""",
    ("db_meta_src",),
)


def _db_data_sql(name: str, src: str, dst: str, cols) -> str:
    h = G.row_hash(cols)
    return f"""SELECT '{name}' AS tablename, CAST(coalesce(sum(sn), 0) AS BIGINT) AS source_count, CAST(coalesce(sum(dn), 0) AS BIGINT) AS destination_count,
  count(CASE WHEN dn IS NULL THEN 1 END) AS s_only, count(CASE WHEN sn IS NULL THEN 1 END) AS d_only
FROM (SELECT {h} AS h, count(*) AS sn FROM {src} GROUP BY 1) a FULL OUTER JOIN (SELECT {h} AS h, count(*) AS dn FROM {dst} GROUP BY 1) b ON a.h = b.h"""


_DB_SQL = f"""WITH sig AS (SELECT table_name, count(*) AS n, string_agg(column_name || ':' || data_type, ',' ORDER BY ordinal_position) AS s FROM db_meta_src GROUP BY 1),
dig AS (SELECT table_name, count(*) AS n, string_agg(column_name || ':' || data_type, ',' ORDER BY ordinal_position) AS s FROM db_meta_dst GROUP BY 1),
ddl AS (SELECT sig.table_name, CASE WHEN dig.table_name IS NULL THEN 'Table missing in destination' WHEN sig.n <> dig.n THEN 'DDL mismatch'
                                    WHEN sig.s <> dig.s THEN 'Column data type mismatch' END AS early FROM sig LEFT JOIN dig ON sig.table_name = dig.table_name),
data AS ({_db_data_sql('orders', 'src_orders', 'tgt_orders', ALL_COLS)}
  UNION ALL {_db_data_sql('supplier', 'supplier', 'supplier', ['s_suppkey', 's_name', 's_nationkey', 's_acctbal'])}
  UNION ALL {_db_data_sql('region', 'region', '(SELECT * FROM region WHERE r_regionkey > 100)', ['r_regionkey', 'r_name'])})
SELECT ddl.table_name AS tablename,
  CASE WHEN early IS NULL THEN data.source_count END AS source_count, CASE WHEN early IS NULL THEN data.destination_count END AS destination_count,
  coalesce(early, CASE WHEN data.source_count > 0 AND data.destination_count > 0
                       THEN CASE WHEN s_only = 0 AND d_only = 0 THEN 'Data matches' ELSE 'Data mismatch' END ELSE 'No data to compare' END) AS result_status
FROM ddl LEFT JOIN data ON ddl.table_name = data.tablename"""


@query("compare_database", _DB_SQL, ("db_meta_dst", "src_orders", "tgt_orders"))
def compare_database(spark, sf):
    """Missing table -> DDL -> type list -> counts + EXCEPT DISTINCT both ways -> label."""
    src, dst = _db_frames(spark, sf)
    return RR.compare_database(spark, src, dst)


# ---------------------------------------------------------------------- R13 comments
_COMMENTS = _RUN[: _RUN.rindex(")\n")] + ")" + f""",
{_keyed_row_ctes('dup', 'dup_source', 'dup_target', KEY, sorted(COLS))},
{_keyed_row_ctes('timed', 'timed_source', 'timed_target', KEY, _TIMED_COLS, cycle=True)}
SELECT source_table, comments FROM run UNION ALL SELECT source_table, comments FROM dup_row UNION ALL SELECT source_table, comments FROM timed_row"""


@query("recon_comments", _COMMENTS, (*_RUN_FX, "dup_source", "dup_target", "timed_source", "timed_target"))
def recon_comments(spark, sf):
    """The findings of each pair in words; also where keys repeat, and of a completed cycle."""
    dup = RR.PairSpec("dup", "dup_tgt", *_dup(spark, sf))
    return RR.comments_many(spark, [*_pairs(spark, sf), dup, _timed(spark, sf)], dataclasses.replace(CFG, cycle=CYCLE), RUN)


_KINDS = """SELECT source_table, kind, CAST(n AS BIGINT) AS rows FROM dup_n, (SELECT 'dup' AS source_table),
LATERAL (VALUES ('FULL_KEYED', matched_row_count), ('ONLY_SOURCE_ROWS', rows_only_in_source), ('ONLY_TARGET_ROWS', rows_only_in_target), ('REPEATED_KEYS', duplicate_keys)) x(kind, n) WHERE n > 0
UNION ALL SELECT 'dup', 'COLUMN', v + f FROM dup_c"""


@query("recon_findings", "WITH " + _keyed_row_ctes("dup", "dup_source", "dup_target", KEY, sorted(COLS)) + "\n" + _KINDS, DUP)
def recon_findings(spark, sf):
    """R13 as data: kinds of findings with their numbers of rows."""
    found = RR.findings_many(spark, [RR.PairSpec("dup", "dup_tgt", *_dup(spark, sf))], CFG, RUN)
    return found.where("rows IS NOT NULL").select("source_table", "kind", "rows")


@query("recon_run_isolated", _RUN + "SELECT * EXCLUDE (duration_seconds), TRUE AS timed FROM run", _RUN_FX)
def recon_run_isolated(spark, sf):
    """R14 with the reference's run semantics: one timed job per pair on a thread pool (8), retry, error rows."""
    out = RR.reconcile_many(spark, _pairs(spark, sf), CFG, RUN, isolate=True, max_workers=8, retries=1)
    return out.withColumn("timed", F.col("duration_seconds") >= 0).drop("duration_seconds")
