"""Quality-rule, audit and layer-consistency queries (Q-5 ... Q-18, R18, R19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx

NOW = "1998-08-02 00:00:00"


@query(
    "recent_row_count",
    f"""SELECT 'orders' AS table_name, 'o_orderdate' AS time_column, count(CASE WHEN o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY THEN 1 END) AS recent_rows, count(*) AS total_rows FROM orders
UNION ALL SELECT 'lineitem', 'l_shipdate', count(CASE WHEN l_shipdate >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY THEN 1 END), count(*) FROM lineitem
UNION ALL SELECT 'events', 'ts', count(CASE WHEN ts >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY THEN 1 END), count(*) FROM events
UNION ALL SELECT 'customer', CAST(NULL AS VARCHAR), count(*), count(*) FROM customer""",
)
def recent_row_count(spark, sf):
    """Q-5: rows of the last year per table (time column picked from the schema; none -> total)."""
    frames = {t: fx.load(spark, sf, t) for t in ("orders", "lineitem", "events", "customer")}
    return Q.recent_row_count(frames, NOW, 365)


@query(
    "oversized_values",
    """SELECT 'text' AS column_name, CAST(max(strlen(text)) AS BIGINT) AS max_bytes, count(CASE WHEN strlen(text) > 65536 THEN 1 END) AS oversized_values,
  count(CASE WHEN strlen(text) > 65536 THEN 1 END) > 0 AS has_oversized FROM documents
UNION ALL
SELECT 'html', CAST(max(strlen(html)) AS BIGINT), count(CASE WHEN strlen(html) > 65536 THEN 1 END), count(CASE WHEN strlen(html) > 65536 THEN 1 END) > 0 FROM pages""",
)
def oversized_values(spark, sf):
    """Q-6: values above a byte threshold per text column (one aggregate per table)."""
    d = Q.oversized(fx.load(spark, sf, "documents"), 65536, ["text"])
    p = Q.oversized(fx.load(spark, sf, "pages"), 65536, ["html"])
    return d.unionByName(p)


_REQ = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


@query(
    "dq_null_check",
    "WITH a AS (SELECT "
    + ", ".join(f"count(CASE WHEN {c} IS NULL THEN 1 END) AS n{i}" for i, c in enumerate(_REQ))
    + ", count(CASE WHEN " + " OR ".join(f"{c} IS NULL" for c in _REQ) + " THEN 1 END) AS nany FROM tgt_orders)\n"
    + "SELECT *, CASE WHEN null_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, n{i} AS null_count FROM a" for i, c in enumerate(_REQ))
    + " UNION ALL SELECT '*' AS column_name, nany AS null_count FROM a)",
    ("tgt_orders",),
)
def dq_null_check(spark, sf):
    """Q-7: NULLs in required columns."""
    return Q.null_check(fx.tgt_orders(spark, sf), _REQ)


@query(
    "dq_unique_check",
    "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def dq_unique_check(spark, sf):
    """Q-8: duplicated keys with their occurrence count."""
    return Q.unique_check(fx.load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


RULES = {
    "quantity_positive": "l_quantity > 0",
    "discount_range": "l_discount BETWEEN 0.0 AND 0.08",
    "tax_below_7pct": "l_tax < 0.07",
    "flag_known": "l_returnflag IN ('A', 'N', 'R')",
    "price_covers_quantity": "l_extendedprice >= l_quantity",
}


@query(
    "dq_rule_check",
    "WITH a AS (SELECT "
    + ", ".join(f"count(CASE WHEN NOT ({r}) THEN 1 END) AS v{i}" for i, r in enumerate(RULES.values()))
    + " FROM lineitem)\nSELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS rule_name, v{i} AS violations FROM a" for i, n in enumerate(RULES))
    + ")",
)
def dq_rule_check(spark, sf):
    """Q-9: rows breaking each consistency rule."""
    return Q.rule_check(fx.load(spark, sf, "lineitem"), RULES)


@query(
    "dq_source_minus_target",
    """WITH a AS (SELECT o_orderkey, count(*) AS an FROM src_orders GROUP BY 1),
b AS (SELECT o_orderkey, count(*) AS bn FROM tgt_orders GROUP BY 1),
r AS (SELECT CAST(coalesce(sum(an), 0) AS BIGINT) AS source_count, CAST(coalesce(sum(bn), 0) AS BIGINT) AS target_count,
             CAST(coalesce(sum(CASE WHEN bn IS NULL THEN an END), 0) AS BIGINT) AS missing_in_target
      FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT *, CASE WHEN target_count >= source_count AND missing_in_target = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""",
    ("src_orders", "tgt_orders"),
)
def dq_source_minus_target(spark, sf):
    """Q-11: source minus target on the key plus the count rule."""
    return Q.source_minus_target(fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), ["o_orderkey"])


_CASTS = {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "int"}
_DUCK_T = {"bigint": "BIGINT", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}


@query(
    "dq_cast_check",
    "WITH s AS (SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _CASTS) + " FROM orders),\na AS (SELECT "
    + ", ".join(f"count(CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS {_DUCK_T[t]}) IS NULL THEN 1 END) AS b{i}" for i, (c, t) in enumerate(_CASTS.items()))
    + " FROM s)\n"
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS target_type, b{i} AS bad_values FROM a" for i, (c, t) in enumerate(_CASTS.items())),
)
def dq_cast_check(spark, sf):
    """Q-12: text values that do not cast to the declared type."""
    o = fx.load(spark, sf, "orders").select(*[F.col(c).cast("string").alias(c) for c in _CASTS])
    return Q.cast_check(o, _CASTS)


@query(
    "dq_quarantine",
    "SELECT l_orderkey, l_linenumber, reasons, reasons IS NULL AS is_valid FROM (SELECT l_orderkey, l_linenumber, NULLIF(concat_ws(';', "
    + ", ".join(f"CASE WHEN NOT coalesce({r}, FALSE) THEN '{n}' END" for n, r in RULES.items())
    + "), '') AS reasons FROM lineitem)",
)
def dq_quarantine(spark, sf):
    """Q-13: every row tagged valid / invalid with the failed rules (split with ``quarantine``)."""
    t = Q.tag_rules(fx.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *{"l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice"}), RULES)
    return t.select("l_orderkey", "l_linenumber", "reasons", "is_valid")


@query(
    "dq_sequence_gaps",
    """SELECT * FROM (SELECT l_orderkey, min(l_linenumber) AS min_seq, max(l_linenumber) AS max_seq, count(DISTINCT l_linenumber) AS present,
  count(*) AS row_count, CAST(max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS BIGINT) AS missing
  FROM lineitem GROUP BY l_orderkey)
WHERE missing > 0 OR row_count > present""",
)
def dq_sequence_gaps(spark, sf):
    """Q-14: orders whose line numbers have gaps or repeats (one grouped pass)."""
    return Q.sequence_gaps(fx.load(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    "dq_one_to_one",
    """WITH a AS (SELECT o_orderkey, count(*) AS an FROM src_orders GROUP BY 1),
b AS (SELECT o_orderkey, count(*) AS bn FROM tgt_orders GROUP BY 1)
SELECT CASE WHEN bn IS NULL THEN 'MISSING_IN_TARGET' WHEN an IS NULL THEN 'MISSING_IN_SOURCE'
            WHEN an = 1 AND bn = 1 THEN 'ONE_TO_ONE' WHEN an = 1 THEN 'ONE_TO_MANY' WHEN bn = 1 THEN 'MANY_TO_ONE' ELSE 'MANY_TO_MANY' END AS mapping,
       count(*) AS key_count
FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey GROUP BY 1""",
    ("src_orders", "tgt_orders"),
)
def dq_one_to_one(spark, sf):
    """Q-15: 1:1 mapping classes between two layers."""
    return Q.one_to_one(fx.src_orders(spark, sf), fx.tgt_orders(spark, sf), ["o_orderkey"])


@query(
    "dq_trace",
    """WITH u AS (SELECT o_orderkey, 0 AS l FROM src_orders UNION ALL SELECT o_orderkey, 1 FROM tgt_orders UNION ALL SELECT o_orderkey, 2 FROM third_orders),
g AS (SELECT o_orderkey, max(CASE WHEN l = 0 THEN TRUE ELSE FALSE END) AS in_source, max(CASE WHEN l = 1 THEN TRUE ELSE FALSE END) AS in_target,
             max(CASE WHEN l = 2 THEN TRUE ELSE FALSE END) AS in_third FROM u GROUP BY o_orderkey)
SELECT *, CASE WHEN NOT in_source THEN 'source' WHEN NOT in_target THEN 'target' WHEN NOT in_third THEN 'third' END AS first_missing_layer FROM g""",
    ("src_orders", "tgt_orders", "third_orders"),
)
def dq_trace(spark, sf):
    """Q-16: lineage trace of every key across three layers."""
    return Q.trace({"source": fx.src_orders(spark, sf), "target": fx.tgt_orders(spark, sf), "third": fx.third_orders(spark, sf)}, "o_orderkey")


@query(
    "dq_latency",
    """WITH x AS (SELECT message_type, CASE WHEN event_id % 13 = 0 THEN NULL ELSE enqueued_time + to_seconds(CAST(floor(value * 10) AS BIGINT)) END AS ingest_time, enqueued_time FROM feed),
y AS (SELECT message_type, date_diff('second', enqueued_time, ingest_time) AS lat, ingest_time IS NULL AS missing FROM x)
SELECT message_type, count(*) AS row_count, count(CASE WHEN missing THEN 1 END) AS missing_ingest,
  quantile_cont(CAST(lat AS DOUBLE), 0.5) AS p50_seconds, quantile_cont(CAST(lat AS DOUBLE), 0.95) AS p95_seconds,
  max(lat) AS max_seconds, count(CASE WHEN lat > 300 THEN 1 END) AS sla_breaches
FROM y GROUP BY message_type""",
    ("feed",),
)
def dq_latency(spark, sf):
    """Q-17: ingestion latency per message type against a 300 s SLA (ingest time derived from the feed)."""
    f = fx.feed(spark, sf)
    ingest = F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(
        F.timestamp_add("SECOND", F.floor(F.col("value") * 10).cast("long"), F.col("enqueued_time"))
    )
    x = f.select("message_type", "enqueued_time", ingest.alias("ingest_time"))
    return Q.latency(x, "enqueued_time", "ingest_time", ["message_type"], 300)


_EXPECTED = ["click", "error", "purchase", "signup", "view", "refund"]


@query(
    "dq_coverage",
    "WITH a AS (SELECT " + ", ".join(f"count(CASE WHEN message_type = '{v}' THEN 1 END) AS c{i}" for i, v in enumerate(_EXPECTED)) + " FROM feed)\n"
    + " UNION ALL ".join(f"SELECT '{v}' AS expected_value, c{i} AS row_count, c{i} > 0 AS covered FROM a" for i, v in enumerate(_EXPECTED)),
    ("feed",),
)
def dq_coverage(spark, sf):
    """Q-18: expected message types present in the feed."""
    return Q.coverage(fx.feed(spark, sf), "message_type", _EXPECTED)


@query(
    "metric_recon",
    """WITH g AS (SELECT l_returnflag, sum(l_extendedprice) AS gross, sum(l_extendedprice * l_discount) AS discount,
       round(sum(l_extendedprice * (1 - l_discount)), 0) AS reported_net, round(sum(l_extendedprice * l_discount) * 100 / sum(l_extendedprice), 1) AS reported_discount_pct
  FROM lineitem GROUP BY l_returnflag),
x AS (SELECT l_returnflag, 'net_revenue' AS metric, round(CAST(reported_net AS DOUBLE), 4) AS reported_value, round(CAST(gross - discount AS DOUBLE), 4) AS recomputed_value FROM g
      UNION ALL SELECT l_returnflag, 'discount_pct', round(CAST(reported_discount_pct AS DOUBLE), 4), round(CAST(discount * 100 / gross AS DOUBLE), 4) FROM g)
SELECT l_returnflag, metric, reported_value, recomputed_value, round(recomputed_value - reported_value, 4) AS difference,
       abs(round(recomputed_value - reported_value, 4)) <= 0.5 AS matches
FROM x""",
)
def metric_recon(spark, sf):
    """Reported (rounded) metrics recomputed from their formulas, compared under a tolerance."""
    li = fx.load(spark, sf, "lineitem")
    g = li.groupBy("l_returnflag").agg(
        F.sum("l_extendedprice").alias("gross"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("reported_net"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) * 100 / F.sum("l_extendedprice"), 1).alias("reported_discount_pct"),
    )
    r = Q.reconcile_metrics(
        g,
        {"net_revenue": "gross - discount", "discount_pct": "discount * 100 / gross"},
        {"net_revenue": "reported_net", "discount_pct": "reported_discount_pct"},
        tolerance=0.5,
    )
    return r.select("l_returnflag", "metric", "reported_value", "recomputed_value", "difference", "matches")


@query(
    "layer_count_match",
    """WITH u AS (SELECT 0 AS layer_order, 'source' AS layer, CAST(year(o_orderdate) AS VARCHAR) AS period FROM src_orders
  UNION ALL SELECT 1, 'target', CAST(year(o_orderdate) AS VARCHAR) FROM tgt_orders
  UNION ALL SELECT 2, 'third', CAST(year(o_orderdate) AS VARCHAR) FROM third_orders),
g AS (SELECT layer_order, layer, period, count(*) AS row_count FROM u GROUP BY 1, 2, 3),
b AS (SELECT *, CAST(coalesce(max(CASE WHEN layer_order = 0 THEN row_count END) OVER (PARTITION BY period), 0) AS BIGINT) AS base_count FROM g)
SELECT layer, period, row_count, base_count, CAST(greatest(base_count - row_count, 0) AS BIGINT) AS missing_rows,
       CAST(greatest(row_count - base_count, 0) AS BIGINT) AS extra_rows FROM b""",
    ("src_orders", "tgt_orders", "third_orders"),
)
def layer_count_match(spark, sf):
    """Rows per layer and order year against the source layer."""
    layers = {"source": fx.src_orders(spark, sf), "target": fx.tgt_orders(spark, sf), "third": fx.third_orders(spark, sf)}
    return Q.count_match(layers, F.year("o_orderdate"))


# Scores of the rating stream by quote; the silver rows parsed from the payload hold what the pipeline carried along.
_SILVER = """SELECT p.mqs_quote_id, p.event_ts, p.status, p.event_id, CASE WHEN p.event_id % 23 = 0 THEN NULL WHEN p.event_id % 19 = 0 THEN -1 ELSE e.value END AS score
FROM flow_parsed p JOIN events e ON e.event_id = p.event_id"""
_CARRIED = f"""WITH s AS ({_SILVER}), b AS (SELECT CAST(user_id AS VARCHAR) AS k, ts, event_id, value FROM events WHERE event_id % 3 <> 0),
u AS (SELECT mqs_quote_id AS k, event_ts AS t, 1 AS r, event_id AS o, CAST(NULL AS DOUBLE) AS v, status, score FROM s
  UNION ALL SELECT k, ts, 0, event_id, value, NULL, NULL FROM b),
w AS (SELECT *, max(CASE WHEN r = 0 THEN {{'t': t, 'o': o, 'v': v}} END) OVER (PARTITION BY k ORDER BY t, r, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM u)
SELECT o AS event_id, k AS mqs_quote_id, status, score, last.v AS expected,
  CASE WHEN last IS NULL AND score IS NOT NULL THEN 'UNKNOWN' WHEN score IS NOT DISTINCT FROM last.v THEN 'MATCH' ELSE 'STALE' END AS verdict
FROM w WHERE r = 1"""


@query("dq_carry_forward", _CARRIED, ("flow_parsed",))
def dq_carry_forward(spark, sf):
    """Q-20: the score that each parsed silver row holds against the last one its quote had by then (as-of compare)."""
    from tidemark.operators.monitor import parse_flow

    e = fx.load(spark, sf, "events")
    states = e.where(F.col("event_id") % 3 != 0).select(F.col("user_id").cast("string").alias("mqs_quote_id"), F.col("ts").alias("event_ts"), "event_id", "value")
    score = F.when(F.col("event_id") % 23 == 0, F.lit(None)).when(F.col("event_id") % 19 == 0, F.lit(-1.0)).otherwise(F.col("value"))
    silver = parse_flow(fx.flow(spark, sf)).join(e.select("event_id", "value"), "event_id").select("event_id", "mqs_quote_id", "event_ts", "status", score.alias("score"))
    out = Q.carried_forward(silver, states, "mqs_quote_id", "event_ts", "value", "event_id", "score")
    return out.select("event_id", "mqs_quote_id", "status", "score", "expected", "verdict")


@query(
    "field_mapping",
    """SELECT p.event_id, p.status IS DISTINCT FROM s.status AS status_differs, p.mqs_quote_id IS DISTINCT FROM s.quote AS quote_differs, p.brand IS DISTINCT FROM s.brand AS brand_differs
FROM flow_parsed p JOIN (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN lower(status) ELSE status END AS status, mqs_quote_id AS quote, CASE WHEN event_id % 37 = 0 THEN NULL ELSE brand END AS brand FROM flow_parsed) s
ON p.event_id = s.event_id WHERE p.event_id % 31 = 0 AND p.status <> lower(p.status) OR p.event_id % 37 = 0""",
    ("flow_parsed",),
)
def field_mapping(spark, sf):
    """Q-20: payload fields against the columns that a silver table keeps of them, by the keyed compare."""
    from tidemark.operators.monitor import parse_flow
    from tidemark.operators.recon import KeyedCompare

    bronze = parse_flow(fx.flow(spark, sf)).select("event_id", "status", "mqs_quote_id", "brand")
    k = F.col("event_id")
    silver = bronze.select("event_id", F.when(k % 31 == 0, F.lower("status")).otherwise(F.col("status")).alias("status"), "mqs_quote_id", F.when(k % 37 != 0, F.col("brand")).alias("brand"))
    found = KeyedCompare(bronze, silver, "event_id", ["status", "mqs_quote_id", "brand"]).mismatches()
    has = lambda c: F.max((F.col("column_name") == c).cast("int")) == 1
    names = (("status", "status_differs"), ("mqs_quote_id", "quote_differs"), ("brand", "brand_differs"))
    return found.groupBy(F.col("key").cast("long").alias("event_id")).agg(*[has(c).alias(n) for c, n in names])
