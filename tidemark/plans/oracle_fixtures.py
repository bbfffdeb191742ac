"""DuckDB twins of ``tidemark.sources.fixtures`` as CTE fragments.

``with_fixtures(body, *names)`` prefixes a query with the CTEs it needs (and their
dependencies), so every oracle query reads only the driver's pre-registered views.
"""

from __future__ import annotations

FIXTURE_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "src_orders": (
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
        (),
    ),
    "tgt_orders": (
        """SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 31 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 89 = 0""",
        (),
    ),
    "third_orders": ("SELECT * FROM tgt_orders WHERE o_orderkey % 7 <> 0", ("tgt_orders",)),
    "feed": (
        """SELECT event_id, ts AS enqueued_time, CAST(ts AS DATE) AS queued_date, event_type AS message_type,
  CASE WHEN user_id % 4 IN (0, 1) THEN 'B1' WHEN user_id % 4 = 2 THEN 'B2'
       WHEN event_id % 2 = 0 THEN 'ZZ' ELSE NULL END AS brand_raw, value, props
FROM events""",
        (),
    ),
    "bronze_feed": ("SELECT * FROM feed WHERE event_id % 7 <> 0", ("feed",)),
    "flow": (
        """SELECT event_id, CAST(ts AS DATE) AS queued_date,
  '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","interaction":' ||
  CAST(json_object(
    'status', ['QUOTED', 'BOUND', 'DECLINED'][CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 + 1 AS INTEGER)],
    'mqsQuoteId', CAST(user_id AS VARCHAR),
    '_id', CAST(event_id AS VARCHAR),
    'brandName', CASE user_id % 5 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' WHEN 2 THEN 'Gamma' END,
    'generationCode', CASE WHEN user_id % 5 = 3 THEN ['G1', 'G2', 'G9'][CAST(event_id % 3 + 1 AS INTEGER)] END
  ) AS VARCHAR) || '}' AS payload
FROM events""",
        (),
    ),
    "registry": (
        """SELECT ts AS enqueued_time, CAST(user_id AS VARCHAR) AS mqs_quote_id, CAST(event_id AS VARCHAR) AS interaction_id
FROM events WHERE event_id % 5 <> 0""",
        (),
    ),
    "bool_orders": (
        """SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN 't' WHEN o_orderstatus = 'O' THEN 'f' END AS o_isfinal,
  CASE WHEN o_orderstatus = 'F' THEN 'T' WHEN o_orderstatus = 'O' THEN 'f' ELSE 'f' END AS o_flag_upper,
  CASE WHEN o_orderstatus = 'F' THEN 't' END AS o_t_only, CAST(NULL AS VARCHAR) AS o_unused,
  o_orderstatus, o_orderpriority
FROM orders""",
        (),
    ),
    "typed_target": (
        "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderdate, o_orderpriority FROM tgt_orders",
        ("tgt_orders",),
    ),
    "decimal_lineitem": (
        "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(15,2)) AS l_extendedprice, CAST(l_discount AS DECIMAL(4,2)) AS l_discount, l_quantity FROM lineitem",
        (),
    ),
    "val_source": (
        """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 't' WHEN o_orderstatus = 'O' THEN 'f' END AS o_isfinal,
  o_totalprice, o_orderdate, o_orderpriority, 'note-' || CAST(o_custkey AS VARCHAR) AS o_note FROM orders""",
        (),
    ),
    "val_target": (
        """WITH t AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS o_isfinal,
  CAST(CASE WHEN o_orderkey % 37 = 0 THEN o_totalprice + 0.01 ELSE o_totalprice END AS DECIMAL(12,2)) AS o_totalprice,
  o_orderdate, o_orderpriority, o_orderdate AS azure_load_date, o_custkey % 10 AS o_target_only FROM orders)
SELECT * FROM t UNION ALL SELECT * FROM t WHERE o_orderkey % 50 = 0""",
        (),
    ),
    "run_results": (
        """SELECT strftime(queued_date, '%Y%m%d') AS run_id, table_name, src_count, tgt_count,
  CASE WHEN src_count = tgt_count THEN 'PASS' WHEN tgt_count * 10 >= src_count * 9 THEN 'WARN' ELSE 'FAIL' END AS status
FROM (SELECT queued_date, message_type AS table_name, count(*) AS src_count,
             count(CASE WHEN event_id % 7 <> 0 THEN 1 END) AS tgt_count
      FROM feed GROUP BY queued_date, message_type)""",
        ("feed",),
    ),
}


def register(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    FIXTURE_SQL[name] = (sql, deps)


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in FIXTURE_SQL[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with the fixture CTEs; a body that starts with its own
    ``WITH`` has its CTEs appended after the fixtures."""
    body = body.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS (\n{FIXTURE_SQL[n][0]}\n)" for n in _order(names))
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
