"""Dashboard widgets and streak windows over the monitoring facts.

Parameters are bound to the whole data range (first to last run date) and the
fixture brands, so every widget reads the whole fact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.windows import breach_streak as breach_streak_op
from tidemark.operators.windows import previous_max, running_sum
from tidemark.plans import sqlgen as G
from tidemark.plans import widgets as W
from tidemark.plans.oracle_fixtures import register
from tidemark.plans.q_monitor import bounds, bronze_fact, feed_fact, interaction_fact
from tidemark.plans.registry import query

BR = "'B1', 'B2'"
DATES = "run_date BETWEEN (SELECT CAST(ws AS DATE) FROM fbounds) AND (SELECT CAST(we AS DATE) - 1 FROM fbounds)"
SCOPE = f"{DATES} AND brand IN ({BR})"


def args(spark, sf) -> W.WidgetArgs:
    s, e = bounds(spark, sf)
    return W.WidgetArgs(start_date=s.date().isoformat(), end_date=(e - dt.timedelta(days=1)).date().isoformat())


def _pct(num: str, den: str) -> str:
    return G.pct_round(num, den)


def _health_sql(src: str, source: str, measure: str, cond: str) -> str:
    return f"""SELECT '{source}' AS source, count(DISTINCT interval_end) AS total_intervals,
  count(DISTINCT CASE WHEN is_sla_breach = 1 THEN interval_end END) AS breached_intervals,
  CAST(sum({measure}) AS BIGINT) AS total_messages,
  {_pct('count(CASE WHEN is_sla_breach = 0 THEN 1 END)', 'count(*)')} AS health_pct,
  max(interval_end) AS latest_interval
FROM {src} WHERE {SCOPE} AND {cond}"""


_W1 = f"""SELECT source, total_intervals, breached_intervals, total_intervals - breached_intervals AS healthy_intervals,
  total_messages, health_pct,
  CASE WHEN health_pct >= 95 THEN 'OK' WHEN health_pct >= 80 THEN 'MINOR' WHEN health_pct >= 60 THEN 'MEDIUM' ELSE 'HIGH' END AS alert_level,
  latest_interval
FROM ({_health_sql('feed_fact', 'EHUB', 'message_count', "message_type <> 'ALL'")}
      UNION ALL {_health_sql('bronze_fact', 'BRONZE', 'message_count', "message_type <> 'ALL'")}
      UNION ALL {_health_sql('interaction_fact', 'INTERACTION', 'total_count', "status = 'ALL'")})"""


@query("w1_system_health", _W1, ("feed_fact", "bronze_fact", "interaction_fact", "fbounds"))
def w1(spark, sf):
    return W.w1_system_health(feed_fact(spark, sf), bronze_fact(spark, sf), interaction_fact(spark, sf), args(spark, sf))


register(
    "w_iv",
    f"""SELECT interval_end, brand, count(DISTINCT message_type) AS total_types,
  count(DISTINCT CASE WHEN is_sla_breach = 1 THEN message_type END) AS breached_types,
  CAST(sum(message_count) AS BIGINT) AS total_count,
  max(CASE WHEN is_sla_breach = 1 THEN 1 ELSE 0 END) AS any_breach
FROM feed_fact WHERE {SCOPE} AND message_type <> 'ALL' GROUP BY interval_end, brand""",
    ("feed_fact", "fbounds"),
)

_W2 = f"""WITH {G.streak_ref_ctes('w_iv', 'brand', 'breached_types = total_types', 'consecutive_zeros', 'z')},
lv AS (SELECT *, greatest(
    CASE WHEN breached_types >= 3 THEN 3 WHEN breached_types >= 2 THEN 2 WHEN breached_types >= 1 THEN 1 ELSE 0 END,
    CASE WHEN consecutive_zeros >= 4 THEN 3 WHEN consecutive_zeros >= 2 THEN 2 WHEN consecutive_zeros >= 1 THEN 1 ELSE 0 END) AS alert_level_num FROM z2)
SELECT interval_end, strftime(interval_end, '%H:%M') AS interval_time, brand, total_types, breached_types, total_count, any_breach,
  consecutive_zeros, alert_level_num,
  CASE alert_level_num WHEN 0 THEN 'OK' WHEN 1 THEN 'MINOR' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' END AS alert_level
FROM lv"""


@query("w2_alert_by_slot", _W2, ("w_iv",))
def w2(spark, sf):
    return W.w2_alert_by_slot(feed_fact(spark, sf), args(spark, sf))


def _detail_sql(src: str, series: str, measure: str) -> str:
    return f"""WITH base AS (SELECT * FROM {src} WHERE {SCOPE} AND {series} <> 'ALL'),
{G.streak_ref_ctes('base', f'brand, {series}', 'is_sla_breach = 1', 'consecutive_breach', 'd')}
SELECT interval_end, strftime(interval_end, '%H:%M') AS interval_time, brand, {series}, {measure}, is_sla_breach, consecutive_breach,
  CASE WHEN is_sla_breach = 0 THEN 'OK' WHEN consecutive_breach >= 4 THEN 'HIGH' WHEN consecutive_breach >= 2 THEN 'MEDIUM' ELSE 'MINOR' END AS alert_level
FROM d2"""


@query("w3_type_detail", _detail_sql("feed_fact", "message_type", "message_count"), ("feed_fact", "fbounds"))
def w3(spark, sf):
    return W.w3_type_detail(feed_fact(spark, sf), args(spark, sf))


@query("w4_bronze_detail", _detail_sql("bronze_fact", "message_type", "message_count"), ("bronze_fact", "fbounds"))
def w4(spark, sf):
    return W.w4_bronze_detail(bronze_fact(spark, sf), args(spark, sf))


@query("w5_status_detail", _detail_sql("interaction_fact", "status", "total_count"), ("interaction_fact", "fbounds"))
def w5(spark, sf):
    return W.w5_status_detail(interaction_fact(spark, sf), args(spark, sf))


_W6 = f"""WITH r1 AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY interval_end) AS __rn FROM w_iv),
r2 AS (SELECT *, CASE WHEN breached_types = total_types THEN __rn - MAX(CASE WHEN NOT (breached_types = total_types) THEN __rn END)
          OVER (PARTITION BY brand ORDER BY interval_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE 0 END AS consecutive_zeros FROM r1),
k AS (SELECT count(DISTINCT interval_end) AS total_intervals,
  count(DISTINCT CASE WHEN breached_types > 0 THEN interval_end END) AS breached_intervals,
  CAST(max(greatest(0, consecutive_zeros)) AS BIGINT) AS max_consecutive_zeros,
  max(breached_types) AS max_breached_types,
  CAST(sum(total_count) AS BIGINT) AS total_messages,
  {_pct('count(CASE WHEN breached_types = 0 THEN 1 END)', 'count(*)')} AS overall_health_pct
  FROM r2)
SELECT *, CASE WHEN max_breached_types >= 3 OR max_consecutive_zeros >= 4 THEN 'HIGH'
               WHEN max_breached_types >= 2 OR max_consecutive_zeros >= 2 THEN 'MEDIUM'
               WHEN max_breached_types >= 1 OR max_consecutive_zeros >= 1 THEN 'MINOR' ELSE 'OK' END AS overall_alert_level
FROM k"""


@query("w6_kpi_summary", _W6, ("w_iv",))
def w6(spark, sf):
    return W.w6_kpi_summary(feed_fact(spark, sf), args(spark, sf))


_W7 = f"""SELECT interval_end, strftime(interval_end, '%H:%M') AS interval_time, brand, CAST(sum(message_count) AS BIGINT) AS total_count,
  count(DISTINCT CASE WHEN is_sla_breach = 1 THEN message_type END) AS breached_types,
  count(DISTINCT message_type) AS total_types,
  {_pct('count(CASE WHEN is_sla_breach = 0 THEN 1 END)', 'count(*)')} AS health_pct,
  max(is_sla_breach) AS any_breach
FROM feed_fact WHERE {SCOPE} AND message_type <> 'ALL' GROUP BY interval_end, brand"""


@query("w7_brand_comparison", _W7, ("feed_fact", "fbounds"))
def w7(spark, sf):
    return W.w7_brand_comparison(feed_fact(spark, sf), args(spark, sf))


_W8 = f"""SELECT *, CASE WHEN breach_pct >= 50 THEN 'HIGH' WHEN breach_pct >= 20 THEN 'MEDIUM' WHEN breach_pct > 0 THEN 'MINOR' ELSE 'OK' END AS alert_level
FROM (SELECT brand, message_type, count(*) AS total_intervals, CAST(sum(is_sla_breach) AS BIGINT) AS breach_count,
        {_pct('sum(is_sla_breach)', 'count(*)')} AS breach_pct, CAST(sum(message_count) AS BIGINT) AS total_messages
      FROM feed_fact WHERE {SCOPE} AND message_type <> 'ALL' GROUP BY brand, message_type)"""


@query("w8_top_breaches", _W8, ("feed_fact", "fbounds"))
def w8(spark, sf):
    return W.w8_top_breaches(feed_fact(spark, sf), args(spark, sf))


_W9 = f"""SELECT interval_end, strftime(interval_end, '%H:%M') AS interval_time, message_type, message_count, is_unexpected_brand
FROM feed_fact WHERE {DATES} AND brand = 'OTHER' AND message_count > 0
ORDER BY interval_end DESC, message_count DESC, message_type LIMIT 100"""


@query("w9_unexpected", _W9, ("feed_fact", "fbounds"))
def w9(spark, sf):
    return W.w9_unexpected(feed_fact(spark, sf), args(spark, sf))


register(
    "alert_state",
    f"""WITH base AS (SELECT *, CASE WHEN is_sla_breach = 1 THEN 'BREACH' ELSE 'HEALTHY' END AS status FROM feed_fact),
{G.streak_fix_ctes('base', 'brand, message_type', 'is_sla_breach = 1', 'streak', 'a')},
a3 AS (SELECT *, lag(status) OVER (PARTITION BY brand, message_type ORDER BY interval_end) AS prev_status FROM a2)
SELECT brand || ':' || message_type AS alert_name, arg_max(status, interval_end) AS current_status,
  arg_max(prev_status, interval_end) AS notified_status, CAST(arg_max(streak, interval_end) AS BIGINT) AS consecutive_count,
  max(interval_end) AS last_interval, max(CASE WHEN is_sla_breach = 1 THEN interval_end END) AS last_notified_at
FROM a3 GROUP BY brand, message_type""",
    ("feed_fact",),
)


@query(
    "w10_alert_history",
    """SELECT *, CASE current_status WHEN 'BREACH' THEN 'HIGH' WHEN 'HEALTHY' THEN 'OK' ELSE 'UNKNOWN' END AS alert_level
FROM alert_state ORDER BY last_notified_at DESC""",
    ("alert_state",),
)
def w10(spark, sf):
    return W.w10_alert_history(W.alert_state(feed_fact(spark, sf)))


@query(
    "window_running_sum",
    """SELECT brand, message_type, interval_start, message_count,
  CAST(sum(message_count) OVER (PARTITION BY brand, message_type ORDER BY interval_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_count
FROM feed_fact""",
    ("feed_fact",),
)
def window_running_sum(spark, sf):
    """Running message count per series."""
    f = feed_fact(spark, sf).select("brand", "message_type", "interval_start", "message_count")
    return running_sum(f, ["brand", "message_type"], ["interval_start"], "message_count", "running_count").withColumn(
        "running_count", F.col("running_count").cast("long")
    )


@query(
    "window_prev_max",
    """SELECT brand, message_type, interval_start, message_count,
  max(message_count) OVER (PARTITION BY brand, message_type ORDER BY interval_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_max
FROM feed_fact""",
    ("feed_fact",),
)
def window_prev_max(spark, sf):
    """Maximum of the strictly preceding slots."""
    f = feed_fact(spark, sf).select("brand", "message_type", "interval_start", "message_count")
    return previous_max(f, ["brand", "message_type"], ["interval_start"], "message_count", "previous_max")


@query(
    "breach_streak",
    f"""WITH base AS (SELECT brand, message_type, interval_end, is_sla_breach FROM feed_fact),
{G.streak_fix_ctes('base', 'brand, message_type', 'is_sla_breach = 1', 'breach_streak', 'b')}
SELECT brand, message_type, interval_end, is_sla_breach, breach_streak FROM b2""",
    ("feed_fact",),
)
def breach_streak(spark, sf):
    """Corrected gaps-and-islands streak."""
    f = feed_fact(spark, sf).select("brand", "message_type", "interval_end", "is_sla_breach")
    return breach_streak_op(f, ["brand", "message_type"], ["interval_end"], F.col("is_sla_breach") == 1, "breach_streak").withColumn(
        "breach_streak", F.col("breach_streak").cast("long")
    )
