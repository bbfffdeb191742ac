"""Dashboard widgets V1-V10 as DataFrame plans over the monitoring facts.

Each widget takes the fact frame(s) and its parameters (date range, brand list,
thresholds) explicitly. The facts are already aggregated per slot, so the windows
here run over ``slots x types x brands`` rows, partitioned by series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timefn import date_lit
from tidemark.operators.windows import breach_streak, pct_round, streak_reference, streak_rownum


@dataclass(frozen=True)
class WidgetArgs:
    start_date: str
    end_date: str
    brands: tuple[str, ...] = ("B1", "B2")
    high_threshold: int = 3
    medium_threshold: int = 2
    minor_threshold: int = 1


def _scope(df: DataFrame, a: WidgetArgs, type_col: str = "message_type", keep_all: bool = False) -> DataFrame:
    cond = F.col("run_date").between(date_lit(a.start_date), date_lit(a.end_date)) & F.col("brand").isin(list(a.brands))
    cond = cond & ((F.col(type_col) == "ALL") if keep_all else (F.col(type_col) != "ALL"))
    return df.where(cond)


def _hhmm(c: str = "interval_end") -> Column:
    return F.date_format(c, "HH:mm").alias("interval_time")


def _level_by_pct(h: Column) -> Column:
    return F.when(h >= 95, "OK").when(h >= 80, "MINOR").when(h >= 60, "MEDIUM").otherwise("HIGH")


def _health(df: DataFrame, source: str, measure: str) -> DataFrame:
    breach = F.col("is_sla_breach") == 1
    return df.agg(
        F.lit(source).alias("source"),
        F.countDistinct("interval_end").alias("total_intervals"),
        F.countDistinct(F.when(breach, F.col("interval_end"))).alias("breached_intervals"),
        F.sum(measure).cast("long").alias("total_messages"),
        pct_round(F.count(F.when(F.col("is_sla_breach") == 0, 1)), F.count(F.lit(1))).alias("health_pct"),
        F.max("interval_end").alias("latest_interval"),
    )


def w1_system_health(feed: DataFrame, bronze: DataFrame, interaction: DataFrame, a: WidgetArgs) -> DataFrame:
    """V1: health per source (three aggregates, UNION ALL), level 95/80/60."""
    u = (
        _health(_scope(feed, a), "EHUB", "message_count")
        .unionByName(_health(_scope(bronze, a), "BRONZE", "message_count"))
        .unionByName(_health(_scope(interaction, a, "status", keep_all=True), "INTERACTION", "total_count"))
    )
    return u.select(
        "source",
        "total_intervals",
        "breached_intervals",
        (F.col("total_intervals") - F.col("breached_intervals")).alias("healthy_intervals"),
        "total_messages",
        "health_pct",
        _level_by_pct(F.col("health_pct")).alias("alert_level"),
        "latest_interval",
    )


def _per_slot_brand(feed: DataFrame, a: WidgetArgs) -> DataFrame:
    breach = F.col("is_sla_breach") == 1
    return _scope(feed, a).groupBy("interval_end", "brand").agg(
        F.countDistinct("message_type").alias("total_types"),
        F.countDistinct(F.when(breach, F.col("message_type"))).alias("breached_types"),
        F.sum("message_count").cast("long").alias("total_count"),
        F.max(F.when(breach, 1).otherwise(0)).alias("any_breach"),
    )


def _level_num(c: Column, a: WidgetArgs) -> Column:
    return F.when(c >= a.high_threshold, 3).when(c >= a.medium_threshold, 2).when(c >= a.minor_threshold, 1).otherwise(0)


def _consec_level(c: Column) -> Column:
    return F.when(c >= 4, 3).when(c >= 2, 2).when(c >= 1, 1).otherwise(0)


def _level_name(c: Column) -> Column:
    return F.when(c == 0, "OK").when(c == 1, "MINOR").when(c == 2, "MEDIUM").when(c == 3, "HIGH")


def w2_alert_by_slot(feed: DataFrame, a: WidgetArgs) -> DataFrame:
    """V2: breached types vs thresholds and the all-types-breached streak (reference form, X1)."""
    iv = _per_slot_brand(feed, a)
    flag = F.col("breached_types") == F.col("total_types")
    x = streak_reference(iv, ["brand"], ["interval_end"], flag, "consecutive_zeros")
    lvl = F.greatest(_level_num(F.col("breached_types"), a), _consec_level(F.col("consecutive_zeros")))
    return x.select(
        "interval_end",
        _hhmm(),
        "brand",
        "total_types",
        "breached_types",
        "total_count",
        "any_breach",
        F.col("consecutive_zeros").cast("long").alias("consecutive_zeros"),
        lvl.alias("alert_level_num"),
        _level_name(lvl).alias("alert_level"),
    )


def _detail(df: DataFrame, a: WidgetArgs, series: str, measure: str) -> DataFrame:
    x = streak_reference(_scope(df, a, series), ["brand", series], ["interval_end"], F.col("is_sla_breach") == 1, "consecutive_breach")
    cb = F.col("consecutive_breach")
    return x.select(
        "interval_end",
        _hhmm(),
        "brand",
        series,
        measure,
        "is_sla_breach",
        cb.cast("long").alias("consecutive_breach"),
        F.when(F.col("is_sla_breach") == 0, "OK").when(cb >= 4, "HIGH").when(cb >= 2, "MEDIUM").otherwise("MINOR").alias("alert_level"),
    )


def w3_type_detail(feed: DataFrame, a: WidgetArgs) -> DataFrame:
    """V3: per message type with breach streak (reference form)."""
    return _detail(feed, a, "message_type", "message_count")


def w4_bronze_detail(bronze: DataFrame, a: WidgetArgs) -> DataFrame:
    """V4: V3 on the bronze fact."""
    return _detail(bronze, a, "message_type", "message_count")


def w5_status_detail(interaction: DataFrame, a: WidgetArgs) -> DataFrame:
    """V5: per interaction status (excluding ALL) with streak; always OK by construction."""
    return _detail(interaction, a, "status", "total_count")


def w6_kpi_summary(feed: DataFrame, a: WidgetArgs) -> DataFrame:
    """V6: single-row KPI with the row-number streak form."""
    iv = _per_slot_brand(feed, a).withColumnRenamed("total_count", "total_messages")
    x = streak_rownum(iv, ["brand"], ["interval_end"], F.col("breached_types") == F.col("total_types"), "consecutive_zeros")
    cz = F.max(F.greatest(F.lit(0), F.col("consecutive_zeros"))).cast("long")
    mb = F.max("breached_types")
    k = x.agg(
        F.countDistinct("interval_end").alias("total_intervals"),
        F.countDistinct(F.when(F.col("breached_types") > 0, F.col("interval_end"))).alias("breached_intervals"),
        cz.alias("max_consecutive_zeros"),
        mb.alias("max_breached_types"),
        F.sum("total_messages").cast("long").alias("total_messages"),
        pct_round(F.count(F.when(F.col("breached_types") == 0, 1)), F.count(F.lit(1))).alias("overall_health_pct"),
    )
    m, c = F.col("max_breached_types"), F.col("max_consecutive_zeros")
    return k.withColumn(
        "overall_alert_level",
        F.when((m >= a.high_threshold) | (c >= 4), "HIGH")
        .when((m >= a.medium_threshold) | (c >= 2), "MEDIUM")
        .when((m >= a.minor_threshold) | (c >= 1), "MINOR")
        .otherwise("OK"),
    )


def w7_brand_comparison(feed: DataFrame, a: WidgetArgs) -> DataFrame:
    """V7: brand side by side per slot."""
    breach = F.col("is_sla_breach") == 1
    g = _scope(feed, a).groupBy("interval_end", "brand").agg(
        F.sum("message_count").cast("long").alias("total_count"),
        F.countDistinct(F.when(breach, F.col("message_type"))).alias("breached_types"),
        F.countDistinct("message_type").alias("total_types"),
        pct_round(F.count(F.when(F.col("is_sla_breach") == 0, 1)), F.count(F.lit(1))).alias("health_pct"),
        F.max("is_sla_breach").alias("any_breach"),
    )
    return g.select("interval_end", _hhmm(), "brand", "total_count", "breached_types", "total_types", "health_pct", "any_breach")


def w8_top_breaches(feed: DataFrame, a: WidgetArgs) -> DataFrame:
    """V8: breach frequency per (brand, type), levels 50/20/0."""
    g = _scope(feed, a).groupBy("brand", "message_type").agg(
        F.count(F.lit(1)).alias("total_intervals"),
        F.sum("is_sla_breach").cast("long").alias("breach_count"),
        pct_round(F.sum("is_sla_breach"), F.count(F.lit(1))).alias("breach_pct"),
        F.sum("message_count").cast("long").alias("total_messages"),
    )
    p = F.col("breach_pct")
    return g.withColumn("alert_level", F.when(p >= 50, "HIGH").when(p >= 20, "MEDIUM").when(p > 0, "MINOR").otherwise("OK")).orderBy(
        F.col("breach_pct").desc(), F.col("breach_count").desc()
    )


def w9_unexpected(feed: DataFrame, a: WidgetArgs, other: str = "OTHER", n: int = 100) -> DataFrame:
    """V9: latest ``n`` slots with unexpected-brand traffic (top-k; type breaks ties)."""
    f = feed.where(F.col("run_date").between(date_lit(a.start_date), date_lit(a.end_date)) & (F.col("brand") == other) & (F.col("message_count") > 0))
    return f.select("interval_end", _hhmm(), "message_type", "message_count", "is_unexpected_brand").orderBy(
        F.col("interval_end").desc(), F.col("message_count").desc(), F.col("message_type")
    ).limit(n)


def alert_state(feed: DataFrame) -> DataFrame:
    """Alert-state table per (brand, type) series: last status, the status before it,
    current corrected streak, last slot and last breach slot."""
    status = F.when(F.col("is_sla_breach") == 1, "BREACH").otherwise("HEALTHY")
    w = Window.partitionBy("brand", "message_type").orderBy("interval_end")
    x = breach_streak(feed.withColumn("status", status), ["brand", "message_type"], ["interval_end"], F.col("is_sla_breach") == 1, "streak")
    x = x.withColumn("prev_status", F.lag("status").over(w))
    g = x.groupBy("brand", "message_type").agg(
        F.max_by("status", "interval_end").alias("current_status"),
        F.max_by("prev_status", "interval_end").alias("notified_status"),
        F.max_by("streak", "interval_end").cast("long").alias("consecutive_count"),
        F.max("interval_end").alias("last_interval"),
        F.max(F.when(F.col("is_sla_breach") == 1, F.col("interval_end"))).alias("last_notified_at"),
    )
    return g.select(
        F.concat_ws(":", "brand", "message_type").alias("alert_name"),
        "current_status",
        "notified_status",
        "consecutive_count",
        "last_interval",
        "last_notified_at",
    )


def w10_alert_history(state: DataFrame) -> DataFrame:
    """Alert-state rows with the level map."""
    s = F.col("current_status")
    return state.select(
        "alert_name", "current_status", "notified_status", "consecutive_count", "last_interval", "last_notified_at",
        F.when(s == "BREACH", "HIGH").when(s == "HEALTHY", "OK").otherwise("UNKNOWN").alias("alert_level"),
    ).orderBy(F.col("last_notified_at").desc())
