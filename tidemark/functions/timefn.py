"""Time helpers: typed literals, slot floors, slot spines (M1, M2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ts_lit(value) -> Column:
    """TIMESTAMP_NTZ literal from a string or naive datetime (no session-time-zone shift)."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.lit(str(value)).cast("timestamp_ntz")


def date_lit(value) -> Column:
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.strftime("%Y-%m-%d")
    return F.to_date(F.lit(str(value)[:10]))


def step(minutes: int) -> Column:
    return F.expr(f"INTERVAL {int(minutes)} MINUTES")


def slot_floor(ts: Column, minutes: int = 30) -> Column:
    """M2: start of the tumbling slot a timestamp falls in (epoch-aligned)."""
    return F.window(ts, f"{int(minutes)} minutes").start


def slots(spark: SparkSession, start, end, minutes: int = 30) -> DataFrame:
    """M1: ``(interval_start, interval_end, run_date)`` for every slot in ``[start, end)``.

    Empty when ``end <= start`` instead of failing like ``sequence`` does (X11).
    """
    s, e = ts_lit(start), ts_lit(end)
    bounds = spark.range(1).select(s.alias("s"), e.alias("e"))
    return slots_from_bounds(bounds, "s", "e", minutes)


def slots_from_bounds(bounds: DataFrame, start_col: str, end_col: str, minutes: int = 30) -> DataFrame:
    """M1 over a bounds frame (any number of rows, e.g. one per partition of work)."""
    st = step(minutes)
    s, e = F.col(start_col), F.col(end_col)
    return (
        bounds.select(explode_slots(s, e, minutes).alias("interval_start"))
        .select("interval_start", (F.col("interval_start") + st).alias("interval_end"), F.to_date("interval_start").alias("run_date"))
    )


def explode_slots(start: Column, end: Column, minutes: int = 30) -> Column:
    """Slot starts in ``[start, end)``; the guard sits inside the expression so constant
    folding of literal bounds never evaluates an invalid ``sequence`` (X11)."""
    st = step(minutes)
    return F.explode(F.when(end > start, F.sequence(start, end - st, st)))


def day_bounds(df: DataFrame, ts_col: str):
    """Whole-day bounds covering a timestamp column: ``(first midnight, midnight after the last row)``.

    One tiny aggregate collected to the driver (two scalars), like the reference's bounds query.
    """
    r = df.agg(
        F.date_trunc("day", F.min(ts_col)).alias("s"),
        (F.date_trunc("day", F.max(ts_col)) + F.expr("INTERVAL 1 DAY")).alias("e"),
    ).first()
    return r["s"], r["e"]
