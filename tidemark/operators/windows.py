"""Window operators (W1-W8): running sums, strictly-preceding maxima and breach streaks.

All streak forms partition by the monitored series, so each window task sees one
series of (already aggregated) slot rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(part: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*part).orderBy(*order)


def running_sum(df: DataFrame, part: Sequence[str], order: Sequence[str], col: str | Column, name: str = "running_sum") -> DataFrame:
    """``SUM(c) OVER (PARTITION BY .. ORDER BY .. ROWS UNBOUNDED PRECEDING..CURRENT ROW)``."""
    c = F.col(col) if isinstance(col, str) else col
    return df.withColumn(name, F.sum(c).over(_w(part, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def previous_max(df: DataFrame, part: Sequence[str], order: Sequence[str], col: str | Column, name: str = "previous_max") -> DataFrame:
    """Maximum over the strictly preceding rows (``..1 PRECEDING``); NULL on the first row."""
    c = F.col(col) if isinstance(col, str) else col
    return df.withColumn(name, F.max(c).over(_w(part, order).rowsBetween(Window.unboundedPreceding, -1)))


def streak_reference(df: DataFrame, part: Sequence[str], order: Sequence[str], flag: Column, name: str = "consecutive_breach") -> DataFrame:
    """W3/W4, reference-exact: running count of flagged rows minus its value at the last
    unflagged row strictly before (nested window split in two steps).

    Kept as the reference computes it, including the recovery-row quirk (X1).
    """
    w = _w(part, order)
    cs = "__cs"
    out = df.withColumn(cs, F.sum(F.when(flag, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    prev = F.max(F.when(~flag, F.col(cs))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn(name, F.greatest(F.lit(0), F.col(cs) - F.coalesce(prev, F.lit(0)))).drop(cs)


def streak_rownum(df: DataFrame, part: Sequence[str], order: Sequence[str], flag: Column, name: str = "consecutive_zeros") -> DataFrame:
    """W5, reference-exact row-number form: NULL when no unflagged row precedes."""
    w = _w(part, order)
    out = df.withColumn("__rn", F.row_number().over(w))
    prev = F.max(F.when(~flag, F.col("__rn"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn(name, F.when(flag, F.col("__rn") - prev).otherwise(F.lit(0))).drop("__rn")


def breach_streak(df: DataFrame, part: Sequence[str], order: Sequence[str], flag: Column, name: str = "breach_streak") -> DataFrame:
    """W6, corrected gaps-and-islands streak: length of the current run of flagged rows, 0 on unflagged rows."""
    w = _w(part, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("__grp", F.sum(F.when(flag, 0).otherwise(1)).over(w))
    w2 = Window.partitionBy(*part, "__grp").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn(name, F.when(flag, F.sum(F.when(flag, 1).otherwise(0)).over(w2)).otherwise(F.lit(0))).drop("__grp")


def first_n_per(df: DataFrame, part: Sequence[str], order: Sequence, n: int, name: str = "rank", salt: Column | None = None, buckets: int = 1024) -> DataFrame:
    """First ``n`` rows per group by a total order.

    With ``salt`` (a column spreading a group's rows, e.g. a hash of the row key)
    the selection is two-level and still exact: the first ``n`` of every
    (group, bucket) are kept, then the first ``n`` of the group among those
    ``n * buckets`` candidates. A hot group is therefore ranked by many tasks
    instead of being sorted whole in one.
    """
    if salt is not None:
        b = F.pmod(salt, F.lit(buckets))
        w1 = Window.partitionBy(*part, b).orderBy(*order)
        df = df.withColumn("__salt_rank", F.row_number().over(w1)).where(F.col("__salt_rank") <= n).drop("__salt_rank")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def pct_round(num: Column, den: Column, digits: int = 1) -> Column:
    """``ROUND(100 * num / NULLIF(den, 0), digits)`` with exact half-up rounding.

    Integer arithmetic (numerator and denominator are counts) avoids the double
    rounding of decimal or floating division; DuckDB oracles use the same formula.
    """
    scale = 10**digits
    n = num.cast("long")
    d = F.when(den.cast("long") == 0, F.lit(None).cast("long")).otherwise(den.cast("long"))
    return F.floor((n * (200 * scale) + d) / (d * 2)).cast("double") / scale
