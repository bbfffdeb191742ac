"""Exact quantiles by selection, for all groups, columns and ranks at once (A14, Q-17).

Spark's exact ``percentile`` merges a whole group's value -> count map in one task. Here the wanted ranks are
narrowed down instead: a group's values lie in one interval first; a round cuts every interval that holds a wanted rank
into equal bins, counts the values of each bin (combined map-side: a bin is one row however many values it holds), and
goes on with the bin in which the rank falls, shrunk to the least and greatest value found in it.
After the rounds a rank's bin holds one value, or about ``bins ** -rounds`` of the group's range (more rounds suit
groups of over 10**12 values); its distinct
values are then counted and the rank is read off. Every step is exact, whatever the distribution (a bin that
holds too much costs time, not correctness). One lazy plan of ``rounds`` + 2 scans: no job while it is built, no Python worker, no
hint: the frames of bins and ranks have some rows a group, and adaptive execution sees their size.

A quantile is interpolated between the two ranks around ``p * (n - 1)``, which is exactly what ``percentile`` / SQL
``quantile_cont`` return. NULL, NaN and infinite values are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, value_cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), bins: int = 1 << 14, rounds: int = 1) -> DataFrame:
    """Rows ``(*by, column_name, prob, quantile)``."""
    number = lambda c: F.col(f"`{c}`").cast("double")
    usable = lambda c: F.when((number(c) > float("-inf")) & (number(c) < float("inf")), number(c))  # noqa: E731  (NaN is above infinity)
    pairs = F.array(*[F.struct(F.lit(i).alias("col"), usable(c).alias("value")) for i, c in enumerate(value_cols)])
    values = df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*").where("value IS NOT NULL")
    group = [*by, "col"]

    # One interval a group, and the ranks wanted of it: floor and ceiling of p * (n - 1).
    wide = df.groupBy(*by).agg(*[f(usable(c)).alias(f"{n}{i}") for i, c in enumerate(value_cols) for f, n in ((F.count, "n"), (F.min, "lo"), (F.max, "hi"))])
    each = F.array(*[F.struct(F.lit(i).alias("col"), *[F.col(f"{n}{i}").alias(n) for n in ("n", "lo", "hi")]) for i, _ in enumerate(value_cols)])
    whole = wide.select(*by, F.explode(each).alias("p")).select(*by, "p.*").where("n > 0")
    at = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    asked = whole.select(*group, "n", "lo", "hi", at).withColumn("x", F.col("prob") * (F.col("n") - 1))
    aims = asked.select(*group, "prob", "x", "lo", "hi", F.lit(0).cast("long").alias("below"), F.explode(F.array_distinct(F.array(F.floor("x"), F.ceil("x")))).alias("rank"))
    for _ in range(rounds):
        # Halves keep the width finite; values and bins rise together, since every step is monotonous.
        part = f"IF(lo = hi, 0, least({bins - 1}, CAST(floor((value / 2 - lo / 2) / (hi / 2 - lo / 2) * {bins}) AS INT))) AS part"
        cells = _inside(values, aims, group).selectExpr(*[f"`{c}`" for c in group], "below", "value", part)
        found = cells.groupBy(*group, "below", "part").agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("least"), F.max("value").alias("most"))
        aims = _aimed(aims, found, group, "part")
    counted = _inside(values, aims, group).groupBy(*group, "below", "value").agg(F.count(F.lit(1)).alias("c"))
    picked = _aimed(aims, counted.withColumn("least", F.col("value")).withColumn("most", F.col("value")), group, "value")
    value = lambda r: F.max(F.when(F.col("rank") == r(F.col("x")), F.col("lo")))
    ends = picked.groupBy(*group, "prob", "x").agg(value(F.floor).alias("v0"), value(F.ceil).alias("v1"))
    names = F.array(*[F.lit(c) for c in value_cols])
    return ends.select(*by, names[F.col("col")].alias("column_name"), "prob", (F.col("v0") + (F.col("x") - F.floor("x")) * (F.col("v1") - F.col("v0"))).alias("quantile"))


def _same(a: str, b: str, names: Sequence[str]):
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return cond


def _inside(values: DataFrame, aims: DataFrame, group: Sequence[str]) -> DataFrame:
    """Values within the intervals of some rank, with the interval. Intervals of a group don't overlap, and differ in ``below``."""
    spans = aims.select(*group, "lo", "hi", "below").distinct()
    j = values.alias("v").join(spans.alias("a"), _same("v", "a", group) & (F.col("v.value") >= F.col("a.lo")) & (F.col("v.value") <= F.col("a.hi")))
    return j.select(*[F.col(f"v.{c}").alias(c) for c in group], "a.lo", "a.hi", "a.below", "v.value")


def _aimed(aims: DataFrame, found: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Every rank with the part of its interval it falls in: ``found`` has the parts' counts ``c`` and bounds, in rising ``order``."""
    span = [*group, "below"]
    before = Window.partitionBy(*span).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = found.withColumn("start", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
    j = aims.alias("a").join(parts.alias("f"), _same("a", "f", span) & (F.col("a.rank") >= F.col("f.start")) & (F.col("a.rank") < F.col("f.start") + F.col("f.c")))
    return j.select(*[F.col(f"a.{c}").alias(c) for c in group], "a.prob", "a.x", F.col("f.least").alias("lo"), F.col("f.most").alias("hi"), F.col("f.start").alias("below"), "a.rank")
