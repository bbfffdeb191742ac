"""Set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` not in ``b``; duplicates are invisible."""
    return a.subtract(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference."""
    return a.exceptAll(b)


def except_both(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    """U1/U2 both ways with a ``side`` label (``source_only`` / ``target_only``)."""
    op = except_distinct if distinct else except_all
    left = op(a, b.select(*a.columns)).select(F.lit("source_only").alias("side"), *a.columns)
    right = op(b.select(*a.columns), a).select(F.lit("target_only").alias("side"), *a.columns)
    return left.unionByName(right)


def dedup_rows(df: DataFrame, keys: Sequence[str] | None = None, keep: str = "min") -> DataFrame:
    """Distinct rows, or exactly one row per key.

    With ``keys`` the kept row is the smallest (``keep="min"``) or largest remaining
    row in column order: ``min(struct(other columns))`` is a declarative aggregate,
    combined map-side, so a hot key never lands whole in one task (unlike a
    ``row_number`` window) and the choice is deterministic (unlike ``dropDuplicates``).
    """
    if not keys:
        return df.distinct()
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*keys).distinct()
    pick = F.min if keep == "min" else F.max
    g = df.groupBy(*keys).agg(pick(F.struct(*others)).alias("__row"))
    return g.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])


def fingerprints(df: DataFrame, forms: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Per column (``forms``: its name and the SQL of its text) the number of its values and two sums of their hashes, and the
    same of whole rows (``column_name`` NULL).

    Sums add up: fingerprints of days (``by``) merge into those of the table. Columns with equal
    fingerprints hold the same values equally often but for a chance of about 2**-64; order and partitions don't
    matter. One scan and no shuffle but of one row a task.
    """
    tokens = [f"coalesce({f}, '\u0000')" for f in forms.values()]
    sums = lambda x, i: [F.sum(F.expr(f"CAST(xxhash64({x}, {k}) AS DECIMAL(38, 0))")).alias(f"h{k}_{i}") for k in (1, 2)]
    aggs = [e for i, t in enumerate([*tokens, ", ".join(tokens) or "1"]) for e in sums(t, i)]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    one = [F.struct(F.lit(c).cast("string").alias("column_name"), F.col(f"h1_{i}").alias("h1"), F.col(f"h2_{i}").alias("h2")) for i, c in enumerate([*forms, None])]
    return wide.select(*by, F.col("n").alias("row_count"), F.explode(F.array(*one)).alias("p")).select(*by, "row_count", "p.*")


def merge_fingerprints(parts: DataFrame) -> DataFrame:
    """Fingerprints of a table from those of its parts."""
    return parts.groupBy("column_name").agg(F.sum("row_count").alias("row_count"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))


def same_fingerprints(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column_name, source_rows, target_rows, same)`` of two tables' fingerprints; an empty table's row counts are 0."""
    j = a.alias("a").join(b.alias("b"), F.col("a.column_name").eqNullSafe(F.col("b.column_name")))
    same = F.col("a.row_count").eqNullSafe(F.col("b.row_count")) & F.col("a.h1").eqNullSafe(F.col("b.h1")) & F.col("a.h2").eqNullSafe(F.col("b.h2"))
    return j.select(F.col("a.column_name").alias("column_name"), F.col("a.row_count").alias("source_rows"), F.col("b.row_count").alias("target_rows"), same.alias("same"))


def column_multiset_diff(a: DataFrame, b: DataFrame, cols: Sequence[str], distinct: bool = True) -> DataFrame:
    """Per column, how many values of one side are absent on the other.

    Returns ``(column_name, source_only_values, target_only_values)`` for every compared column. Fingerprints are
    compared first (one scan of each side, a small job while this is built); only the values of columns that differ are
    unpivoted and counted, so equal tables aren't shuffled.
    """
    texts = {c: f"CAST(`{c}` AS STRING)" for c in cols}
    found = {r["column_name"]: r["same"] for r in same_fingerprints(fingerprints(a, texts), fingerprints(b, texts)).collect()}
    differ = [c for c in cols if not found[c]]
    equal = F.explode(F.array(*[F.lit(c) for c in cols if found[c]]).cast("array<string>")).alias("column_name")
    zeros = a.sparkSession.range(1).select(equal).select("column_name", *[F.lit(0).cast("long").alias(n) for n in ("source_only_values", "target_only_values")])
    if not differ:
        return zeros

    def longform(df: DataFrame, side: str) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in differ])
        return df.select(F.explode(arr).alias("p")).select("p.*", F.lit(side).alias("side"))

    u = longform(a, "s").unionByName(longform(b, "t"))
    g = u.groupBy("column_name", "value").agg(
        F.count(F.when(F.col("side") == "s", 1)).alias("sn"), F.count(F.when(F.col("side") == "t", 1)).alias("tn")
    )
    if distinct:
        so = F.when((F.col("sn") > 0) & (F.col("tn") == 0), 1).otherwise(0)
        to = F.when((F.col("tn") > 0) & (F.col("sn") == 0), 1).otherwise(0)
    else:
        so = F.greatest(F.col("sn") - F.col("tn"), F.lit(0))
        to = F.greatest(F.col("tn") - F.col("sn"), F.lit(0))
    out = g.groupBy("column_name").agg(
        F.sum(so).cast("long").alias("source_only_values"), F.sum(to).cast("long").alias("target_only_values")
    )
    return out.unionByName(zeros)
