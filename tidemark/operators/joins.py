"""Joins (J1-J13) as user-level operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def full_outer_three(a: DataFrame, b: DataFrame, c: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """Presence of each key on three sides.

    Every side is reduced to its distinct keys first (combined map-side), and the
    second join is keyed on the key coalesced from the first join (X4 fixed).
    """
    sides = []
    for df, flag in zip((a, b, c), flags):
        sides.append(df.select(key).distinct().withColumn(flag, F.lit(True)))
    j = sides[0].join(sides[1], key, "full_outer").join(sides[2], key, "full_outer")
    return j.select(key, *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags])


def spine(slots: DataFrame, dims: Mapping[str, Sequence[str]]) -> DataFrame:
    """Slots x dimension values without a join: each dimension is an exploded literal array.

    The dimension lists are configuration (a few values each), so the spine size is
    ``slots x prod(len(values))`` and independent of the data volume.
    """
    out = slots
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def zero_fill(grid: DataFrame, facts: DataFrame, keys: Sequence[str], measures: Sequence[str], broadcast_facts: bool = False) -> DataFrame:
    """Left join of facts onto the spine; missing measures become 0."""
    f = F.broadcast(facts) if broadcast_facts else facts
    j = grid.join(f, list(keys), "left")
    for m in measures:
        j = j.withColumn(m, F.coalesce(F.col(m), F.lit(0).cast("long")))
    return j


def length_compare(src: DataFrame, tgt: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """J10 re-aimed: per column, matched keys whose value lengths differ, and the
    distinct value-length histogram sizes per side.

    An unkeyed ``length(a) != length(b)`` join is O(n*m); here the sides are joined on the key.
    """
    from tidemark.operators.recon import keyed_join

    j = keyed_join(src, tgt, key, cols, how="inner").where((F.col("__s_n") == 1) & (F.col("__t_n") == 1))

    def ln(c: str, p: str) -> Column:
        return F.length(F.col(f"`{p}__{c}`").cast("string"))

    arr = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                ln(c, "s").alias("source_length"),
                ln(c, "t").alias("target_length"),
            )
            for c in cols
        ]
    )
    x = j.select(F.explode(arr).alias("p")).select("p.*")
    return x.groupBy("column_name").agg(
        F.count(F.when(~F.col("source_length").eqNullSafe(F.col("target_length")), 1)).alias("length_mismatch_rows"),
        F.max("source_length").cast("long").alias("max_source_length"),
        F.max("target_length").cast("long").alias("max_target_length"),
    )
