"""Aggregations (A1-A20): counts, totals, profiles and EDA numbers, each as one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of both sides in one job."""
    u = a.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(b.select(F.lit(0).alias("s"), F.lit(1).alias("t")))
    return u.agg(F.sum("s").cast("long").alias("source_row_count"), F.sum("t").cast("long").alias("target_row_count"))


def slot_counts(df: DataFrame, by: Sequence[str | Column], name: str = "message_count") -> DataFrame:
    """A1: count per group (partial aggregation happens map-side)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def counts_with_total(df: DataFrame, by: Sequence[str], total_over: str, label: str = "ALL", count_col: str | None = None, name: str = "total_count") -> DataFrame:
    """A2: per-group counts plus an all-values row for ``total_over`` in ONE pass (grouping sets).

    ``total_over`` is set to ``label`` on the total rows; a NULL in the data stays NULL
    (``grouping()`` tells the two apart).
    """
    agg = F.count(F.col(count_col) if count_col else F.lit(1)).alias(name)
    others = [c for c in by if c != total_over]
    g = df.groupingSets([list(by), others], *by).agg(agg, F.grouping(total_over).alias("__g"))
    return g.select(
        *[F.when(F.col("__g") == 1, F.lit(label)).otherwise(F.col(c)).alias(c) if c == total_over else F.col(c) for c in by],
        name,
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def value_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(column_no, whole, real, other, n)``: how often each value stands in each column of all tables (numbered
    through), in one shuffle.

    A value goes in its own kind (integers as long, floating as double, the rest as text), so that every table
    and type shares one grouping; equal values combine before the shuffle.
    """
    to = {"whole": "long", "real": "double", "other": "string"}
    out, no = None, 0
    for df in tables.values():
        cells = []
        for f in df.schema.fields:
            kind = "whole" if isinstance(f.dataType, T.IntegralType) else "real" if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else "other"
            cells.append(F.struct(F.lit(no).alias("column_no"), *[(F.col(f"`{f.name}`") if k == kind else F.lit(None)).cast(t).alias(k) for k, t in to.items()]))
            no += 1
        part = df.select(F.explode(F.array(*cells)).alias("p")).select("p.*")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("column_no", *to).agg(F.count(F.lit(1)).alias("n"))


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A9/A10/Q-2: ``(table_name, column_name, row_count, null_count, distinct_count)`` and their shares, for all columns of
    all tables by two exchanges. A column without rows has no row."""
    from tidemark.operators.windows import pct_round

    absent = F.col("whole").isNull() & F.col("real").isNull() & F.col("other").isNull()
    per = value_counts(tables).groupBy("column_no").agg(
        F.sum("n").cast("long").alias("row_count"), F.coalesce(F.sum(F.when(absent, F.col("n"))), F.lit(0)).cast("long").alias("null_count"), F.count(F.when(~absent, 1)).alias("distinct_count")
    )
    named = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for t, df in tables.items() for c in df.columns])
    pct = lambda x: pct_round(x, F.col("row_count"), 2)
    return per.withColumn("name", named[F.col("column_no")]).select(
        "name.table_name", "name.column_name", "row_count", "null_count", "distinct_count",
        pct(F.col("null_count")).alias("null_pct"), pct(F.col("row_count") - F.col("null_count")).alias("density_pct"), pct(F.col("distinct_count")).alias("distinct_pct"),
    )


def profile(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """A6/A8-A10/Q-1: one row per column of a table.

    Columns: ``column_name, row_count, null_count, distinct_count, null_pct, density_pct,
    distinct_pct, mean, stddev`` (mean/stddev only for numeric columns). Two scans: one grouping of all values
    (``value_counts``) and one aggregate without a shuffle of values.
    """
    df = df.select(*[f"`{c}`" for c in cols]) if cols is not None else df
    numeric = numeric_columns(df)
    x = lambda c: F.col(f"`{c}`").cast("double")
    wide = df.agg(F.lit(0).alias("none"), *[e for i, c in enumerate(numeric) for e in (F.avg(x(c)).alias(f"m{i}"), F.stddev(x(c)).alias(f"s{i}"))])
    rows = [F.struct(F.lit(c).alias("name"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("stddev")) for i, c in enumerate(numeric)]
    moments = wide.select(F.explode(F.array(*rows).cast("array<struct<name: string, mean: double, stddev: double>>")).alias("p")).select("p.*")
    shares = profile_tables({"": df}).drop("table_name")
    out = shares.join(moments, F.col("column_name") == F.col("name"), "left")
    return out.select(*shares.columns, F.round("mean", digits).alias("mean"), F.round("stddev", digits).alias("stddev"))


def distinct_sketches(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (), lg_k: int = 12) -> DataFrame:
    """A9 approximate: ``(*by, column_name, row_count, null_count, sketch)``; a sketch of some KB for each column (and day),
    to be stored and merged: a day is read once, however often the table's distinct counts are asked for."""
    cols = list(cols) if cols is not None else df.columns
    text = lambda c: F.col(f"`{c}`").cast("string")
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *[e for i, c in enumerate(cols) for e in (F.count(text(c)).alias(f"n{i}"), F.hll_sketch_agg(text(c), F.lit(lg_k)).alias(f"h{i}"))])
    rows = [F.struct(F.lit(c).alias("column_name"), (F.col("row_count") - F.col(f"n{i}")).alias("null_count"), F.col(f"h{i}").alias("sketch")) for i, c in enumerate(cols)]
    return wide.select(*by, "row_count", F.explode(F.array(*rows)).alias("p")).select(*by, "p.column_name", "row_count", "p.null_count", "p.sketch")


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """``(column_name, row_count, null_count, distinct_estimate)`` of the whole from sketches of its parts."""
    return sketches.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate")
    )


def describe(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """count/mean/stddev/min/max per numeric column, long form, numbers typed (not strings)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"a{i}"), F.stddev(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    wide = df.agg(*aggs)
    arr = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"c{i}").alias("count"),
                F.round(F.col(f"a{i}"), digits).alias("mean"),
                F.round(F.col(f"s{i}"), digits).alias("stddev"),
                F.col(f"l{i}").alias("min"),
                F.col(f"h{i}").alias("max"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return wide.select(F.explode(arr).alias("p")).select("p.*")


def null_counts(df: DataFrame) -> DataFrame:
    """NULL count per column in one aggregate, long form."""
    wide = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(df.columns)])
    return wide.select(F.explode(arr).alias("p")).select("p.*")


def top_values(df: DataFrame, cols: Sequence[str] | None = None, n: int | None = None) -> DataFrame:
    """The values of each column (default: of all) with their counts and ranks (most frequent first, ties by value); ``n``: the first ones only.

    One unpivot + grouped count; the per-column ranking runs on the (column, value)
    counts, never on raw rows.
    """
    from pyspark.sql import Window

    from tidemark.operators.windows import first_n_per

    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in (cols or df.columns)])
    g = df.select(F.explode(arr).alias("p")).select("p.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("value_count"))
    order = [F.col("value_count").desc(), F.col("value").asc_nulls_first()]
    if n is None:  # rank by (count, value) in two levels: values of one count are numbered together, counts are few
        same = Window.partitionBy("column_name", "value_count").orderBy(F.col("value").asc_nulls_first())
        more = Window.partitionBy("column_name").orderBy(F.col("value_count").desc()).rowsBetween(Window.unboundedPreceding, -1)
        levels = g.groupBy("column_name", "value_count").agg(F.count(F.lit(1)).alias("values"))
        offsets = levels.select("column_name", "value_count", F.coalesce(F.sum("values").over(more), F.lit(0)).alias("above"))
        ranked = g.withColumn("own", F.row_number().over(same)).join(offsets, ["column_name", "value_count"])
        return ranked.select("column_name", "value", "value_count", (F.col("own") + F.col("above")).cast("long").alias("value_rank"))
    # A column can have as many distinct values as rows: rank in two salted levels (exact).
    return first_n_per(g, ["column_name"], order, n, "value_rank", salt=F.xxhash64("value"))


def correlation(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Pearson correlation for every pair of numeric columns in ONE aggregate, long form."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    arr = F.array(
        *[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(F.col(f"r{i}"), digits).alias("correlation")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(F.explode(arr).alias("p")).select("p.*")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """A13 re-aimed: equal-width bucket counts between the column's min and max.

    The two bounds come from one aggregate (two scalars to the driver); the bucket
    expression then uses literals, so the counting is one map-side-combined aggregate.
    """
    x = F.col(col).cast("double")
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    j = df.select(x.alias("__x")).where(F.col("__x").isNotNull())
    if lo is None or hi == lo:
        b = F.lit(1)
    else:
        b = F.least(F.lit(bins), (F.floor((F.col("__x") - F.lit(lo)) / F.lit(hi - lo) * bins) + 1).cast("int"))
    return j.groupBy(b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("bucket_count"), F.min("__x").alias("bucket_min"), F.max("__x").alias("bucket_max")
    )


def quartiles(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    """A14 re-aimed: exact quartiles (linear interpolation) per column, long form."""
    from tidemark.operators.quantiles import exact_quantiles

    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    g = q.groupBy("column_name").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    return g.select("column_name", *[F.round(n, digits).alias(n) for n in ("q1", "median", "q3")])


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each category."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("row_count"))


def result_summary(df: DataFrame, label: str, table: str, digits: int = 2) -> DataFrame:
    """Rows per label, share of all rows, distinct tables per label.

    The grand total is a window over the (small) grouped result, not over raw rows.
    """
    from pyspark.sql import Window

    from tidemark.operators.windows import pct_round

    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct(table).alias("table_count"))
    total = F.sum("row_count").over(Window.partitionBy(F.lit(1)))
    return g.withColumn("pct", pct_round(F.col("row_count"), total, digits))


def duplicate_count(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows minus distinct rows (or distinct keys), one row."""
    cols = list(keys) if keys else df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.count(F.when(F.col("__n") > 1, 1)).alias("duplicated_keys"),
    )


def distinct_tables(meta: DataFrame, by: str | None = None) -> DataFrame:
    """Distinct table names (per source when ``by`` is given)."""
    cols = [by, "table_name"] if by else ["table_name"]
    return meta.select(*cols).distinct()
