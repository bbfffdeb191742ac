"""Data-quality checks and audits (Q-5 ... Q-22, R18, R19).

Every check is one aggregate (or one aggregate per input) returning a small
result frame; row-level outputs (quarantine, duplicate keys) stay distributed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timefn import ts_lit


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def recent_row_count(frames: Mapping[str, DataFrame], now, days: int, candidates: Sequence[str] | None = None) -> DataFrame:
    """Q-5: rows newer than ``now - days`` per table.

    The time column is the first timestamp/date column (or first candidate name);
    a bigint candidate is read as epoch milliseconds (UTC). Tables without one
    report their total. One aggregate per table, unioned.
    """
    now_dt = dt.datetime.fromisoformat(str(now))
    cutoff = now_dt - dt.timedelta(days=days)
    out = None
    for name, df in frames.items():
        col, kind = None, "none"
        fields = {f.name.lower(): f for f in df.schema.fields}
        order = [c.lower() for c in candidates] if candidates else []
        for c in order + [f.name.lower() for f in df.schema.fields]:
            f = fields.get(c)
            if f is None:
                continue
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                col, kind = f.name, "ts"
                break
            if c in order and isinstance(f.dataType, (T.LongType, T.IntegerType)):
                col, kind = f.name, "millis"
                break
        if kind == "ts":
            cond = _c(col) >= ts_lit(cutoff)
        elif kind == "millis":
            epoch = dt.datetime(1970, 1, 1)
            cond = _c(col) >= F.lit(int((cutoff - epoch).total_seconds() * 1000))
        else:
            cond = F.lit(True)
        agg = df.agg(
            F.lit(name).alias("table_name"),
            F.lit(col).cast("string").alias("time_column"),
            F.count(F.when(cond, 1)).alias("recent_rows"),
            F.count(F.lit(1)).alias("total_rows"),
        )
        out = agg if out is None else out.unionByName(agg)
    return out


def oversized(df: DataFrame, threshold: int = 1_048_576, cols: Sequence[str] | None = None) -> DataFrame:
    """Q-6: per text/binary column, the largest value in bytes and how many values exceed the threshold (one aggregate)."""
    names = list(cols) if cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    aggs = []
    for i, c in enumerate(names):
        b = F.octet_length(_c(c))
        aggs += [F.max(b).alias(f"m{i}"), F.count(F.when(b > threshold, 1)).alias(f"o{i}")]
    wide = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").cast("long").alias("max_bytes"), F.col(f"o{i}").alias("oversized_values")) for i, c in enumerate(names)])
    return wide.select(F.explode(arr).alias("p")).select("p.*", (F.col("p.oversized_values") > 0).alias("has_oversized"))


def null_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q-7: NULL count per required column plus rows with any NULL (``*``); PASS when zero."""
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | _c(c).isNull()
    aggs = [F.count(F.when(_c(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(cols)] + [F.count(F.when(any_null, 1)).alias("nany")]
    wide = df.agg(*aggs)
    arr = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(cols)],
        F.struct(F.lit("*").alias("column_name"), F.col("nany").alias("null_count")),
    )
    x = wide.select(F.explode(arr).alias("p")).select("p.*")
    return x.withColumn("status", F.when(F.col("null_count") == 0, "PASS").otherwise("FAIL"))


def unique_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q-8: keys occurring more than once, with their occurrence count (grouped, combined map-side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def rule_check(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Q-9: per rule (SQL boolean text) the rows where it is FALSE (NULL is not a violation)."""
    wide = df.agg(*[F.count(F.when(~F.expr(r), 1)).alias(f"v{i}") for i, r in enumerate(rules.values())])
    arr = F.array(*[F.struct(F.lit(n).alias("rule_name"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(rules)])
    x = wide.select(F.explode(arr).alias("p")).select("p.*")
    return x.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def expected_columns(meta: DataFrame, expected: DataFrame) -> DataFrame:
    """Q-10: expected ``(table_name, column_name)`` pairs with a presence flag (left join on metadata)."""
    m = meta.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"), F.lit(True).alias("present"))
    e = expected.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))
    return e.join(m, ["table_name", "column_name"], "left").select("table_name", "column_name", F.coalesce("present", F.lit(False)).alias("present"))


def source_minus_target(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q-11: counts of both sides and source keys absent in the target; PASS when target >= source and none missing."""
    ka = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("an"))
    kb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("bn"))
    j = ka.join(kb, list(keys), "full_outer")
    r = j.agg(
        F.coalesce(F.sum("an"), F.lit(0)).cast("long").alias("source_count"),
        F.coalesce(F.sum("bn"), F.lit(0)).cast("long").alias("target_count"),
        F.coalesce(F.sum(F.when(F.col("bn").isNull(), F.col("an"))), F.lit(0)).cast("long").alias("missing_in_target"),
    )
    return r.withColumn(
        "status", F.when((F.col("target_count") >= F.col("source_count")) & (F.col("missing_in_target") == 0), "PASS").otherwise("FAIL")
    )


def cast_check(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Q-12: values that are present but do not cast to the declared type."""
    aggs = [F.count(F.when(_c(c).isNotNull() & _c(c).try_cast(t).isNull(), 1)).alias(f"b{i}") for i, (c, t) in enumerate(types.items())]
    wide = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("target_type"), F.col(f"b{i}").alias("bad_values")) for i, (c, t) in enumerate(types.items())])
    return wide.select(F.explode(arr).alias("p")).select("p.*")


def quarantine(df: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Q-13: split into (valid, invalid); invalid rows carry ``reasons`` (failed rule names, ';'-joined)."""
    tagged = tag_rules(df, rules)
    return tagged.where("is_valid").drop("is_valid", "reasons"), tagged.where("NOT is_valid").drop("is_valid")


def tag_rules(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    failed = [F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()]
    reasons = F.concat_ws(";", *failed)
    return df.withColumn("reasons", F.when(reasons == "", F.lit(None)).otherwise(reasons)).withColumn("is_valid", F.col("reasons").isNull())


def sequence_gaps(df: DataFrame, part: Sequence[str], seq: str) -> DataFrame:
    """Q-14: sequence continuity per owner as one aggregate: ``missing = max - min + 1 - distinct``.

    Grouped (two-level distinct aggregation), so a hot owner is combined map-side
    instead of being sorted whole in one window task. Only owners with gaps are returned.
    """
    g = df.groupBy(*part).agg(
        F.min(seq).alias("min_seq"),
        F.max(seq).alias("max_seq"),
        F.countDistinct(seq).alias("present"),
        F.count(F.lit(1)).alias("row_count"),
    )
    g = g.withColumn("missing", (F.col("max_seq") - F.col("min_seq") + 1 - F.col("present")).cast("long"))
    return g.where((F.col("missing") > 0) | (F.col("row_count") > F.col("present")))


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q-15: mapping classes of keys between two layers (counts per class)."""
    ka = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("an"))
    kb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("bn"))
    j = ka.join(kb, list(keys), "full_outer")
    cls = (
        F.when(F.col("bn").isNull(), "MISSING_IN_TARGET")
        .when(F.col("an").isNull(), "MISSING_IN_SOURCE")
        .when((F.col("an") == 1) & (F.col("bn") == 1), "ONE_TO_ONE")
        .when(F.col("an") == 1, "ONE_TO_MANY")
        .when(F.col("bn") == 1, "MANY_TO_ONE")
        .otherwise("MANY_TO_MANY")
    )
    return j.groupBy(cls.alias("mapping")).agg(F.count(F.lit(1)).alias("key_count"))


def trace(layers: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Q-16: presence of every key in each layer and the first layer that lost it.

    Union of tagged key columns + one grouped aggregate (no chain of joins).
    """
    names = list(layers)
    u = None
    for i, (n, df) in enumerate(layers.items()):
        part = df.select(F.col(key).alias(key), F.lit(i).alias("__layer"))
        u = part if u is None else u.unionByName(part)
    g = u.groupBy(key).agg(*[F.max(F.when(F.col("__layer") == i, True).otherwise(False)).alias(f"in_{n}") for i, n in enumerate(names)])
    # the earliest layer without the key wins
    fm = None
    for n in names:
        fm = F.when(~F.col(f"in_{n}"), F.lit(n)) if fm is None else fm.when(~F.col(f"in_{n}"), F.lit(n))
    return g.withColumn("first_missing_layer", fm)


def latency(df: DataFrame, t1: str, t2: str, by: Sequence[str], sla_seconds: int) -> DataFrame:
    """Q-17: per group: rows, missing second timestamps, exact p50/p95/max latency (s) and SLA breaches.

    The exact percentiles come from ``quantiles.exact_quantiles`` (no one-task merge of a
    group's values); the counts are one aggregate; both are per group.
    """
    from tidemark.operators.quantiles import exact_quantiles

    lat = F.timestamp_diff("SECOND", _c(t1), _c(t2))
    x = df.select(*by, lat.alias("__lat"), _c(t2).isNull().alias("__missing"))
    counts = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(F.when(F.col("__missing"), 1)).alias("missing_ingest"),
        F.max("__lat").alias("max_seconds"),
        F.count(F.when(F.col("__lat") > sla_seconds, 1)).alias("sla_breaches"),
    )
    q = exact_quantiles(x, ["__lat"], [0.5, 0.95], by=by)
    qs = q.groupBy(*by).agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("p50_seconds"),
        F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))).alias("p95_seconds"),
    )
    return counts.join(qs, list(by), "left").select(*by, "row_count", "missing_ingest", "p50_seconds", "p95_seconds", "max_seconds", "sla_breaches")


def carried_forward(rows: DataFrame, states: DataFrame, key: str, at: str, value: str, order: str, held: str) -> DataFrame:
    """Q-20: ``rows`` with ``expected``, the last ``value`` known of their ``key`` at their time ``at`` (a state of the same time
    is known; of several the last by ``order``), and ``verdict`` on the value they ``held``: MATCH, STALE (an older
    one or none), UNKNOWN (held without any state before).

    Both layers go through one window, cut by key and day; what a key knew at the start of a day comes from the last state of
    each day, a row a day. So a hot key is spread over its days.
    """
    state = F.struct(F.col(at).alias("t"), F.col(order).alias("o"), F.col(value).alias("v"))
    last = states.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("__k"), F.to_date(at).alias("__d")).agg(F.max(state).alias("s"))
    days = last.select("__k", "__d", "s").unionByName(rows.select(F.col(key).alias("__k"), F.to_date(at).alias("__d"), F.lit(None).cast(last.schema["s"].dataType).alias("s")).distinct())
    per_day = days.groupBy("__k", "__d").agg(F.max("s").alias("s"))
    before = F.last("s", ignorenulls=True).over(Window.partitionBy("__k").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1))
    known = per_day.select("__k", "__d", before.alias("__before"))
    both = states.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(0).alias("__row"), state.alias("__s"), F.lit(None).cast(T.StructType(rows.schema.fields)).alias("__r"))
    both = both.unionByName(rows.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__row"), F.lit(None).cast(last.schema["s"].dataType).alias("__s"), F.struct(*rows.columns).alias("__r")))
    today = Window.partitionBy("__k", F.to_date("__t")).orderBy("__t", "__row", F.col("__s.o")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__now", F.last("__s", ignorenulls=True).over(today)).where("__row = 1").withColumn("__d", F.to_date("__t"))
    k = known.select(F.col("__k").alias("__k2"), F.col("__d").alias("__d2"), "__before")
    j = seen.join(k, F.col("__k").eqNullSafe(F.col("__k2")) & F.col("__d").eqNullSafe(F.col("__d2")), "left")
    state_known = F.coalesce("__now", "__before")
    out = j.select("__r.*", state_known["v"].alias("expected"), state_known.isNull().alias("__none"))
    h = F.col(held)
    verdict = F.when(F.col("__none") & h.isNotNull(), "UNKNOWN").when(h.eqNullSafe(F.col("expected")), "MATCH").otherwise("STALE")
    return out.withColumn("verdict", verdict).drop("__none")


def coverage(df: DataFrame, col: str, expected: Sequence[str]) -> DataFrame:
    """Q-18: rows per expected value in ONE conditional aggregate; an expected value with 0 rows is uncovered."""
    wide = df.agg(*[F.count(F.when(_c(col) == v, 1)).alias(f"c{i}") for i, v in enumerate(expected)])
    arr = F.array(*[F.struct(F.lit(v).alias("expected_value"), F.col(f"c{i}").alias("row_count")) for i, v in enumerate(expected)])
    return wide.select(F.explode(arr).alias("p")).select("p.*", (F.col("p.row_count") > 0).alias("covered"))


# File lifecycle states (one spelling, see X12).
DELETABLE, DELETED, ACTIVE = "deletable", "deleted", "active"


def file_lifecycle(inventory: DataFrame, now, days: int = 30, deleted_paths: DataFrame | None = None) -> DataFrame:
    """Q-21: files not updated for ``days`` become deletable; a deletable file that was removed becomes deleted."""
    cutoff = dt.datetime.fromisoformat(str(now)) - dt.timedelta(days=days)
    status = F.when(F.col("last_update_date") < F.lit(cutoff), DELETABLE).otherwise(ACTIVE)
    out = inventory.withColumn("del_status", status).withColumn("del_date", F.lit(None).cast("timestamp"))
    if deleted_paths is not None:
        gone = deleted_paths.select("path", F.lit(True).alias("__gone"))
        out = out.join(gone, "path", "left").withColumn(
            "del_status", F.when(F.col("__gone") & (F.col("del_status") == DELETABLE), DELETED).otherwise(F.col("del_status"))
        ).withColumn("del_date", F.when(F.col("del_status") == DELETED, F.lit(dt.datetime.fromisoformat(str(now))))).drop("__gone")
    return out


def outcome(status: Column, mode: str = "binary") -> Column:
    """Q-22: test status -> outcome. ``binary``: pass -> Passed, else Failed;
    ``three_way``: pass -> Passed, fail -> Failed, else NotExecuted (X22)."""
    s = F.lower(status)
    if mode == "binary":
        return F.when(s == "pass", "Passed").otherwise("Failed")
    if mode == "three_way":
        return F.when(s == "pass", "Passed").when(s == "fail", "Failed").otherwise("NotExecuted")
    raise ValueError(mode)


def reconcile_metrics(df: DataFrame, formulas: Mapping[str, str], reported: Mapping[str, str], tolerance: float, digits: int = 4) -> DataFrame:
    """Recompute each metric from its formula (SQL text over ``df``) and compare with the reported column.

    Returns one row per input row and metric: ``metric, reported_value, recomputed_value, difference, matches``.
    """
    arr = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.round(F.col(reported[m]).cast("double"), digits).alias("reported_value"),
                F.round(F.expr(f).cast("double"), digits).alias("recomputed_value"),
            )
            for m, f in formulas.items()
        ]
    )
    keep = [c for c in df.columns if c not in reported.values()]
    x = df.select(*keep, F.explode(arr).alias("p")).select(*keep, "p.*")
    diff = F.round(F.col("recomputed_value") - F.col("reported_value"), digits)
    return x.withColumn("difference", diff).withColumn("matches", F.abs(diff) <= F.lit(tolerance))


def count_match(layers: Mapping[str, DataFrame], period: Column | str | None = None) -> DataFrame:
    """Rows per layer (and period) next to the first layer's count; missing = base - layer when positive."""
    u = None
    for i, (n, df) in enumerate(layers.items()):
        p = (F.col(period) if isinstance(period, str) else period) if period is not None else F.lit("all")
        part = df.select(F.lit(i).alias("layer_order"), F.lit(n).alias("layer"), p.cast("string").alias("period"))
        u = part if u is None else u.unionByName(part)
    g = u.groupBy("layer_order", "layer", "period").agg(F.count(F.lit(1)).alias("row_count"))
    base = F.max(F.when(F.col("layer_order") == 0, F.col("row_count"))).over(Window.partitionBy("period"))
    g = g.withColumn("base_count", F.coalesce(base, F.lit(0)).cast("long"))
    return g.select(
        "layer", "period", "row_count", "base_count",
        F.greatest(F.col("base_count") - F.col("row_count"), F.lit(0)).cast("long").alias("missing_rows"),
        F.greatest(F.col("row_count") - F.col("base_count"), F.lit(0)).cast("long").alias("extra_rows"),
    )
