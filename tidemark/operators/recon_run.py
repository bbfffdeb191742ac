"""Multi-table reconciliation run (R10-R14) and table/database validation.

A pair's result row is lazy: its counts, its columns' totals and examples and its comment come from one
``KeyedCompare`` (whose cells are shared), and the rows of all pairs are one union. Nothing is counted
beforehand but for a sample. What a pair was found to be is kept as a list of findings (kind, subject, rows,
detail); the comment is that list in words.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import lattice
from tidemark.operators import recon as R

# Names, order and types of a result row (readers of the result table rely on them); the rest is added.
RESULT_DDL = """run_id string, run_timestamp timestamp_ntz, domain string, source_table string, target_table string,
table_status string, data_status string, overall_status string, source_row_count long, target_row_count long,
comparison_mode string, key_column string, filter_applied boolean, filter_column string, matched_row_count long,
rows_only_in_source long, rows_only_in_target long, sample_size long, mismatched_columns string,
mismatched_column_count long, value_mismatch_columns string, format_only_mismatch_columns string,
duration_seconds double, comments string"""
MORE_DDL = "duplicate_keys long, straddling_keys long, filter_start string, filter_end string"
_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}
RESULT_SCHEMA = T.StructType([T.StructField(n, _TYPES[k]) for n, k in (f.split() for f in f"{RESULT_DDL}, {MORE_DDL}".split(","))])
FINDING = "struct<kind: string, subject: string, rows: bigint, detail: string>"


@dataclass
class PairSpec:
    """A table pair. ``target`` is None if there is no such table; ``domain`` is the caller's label."""

    source_table: str
    target_table: str
    source: DataFrame
    target: DataFrame | None
    excluded: Sequence[str] = field(default_factory=tuple)
    domain: str | None = None


@dataclass(frozen=True)
class Run:
    """What the rows of one run share. ``now`` (the clock is an input) also sets the cycle that ``ReconConfig.cycle`` asks for."""

    run_id: str | None = None
    now: dt.datetime | None = None


@dataclass(frozen=True)
class PairPlan:
    """What is compared of a pair, from its schemas alone."""

    mode: str  # MISSING, SKIPPED, FULL_HASH, FULL_KEYED, SAMPLE_KEYED
    key: str | None
    columns: tuple[str, ...]
    only_source: tuple[str, ...]
    only_target: tuple[str, ...]
    excluded: tuple[str, ...]
    window: tuple[str, str, str] | None


def plan_pair(spec: PairSpec, cfg: R.ReconConfig, run: Run = Run()) -> PairPlan:
    """R2, R3, R10, R11."""
    here = {c.lower(): c for c in spec.source.columns}
    if spec.target is None:
        return PairPlan("MISSING", None, (), (), (), (), None)
    there = {c.lower() for c in spec.target.columns}
    left_out = {c.lower() for c in (*spec.excluded, *cfg.excluded_columns)}
    both = sorted(here.keys() & there)
    kept = [c for c in both if c not in left_out]
    rest = (tuple(sorted(here.keys() - there)), tuple(sorted(there - here.keys())), tuple(c for c in both if c in left_out))
    timed = R.pick_first(both, cfg.cycle.columns) if cfg.cycle and (run.now or cfg.cycle.given) else None
    window = (timed, *cfg.cycle.bounds(run.now)) if timed else None
    key = R.pick_first(kept, cfg.key_priority)
    if not kept:
        return PairPlan("SKIPPED", None, (), *rest, window)
    if key is None:
        return PairPlan("FULL_HASH", None, tuple(here[c] for c in kept), *rest, window)
    others = tuple(here[c] for c in kept if c != key.lower())
    return PairPlan("SAMPLE_KEYED" if cfg.sample else "FULL_KEYED", here[key.lower()], others, *rest, window)


def sample_of(spec: PairSpec, plan: PairPlan, cfg: R.ReconConfig) -> tuple[int, int] | None:
    """Keys of the sample and their share of hash buckets, from one count of both sides; None if a side is empty."""
    tagged = [f.select(F.lit(side).alias("side")) for side, f in zip("st", _windowed(spec, plan), strict=True)]
    n = {r["side"]: r["count"] for r in tagged[0].unionByName(tagged[1]).groupBy("side").count().collect()}
    if len(n) < 2:
        return None
    keys = cfg.sample.size(n["s"], n["t"])
    return keys, R.sample_share(keys, n["s"])


def _windowed(spec: PairSpec, plan: PairPlan) -> list[DataFrame]:
    return [R.within(f, *plan.window) if plan.window else f for f in (spec.source, spec.target)]


_NO_COLUMNS = "CAST(array() AS ARRAY<STRUCT<column_name: STRING, value_mismatches: BIGINT, format_mismatches: BIGINT, examples: ARRAY<STRUCT<key: STRING, source_value: STRING, target_value: STRING, mismatch_type: STRING>>>>)"
_COUNTS = ("source_row_count", "target_row_count", "matched_row_count", "rows_only_in_source", "rows_only_in_target", "duplicate_keys", "straddling_keys")


def _measured(spark: SparkSession, spec: PairSpec, plan: PairPlan, cfg: R.ReconConfig) -> tuple[str, int | None, DataFrame]:
    """The mode that ran, the sample's size, and one row of counts and ``columns`` (worst first)."""
    if plan.mode in ("MISSING", "SKIPPED"):
        n = "NULL" if plan.mode == "MISSING" else "0"
        return "SKIPPED", None, spark.range(1).selectExpr(*[f"CAST({n} AS BIGINT) AS {c}" for c in _COUNTS], f"{_NO_COLUMNS} AS columns")
    if plan.mode == "FULL_HASH":
        s, t = _windowed(spec, plan)
        rules = lattice.pairs(s.schema, t.schema, plan.columns)
        forms = [s.select(*[F.expr(p.source_value).alias(p.name) for p in rules]), t.select(*[F.expr(p.target_value).alias(p.name) for p in rules])]
        h = R.hash_diff(*forms, list(plan.columns))
        return "FULL_HASH", None, h.selectExpr("*", *[f"CAST(0 AS BIGINT) AS {c}" for c in ("matched_row_count", "duplicate_keys", "straddling_keys")], f"{_NO_COLUMNS} AS columns")
    sample = sample_of(spec, plan, cfg) if plan.mode == "SAMPLE_KEYED" else None
    both = R.KeyedCompare(spec.source, spec.target, plan.key, plan.columns, cfg.detect_format, plan.window, sample and sample[1])
    found = R.column_findings(both.mismatches(), cfg.examples)
    worst = F.array_sort(F.collect_list(F.struct((-F.col("value_mismatches") - F.col("format_mismatches")).alias("less"), F.struct(*found.columns).alias("c"))))
    columns = found.agg(F.transform(worst, lambda x: x["c"]).alias("columns")).withColumn("__one", F.lit(1))
    counts = both.counts().withColumn("__one", F.lit(1))  # both are single rows
    if sample:
        counts = counts.withColumn("rows_only_in_target", F.lit(None).cast("long"))
    return "SAMPLE_KEYED" if sample else "FULL_KEYED", sample and sample[0], counts.join(columns, "__one").drop("__one")


def _findings(spec: PairSpec, plan: PairPlan, mode: str, sample: int | None, cfg: R.ReconConfig) -> str:
    """R13 as SQL: the array of findings, over a row of counts and ``columns``."""
    src, tgt = cfg.source_label, cfg.target_label

    def one(kind: str, subject: str | None = None, rows: str = "NULL", detail: str = "NULL", when: str | None = None) -> str:
        row = f"named_struct('kind', {lattice.text(kind)}, 'subject', {lattice.text(subject) if subject else 'NULL'}, 'rows', CAST({rows} AS BIGINT), 'detail', {detail})"
        return f"IF({when}, {row}, NULL)" if when else row

    out = []
    if plan.mode == "MISSING":
        out.append(one("NO_TARGET", spec.target_table))
    for kind, names in (("ONLY_SOURCE_COLUMNS", plan.only_source), ("ONLY_TARGET_COLUMNS", plan.only_target), ("EXCLUDED_COLUMNS", plan.excluded)):
        if names:
            out.append(one(kind, ", ".join(names), str(len(names))))
    if plan.mode == "SKIPPED":
        out.append(one("NOTHING_COMMON"))
    if plan.mode not in ("MISSING", "SKIPPED"):
        if plan.window:
            out.append(one("WINDOW", plan.window[0], "straddling_keys", lattice.text(f"{plan.window[1]} to {plan.window[2]}")))
        else:
            out.append(one("WHOLE_TABLES"))
        out.append(one(mode, plan.key, str(sample) if sample else "matched_row_count"))
        sizes = f"concat('{src} ', source_row_count, ', {tgt} ', target_row_count)"
        out.append(one("ROW_COUNTS", None, "NULL", sizes, "source_row_count <> target_row_count"))
        out.append(one("ONLY_SOURCE_ROWS", None, "rows_only_in_source", "NULL", "rows_only_in_source > 0"))
        out.append(one("ONLY_TARGET_ROWS", None, "rows_only_in_target", "NULL", "rows_only_in_target > 0"))
        out.append(one("REPEATED_KEYS", None, "duplicate_keys", "NULL", "duplicate_keys > 0"))
    shown = "array_join(transform(c.examples, e -> concat(coalesce(e.key, 'NULL'), ': ', coalesce(concat('[', e.source_value, ']'), 'NULL'), ' / ', coalesce(concat('[', e.target_value, ']'), 'NULL'))), ', ')"
    column = f"named_struct('kind', 'COLUMN', 'subject', c.column_name, 'rows', c.value_mismatches + c.format_mismatches, 'detail', concat(c.value_mismatches, ' in value, ', c.format_mismatches, ' in format; ', {shown}))"
    same = "size(columns) = 0 AND coalesce(rows_only_in_source, 0) + coalesce(rows_only_in_target, 0) = 0"
    last = [one("NO_DIFFERENCE", None, "NULL", "NULL", same)] if plan.mode not in ("MISSING", "SKIPPED") else []
    whole = f"concat(array({', '.join(out)}), transform(columns, c -> {column}), array({', '.join(last)}))" if last else f"array({', '.join(out)})"
    return f"filter(CAST({whole} AS ARRAY<{FINDING}>), x -> x IS NOT NULL)"


def _words(cfg: R.ReconConfig) -> dict[str, str]:
    """The clause of each kind of finding: ``{s}`` subject, ``{n}`` rows, ``{d}`` detail."""
    src, tgt = cfg.source_label, cfg.target_label
    return {
        "NO_TARGET": "{s} doesn't exist",
        "ONLY_SOURCE_COLUMNS": f"{src} alone has {{s}}",
        "ONLY_TARGET_COLUMNS": f"{tgt} alone has {{s}}",
        "EXCLUDED_COLUMNS": "left out by request: {s}",
        "NOTHING_COMMON": "no common column is left to compare",
        "WINDOW": "{s} from {d}, keys with rows on one side only: {n}",
        "WHOLE_TABLES": "whole tables",
        "FULL_HASH": "no key, so whole rows were compared",
        "FULL_KEYED": "by {s}, {n} pairs",
        "SAMPLE_KEYED": "by {s}, a sample of {n} keys",
        "ROW_COUNTS": "sizes differ: {d}",
        "ONLY_SOURCE_ROWS": f"rows that {src} alone has: {{n}}",
        "ONLY_TARGET_ROWS": f"rows that {tgt} alone has: {{n}}",
        "REPEATED_KEYS": "keys with several rows: {n}",
        "COLUMN": "{s} differs in {n} ({d})",
        "NO_DIFFERENCE": "no difference",
    }


def _clause(kind: str, words: str) -> str:
    """A clause as a SQL ``WHEN`` over the finding ``x``."""
    fields = {"{s}": "x.subject", "{n}": "CAST(x.rows AS STRING)", "{d}": "x.detail"}
    parts, rest = [], words
    while rest:
        at = min((rest.find(f) for f in fields if f in rest), default=len(rest))
        if at:
            parts.append(lattice.text(rest[:at]))
        if rest[at : at + 3] in fields:
            parts.append(fields[rest[at : at + 3]])
        rest = rest[at + 3 :]
    return f"WHEN {lattice.text(kind)} THEN concat({', '.join(parts)})"


def _pair_row(spark: SparkSession, spec: PairSpec, cfg: R.ReconConfig, run: Run) -> DataFrame:
    """The result row of a pair with its ``findings``."""
    plan = plan_pair(spec, cfg, run)
    mode, sample, measured = _measured(spark, spec, plan, cfg)
    found = measured.withColumn("findings", F.expr(_findings(spec, plan, mode, sample, cfg)))
    names = lambda keep: f"array_join(transform(filter(columns, c -> {keep}), c -> c.column_name), ', ')"
    missing, skipped = plan.mode == "MISSING", plan.mode == "SKIPPED"
    # A sample that matches says nothing of the other rows: it is no pass, and sizes that differ are a mismatch.
    differs = "coalesce(rows_only_in_source, 0) + coalesce(rows_only_in_target, 0) > 0 OR exists(columns, c -> c.value_mismatches > 0)"
    data = "'NOT_COMPARED'" if missing or skipped else f"CASE WHEN {differs} THEN 'DATA_MISMATCH' WHEN size(columns) > 0 THEN 'FORMAT_VARIANCE' ELSE {lattice.text('SAMPLE_MATCH' if sample else 'DATA_MATCH')} END"
    stated = {
        "run_id": lattice.text(run.run_id) if run.run_id else "NULL",
        "run_timestamp": lattice.text(f"{run.now.replace(tzinfo=None):%Y-%m-%d %H:%M:%S.%f}") if run.now else "NULL",
        "domain": lattice.text(spec.domain) if spec.domain else "NULL",
        "source_table": lattice.text(spec.source_table),
        "target_table": lattice.text(spec.target_table),
        "table_status": "'MISSING_IN_TARGET'" if missing else "'OK'",
        "data_status": data,
        "overall_status": "'FAIL'" if missing else f"element_at(map('DATA_MISMATCH', 'FAIL', 'DATA_MATCH', 'PASS', 'FORMAT_VARIANCE', 'WARN', 'SAMPLE_MATCH', 'WARN', 'NOT_COMPARED', 'WARN'), {data})",
        "comparison_mode": lattice.text(mode),
        "key_column": lattice.text(plan.key) if plan.key else "NULL",
        "filter_applied": "TRUE" if plan.window else "FALSE",
        "filter_column": lattice.text(plan.window[0]) if plan.window else "NULL",
        "filter_start": lattice.text(plan.window[1]) if plan.window else "NULL",
        "filter_end": lattice.text(plan.window[2]) if plan.window else "NULL",
        "sample_size": str(sample) if sample else "NULL",
        "mismatched_columns": "NULL" if missing else names("TRUE"),
        "mismatched_column_count": "NULL" if missing else "size(columns)",
        "value_mismatch_columns": "NULL" if missing else names("c.value_mismatches > 0"),
        "format_only_mismatch_columns": "NULL" if missing else names("c.value_mismatches = 0"),
        "duration_seconds": "NULL",
        "comments": f"array_join(transform(findings, x -> CASE x.kind {' '.join(_clause(k, w) for k, w in _words(cfg).items())} END), '; ')",
    }
    return found.selectExpr(*[f"CAST({stated.get(f.name, f.name)} AS {f.dataType.simpleString()}) AS {f.name}" for f in RESULT_SCHEMA.fields], "findings")


def _error_row(spec: PairSpec, run: Run, error: Exception, seconds: float | None) -> tuple:
    said = {
        "run_id": run.run_id, "run_timestamp": run.now and run.now.replace(tzinfo=None), "domain": spec.domain, "source_table": spec.source_table, "target_table": spec.target_table,
        "table_status": "ERROR", "data_status": "NOT_COMPARED", "overall_status": "ERROR", "comparison_mode": "NONE", "filter_applied": False, "duration_seconds": seconds, "comments": f"{type(error).__name__}: {error}",
    }
    return tuple(said.get(n) for n in RESULT_SCHEMA.fieldNames())


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def reconcile_many(
    spark: SparkSession,
    specs: Sequence[PairSpec],
    cfg: R.ReconConfig = R.ReconConfig(),
    run: Run = Run(),
    isolate: bool = False,
    max_workers: int = 8,
    retries: int = 1,
    max_error_rate: float | None = None,
) -> DataFrame:
    """Result rows for all pairs.

    Default: one lazy frame; a pair whose comparison can't even be planned is an ERROR row, an error while
    rows are read fails the job. ``isolate=True`` follows the reference's run semantics: every pair is compared in its own job
    on a bounded thread pool and timed, retried ``retries`` times, a pair that still fails becomes an ERROR row with the
    whole error text, and the run raises when the share of errors exceeds ``max_error_rate``. Only the one-row results
    reach the driver.
    """
    from concurrent.futures import ThreadPoolExecutor

    from tidemark.sources.readers import literal_rows

    names = RESULT_SCHEMA.fieldNames()
    if not specs:
        return spark.createDataFrame([], RESULT_SCHEMA)
    if not isolate:
        rows = []
        for spec in specs:
            try:
                rows.append(_pair_row(spark, spec, cfg, run).select(*names))
            except Exception as e:  # noqa: BLE001  (a pair that can't be planned becomes an ERROR row)
                rows.append(literal_rows(spark, [_error_row(spec, run, e, None)], RESULT_SCHEMA))
        return _union(rows)

    def one(spec: PairSpec):
        began, error = time.monotonic(), None
        for _ in range(retries + 1):
            try:
                row = _pair_row(spark, spec, cfg, run).select(*names).first().asDict()
                return tuple((row | {"duration_seconds": round(time.monotonic() - began, 3)}).values()), None
            except Exception as e:  # noqa: BLE001  (a failed table becomes an ERROR row)
                error = e
        return _error_row(spec, run, error, round(time.monotonic() - began, 3)), error

    with ThreadPoolExecutor(max_workers=max(1, max_workers)) as pool:
        results = list(pool.map(one, specs))
    errors = [e for _, e in results if e]
    if max_error_rate is not None and len(errors) / len(specs) > max_error_rate:
        raise RuntimeError(f"{len(errors)} of {len(specs)} pairs failed, more than {max_error_rate:.1%}: {errors[:3]}")
    return literal_rows(spark, [r for r, _ in results], RESULT_SCHEMA)


def findings_many(spark: SparkSession, specs: Sequence[PairSpec], cfg: R.ReconConfig = R.ReconConfig(), run: Run = Run()) -> DataFrame:
    """R13 as data: ``(source_table, position, kind, subject, rows, detail)``."""
    rows = [_pair_row(spark, s, cfg, run).select("source_table", F.posexplode("findings").alias("position", "f")).select("source_table", "position", "f.*") for s in specs]
    return _union(rows)


def comments_many(spark: SparkSession, specs: Sequence[PairSpec], cfg: R.ReconConfig = R.ReconConfig(), run: Run = Run()) -> DataFrame:
    """R13 for all pairs: ``(source_table, comments)``."""
    return _union([_pair_row(spark, s, cfg, run).select("source_table", "comments") for s in specs])


def triage(results: DataFrame, statuses: Sequence[str] = ("FAIL", "WARN", "ERROR")) -> DataFrame:
    """L1/L4: flagged rows with their triage rank (status desc, mismatched columns desc nulls last, table)."""
    from pyspark.sql import Window

    # One row per table: a single ordered window over the result rows is small by construction.
    w = Window.orderBy(F.col("overall_status").desc(), F.col("mismatched_column_count").desc_nulls_last(), F.col("source_table"))
    return results.where(F.col("overall_status").isin(list(statuses))).withColumn("triage_rank", F.row_number().over(w).cast("long"))


# ------------------------------------------------------------------ table validation (R15) and database compare


def _row_hash_counts(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(R.row_hash(df, cols).alias("h")).agg(F.count(F.lit(1)).alias(name))


def validate_table(
    spark: SparkSession,
    table_name: str,
    source: DataFrame,
    target: DataFrame,
    drop_target: Sequence[str] = (),
    created_col: str = "creationtime",
    updated_col: str = "updatetime",
    window: tuple[str, str] | None = None,
    null_mode: str = "keep_null",
) -> DataFrame:
    """R15 for one table, one result row.

    Boolean t/f columns of the source are found with ONE aggregate and recoded;
    target decimals become doubles; the target is de-duplicated unless it carries
    both time columns; both sides are filtered to ``window`` whenever it is given, of
    whatever size they are (the target needs the creation column for it); the common columns are compared as
    text with EXCEPT ALL semantics.

    A target that needs no de-duplication is compared by additive fingerprints first: equal tables take one
    scan of each side and no shuffle. Else digests alone are shuffled, never the rows: a target row goes as the digest of all
    its columns, which tells duplicates, and that of the common ones.
    """
    from tidemark.functions.columns import boolean_patterns, decimals_to_double, lower_columns, recode_boolean
    from tidemark.operators.setops import fingerprints, same_fingerprints

    src, tgt = lower_columns(source), lower_columns(target)
    tgt = tgt.drop(*[c for c in drop_target if c in tgt.columns])
    dec_cols = sorted(f.name for f in tgt.schema.fields if isinstance(f.dataType, T.DecimalType))
    tgt = decimals_to_double(tgt)
    bool_cols = sorted(r["column_name"] for r in boolean_patterns(src).collect() if r["pattern"] is not None)
    dedup = not (created_col in tgt.columns and updated_col in tgt.columns)
    timed = window is not None and created_col in tgt.columns
    here = F.col(created_col).between(*[F.lit(x) for x in window]) if timed else F.lit(True)
    common = sorted(set(src.columns) & set(tgt.columns))
    s = src.where(here).select(*[(recode_boolean(F.col(c), null_mode) if c in bool_cols else F.col(c)).cast("string").alias(c) for c in common])
    texts = {c: f"CAST(`{c}` AS STRING)" for c in common}
    differing = None
    if not dedup:
        found = same_fingerprints(fingerprints(s, texts), fingerprints(tgt.where(here), texts)).collect()
        differing = sorted(r["column_name"] for r in found if r["column_name"] is not None and not r["same"])
        same = next(r for r in found if r["column_name"] is None)
    if not dedup and same["same"]:
        n = F.lit(same["source_rows"]).cast("long")
        full = tgt.agg(F.count(F.lit(1)).alias("full")) if timed else spark.range(1).select(n.alias("full"))
        none = F.lit(0).cast("long")
        both = full.select("full", F.col("full").alias("kept"), n.alias("s"), n.alias("t"), none.alias("only_s"), none.alias("only_t"))
    else:
        h = lambda cols, name: [F.expr(f"{x} AS {name}{i}") for i, x in enumerate(R.hashes([f"CAST({lattice.ident(c)} AS STRING)" for c in cols]))]
        rows = tgt.select(*h(sorted(tgt.columns), "row"), *h(common, "h"), F.coalesce(here, F.lit(False)).alias("here"))
        counted = rows.groupBy("row0", "row1", "h0", "h1", "here").agg(F.count(F.lit(1)).alias("n"))
        once = F.lit(1) if dedup else F.col("n")
        cells = counted.select("h0", "h1", F.lit(0).alias("s"), F.when(F.col("here"), once).otherwise(0).alias("t"), F.col("n").alias("full"), once.alias("kept"))
        none = [F.lit(0).alias(c) for c in ("t", "full", "kept")]
        cells = cells.unionByName(s.select(*h(common, "h")).groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("s")).select("h0", "h1", "s", *none))
        total = lambda x, name: F.expr(f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS {name}")
        per = cells.groupBy("h0", "h1").agg(*[F.sum(c).alias(c) for c in ("s", "t", "full", "kept")])
        both = per.agg(*[total(c, c) for c in ("s", "t", "full", "kept")], total("greatest(s - t, 0)", "only_s"), total("greatest(t - s, 0)", "only_t"))
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    miss_src, miss_tgt = sorted(set(tgt.columns) - set(src.columns)), sorted(set(src.columns) - set(tgt.columns))
    out = both.select(
        F.lit(table_name).alias("table_name"),
        F.col("s").alias("source_count"),
        F.col("full").alias("target_full_count"),
        F.col("t").alias("target_filter_count"),
        F.col("kept").alias("target_post_dedup_count"),
        (F.col("full") - F.col("kept")).alias("duplicate_count"),
        names(bool_cols).alias("converted_boolean_columns"),
        names(dec_cols).alias("decimal_columns"),
        F.col("only_s").alias("source_only_count"),
        F.col("only_t").alias("target_only_count"),
        names(miss_src).alias("missing_in_source"),
        names(miss_tgt).alias("missing_in_target"),
        (names(differing) if differing is not None else F.lit(None).cast("array<string>")).alias("differing_columns"),
    )
    comment = F.concat_ws(
        " | ",
        F.when(F.col("source_count") != F.col("target_filter_count"), F.lit("count mismatch")),
        F.lit("missing columns in source") if miss_src else F.lit(None),
        F.lit("missing columns in target") if miss_tgt else F.lit(None),
        F.when(F.col("source_only_count") + F.col("target_only_count") > 0, F.lit("data mismatch")),
        F.when(F.col("duplicate_count") > 0, F.lit("duplicates in target")),
    )
    return out.withColumn("comment", F.when(comment == "", "All checks passed").otherwise(comment))


def compare_database(
    spark: SparkSession,
    source: dict[str, DataFrame],
    destination: dict[str, DataFrame],
    exclude: Sequence[str] = (),
    windows: dict[str, Column] | None = None,
) -> DataFrame:
    """Per source table: missing -> DDL (column count) -> ordered (name, type) list ->
    counts and EXCEPT DISTINCT both ways -> label. Schema checks read only metadata;
    each data compare is one grouped row-hash pass per side, unioned lazily."""
    schema = "tablename string, source_count long, destination_count long, result_status string"
    out = None
    for name, s in source.items():
        d = destination.get(name)
        row = None
        if d is None:
            row = (name, None, None, "Table missing in destination")
        elif len(s.columns) != len(d.columns):
            row = (name, None, None, "DDL mismatch")
        elif [(f.name, f.dataType.simpleString()) for f in s.schema.fields] != [(f.name, f.dataType.simpleString()) for f in d.schema.fields]:
            row = (name, None, None, "Column data type mismatch")
        if row is not None:
            from tidemark.sources.readers import literal_rows

            part = literal_rows(spark, [row], schema)
        else:
            cond = (windows or {}).get(name)
            if cond is not None:
                s, d = s.where(cond), d.where(cond)
            cols = [c for c in s.columns if c not in exclude]
            hs = _row_hash_counts(s.select(*cols), cols, "sn")
            hd = _row_hash_counts(d.select(*cols), cols, "dn")
            j = hs.join(hd, "h", "full_outer").agg(
                F.coalesce(F.sum("sn"), F.lit(0)).cast("long").alias("source_count"),
                F.coalesce(F.sum("dn"), F.lit(0)).cast("long").alias("destination_count"),
                F.count(F.when(F.col("dn").isNull(), 1)).alias("s_only"),
                F.count(F.when(F.col("sn").isNull(), 1)).alias("d_only"),
            )
            status = (
                F.when((F.col("source_count") > 0) & (F.col("destination_count") > 0), F.when((F.col("s_only") == 0) & (F.col("d_only") == 0), "Data matches").otherwise("Data mismatch"))
                .otherwise("No data to compare")
            )
            part = j.select(F.lit(name).alias("tablename"), "source_count", "destination_count", status.alias("result_status"))
        out = part if out is None else out.unionByName(part)
    return out
