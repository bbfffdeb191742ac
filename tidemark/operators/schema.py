"""Schema drift and DDL reconciliation (S5, D1-D9, R1, R17, P4, Q-10).

Input is column metadata ``(table_name, column_name, data_type, is_nullable,
ordinal_position)`` as a DataFrame (``sources.table_columns``). Every comparison
is a full-outer join on (table, column) plus a group-by on the table; no driver
dictionaries, so thousands of tables cost the same three small jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import NUMERIC_TYPES, normalize_type, strip_prefix

# Severity order used to pick the worst status.
SEVERITY_RANK = {"PASS": 0, "WARN": 1, "FAIL": 2, "ERROR": 3}


def norm_meta(meta: DataFrame, fold_types: bool = True) -> DataFrame:
    """Lower-cased names, normalised type, boolean nullability."""
    return meta.select(
        F.lower("table_name").alias("t"),
        F.lower("column_name").alias("c"),
        normalize_type(F.col("data_type"), fold_types).alias("dt"),
        (F.upper("is_nullable") == "YES").alias("nl"),
        F.col("ordinal_position").alias("pos"),
    )


def _sorted_join(flag: Column, text: Column, sep: str) -> Column:
    """``string_agg(text ORDER BY column)`` over flagged rows; '' when none."""
    items = F.collect_list(F.when(flag, F.struct(F.col("c").alias("k"), text.alias("v"))))
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["v"]), sep)


def _fam_sql(x: str) -> str:
    d = f"lower(trim(coalesce({x}, '')))"
    names = ", ".join(f"'{n}'" for n in NUMERIC_TYPES)
    return f"(CASE WHEN substring_index({d}, '(', 1) IN ({names}) THEN 'numeric' ELSE {d} END)"


def _agg_sql(flag: str, text: str, sep: str, name: str) -> Column:
    """SQL twin of ``_sorted_join``: one JVM call per finding list."""
    return F.expr(
        f"array_join(transform(array_sort(collect_list(CASE WHEN {flag} THEN named_struct('k', c, 'v', {text}) END)), x -> x.v), '{sep}') AS {name}"
    )


def _findings(j: DataFrame, label: str, bl: str) -> DataFrame:
    """Group the (table, column) comparison rows into the five finding lists.

    ``j`` has ``t, c, bdt, odt, bnl, onl, inb, ino`` and ``bl`` is SQL text for the
    baseline label (a literal or a column).
    """
    both = "inb AND ino"
    differ = f"{both} AND bdt <> odt"
    numeric = f"({_fam_sql('bdt')} = 'numeric' AND {_fam_sql('odt')} = 'numeric')"
    ty = f"concat(upper(c), ': ', {bl}, '=', bdt, ' vs {label}=', odt)"
    nt = (
        f"concat(upper(c), ': ', {bl}, '_nullable=', CASE WHEN bnl THEN 'True' ELSE 'False' END, "
        f"' vs {label}_nullable=', CASE WHEN onl THEN 'True' ELSE 'False' END)"
    )
    return j.groupBy("t").agg(
        _agg_sql("inb AND NOT ino", "upper(c)", ", ", "missing_columns"),
        _agg_sql("ino AND NOT inb", "upper(c)", ", ", "additional_columns"),
        _agg_sql(f"{differ} AND NOT {numeric}", ty, "; ", "datatype_mismatches"),
        _agg_sql(f"{differ} AND {numeric}", ty, "; ", "numeric_type_variances"),
        _agg_sql(f"{both} AND bnl <> onl", nt, "; ", "nullability_mismatches"),
    )


def pair_findings(base: DataFrame, other: DataFrame, label: str, base_label: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Per table present on both sides, the finding lists of ``other`` against ``base``.

    ``base``/``other`` are ``norm_meta`` frames. Returns ``t, missing_columns,
    additional_columns, datatype_mismatches, numeric_type_variances, nullability_mismatches``.
    Differing numeric types are reported as numeric variances (WARN), others as
    datatype mismatches (FAIL).
    """
    ig = [i.lower() for i in ignore]
    b = base.where(~F.col("c").isin(ig)) if ig else base
    o = other.where(~F.col("c").isin(ig)) if ig else other
    b = b.select("t", "c", F.col("dt").alias("bdt"), F.col("nl").alias("bnl"), F.lit(True).alias("inb"))
    o = o.select("t", "c", F.col("dt").alias("odt"), F.col("nl").alias("onl"), F.lit(True).alias("ino"))
    j = b.join(o, ["t", "c"], "full_outer").withColumn("inb", F.coalesce("inb", F.lit(False))).withColumn("ino", F.coalesce("ino", F.lit(False)))
    return _findings(j, label, "'" + base_label.replace("'", "") + "'")


def pair_severity(label: str, exists: Column, prefix: str = "") -> Column:
    """FAIL for missing table/column or type conflict; additional is FAIL except for the
    drift-tolerant ``CDA``-style side (WARN); numeric variance and nullability WARN."""

    def c(n: str) -> Column:
        return F.col(f"{prefix}{n}")

    nonempty = lambda n: F.coalesce(c(n), F.lit("")) != ""
    fail = (nonempty("missing_columns")) | (nonempty("datatype_mismatches"))
    if label != "CDA":
        fail = fail | nonempty("additional_columns")
    warn = nonempty("numeric_type_variances") | nonempty("additional_columns") | nonempty("nullability_mismatches")
    return F.when(~exists, "FAIL").when(fail, "FAIL").when(warn, "WARN").otherwise("PASS")


def table_set(meta: DataFrame, flag: str) -> DataFrame:
    return meta.select(F.col("t")).distinct().withColumn(flag, F.lit(True))


def schema_pair(base_meta: DataFrame, other_meta: DataFrame, label: str = "TST", base_label: str = "PROD", ignore: Sequence[str] = ()) -> DataFrame:
    """D1/D4 two-way: one row per base table with finding lists and status."""
    b, o = norm_meta(base_meta), norm_meta(other_meta)
    tables = table_set(b, "__b").join(table_set(o, "exists_in_other"), "t", "left").withColumn(
        "exists_in_other", F.coalesce("exists_in_other", F.lit(False))
    ).drop("__b")
    f = pair_findings(b, o, label, base_label, ignore)
    j = tables.join(f, "t", "left")
    cols = ["missing_columns", "additional_columns", "datatype_mismatches", "numeric_type_variances", "nullability_mismatches"]
    j = j.select("t", "exists_in_other", *[F.when(F.col("exists_in_other"), F.col(c)).alias(c) for c in cols])
    return j.select(F.col("t").alias("table_name"), "exists_in_other", *cols, pair_severity(label, F.col("exists_in_other")).alias("status"))


def _worst(*sevs: Column) -> Column:
    rank = lambda s: F.when(s == "PASS", 0).when(s == "WARN", 1).when(s == "FAIL", 2).when(s == "ERROR", 3)
    best = F.greatest(*[rank(s) for s in sevs])
    return F.when(best == 3, "ERROR").when(best == 2, "FAIL").when(best == 1, "WARN").when(best == 0, "PASS")


def schema_drift(prod: DataFrame, tst: DataFrame, cda: DataFrame, cda_suffix: str = "_cda", cda_ignore: Sequence[str] = ()) -> DataFrame:
    """D2/D3/D4 three-way drift per base table: PROD baseline, TST fallback, CDA-only reported."""
    p, t = norm_meta(prod), norm_meta(tst)
    c_all = norm_meta(cda)
    # D3: only suffixed tables count on the CDA side; the base name drops the suffix.
    c = c_all.where(F.col("t").endswith(cda_suffix)).withColumn("t", F.expr(f"substring(t, 1, length(t) - {len(cda_suffix)})"))
    tables = (
        table_set(p, "exists_in_prod")
        .join(table_set(t, "exists_in_tst"), "t", "full_outer")
        .join(table_set(c, "exists_in_cda"), "t", "full_outer")
        .select("t", *[F.coalesce(F.col(x), F.lit(False)).alias(x) for x in ("exists_in_prod", "exists_in_tst", "exists_in_cda")])
    )
    baseline = F.when(F.col("exists_in_prod"), "PROD").when(F.col("exists_in_tst"), "TST").otherwise("NONE")
    tables = tables.withColumn("baseline_source", baseline)
    # Baseline metadata: PROD rows, plus TST rows of tables missing in PROD.
    base_meta = p.unionByName(t.join(table_set(p, "__p"), "t", "left_anti"))
    base_label = tables.select("t", "baseline_source")
    tst_f = pair_findings(p, t, "TST", "PROD")
    cda_f = _cda_findings(base_meta, c, base_label, cda_ignore)
    cols = ["missing_columns", "additional_columns", "datatype_mismatches", "numeric_type_variances"]
    j = tables.join(tst_f.select("t", *[F.col(x).alias(f"tst_{x}") for x in cols + ["nullability_mismatches"]]), "t", "left").join(
        cda_f.select("t", *[F.col(x).alias(f"cda_{x}") for x in cols + ["nullability_mismatches"]]), "t", "left"
    )
    prod_based = F.col("baseline_source") == "PROD"
    none = F.col("baseline_source") == "NONE"
    tst_sev = F.when(none, "N/A").when(prod_based, pair_severity("TST", F.col("exists_in_tst"), "tst_")).otherwise("N/A")
    cda_sev = F.when(none, "N/A").otherwise(pair_severity("CDA", F.col("exists_in_cda"), "cda_"))
    j = j.withColumn("tst_vs_prod_status", tst_sev).withColumn("cda_vs_prod_status", cda_sev)
    prod_missing = F.when(F.col("exists_in_prod"), "PASS").otherwise("WARN")
    overall = F.when(none, "WARN").otherwise(
        _worst(prod_missing, F.when(F.col("tst_vs_prod_status") != "N/A", F.col("tst_vs_prod_status")), F.col("cda_vs_prod_status"))
    )
    tst_ok = prod_based & F.col("exists_in_tst")
    cda_ok = ~none & F.col("exists_in_cda")
    return j.select(
        F.col("t").alias("table_base_name"),
        "exists_in_prod", "exists_in_tst", "exists_in_cda", "baseline_source", "tst_vs_prod_status", "cda_vs_prod_status",
        *[F.when(tst_ok, F.col(f"tst_{x}")).alias(f"tst_{x}") for x in cols],
        *[F.when(cda_ok, F.col(f"cda_{x}")).alias(f"cda_{x}") for x in cols],
        overall.alias("overall_status"),
    )


def _cda_findings(base_meta: DataFrame, cda: DataFrame, base_label: DataFrame, ignore: Sequence[str]) -> DataFrame:
    """CDA findings against each table's own baseline; the label (PROD/TST) comes from the table row."""
    b = base_meta.join(base_label, "t")
    o = cda.join(base_label, "t")
    ig = [i.lower() for i in ignore]
    b = b.where(~F.col("c").isin(ig)).select("t", "c", "baseline_source", F.col("dt").alias("bdt"), F.col("nl").alias("bnl"), F.lit(True).alias("inb"))
    o = o.where(~F.col("c").isin(ig)).select("t", "c", F.col("baseline_source").alias("__bs"), F.col("dt").alias("odt"), F.col("nl").alias("onl"), F.lit(True).alias("ino"))
    j = b.join(o, ["t", "c"], "full_outer").select(
        "t", "c", F.coalesce("baseline_source", "__bs").alias("bl"), "bdt", "bnl", "odt", "onl",
        F.coalesce("inb", F.lit(False)).alias("inb"), F.coalesce("ino", F.lit(False)).alias("ino"),
    )
    return _findings(j, "CDA", "bl")


# ------------------------------------------------------------------ DDL labels


def ddl_sides(meta: DataFrame) -> DataFrame:
    """Split a type such as ``decimal(12,2)`` into base type, precision and scale text."""
    dt = F.lower(F.col("data_type"))
    prec = F.regexp_extract(dt, r"\((\d+)", 1)
    scale = F.regexp_extract(dt, r",\s*(\d+)\)", 1)
    return meta.select(
        F.lower("table_name").alias("table_name"),
        F.lower("column_name").alias("column_name"),
        F.regexp_replace(dt, r"\(.*$", "").alias("data_type"),
        F.when(prec != "", prec).alias("precision"),
        F.when(scale != "", scale).alias("scale"),
    )


def ddl_compare(a: DataFrame, b: DataFrame, a_name: str = "SOURCE", b_name: str = "TARGET", exclude: Sequence[str] = ()) -> DataFrame:
    """Per (table, column) first-match label. Table membership is a join flag (J11),
    exclusion is case-insensitive and the precision compare is NULL-safe (X9)."""
    ex = [e.lower() for e in exclude]
    a = a.where(~F.lower("column_name").isin(ex)) if ex else a
    ta = a.select(F.col("table_name").alias("table_name_resolved")).distinct().withColumn("in_a", F.lit(True))
    tb = b.select(F.col("table_name").alias("table_name_resolved")).distinct().withColumn("in_b", F.lit(True))
    A = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    B = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    j = A.join(B, (F.col("a_table_name") == F.col("b_table_name")) & (F.col("a_column_name") == F.col("b_column_name")), "full_outer")
    j = j.withColumn("table_name_resolved", F.coalesce("a_table_name", "b_table_name"))
    j = j.join(ta, "table_name_resolved", "left").join(tb, "table_name_resolved", "left")
    in_a, in_b = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    label = (
        F.when(F.col("a_table_name").isNull() & F.col("a_column_name").isNull() & in_a, f"COLUMN MISSING IN {a_name}")
        .when(F.col("b_table_name").isNull() & F.col("b_column_name").isNull() & in_b, f"COLUMN MISSING IN {b_name}")
        .when(F.col("a_table_name").isNull() & ~in_a, f"TABLE MISSING IN {a_name}")
        .when(F.col("b_table_name").isNull() & ~in_b, f"TABLE MISSING IN {b_name}")
        .when(F.col("a_data_type") != F.col("b_data_type"), "DATATYPE MISMATCH")
        .when(
            (F.coalesce(F.col("a_precision").try_cast("int"), F.lit(0)) > 0)
            & (~F.col("a_precision").eqNullSafe(F.col("b_precision")) | ~F.col("a_scale").eqNullSafe(F.col("b_scale"))),
            "PRECISION OR SCALE MISMATCH",
        )
        .otherwise("MATCH")
    )
    return j.select(
        "table_name_resolved",
        F.col("a_column_name").alias(f"{a_name.lower()}_column_name"),
        F.col("a_data_type").alias(f"{a_name.lower()}_data_type"),
        F.col("b_column_name").alias(f"{b_name.lower()}_column_name"),
        F.col("b_data_type").alias(f"{b_name.lower()}_data_type"),
        label.alias("comparison_result"),
    )


def ddl_compare_three(sides: Mapping[str, DataFrame], patterns: Sequence[str]) -> DataFrame:
    """Three-way label per (normalised table, column).

    Each side is ``(table_name, column_name, data_type)``; table names are normalised
    by stripping ``patterns``. The second full join is keyed on the coalesced name (X4 fixed).
    """
    names = list(sides)
    frames = []
    for n, df in sides.items():
        p = n.lower()
        frames.append(
            df.select(
                strip_prefix(F.lower("table_name"), patterns).alias("ntable"),
                F.lower("column_name").alias("column_name"),
                F.lower("table_name").alias(f"{p}_table_name"),
                F.lower("column_name").alias(f"{p}_column_name"),
                F.lower("data_type").alias(f"{p}_data_type"),
            )
        )
    j = frames[0].join(frames[1], ["ntable", "column_name"], "full_outer").join(frames[2], ["ntable", "column_name"], "full_outer")
    for n, df in zip(names, frames):
        j = j.join(df.select("ntable").distinct().withColumn(f"__in_{n.lower()}", F.lit(True)), "ntable", "left")
    a, b, c = [n.lower() for n in names]
    present = lambda s: F.col(f"{s}_column_name").isNotNull()
    member = lambda s: F.coalesce(F.col(f"__in_{s}"), F.lit(False))
    label = F.when(
        present(a) & present(b) & present(c),
        F.when((F.col(f"{a}_data_type") == F.col(f"{b}_data_type")) & (F.col(f"{b}_data_type") == F.col(f"{c}_data_type")), "MATCH").otherwise("DATA_TYPE_MISMATCH"),
    )
    for s in (a, b, c):
        label = label.when(~present(s) & member(s), f"COLUMN_MISSING_IN_{s.upper()}").when(~present(s) & ~member(s), f"TABLE_MISSING_IN_{s.upper()}")
    label = label.otherwise("DATA_TYPE_MISMATCH")
    return j.select(
        F.col("ntable").alias("table_name_resolved"),
        *[F.col(f"{s}_{x}") for s in (a, b, c) for x in ("table_name", "column_name", "data_type")],
        label.alias("comparison_result"),
    )


# ------------------------------------------------------------------ drift classes

# Fixed values: (old type, new type) changes that cast without loss.
SAFE_WIDENINGS = [
    ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"),
    ("int", "bigint"), ("int", "double"), ("bigint", "double"), ("float", "double"), ("int", "string"),
    ("bigint", "string"), ("double", "string"), ("date", "timestamp"), ("date", "timestamp_ntz"),
]


def drift_class(old: DataFrame, new: DataFrame) -> DataFrame:
    """Name-keyed drift class per column: NONE, REORDERED (no drift), ADDED_COLUMN,
    MISSING_COLUMN, CAST_COMPATIBLE or CAST_INCOMPATIBLE type change."""
    o = norm_meta(old, fold_types=False).select("t", "c", F.col("dt").alias("old_type"), F.col("pos").alias("old_pos"), F.lit(True).alias("ino"))
    n = norm_meta(new, fold_types=False).select("t", "c", F.col("dt").alias("new_type"), F.col("pos").alias("new_pos"), F.lit(True).alias("inn"))
    j = o.join(n, ["t", "c"], "full_outer")
    safe = F.lit(False)
    for a, b in SAFE_WIDENINGS:
        safe = safe | ((F.col("old_type") == a) & (F.col("new_type") == b))
    cls = (
        F.when(F.col("ino").isNull(), "ADDED_COLUMN")
        .when(F.col("inn").isNull(), "MISSING_COLUMN")
        .when(F.col("old_type") != F.col("new_type"), F.when(safe, "CAST_COMPATIBLE").otherwise("CAST_INCOMPATIBLE"))
        .when(F.col("old_pos") != F.col("new_pos"), "REORDERED")
        .otherwise("NONE")
    )
    return j.select(F.col("t").alias("table_name"), F.col("c").alias("column_name"), "old_type", "new_type", "old_pos", "new_pos", cls.alias("drift_class"))


# ------------------------------------------------------------------ pair discovery


def discover_pairs(src_meta: DataFrame, tgt_meta: DataFrame, domains: Mapping[str, str], suffix: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Source tables per domain prefix (stray suffixed tables excluded), their
    ``<table><suffix>`` target, comparable columns and columns found on one side only."""
    s = norm_meta(src_meta)
    t = norm_meta(tgt_meta)
    dom = None
    for d, prefix in domains.items():
        cond = F.col("t").startswith(prefix.lower())
        dom = F.when(cond, F.lit(d)) if dom is None else dom.when(cond, F.lit(d))
    s = s.withColumn("domain", dom).where(F.col("domain").isNotNull() & ~F.col("t").endswith(suffix))
    ex = [e.lower() for e in excluded]
    s = s.where(~F.col("c").isin(ex))
    t = t.where(F.col("t").endswith(suffix)).where(~F.col("c").isin(ex)).withColumn(
        "t", F.expr(f"substring(t, 1, length(t) - {len(suffix)})")
    )
    src_tables = s.select("domain", "t").distinct()
    tgt_tables = t.select("t").distinct().withColumn("has_target", F.lit(True))
    cols = s.select("t", "c", F.lit(True).alias("ins")).join(t.select("t", "c", F.lit(True).alias("int")), ["t", "c"], "full_outer")
    agg = cols.groupBy("t").agg(
        F.count(F.when(F.col("ins") & F.col("int"), 1)).alias("comparable_columns"),
        _sorted_join(F.col("ins") & F.col("int").isNull(), F.col("c"), ", ").alias("columns_only_in_source"),
        _sorted_join(F.col("int") & F.col("ins").isNull(), F.col("c"), ", ").alias("columns_only_in_target"),
    )
    j = src_tables.join(tgt_tables, "t", "left").join(agg, "t", "left")
    has = F.coalesce(F.col("has_target"), F.lit(False))
    return j.select(
        "domain",
        F.col("t").alias("source_table"),
        F.when(has, F.concat(F.col("t"), F.lit(suffix))).alias("target_table"),
        F.when(has, "PAIRED").otherwise("MISSING_IN_TARGET").alias("pair_status"),
        F.when(has, F.col("comparable_columns")).alias("comparable_columns"),
        F.when(has, F.col("columns_only_in_source")).alias("columns_only_in_source"),
        F.when(has, F.col("columns_only_in_target")).alias("columns_only_in_target"),
    )


def in_scope(meta: DataFrame, scope_col: str | None = "in_scope", tables: Sequence[str] = (), exclude_columns: Sequence[str] = (), name_pattern: str = r"[^a-z0-9_-]") -> DataFrame:
    """Keep in-scope metadata rows: scope flag true (case-insensitive), optional table
    list, table names without unexpected characters, audit columns excluded (case-insensitive, X9)."""
    out = meta.withColumn("table_name", F.lower("table_name")).withColumn("column_name", F.lower("column_name"))
    if scope_col and scope_col in [c.lower() for c in meta.columns]:
        out = out.where(F.lower(F.col(scope_col).cast("string")) == "true")
    if tables:
        out = out.where(F.col("table_name").isin([t.lower() for t in tables]))
    out = out.where(~F.col("table_name").rlike(name_pattern))
    if exclude_columns:
        out = out.where(~F.col("column_name").isin([c.lower() for c in exclude_columns]))
    return out
