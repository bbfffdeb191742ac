"""Column-level helpers (P1-P21): naming, casts, boolean recoding, normalisers.

All of them build Catalyst expressions; nothing runs row by row in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- names


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def resolve_col(df: DataFrame, name: str) -> str:
    """Actual column name for a case-insensitive lookup (the name itself when absent)."""
    return next((c for c in df.columns if c.lower() == name.lower()), name)


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns by case-insensitive name."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])


def column_overlap(a: DataFrame, b: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str], list[str]]:
    """(common, only_in_a, only_in_b), lower-cased and sorted, excluded names removed."""
    ex = {e.lower() for e in exclude}
    ca = {c.lower() for c in a.columns} - ex
    cb = {c.lower() for c in b.columns} - ex
    return sorted(ca & cb), sorted(ca - cb), sorted(cb - ca)


def filter_names(col: Column, prefixes=(), suffixes=(), contains=(), reject_regex: str | None = None, names=()) -> Column:
    """Name filter combining prefix / suffix / contains / regex-reject / IN-list rules."""
    cond = F.lit(True)
    if prefixes:
        cond = cond & _any(col.startswith(p) for p in prefixes)
    if suffixes:
        cond = cond & _any(col.endswith(s) for s in suffixes)
    if contains:
        cond = cond & _any(col.contains(c) for c in contains)
    if reject_regex:
        cond = cond & ~col.rlike(reject_regex)
    if names:
        cond = cond & col.isin(list(names))
    return cond


def _any(conds: Iterable[Column]) -> Column:
    out = None
    for c in conds:
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)


def strip_prefix(col: Column, patterns: Iterable[str]) -> Column:
    """Normalised table name: remove system prefixes (regular expressions, applied in order)."""
    out = col
    for p in patterns:
        out = F.regexp_replace(out, p, "")
    return out


def route_name(col: Column, rules: Mapping[str, str], default: str | None = None) -> Column:
    """Prefix a name with a domain chosen by its first letter."""
    first = F.lower(F.substring(col, 1, 1))
    out = None
    for letter, prefix in rules.items():
        expr = F.concat(F.lit(prefix), col)
        out = F.when(first == letter.lower(), expr) if out is None else out.when(first == letter.lower(), expr)
    if out is None:
        return col
    return out.otherwise(F.lit(default) if default is not None else col)


# ---------------------------------------------------------------- casts


def align_types(source: DataFrame, target: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """P10: ``source`` with each paired column cast to the target's type (the target wins).

    ``try_cast`` keeps malformed text as NULL instead of failing the job under ANSI mode.
    """
    wanted = None if cols is None else {c.lower() for c in cols}
    to = {f.name.lower(): f.dataType for f in target.schema.fields if wanted is None or f.name.lower() in wanted}
    here = [(F.col(f"`{f.name}`"), f, to.get(f.name.lower(), f.dataType)) for f in source.schema.fields]
    return source.select(*[c if kind == f.dataType else c.try_cast(kind).alias(f.name) for c, f, kind in here])


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Every decimal column cast to double in one projection."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def stringify(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Chosen (default all) columns cast to string."""
    chosen = {c.lower() for c in cols} if cols is not None else {c.lower() for c in df.columns}
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c.lower() in chosen else F.col(f"`{c}`") for c in df.columns])


# ---------------------------------------------------------------- booleans

# Pattern labels of a text column holding 't'/'f'/NULL.
BOOLEAN_PATTERNS = ["tf", "t_null", "f_null", "t", "f", "null_only"]


def boolean_pattern_label(has_t: Column, has_f: Column, has_null: Column, has_other: Column) -> Column:
    """Label for a column from its four presence flags; NULL when it is not t/f text."""
    return (
        F.when(has_other, F.lit(None).cast("string"))
        .when(has_t & has_f, "tf")
        .when(has_t & has_null, "t_null")
        .when(has_f & has_null, "f_null")
        .when(has_t, "t")
        .when(has_f, "f")
        .when(has_null, "null_only")
    )


def boolean_patterns(df: DataFrame, cols: Iterable[str] | None = None, case_sensitive: bool = True) -> DataFrame:
    """Detect t/f/NULL columns in ONE aggregate over all columns (not one job per column).

    Returns ``(column_name, has_t, has_f, has_null, has_other, pattern)``; ``pattern`` is
    NULL for columns holding other values. A non-string column can only be
    ``null_only`` (all NULL), as in the reference's distinct-value test.
    """
    names = list(cols) if cols is not None else list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(names):
        raw = F.col(f"`{c}`")
        if isinstance(types[c], T.StringType):
            v = raw if case_sensitive else F.lower(raw)
            t_, f_, o_ = F.coalesce(v == "t", F.lit(False)), F.coalesce(v == "f", F.lit(False)), F.coalesce(~v.isin("t", "f"), F.lit(False))
        else:
            t_, f_, o_ = F.lit(False), F.lit(False), raw.isNotNull()
        aggs += [F.max(t_).alias(f"t{i}"), F.max(f_).alias(f"f{i}"), F.max(raw.isNull()).alias(f"n{i}"), F.max(o_).alias(f"o{i}")]
    wide = df.agg(*aggs)
    longf = wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.coalesce(F.col(f"t{i}"), F.lit(False)).alias("has_t"),
                        F.coalesce(F.col(f"f{i}"), F.lit(False)).alias("has_f"),
                        F.coalesce(F.col(f"n{i}"), F.lit(False)).alias("has_null"),
                        F.coalesce(F.col(f"o{i}"), F.lit(False)).alias("has_other"),
                    )
                    for i, c in enumerate(names)
                ]
            )
        ).alias("p")
    ).select("p.*")
    return longf.withColumn("pattern", boolean_pattern_label(F.col("has_t"), F.col("has_f"), F.col("has_null"), F.col("has_other")))


def recode_boolean(col: Column, null_mode: str = "keep_null") -> Column:
    """P14/P15: 't' -> 1, 'f' -> 0 (case-insensitive); NULL kept or turned into 0."""
    v = F.lower(F.trim(col))
    out = F.when(v == "t", F.lit(1)).when(v == "f", F.lit(0))
    if null_mode == "null_as_zero":
        out = F.coalesce(out, F.lit(0))
    elif null_mode != "keep_null":
        raise ValueError(f"unknown null_mode {null_mode!r}")
    return out


def recode_booleans(df: DataFrame, cols: Iterable[str], null_mode: str = "keep_null") -> DataFrame:
    chosen = {c.lower() for c in cols}
    return df.select(
        *[recode_boolean(F.col(f"`{c}`"), null_mode).alias(c) if c.lower() in chosen else F.col(f"`{c}`") for c in df.columns]
    )


# ---------------------------------------------------------------- text


def replace_chars(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Replace characters in every string column, one projection (regexp_replace, X6)."""
    import re

    def fix(c: Column) -> Column:
        for bad, good in mapping.items():
            c = F.regexp_replace(c, re.escape(bad), good.replace("\\", "\\\\").replace("$", "\\$"))
        return c

    return df.select(
        *[fix(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


#: P20: what doesn't tell two lower-case texts apart, as (pattern, replacement): runs of blanks, blanks
#: at the ends, zeros at the end of a plain decimal, and its point if nothing else follows.
FORMAT_RULES = [
    (r"[\x09-\x0D ]+", " "),
    (r"^ | $", ""),
    (r"^(-?[0-9]+\.[0-9]*[1-9])0+$", "$1"),
    (r"^(-?[0-9]+)\.0+$", "$1"),
]


def normalize_format(col: Column) -> Column:
    """P20: the text without what ``FORMAT_RULES`` takes away ('  A  123.50' and 'a 123.50' are alike, as are '123.50' and '123.5')."""
    out = F.lower(col)
    for pattern, new in FORMAT_RULES:
        out = F.regexp_replace(out, pattern, new)
    return out


def normal_text_sql(value: str) -> str:
    """``normalize_format`` as SQL text: wide tables build many of these, and a text costs one call."""
    out = f"lower({value})"
    for pattern, new in FORMAT_RULES:
        escaped = pattern.replace("\\", "\\\\")
        out = f"regexp_replace({out}, '{escaped}', '{new}')"
    return out


# Names of one type under several spellings, and the numeric ones among all names.
TYPE_ALIASES = {"varchar": "string", "char": "string", "character": "string", "decimal": "decimal", "numeric": "decimal"}
NUMERIC_TYPES = ["tinyint", "smallint", "int", "integer", "bigint", "long", "float", "double", "decimal", "numeric"]


def _type_word(col: Column) -> tuple[Column, Column]:
    """A type name in lower case (empty for none), and the word it begins with."""
    name = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return name, F.regexp_extract(name, "^[a-z]+", 0)


def normalize_type(col: Column, fold: bool = True) -> Column:
    """A type name in lower case; with ``fold`` the one name of its aliases, without length or precision."""
    name, word = _type_word(col)
    return F.coalesce(map_lookup(word, TYPE_ALIASES, None), name) if fold else name


def type_family(col: Column) -> Column:
    """``numeric`` for every number type, whatever its precision; else the name."""
    name, word = _type_word(col)
    plain = F.regexp_replace(name, r"\(.*$", "") == word
    return F.when(plain & word.isin(NUMERIC_TYPES), "numeric").otherwise(name)


# ---------------------------------------------------------------- nested / lookup


def field_or(df: DataFrame, struct_col: str, field: str, default=None) -> Column:
    """Struct field -> dotted top-level column -> literal, resolved on the schema."""
    lookup = {c.lower(): c for c in df.columns}
    if struct_col.lower() in lookup:
        dt = df.schema[lookup[struct_col.lower()]].dataType
        if isinstance(dt, T.StructType):
            return F.col(f"`{lookup[struct_col.lower()]}`").getField(field).cast("string")
    dotted = f"{struct_col}.{field}".lower()
    if dotted in lookup:
        return F.col(f"`{lookup[dotted]}`").cast("string")
    return F.lit(default).cast("string")


def pick_event_time(df: DataFrame, time_col: str, date_col: str) -> tuple[Column | None, bool]:
    """Event time (timestamp column, else the date column at midnight) and whether the date column exists."""
    lookup = {c.lower(): c for c in df.columns}
    has_date = date_col.lower() in lookup
    if time_col.lower() in lookup:
        return F.col(f"`{lookup[time_col.lower()]}`"), has_date
    if has_date:
        return F.col(f"`{lookup[date_col.lower()]}`").cast("date").cast("timestamp_ntz"), True
    return None, False


def map_lookup(col: Column, mapping: Mapping[str, str], default: str | None) -> Column:
    """Literal map lookup with a default for unknown keys."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col), F.lit(default))
