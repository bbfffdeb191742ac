"""Column-level queries: boolean detection and recoding, type alignment, decimals, character cleanup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx

_BCOLS = ["o_orderkey", "o_isfinal", "o_flag_upper", "o_t_only", "o_unused", "o_orderstatus", "o_orderpriority"]
_STR = set(_BCOLS) - {"o_orderkey"}


def _bp_sql() -> str:
    aggs = []
    for c in _BCOLS:
        if c in _STR:
            aggs.append(
                f"coalesce(bool_or(coalesce({c} = 't', FALSE)), FALSE) AS {c}__t, coalesce(bool_or(coalesce({c} = 'f', FALSE)), FALSE) AS {c}__f, "
                f"coalesce(bool_or({c} IS NULL), FALSE) AS {c}__n, coalesce(bool_or(coalesce({c} NOT IN ('t', 'f'), FALSE)), FALSE) AS {c}__o"
            )
        else:
            aggs.append(f"FALSE AS {c}__t, FALSE AS {c}__f, coalesce(bool_or({c} IS NULL), FALSE) AS {c}__n, coalesce(bool_or({c} IS NOT NULL), FALSE) AS {c}__o")
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}__t AS has_t, {c}__f AS has_f, {c}__n AS has_null, {c}__o AS has_other FROM a" for c in _BCOLS)
    return f"""WITH a AS (SELECT {', '.join(aggs)} FROM bool_orders), l AS ({parts})
SELECT *, CASE WHEN has_other THEN NULL WHEN has_t AND has_f THEN 'tf' WHEN has_t AND has_null THEN 't_null' WHEN has_f AND has_null THEN 'f_null'
  WHEN has_t THEN 't' WHEN has_f THEN 'f' WHEN has_null THEN 'null_only' END AS pattern FROM l"""


@query("boolean_patterns", _bp_sql(), ("bool_orders",))
def boolean_patterns(spark, sf):
    """t/f/NULL pattern of every column in one aggregate."""
    return C.boolean_patterns(fx.bool_orders(spark, sf).select(*_BCOLS))


_RC = ["o_isfinal", "o_flag_upper", "o_t_only"]


def _rc_sql(zero: bool) -> str:
    def e(c):
        x = f"CASE WHEN lower(trim({c})) = 't' THEN 1 WHEN lower(trim({c})) = 'f' THEN 0 END"
        return f"coalesce({x}, 0)" if zero else x

    return "SELECT o_orderkey, " + ", ".join(f"{e(c)} AS {c}" for c in _RC) + ", o_orderstatus FROM bool_orders"


@query("boolean_recode_null", _rc_sql(False), ("bool_orders",))
def boolean_recode_null(spark, sf):
    """T -> 1, f -> 0, NULL kept."""
    return C.recode_booleans(fx.bool_orders(spark, sf).select("o_orderkey", *_RC, "o_orderstatus"), _RC, "keep_null")


@query("boolean_recode_zero", _rc_sql(True), ("bool_orders",))
def boolean_recode_zero(spark, sf):
    """T -> 1, f -> 0, NULL -> 0."""
    return C.recode_booleans(fx.bool_orders(spark, sf).select("o_orderkey", *_RC, "o_orderstatus"), _RC, "null_as_zero")


@query(
    "align_types",
    """SELECT o_orderkey, TRY_CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice,
  o_orderdate, o_orderpriority FROM typed_target""",
    ("typed_target",),
)
def align_types(spark, sf):
    """P10: source columns cast to the target's types (try_cast, the target wins)."""
    return C.align_types(fx.typed_target(spark, sf), fx.src_orders(spark, sf))


@query(
    "decimal_to_double",
    "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount, l_quantity FROM decimal_lineitem",
    ("decimal_lineitem",),
)
def decimal_to_double(spark, sf):
    """Every decimal column to double, one projection."""
    return C.decimals_to_double(fx.decimal_lineitem(spark, sf))


# The replacement character becomes a hyphen; line breaks become blanks.
REPLACEMENTS = {"�": "-", "\n": " "}


@query(
    "replace_chars",
    """SELECT doc_id, replace(replace(text, chr(65533), '-'), chr(10), ' ') AS text, lang, source,
  CAST(length(text) - length(replace(replace(text, chr(65533), ''), chr(10), '')) AS BIGINT) AS replaced_chars
FROM documents""",
)
def replace_chars(spark, sf):
    """Character replacement in every string column of a table, whole texts."""
    removed = F.col("text")
    for bad in REPLACEMENTS:
        removed = F.replace(removed, F.lit(bad), F.lit(""))
    d = fx.load(spark, sf, "documents").select(
        "doc_id", "text", "lang", "source", (F.length("text") - F.length(removed)).cast("long").alias("replaced_chars")
    )
    # One projection: the count is computed from the original text, then every string column is cleaned.
    return C.replace_chars(d, REPLACEMENTS)
