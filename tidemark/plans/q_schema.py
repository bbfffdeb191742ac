"""Schema-drift queries over metadata derived from the driver tables.

Three metadata sets (FIXTURES.md): PROD = the real schemas; TST = PROD with one
column dropped, one added, one retyped, one widened, one nullability flip, two
columns swapped and one table missing; CDA = PROD with the ``_cda`` suffix, a
dropped column, a decimal column, a CDC column, an extra column, a missing and an
orphan table. The DuckDB twins build the same sets from ``information_schema``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from tidemark.operators import schema as S
from tidemark.operators.aggs import row_counts
from tidemark.plans.oracle_fixtures import register
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx
from tidemark.sources.readers import literal_rows, table_columns

ALL_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
META_TABLES = ["orders", "lineitem", "customer", "part", "supplier", "nation", "region"]
CDA_IGNORE = ["cdc_operation"]


def _meta(spark, sf, tables):
    return table_columns(spark, {t: fx.load(spark, sf, t) for t in tables})


def _is(t, c=None):
    cond = F.col("table_name") == t
    return cond & (F.col("column_name") == c) if c else cond


def _renamed(meta, t, c, table, column, dtype, pos_delta=1):
    return meta.where(_is(t, c)).select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit(dtype).alias("data_type"),
        "is_nullable", (F.col("ordinal_position") + pos_delta).alias("ordinal_position"),
    )


@lru_cache(maxsize=16)
def meta_prod(spark, sf):
    return _meta(spark, sf, META_TABLES)


@lru_cache(maxsize=16)
def meta_tst(spark, sf):
    p = meta_prod(spark, sf)
    dt = F.when(_is("customer", "c_acctbal"), "string").when(_is("part", "p_size"), "bigint").otherwise(F.col("data_type"))
    nl = F.when(_is("nation", "n_regionkey"), "NO").otherwise(F.col("is_nullable"))
    pos = F.when(_is("part", "p_name"), 3).when(_is("part", "p_brand"), 2).otherwise(F.col("ordinal_position"))
    base = p.where(~_is("orders", "o_orderpriority") & ~_is("supplier")).select(
        "table_name", "column_name", dt.alias("data_type"), nl.alias("is_nullable"), pos.alias("ordinal_position")
    )
    return base.unionByName(_renamed(p, "lineitem", "l_shipdate", "lineitem", "l_comment", "string"))


@lru_cache(maxsize=16)
def meta_cda(spark, sf):
    p = meta_prod(spark, sf)
    dt = F.when(_is("part", "p_retailprice"), "decimal(12,2)").otherwise(F.col("data_type"))
    base = p.where(~_is("orders", "o_custkey") & ~_is("region")).select(
        F.concat("table_name", F.lit("_cda")).alias("table_name"), "column_name", dt.alias("data_type"), "is_nullable", "ordinal_position"
    )
    return (
        base.unionByName(_renamed(p, "lineitem", "l_shipdate", "lineitem_cda", "cdc_operation", "string"))
        .unionByName(_renamed(p, "lineitem", "l_shipdate", "lineitem_cda", "l_extra", "string", 2))
        .unionByName(p.where(_is("region")).withColumn("table_name", F.lit("audit_log_cda")))
    )


# ---------------------------------------------------------------- SQL twins
_TYPE_MAP = """CASE upper(data_type) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
  WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DATE' THEN 'date'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'FLOAT' THEN 'float' WHEN 'SMALLINT' THEN 'smallint' ELSE lower(data_type) END"""


def _info(tables) -> str:
    names = ", ".join(f"'{t}'" for t in tables)
    return f"""SELECT DISTINCT table_name, column_name, {_TYPE_MAP} AS data_type, is_nullable, CAST(ordinal_position AS INTEGER) AS ordinal_position
FROM information_schema.columns WHERE table_name IN ({names})"""


register("meta_all", _info(ALL_TABLES))
register("meta_prod", _info(META_TABLES))


def _ren_sql(t, c, table, column, dtype, delta=1):
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{dtype}' AS data_type, is_nullable, ordinal_position + {delta} AS ordinal_position FROM meta_prod WHERE table_name = '{t}' AND column_name = '{c}'"


register(
    "meta_tst",
    f"""SELECT table_name, column_name,
  CASE WHEN table_name = 'customer' AND column_name = 'c_acctbal' THEN 'string' WHEN table_name = 'part' AND column_name = 'p_size' THEN 'bigint' ELSE data_type END AS data_type,
  CASE WHEN table_name = 'nation' AND column_name = 'n_regionkey' THEN 'NO' ELSE is_nullable END AS is_nullable,
  CASE WHEN table_name = 'part' AND column_name = 'p_name' THEN 3 WHEN table_name = 'part' AND column_name = 'p_brand' THEN 2 ELSE ordinal_position END AS ordinal_position
FROM meta_prod WHERE NOT (table_name = 'orders' AND column_name = 'o_orderpriority') AND table_name <> 'supplier'
UNION ALL {_ren_sql('lineitem', 'l_shipdate', 'lineitem', 'l_comment', 'string')}""",
    ("meta_prod",),
)
register(
    "meta_cda",
    f"""SELECT table_name || '_cda' AS table_name, column_name,
  CASE WHEN table_name = 'part' AND column_name = 'p_retailprice' THEN 'decimal(12,2)' ELSE data_type END AS data_type, is_nullable, ordinal_position
FROM meta_prod WHERE NOT (table_name = 'orders' AND column_name = 'o_custkey') AND table_name <> 'region'
UNION ALL {_ren_sql('lineitem', 'l_shipdate', 'lineitem_cda', 'cdc_operation', 'string')}
UNION ALL {_ren_sql('lineitem', 'l_shipdate', 'lineitem_cda', 'l_extra', 'string', 2)}
UNION ALL SELECT 'audit_log_cda', column_name, data_type, is_nullable, ordinal_position FROM meta_prod WHERE table_name = 'region'""",
    ("meta_prod",),
)

_NUMERIC = "('tinyint', 'smallint', 'int', 'integer', 'bigint', 'long', 'float', 'double', 'decimal', 'numeric')"


def _ntype(x: str) -> str:
    d = f"lower(trim(coalesce({x}, '')))"
    return f"(CASE WHEN {d} LIKE 'varchar%' OR {d} LIKE 'char%' THEN 'string' WHEN {d} LIKE 'decimal%' OR {d} LIKE 'numeric%' THEN 'decimal' ELSE {d} END)"


def _fam(x: str) -> str:
    return f"(CASE WHEN split_part({x}, '(', 1) IN {_NUMERIC} THEN 'numeric' ELSE {x} END)"


def _norm(src: str) -> str:
    return f"SELECT lower(table_name) AS t, lower(column_name) AS c, {_ntype('data_type')} AS dt, upper(is_nullable) = 'YES' AS nl FROM {src}"


def _bt(x: str) -> str:
    return f"(CASE WHEN {x} THEN 'True' ELSE 'False' END)"


def _findings_sql(name: str, base: str, other: str, label: str, base_label: str, ignore=(), with_bl: bool = False) -> str:
    """CTE ``name`` (t + five lists); ``base_label`` is SQL text (a literal or column)."""
    ig = " AND c NOT IN (" + ", ".join(f"'{i}'" for i in ignore) + ")" if ignore else ""
    bl_col = ", b.bl AS bl" if with_bl else f", {base_label} AS bl"
    ty = f"upper(c) || ': ' || bl || '=' || bdt || ' vs {label}=' || odt"
    nt = f"upper(c) || ': ' || bl || '_nullable=' || {_bt('bnl')} || ' vs {label}_nullable=' || {_bt('onl')}"
    differ = "inb AND ino AND bdt <> odt"
    num = f"{_fam('bdt')} = 'numeric' AND {_fam('odt')} = 'numeric'"
    return f"""{name}_j AS (SELECT coalesce(b.t, o.t) AS t, coalesce(b.c, o.c) AS c, b.dt AS bdt, o.dt AS odt, b.nl AS bnl, o.nl AS onl,
    b.c IS NOT NULL AS inb, o.c IS NOT NULL AS ino{bl_col.replace('b.bl', 'coalesce(b.bl, o.bl)')}
  FROM (SELECT * FROM {base} WHERE TRUE{ig}) b FULL OUTER JOIN (SELECT * FROM {other} WHERE TRUE{ig}) o ON b.t = o.t AND b.c = o.c),
{name} AS (SELECT t,
  coalesce(string_agg(CASE WHEN inb AND NOT ino THEN upper(c) END, ', ' ORDER BY c), '') AS missing_columns,
  coalesce(string_agg(CASE WHEN ino AND NOT inb THEN upper(c) END, ', ' ORDER BY c), '') AS additional_columns,
  coalesce(string_agg(CASE WHEN {differ} AND NOT ({num}) THEN {ty} END, '; ' ORDER BY c), '') AS datatype_mismatches,
  coalesce(string_agg(CASE WHEN {differ} AND ({num}) THEN {ty} END, '; ' ORDER BY c), '') AS numeric_type_variances,
  coalesce(string_agg(CASE WHEN inb AND ino AND bnl <> onl THEN {nt} END, '; ' ORDER BY c), '') AS nullability_mismatches
  FROM {name}_j GROUP BY t)"""


def _sev(label: str, exists: str, p: str = "") -> str:
    ne = lambda n: f"coalesce({p}{n}, '') <> ''"
    fail = f"{ne('missing_columns')} OR {ne('datatype_mismatches')}" + ("" if label == "CDA" else f" OR {ne('additional_columns')}")
    warn = f"{ne('numeric_type_variances')} OR {ne('additional_columns')} OR {ne('nullability_mismatches')}"
    return f"(CASE WHEN NOT ({exists}) THEN 'FAIL' WHEN {fail} THEN 'FAIL' WHEN {warn} THEN 'WARN' ELSE 'PASS' END)"


_LISTS = ["missing_columns", "additional_columns", "datatype_mismatches", "numeric_type_variances", "nullability_mismatches"]

_PAIR_SQL = f"""WITH pb AS ({_norm('meta_prod')}), po AS ({_norm('meta_tst')}),
{_findings_sql('pf', 'pb', 'po', 'TST', "'PROD'")},
tb AS (SELECT DISTINCT t FROM pb), tob AS (SELECT DISTINCT t FROM po),
x AS (SELECT tb.t, tob.t IS NOT NULL AS exists_in_other FROM tb LEFT JOIN tob ON tb.t = tob.t)
SELECT x.t AS table_name, exists_in_other, {', '.join(f'CASE WHEN exists_in_other THEN pf.{c} END AS {c}' for c in _LISTS)},
  {_sev('TST', 'exists_in_other', 'pf.')} AS status
FROM x LEFT JOIN pf ON x.t = pf.t"""


@query("schema_pair", _PAIR_SQL, ("meta_tst",))
def schema_pair(spark, sf):
    """TST against PROD, one row per PROD table."""
    return S.schema_pair(meta_prod(spark, sf), meta_tst(spark, sf), "TST", "PROD")


_DRIFT_SQL = f"""WITH p AS ({_norm('meta_prod')}), t AS ({_norm('meta_tst')}),
c AS (SELECT substring(t, 1, length(t) - 4) AS t, c, dt, nl FROM ({_norm('meta_cda')}) WHERE t LIKE '%\\_cda' ESCAPE '\\'),
tables AS (SELECT coalesce(a.t, b.t, cc.t) AS t, coalesce(a.e, FALSE) AS exists_in_prod, coalesce(b.e, FALSE) AS exists_in_tst, coalesce(cc.e, FALSE) AS exists_in_cda
  FROM (SELECT DISTINCT t, TRUE AS e FROM p) a FULL OUTER JOIN (SELECT DISTINCT t, TRUE AS e FROM t) b ON a.t = b.t
  FULL OUTER JOIN (SELECT DISTINCT t, TRUE AS e FROM c) cc ON coalesce(a.t, b.t) = cc.t),
tb AS (SELECT *, CASE WHEN exists_in_prod THEN 'PROD' WHEN exists_in_tst THEN 'TST' ELSE 'NONE' END AS baseline_source FROM tables),
basemeta AS (SELECT p.*, 'PROD' AS bl FROM p UNION ALL SELECT t.*, 'TST' AS bl FROM t WHERE t.t NOT IN (SELECT t FROM p)),
cm AS (SELECT c.*, tb.baseline_source AS bl FROM c JOIN tb ON c.t = tb.t),
{_findings_sql('tf', 'p', 't', 'TST', "'PROD'")},
{_findings_sql('cf', 'basemeta', 'cm', 'CDA', '', CDA_IGNORE, with_bl=True)},
j AS (SELECT tb.*, {', '.join(f'tf.{x} AS tst_{x}' for x in _LISTS)}, {', '.join(f'cf.{x} AS cda_{x}' for x in _LISTS)}
  FROM tb LEFT JOIN tf ON tb.t = tf.t LEFT JOIN cf ON tb.t = cf.t),
s AS (SELECT *,
  CASE WHEN baseline_source = 'NONE' THEN 'N/A' WHEN baseline_source = 'PROD' THEN {_sev('TST', 'exists_in_tst', 'tst_')} ELSE 'N/A' END AS tst_vs_prod_status,
  CASE WHEN baseline_source = 'NONE' THEN 'N/A' ELSE {_sev('CDA', 'exists_in_cda', 'cda_')} END AS cda_vs_prod_status FROM j),
r AS (SELECT *, greatest(CASE WHEN exists_in_prod THEN 0 ELSE 1 END,
    CASE tst_vs_prod_status WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 WHEN 'FAIL' THEN 2 WHEN 'ERROR' THEN 3 END,
    CASE cda_vs_prod_status WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 WHEN 'FAIL' THEN 2 WHEN 'ERROR' THEN 3 END) AS rk FROM s)
SELECT t AS table_base_name, exists_in_prod, exists_in_tst, exists_in_cda, baseline_source, tst_vs_prod_status, cda_vs_prod_status,
  {', '.join(f"CASE WHEN baseline_source = 'PROD' AND exists_in_tst THEN tst_{x} END AS tst_{x}" for x in _LISTS[:4])},
  {', '.join(f"CASE WHEN baseline_source <> 'NONE' AND exists_in_cda THEN cda_{x} END AS cda_{x}" for x in _LISTS[:4])},
  CASE WHEN baseline_source = 'NONE' THEN 'WARN' WHEN rk = 3 THEN 'ERROR' WHEN rk = 2 THEN 'FAIL' WHEN rk = 1 THEN 'WARN' ELSE 'PASS' END AS overall_status
FROM r"""


@query("schema_drift_3way", _DRIFT_SQL, ("meta_tst", "meta_cda"))
def schema_drift_3way(spark, sf):
    """Three-way drift with PROD baseline and TST fallback."""
    return S.schema_drift(meta_prod(spark, sf), meta_tst(spark, sf), meta_cda(spark, sf), "_cda", CDA_IGNORE)


def _ddl_a(spark, sf):
    p = meta_prod(spark, sf)
    dt = F.when(_is("part", "p_retailprice"), "decimal(12,2)").when(_is("lineitem", "l_extendedprice"), "decimal(15,2)").otherwise(F.col("data_type"))
    return S.ddl_sides(p.withColumn("data_type", dt))


def _ddl_b(spark, sf):
    t = meta_tst(spark, sf)
    dt = F.when(_is("part", "p_retailprice"), "decimal(12,4)").when(_is("lineitem", "l_extendedprice"), "decimal(15,2)").otherwise(F.col("data_type"))
    return S.ddl_sides(t.withColumn("data_type", dt))


def _ddl_side_sql(src: str, tweaks: str) -> str:
    dt = f"lower(CASE {tweaks} ELSE data_type END)"
    return f"""SELECT lower(table_name) AS table_name, lower(column_name) AS column_name, regexp_replace({dt}, '\\(.*$', '') AS data_type,
  NULLIF(regexp_extract({dt}, '\\((\\d+)', 1), '') AS precision, NULLIF(regexp_extract({dt}, ',\\s*(\\d+)\\)', 1), '') AS scale FROM {src}"""


_TW_A = "WHEN table_name = 'part' AND column_name = 'p_retailprice' THEN 'decimal(12,2)' WHEN table_name = 'lineitem' AND column_name = 'l_extendedprice' THEN 'decimal(15,2)'"
_TW_B = "WHEN table_name = 'part' AND column_name = 'p_retailprice' THEN 'decimal(12,4)' WHEN table_name = 'lineitem' AND column_name = 'l_extendedprice' THEN 'decimal(15,2)'"

_DDL2_SQL = f"""WITH a AS (SELECT * FROM ({_ddl_side_sql('meta_prod', _TW_A)}) WHERE lower(column_name) NOT IN ('r_name')),
b AS ({_ddl_side_sql('meta_tst', _TW_B)}),
j AS (SELECT coalesce(a.table_name, b.table_name) AS table_name_resolved, a.table_name AS a_t, a.column_name AS a_c, a.data_type AS a_dt,
        a.precision AS a_p, a.scale AS a_s, b.table_name AS b_t, b.column_name AS b_c, b.data_type AS b_dt, b.precision AS b_p, b.scale AS b_s
      FROM a FULL OUTER JOIN b ON a.table_name = b.table_name AND a.column_name = b.column_name),
k AS (SELECT j.*, ta.x IS NOT NULL AS in_a, tb.x IS NOT NULL AS in_b FROM j
      LEFT JOIN (SELECT DISTINCT table_name AS x FROM a) ta ON j.table_name_resolved = ta.x
      LEFT JOIN (SELECT DISTINCT table_name AS x FROM b) tb ON j.table_name_resolved = tb.x)
SELECT table_name_resolved, a_c AS source_column_name, a_dt AS source_data_type, b_c AS target_column_name, b_dt AS target_data_type,
  CASE WHEN a_t IS NULL AND a_c IS NULL AND in_a THEN 'COLUMN MISSING IN SOURCE'
       WHEN b_t IS NULL AND b_c IS NULL AND in_b THEN 'COLUMN MISSING IN TARGET'
       WHEN a_t IS NULL AND NOT in_a THEN 'TABLE MISSING IN SOURCE'
       WHEN b_t IS NULL AND NOT in_b THEN 'TABLE MISSING IN TARGET'
       WHEN a_dt <> b_dt THEN 'DATATYPE MISMATCH'
       WHEN coalesce(TRY_CAST(a_p AS INTEGER), 0) > 0 AND (a_p IS DISTINCT FROM b_p OR a_s IS DISTINCT FROM b_s) THEN 'PRECISION OR SCALE MISMATCH'
       ELSE 'MATCH' END AS comparison_result
FROM k"""


@query("ddl_compare_2way", _DDL2_SQL, ("meta_tst",))
def ddl_compare_2way(spark, sf):
    """Two-way DDL labels (precision/scale checked for decimals; exclusion case-insensitive)."""
    return S.ddl_compare(_ddl_a(spark, sf), _ddl_b(spark, sf), "SOURCE", "TARGET", exclude=["R_NAME"])


_PATTERNS = [r"^sys_", r"_cda$"]


@query(
    "ddl_compare_3way",
    """WITH a AS (SELECT lower(table_name) AS tn, lower(column_name) AS cn, lower(data_type) AS dt FROM meta_prod),
b AS (SELECT 'sys_' || lower(table_name) AS tn, lower(column_name) AS cn, lower(data_type) AS dt FROM meta_tst),
c AS (SELECT lower(table_name) AS tn, lower(column_name) AS cn, lower(data_type) AS dt FROM meta_cda),
na AS (SELECT regexp_replace(regexp_replace(tn, '^sys_', ''), '_cda$', '') AS nt, cn AS column_name, tn AS source_table_name, cn AS source_column_name, dt AS source_data_type FROM a),
nb AS (SELECT regexp_replace(regexp_replace(tn, '^sys_', ''), '_cda$', '') AS nt, cn AS column_name, tn AS replica_table_name, cn AS replica_column_name, dt AS replica_data_type FROM b),
nc AS (SELECT regexp_replace(regexp_replace(tn, '^sys_', ''), '_cda$', '') AS nt, cn AS column_name, tn AS copy_table_name, cn AS copy_column_name, dt AS copy_data_type FROM c),
ab AS (SELECT coalesce(na.nt, nb.nt) AS nt, coalesce(na.column_name, nb.column_name) AS column_name, na.source_table_name, na.source_column_name, na.source_data_type,
              nb.replica_table_name, nb.replica_column_name, nb.replica_data_type FROM na FULL OUTER JOIN nb ON na.nt = nb.nt AND na.column_name = nb.column_name),
abc AS (SELECT coalesce(ab.nt, nc.nt) AS nt, ab.*, nc.copy_table_name, nc.copy_column_name, nc.copy_data_type FROM ab FULL OUTER JOIN nc ON ab.nt = nc.nt AND ab.column_name = nc.column_name),
m AS (SELECT abc.*, coalesce(ia.e, FALSE) AS in_source, coalesce(ib.e, FALSE) AS in_replica, coalesce(ic.e, FALSE) AS in_copy FROM abc
  LEFT JOIN (SELECT DISTINCT nt, TRUE AS e FROM na) ia ON abc.nt = ia.nt
  LEFT JOIN (SELECT DISTINCT nt, TRUE AS e FROM nb) ib ON abc.nt = ib.nt
  LEFT JOIN (SELECT DISTINCT nt, TRUE AS e FROM nc) ic ON abc.nt = ic.nt)
SELECT nt AS table_name_resolved, source_table_name, source_column_name, source_data_type, replica_table_name, replica_column_name, replica_data_type,
  copy_table_name, copy_column_name, copy_data_type,
  CASE WHEN source_column_name IS NOT NULL AND replica_column_name IS NOT NULL AND copy_column_name IS NOT NULL
         THEN CASE WHEN source_data_type = replica_data_type AND replica_data_type = copy_data_type THEN 'MATCH' ELSE 'DATA_TYPE_MISMATCH' END
       WHEN source_column_name IS NULL AND in_source THEN 'COLUMN_MISSING_IN_SOURCE'
       WHEN source_column_name IS NULL AND NOT in_source THEN 'TABLE_MISSING_IN_SOURCE'
       WHEN replica_column_name IS NULL AND in_replica THEN 'COLUMN_MISSING_IN_REPLICA'
       WHEN replica_column_name IS NULL AND NOT in_replica THEN 'TABLE_MISSING_IN_REPLICA'
       WHEN copy_column_name IS NULL AND in_copy THEN 'COLUMN_MISSING_IN_COPY'
       WHEN copy_column_name IS NULL AND NOT in_copy THEN 'TABLE_MISSING_IN_COPY'
       ELSE 'DATA_TYPE_MISMATCH' END AS comparison_result
FROM m""",
    ("meta_tst", "meta_cda"),
)
def ddl_compare_3way(spark, sf):
    """Three-way labels over normalised table names (prefix/suffix stripped)."""
    t = meta_tst(spark, sf).withColumn("table_name", F.concat(F.lit("sys_"), "table_name"))
    return S.ddl_compare_three({"SOURCE": meta_prod(spark, sf), "REPLICA": t, "COPY": meta_cda(spark, sf)}, _PATTERNS)


_SAFE = " OR ".join(f"(old_type = '{a}' AND new_type = '{b}')" for a, b in S.SAFE_WIDENINGS)


@query(
    "schema_drift_class",
    f"""WITH o AS (SELECT lower(table_name) AS t, lower(column_name) AS c, lower(trim(data_type)) AS old_type, ordinal_position AS old_pos FROM meta_prod),
n AS (SELECT lower(table_name) AS t, lower(column_name) AS c, lower(trim(data_type)) AS new_type, ordinal_position AS new_pos FROM meta_tst),
j AS (SELECT coalesce(o.t, n.t) AS table_name, coalesce(o.c, n.c) AS column_name, old_type, new_type, old_pos, new_pos,
        o.c IS NOT NULL AS ino, n.c IS NOT NULL AS inn FROM o FULL OUTER JOIN n ON o.t = n.t AND o.c = n.c)
SELECT table_name, column_name, old_type, new_type, old_pos, new_pos,
  CASE WHEN NOT ino THEN 'ADDED_COLUMN' WHEN NOT inn THEN 'MISSING_COLUMN'
       WHEN old_type <> new_type THEN CASE WHEN {_SAFE} THEN 'CAST_COMPATIBLE' ELSE 'CAST_INCOMPATIBLE' END
       WHEN old_pos <> new_pos THEN 'REORDERED' ELSE 'NONE' END AS drift_class
FROM j""",
    ("meta_tst",),
)
def schema_drift_class(spark, sf):
    """Added / missing / compatible / incompatible / reordered columns."""
    return S.drift_class(meta_prod(spark, sf), meta_tst(spark, sf))


DOMAINS = {"sales": "o", "items": "l", "parties": "c", "catalog": "p", "supply": "s", "geo": "n", "zones": "r"}


def _dom_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} LIKE '{p}%' THEN '{d}'" for d, p in DOMAINS.items()) + " END"


@query(
    "discover_pairs",
    f"""WITH src AS (SELECT lower(table_name) AS t, lower(column_name) AS c FROM meta_prod
                 UNION ALL SELECT 'customer_cda', lower(column_name) FROM meta_prod WHERE table_name = 'customer'),
s AS (SELECT {_dom_sql('t')} AS domain, t, c FROM src WHERE {_dom_sql('t')} IS NOT NULL AND t NOT LIKE '%\\_cda' ESCAPE '\\' AND c NOT IN ('cdc_operation')),
tg AS (SELECT substring(lower(table_name), 1, length(table_name) - 4) AS t, lower(column_name) AS c FROM meta_cda
       WHERE lower(table_name) LIKE '%\\_cda' ESCAPE '\\' AND lower(column_name) NOT IN ('cdc_operation')),
cols AS (SELECT coalesce(s.t, tg.t) AS t, coalesce(s.c, tg.c) AS c, s.c IS NOT NULL AS ins, tg.c IS NOT NULL AS int_ FROM (SELECT t, c FROM s) s FULL OUTER JOIN tg ON s.t = tg.t AND s.c = tg.c),
agg AS (SELECT t, count(CASE WHEN ins AND int_ THEN 1 END) AS comparable_columns,
  coalesce(string_agg(CASE WHEN ins AND NOT int_ THEN c END, ', ' ORDER BY c), '') AS columns_only_in_source,
  coalesce(string_agg(CASE WHEN int_ AND NOT ins THEN c END, ', ' ORDER BY c), '') AS columns_only_in_target FROM cols GROUP BY t),
st AS (SELECT DISTINCT domain, t FROM s),
tt AS (SELECT DISTINCT t FROM tg)
SELECT st.domain, st.t AS source_table, CASE WHEN tt.t IS NOT NULL THEN st.t || '_cda' END AS target_table,
  CASE WHEN tt.t IS NOT NULL THEN 'PAIRED' ELSE 'MISSING_IN_TARGET' END AS pair_status,
  CASE WHEN tt.t IS NOT NULL THEN agg.comparable_columns END AS comparable_columns,
  CASE WHEN tt.t IS NOT NULL THEN agg.columns_only_in_source END AS columns_only_in_source,
  CASE WHEN tt.t IS NOT NULL THEN agg.columns_only_in_target END AS columns_only_in_target
FROM st LEFT JOIN tt ON st.t = tt.t LEFT JOIN agg ON st.t = agg.t""",
    ("meta_prod", "meta_cda"),
)
def discover_pairs(spark, sf):
    """Table pairs per domain prefix, stray suffixed source tables excluded, missing targets listed."""
    p = meta_prod(spark, sf)
    src = p.unionByName(p.where(_is("customer")).withColumn("table_name", F.lit("customer_cda")))
    return S.discover_pairs(src, meta_cda(spark, sf), DOMAINS, "_cda", CDA_IGNORE)


@query("schema_meta", "SELECT * FROM meta_all", ("meta_all",))
def schema_meta(spark, sf):
    """Column metadata of every driver table (no data scanned)."""
    return _meta(spark, sf, ALL_TABLES)


_EXPECTED = [("orders", "o_orderkey"), ("orders", "o_comment"), ("lineitem", "l_shipdate"), ("lineitem", "l_shipmode"), ("customer", "c_name"), ("customer", "c_phone")]


@query(
    "dq_expected_columns",
    "SELECT e.table_name, e.column_name, m.column_name IS NOT NULL AS present FROM (VALUES "
    + ", ".join(f"('{t}', '{c}')" for t, c in _EXPECTED)
    + ") AS e(table_name, column_name) LEFT JOIN meta_prod m ON e.table_name = m.table_name AND e.column_name = m.column_name",
    ("meta_prod",),
)
def dq_expected_columns(spark, sf):
    """Q-10: completeness of expected columns (expected list joined to the metadata)."""
    from tidemark.operators.quality import expected_columns

    exp = literal_rows(spark, _EXPECTED, "table_name string, column_name string")
    return expected_columns(meta_prod(spark, sf), exp)


@query(
    "column_overlap",
    """WITH a AS (SELECT table_name, column_name FROM meta_prod), b AS (SELECT table_name, column_name FROM meta_tst),
both_t AS (SELECT DISTINCT a.table_name FROM a JOIN (SELECT DISTINCT table_name FROM b) bt ON a.table_name = bt.table_name)
SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name,
  a.column_name IS NOT NULL AS in_source, b.column_name IS NOT NULL AS in_target,
  CASE WHEN a.column_name IS NULL THEN 'ONLY_TARGET' WHEN b.column_name IS NULL THEN 'ONLY_SOURCE' ELSE 'BOTH' END AS overlap
FROM a FULL OUTER JOIN b ON a.table_name = b.table_name AND a.column_name = b.column_name
WHERE coalesce(a.table_name, b.table_name) IN (SELECT table_name FROM both_t)""",
    ("meta_prod", "meta_tst"),
)
def column_overlap(spark, sf):
    """Common and one-sided columns of paired tables (metadata join, not driver sets)."""
    a = meta_prod(spark, sf).select("table_name", "column_name", F.lit(True).alias("in_source"))
    b = meta_tst(spark, sf).select("table_name", "column_name", F.lit(True).alias("in_target"))
    both = a.select("table_name").distinct().join(b.select("table_name").distinct(), "table_name")
    j = a.join(b, ["table_name", "column_name"], "full_outer").join(both, "table_name", "left_semi")
    s, t = F.coalesce("in_source", F.lit(False)), F.coalesce("in_target", F.lit(False))
    return j.select(
        "table_name", "column_name", s.alias("in_source"), t.alias("in_target"),
        F.when(~s, "ONLY_TARGET").when(~t, "ONLY_SOURCE").otherwise("BOTH").alias("overlap"),
    )


_MSG_TABLES = ["orders", "customer", "part"]


@query(
    "schema_messages",
    """WITH cnt AS (
  SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM tgt_orders) AS d
  UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer)
  UNION ALL SELECT 'part', (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_partkey % 50 <> 0)),
a AS (SELECT * FROM meta_prod WHERE table_name IN ('orders', 'customer', 'part')),
b AS (SELECT * FROM meta_tst WHERE table_name IN ('orders', 'customer', 'part')),
j AS (SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name,
        a.data_type AS sdt, b.data_type AS ddt, a.column_name IS NOT NULL AS ins, b.column_name IS NOT NULL AS ind
      FROM a FULL OUTER JOIN b ON a.table_name = b.table_name AND a.column_name = b.column_name),
names AS (SELECT table_name, count(CASE WHEN NOT (ins AND ind) THEN 1 END) AS diff,
            coalesce(string_agg(CASE WHEN ins AND NOT ind THEN column_name END, ', ' ORDER BY column_name), '') AS only_src FROM j GROUP BY table_name)
SELECT table_name, 'Table ''' || table_name || ''' has a count mismatch.' AS message FROM cnt WHERE s <> d
UNION ALL SELECT table_name, 'Table ''' || table_name || ''' has column name mismatch: ' || only_src FROM names WHERE diff > 0
UNION ALL SELECT table_name, 'Column ''' || column_name || ''' in table ''' || table_name || ''' is missing in the destination database.' FROM j WHERE ins AND NOT ind
UNION ALL SELECT table_name, 'Column ''' || column_name || ''' in table ''' || table_name || ''' has data type mismatch: ' || sdt || ' vs ' || ddt FROM j WHERE ins AND ind AND sdt <> ddt""",
    ("meta_tst", "tgt_orders"),
)
def schema_messages(spark, sf):
    """Count, column-name and type differences as messages (counts from data, schema from metadata)."""
    pairs = {
        "orders": (fx.load(spark, sf, "orders"), fx.tgt_orders(spark, sf)),
        "customer": (fx.load(spark, sf, "customer"), fx.load(spark, sf, "customer")),
        "part": (fx.load(spark, sf, "part"), fx.load(spark, sf, "part").where(F.col("p_partkey") % 50 != 0)),
    }
    counts = None
    for t, (s, d) in pairs.items():
        c = row_counts(s, d).select(F.lit(t).alias("table_name"), "source_row_count", "target_row_count")
        counts = c if counts is None else counts.unionByName(c)
    cnt_msgs = counts.where(F.col("source_row_count") != F.col("target_row_count")).select(
        "table_name", F.concat(F.lit("Table '"), F.col("table_name"), F.lit("' has a count mismatch.")).alias("message")
    )
    a = meta_prod(spark, sf).where(F.col("table_name").isin(_MSG_TABLES)).select("table_name", "column_name", F.col("data_type").alias("sdt"), F.lit(True).alias("ins"))
    b = meta_tst(spark, sf).where(F.col("table_name").isin(_MSG_TABLES)).select("table_name", "column_name", F.col("data_type").alias("ddt"), F.lit(True).alias("ind"))
    j = a.join(b, ["table_name", "column_name"], "full_outer").withColumn("ins", F.coalesce("ins", F.lit(False))).withColumn("ind", F.coalesce("ind", F.lit(False)))
    names = j.groupBy("table_name").agg(
        F.count(F.when(~(F.col("ins") & F.col("ind")), 1)).alias("diff"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("ins") & ~F.col("ind"), F.col("column_name")))), ", ").alias("only_src"),
    )
    name_msgs = names.where(F.col("diff") > 0).select(
        "table_name", F.concat(F.lit("Table '"), F.col("table_name"), F.lit("' has column name mismatch: "), F.col("only_src")).alias("message")
    )
    col_msgs = j.where(F.col("ins") & ~F.col("ind")).select(
        "table_name", F.concat(F.lit("Column '"), F.col("column_name"), F.lit("' in table '"), F.col("table_name"), F.lit("' is missing in the destination database.")).alias("message")
    )
    type_msgs = j.where(F.col("ins") & F.col("ind") & (F.col("sdt") != F.col("ddt"))).select(
        "table_name",
        F.concat(F.lit("Column '"), F.col("column_name"), F.lit("' in table '"), F.col("table_name"), F.lit("' has data type mismatch: "), F.col("sdt"), F.lit(" vs "), F.col("ddt")).alias("message"),
    )
    return cnt_msgs.unionByName(name_msgs).unionByName(col_msgs).unionByName(type_msgs)
