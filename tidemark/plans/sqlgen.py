"""Small builders for oracle SQL text (DuckDB dialect) that mirror the Spark operators.

They only assemble static SQL strings at import time; nothing here executes.
"""

from __future__ import annotations

from collections.abc import Sequence


def s(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def norm(expr: str) -> str:
    """P20 in DuckDB."""
    x = f"trim(regexp_replace(lower({expr}), '[\\x09-\\x0D ]+', ' ', 'g'))"
    return f"(CASE WHEN regexp_matches({x}, '^-?[0-9]+\\.[0-9]+$') THEN rtrim(rtrim({x}, '0'), '.') ELSE {x} END)"


def reduced(alias: str, table: str, key: str, cols: Sequence[str], prefix: str, where: str = "") -> str:
    agg = ", ".join([f"count(*) AS __{prefix}_n"] + [f"min({c}) AS {prefix}__{c}" for c in cols])
    w = f" WHERE {where}" if where else ""
    return f"{alias} AS (SELECT {key} AS k, {agg} FROM {table}{w} GROUP BY {key})"


def keyed_join_ctes(src: str, tgt: str, key: str, cols: Sequence[str], how: str = "FULL OUTER", src_where: str = "", name: str = "j") -> str:
    """CTEs ``<name>_s``, ``<name>_t`` and ``<name>`` (one row per key, column k)."""
    sel_s = ", ".join([f"{name}_s.__s_n"] + [f"{name}_s.s__{c}" for c in cols])
    sel_t = ", ".join([f"{name}_t.__t_n"] + [f"{name}_t.t__{c}" for c in cols])
    return (
        reduced(f"{name}_s", src, key, cols, "s", src_where)
        + ",\n"
        + reduced(f"{name}_t", tgt, key, cols, "t")
        + f",\n{name} AS (SELECT coalesce({name}_s.k, {name}_t.k) AS k, {sel_s}, {sel_t} FROM {name}_s {how} JOIN {name}_t ON {name}_s.k = {name}_t.k)"
    )


def tokens(cols: Sequence[str]) -> str:
    """The compared text of a row: every value with its length, NULL as a token of its own."""
    return " || ".join(f"coalesce(length({c}) || ':' || {c} || ';', 'N;')" for c in cols)


def multiset_ctes(src: str, tgt: str, key: str, cols: Sequence[str], name: str = "j") -> str:
    """CTEs of a keyed multiset comparison: ``<name>_k`` (k, s, t: rows of a key on both sides; a NULL key's sides
    stay apart) and ``<name>_p`` (pairs of rows that aren't alike: k, s__col, t__col). Equal rows go by EXCEPT ALL;
    the rest of a key is paired by the order of the digests of its text, within digests that begin alike first."""
    row = lambda t: f"SELECT {key} AS k, {', '.join(f'{s(c)} AS {c}' for c in cols)} FROM {t}"
    left = lambda a, b: f"SELECT *, md5({tokens(cols)}) AS d FROM (SELECT * FROM {name}_{a} WHERE k IS NOT NULL EXCEPT ALL SELECT * FROM {name}_{b})"
    numbered = lambda a, by: f"SELECT *, row_number() OVER (PARTITION BY k{by} ORDER BY d) AS r FROM {name}_{a}"
    rest = lambda a, b: f"SELECT a.* EXCLUDE (r) FROM {name}_{a}1 a WHERE NOT EXISTS (SELECT 1 FROM {name}_{b}1 b WHERE a.k = b.k AND left(a.d, 2) = left(b.d, 2) AND a.r = b.r)"
    pick = ", ".join(f"a.{c} AS s__{c}, b.{c} AS t__{c}" for c in cols)
    return f"""{name}_s AS ({row(src)}), {name}_t AS ({row(tgt)}),
{name}_k AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS s, coalesce(b.n, 0) AS t FROM (SELECT k, count(*) AS n FROM {name}_s GROUP BY k) a
  FULL OUTER JOIN (SELECT k, count(*) AS n FROM {name}_t GROUP BY k) b ON a.k = b.k),
{name}_ls AS ({left('s', 't')}), {name}_lt AS ({left('t', 's')}),
{name}_ls1 AS ({numbered('ls', ', left(d, 2)')}), {name}_lt1 AS ({numbered('lt', ', left(d, 2)')}),
{name}_ls2 AS ({rest('ls', 'lt')}), {name}_lt2 AS ({rest('lt', 'ls')}),
{name}_p AS (SELECT a.k, {pick} FROM {name}_ls1 a JOIN {name}_lt1 b ON a.k = b.k AND left(a.d, 2) = left(b.d, 2) AND a.r = b.r
  UNION ALL SELECT a.k, {pick} FROM ({numbered('ls2', '')}) a JOIN ({numbered('lt2', '')}) b ON a.k = b.k AND a.r = b.r)"""


def differs(c: str) -> str:
    return f"(s__{c} IS DISTINCT FROM t__{c})"


def format_only(c: str) -> str:
    return f"coalesce({norm('s__' + c)} = {norm('t__' + c)}, FALSE)"


def mismatch_rows_sql(name: str, cols: Sequence[str]) -> str:
    """R6 over ``<name>_p``."""
    return "\nUNION ALL\n".join(
        f"SELECT {s('k')} AS key, '{c}' AS column_name, s__{c} AS source_value, t__{c} AS target_value, "
        f"CASE WHEN {format_only(c)} THEN 'FORMAT' ELSE 'VALUE' END AS mismatch_type FROM {name}_p WHERE {differs(c)}"
        for c in cols
    )


def keyed_counts_sql(name: str, straddling: str = "0", beyond_s: str = "0", beyond_t: str = "0") -> str:
    """R4 over ``<name>_k`` and ``<name>_p``."""
    n = lambda x: f"CAST(coalesce(sum({x}), 0) AS BIGINT)"
    return f"""SELECT {n('s')} - {beyond_s} AS source_row_count, {n('t')} - {beyond_t} AS target_row_count,
  {n('s - least(s, t)')} AS rows_only_in_source, {n('t - least(s, t)')} AS rows_only_in_target, {n('least(s, t)')} AS matched_row_count,
  count(*) FILTER (WHERE k IS NOT NULL AND (s > 1 OR t > 1)) AS duplicate_keys, (SELECT count(*) FROM {name}_p) AS mismatched_rows,
  CAST({straddling} AS BIGINT) AS straddling_keys
FROM {name}_k"""


def key_bucket(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({s(expr)}), 1, 8)) AS BIGINT)"


def row_hash(cols: Sequence[str]) -> str:
    parts = [f"CASE WHEN {s(c)} IS NULL THEN 'N;' ELSE {s('length(' + s(c) + ')')} || ':' || {s(c)} || ';' END" for c in sorted(cols, key=str.lower)]
    return "sha256(" + " || ".join(parts) + ")"


def pct_round(num: str, den: str, digits: int = 1) -> str:
    """Twin of ``windows.pct_round``."""
    scale = 10**digits
    return f"(CAST(floor((CAST({num} AS BIGINT) * {200 * scale} + NULLIF(CAST({den} AS BIGINT), 0)) / (NULLIF(CAST({den} AS BIGINT), 0) * 2)) AS DOUBLE) / {scale})"


def streak_ref_ctes(base: str, part: str, flag: str, name: str, prefix: str) -> str:
    """Twin of ``windows.streak_reference`` as two CTEs ``{prefix}1``, ``{prefix}2``."""
    w = f"PARTITION BY {part} ORDER BY interval_end"
    return (
        f"{prefix}1 AS (SELECT *, SUM(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __cs FROM {base}),\n"
        f"{prefix}2 AS (SELECT *, CAST(greatest(0, __cs - coalesce(MAX(CASE WHEN NOT ({flag}) THEN __cs END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS {name} FROM {prefix}1)"
    )


def streak_fix_ctes(base: str, part: str, flag: str, name: str, prefix: str, order: str = "interval_end") -> str:
    """Twin of ``windows.breach_streak`` (gaps-and-islands)."""
    return (
        f"{prefix}1 AS (SELECT *, SUM(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __grp FROM {base}),\n"
        f"{prefix}2 AS (SELECT *, CAST(CASE WHEN {flag} THEN SUM(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER (PARTITION BY {part}, __grp ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS BIGINT) AS {name} FROM {prefix}1)"
    )
