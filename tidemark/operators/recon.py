"""Row-level reconciliation of a table pair.

Keys need not be unique. The rows of a key are two multisets of contents, and one rule holds everywhere: equal rows
cancel, what is left on both sides is put in the order of a digest and paired one by one, and the rest of the longer
side has no partner. A key's rows are so matched one to one, and never multiplied. Rows with a NULL key match nothing.

At scale: both sides first go as narrow rows (key, 128 bits of hash of the compared columns, one) into one grouped
count. Copies combine before the shuffle, and a key that holds a third of all rows is spread by the hashes. All
counts come from these cells. The columns of just the cells that don't cancel are then fetched from the tables and
turned into texts. They are numbered by the digest of their texts, in 256 runs of digests for each key, so that a hot key
isn't sorted by one task; only what finds no partner in its run is numbered through the key. Two rows of a
pair meet by number, and columns are compared by the rules of ``lattice``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import lattice

KEY = "__key__"
CELL = ["__k", "__h1", "__h2"]


@dataclass(frozen=True)
class SampleRule:
    """How many keys a sampled comparison takes, by the sizes of both sides."""

    usual: int = 50_000
    large: int = 500_000
    large_from: int = 20_000_000
    share_of_smaller: float = 0.20
    at_least: int = 1_000

    def size(self, source_rows: int, target_rows: int) -> int:
        wanted = max(self.at_least, int(max(1, min(source_rows, target_rows)) * self.share_of_smaller))
        most = self.large if max(source_rows, target_rows) > self.large_from else self.usual
        return max(1, min(wanted, most, source_rows))


@dataclass(frozen=True)
class Cycle:
    """Compare the rows of the last completed business cycle only, by the first of ``columns`` that both sides have.

    A cycle is ``days`` long and ends at ``cutoff_hour`` in ``zone``; ``given`` bounds stand instead of the
    computed ones.
    """

    columns: tuple[str, ...] = ("updatetime", "createtime")
    cutoff_hour: int = 3
    zone: str = "UTC"
    days: int = 1
    given: tuple[str, str] | None = None

    def bounds(self, now: dt.datetime) -> tuple[str, str]:
        """First instant in, and first instant after the cycle, as local times of ``zone``; ``now`` may be naive (local)."""
        from zoneinfo import ZoneInfo

        if self.given:
            return self.given
        local = now.astimezone(ZoneInfo(self.zone)).replace(tzinfo=None) if now.tzinfo else now
        cutoff = dt.timedelta(hours=self.cutoff_hour)
        # Times move so that cycles begin at midnight: the present one's day is not complete.
        end = dt.datetime.combine((local - cutoff).date(), dt.time()) + cutoff
        return tuple(f"{t:%Y-%m-%d %H:%M:%S}" for t in (end - dt.timedelta(days=self.days), end))


@dataclass(frozen=True)
class ReconConfig:
    """How table pairs are compared. Every row is, unless a sample is asked for."""

    key_priority: tuple[str, ...] = ("id", "publicid", "externalid")
    excluded_columns: tuple[str, ...] = ()
    source_label: str = "SRC"
    target_label: str = "TGT"
    detect_format: bool = True
    examples: int = 3
    sample: SampleRule | None = None
    cycle: Cycle | None = None


def pick_first(columns: Sequence[str], priority: Sequence[str]) -> str | None:
    """R2: the first candidate that is there, whatever its case."""
    there = {c.lower() for c in columns}
    return next((p for p in priority if p.lower() in there), None)


def _c(name: str) -> Column:
    return F.col(lattice.ident(name))


# ------------------------------------------------------------------ presence join


def reduce_by_key(df: DataFrame, key: str, cols: Sequence[str], prefix: str) -> DataFrame:
    """One row per key: its number of rows and the least value of every column (the value, where there is one row)."""
    return df.groupBy(_c(key).alias(KEY)).agg(F.count(F.lit(1)).alias(f"__{prefix}_n"), *[F.min(_c(c)).alias(f"{prefix}__{c}") for c in cols])


def keyed_join(src: DataFrame, tgt: DataFrame, key: str, cols: Sequence[str], how: str = "full_outer") -> DataFrame:
    """One row per key of either side (presence: ``__s_n`` / ``__t_n`` not NULL)."""
    return reduce_by_key(src, key, cols, "s").join(reduce_by_key(tgt, key, cols, "t"), KEY, how)


# ------------------------------------------------------------------ keyed compare


class KeyedCompare:
    """The comparison of two tables by a key, as lazy frames.

    ``window`` (column, from, to) holds both sides to ``from <= column < to``. A key with rows in the window on one
    side only is looked up in the whole other side: its rows there are compared too, so that a row whose time
    moved over the edge isn't taken for a missing one. ``share`` (of 2**32) keeps the keys of that many hash buckets.
    """

    def __init__(self, source: DataFrame, target: DataFrame, key: str, columns: Sequence[str], detect_format: bool = True, window: tuple[str, str, str] | None = None, share: int | None = None):
        self.detect_format = detect_format
        self.key = lattice.pairs(source.schema, target.schema, [key])[0]
        self.columns = lattice.pairs(source.schema, target.schema, columns)
        self.plain_key = source.schema[_named(source, key)].dataType == target.schema[_named(target, key)].dataType
        frames = [self._keyed(source, _named(source, key), self.key.source_text, share), self._keyed(target, _named(target, key), self.key.target_text, share)]
        if window:
            frames = self._in_window(frames, window)
        else:
            frames = [f.withColumn("__beyond", F.lit(0)) for f in frames]
        self.sides = [self._side(f, "s" if i == 0 else "t") for i, f in enumerate(frames)]

    def _keyed(self, df: DataFrame, key: str, form: str, share: int | None) -> DataFrame:
        out = df.withColumn("__k", _c(key) if self.plain_key else F.expr(form.replace("{}", lattice.ident(key))))
        return out if share is None else out.where(key_bucket(F.col("__k")) < F.lit(share))

    @staticmethod
    def _in_window(frames: list[DataFrame], window: tuple[str, str, str]) -> list[DataFrame]:
        column, start, end = window
        inside = [within(f, column, start, end) for f in frames]
        keys = [f.where("__k IS NOT NULL").select("__k").distinct() for f in inside]
        out = []
        for i in (0, 1):
            alone = keys[1 - i].join(keys[i], "__k", "left_anti")
            beyond = frames[i].join(alone, "__k", "left_semi")  # none of its rows are in the window here
            out.append(inside[i].withColumn("__beyond", F.lit(0)).unionByName(beyond.withColumn("__beyond", F.lit(1))))
        return out

    def _side(self, df: DataFrame, side: str) -> DataFrame:
        """``__k``, the hash ``__h1``, ``__h2`` of the compared values, ``__beyond``, and the columns as they are."""
        names = {c.lower(): lattice.ident(c) for c in df.columns}
        h1, h2 = hashes([p.source_value if side == "s" else p.target_value for p in self.columns])
        return df.selectExpr("__k", f"{h1} AS __h1", f"{h2} AS __h2", "__beyond", *[f"{names[p.name.lower()]} AS __c{i}" for i, p in enumerate(self.columns)])

    def cells(self) -> DataFrame:
        """``(__k, __h1, __h2, s, t)``: rows of a key and content on both sides; ``beyond`` and ``beyond_s``: those outside the window."""
        one = lambda side, s, t: side.select("__k", "__h1", "__h2", F.lit(s).alias("s"), F.lit(t).alias("t"), F.col("__beyond").alias("beyond"), (F.col("__beyond") * s).alias("beyond_s"))
        u = one(self.sides[0], 1, 0).unionByName(one(self.sides[1], 0, 1))
        return u.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ("s", "t", "beyond", "beyond_s")])

    def keys(self) -> DataFrame:
        """One row per key: rows on both sides ``s`` and ``t``, and ``equal``, the pairs that are alike."""
        return self.cells().groupBy("__k").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum(F.least("s", "t")).alias("equal"), F.sum("beyond").alias("beyond"), F.sum("beyond_s").alias("beyond_s"))

    def counts(self) -> DataFrame:
        """One row. ``matched_row_count``: pairs; ``mismatched_rows``: pairs that aren't alike; rows without partner on
        either side; keys with several rows on a side; keys in the window on one side only."""
        total = lambda x, name: F.expr(f"CAST(coalesce(sum({x}), 0) AS BIGINT)").alias(name)
        pairs = "IF(__k IS NULL, 0, least(s, t))"
        return self.keys().agg(
            total("s - beyond_s", "source_row_count"),
            total("t - (beyond - beyond_s)", "target_row_count"),
            total(f"s - {pairs}", "rows_only_in_source"),
            total(f"t - {pairs}", "rows_only_in_target"),
            total(pairs, "matched_row_count"),
            total("IF(__k IS NOT NULL AND (s > 1 OR t > 1), 1, 0)", "duplicate_keys"),
            total(f"{pairs} - IF(__k IS NULL, 0, equal)", "mismatched_rows"),
            total("IF(beyond > 0, 1, 0)", "straddling_keys"),
        )

    def _left(self, side: int) -> DataFrame:
        """Rows of a side that don't cancel, copies as one: ``n`` of them, their ``texts`` and the digest of their compared texts."""
        alone = self.cells().where("__k IS NOT NULL").selectExpr(*CELL, f"{'s - t' if side == 0 else 't - s'} AS n").where("n > 0")
        rows = self.sides[side].drop("__beyond").join(alone, CELL)
        texts = ", ".join(f"CAST(__c{i} AS STRING)" for i, _ in enumerate(self.columns))
        forms = [(p.source_text if side == 0 else p.target_text).replace("{}", f"__c{i}") for i, p in enumerate(self.columns)]
        tokens = [f"coalesce(concat(length({f}), ':', {f}, ';'), 'N;')" for f in forms]
        shown = rows.selectExpr(*CELL, "n", f"CAST(array({texts}) AS ARRAY<STRING>) AS texts", f"md5(concat({', '.join(tokens)})) AS digest" if tokens else "'' AS digest")
        once = shown.groupBy(*CELL).agg(F.max(F.struct("n", "digest", "texts")).alias("row")).select("__k", "row.*")
        return once.select("__k", "n", "texts", "digest", F.left("digest", F.lit(2)).alias("run"), F.lit("st"[side]).alias("side"))

    def unequal_pairs(self) -> DataFrame:
        """``(__k, number, s, t)``: paired rows that aren't alike, as arrays of their columns' texts.

        Rows of a key meet within runs of digests first, number by number. Of a hot key's evenly spread digests
        this leaves few; these are then numbered through the whole key.
        """
        left = self._left(0).unionByName(self._left(1))
        run, key = Window.partitionBy("__k", "run"), Window.partitionBy("__k", "side").orderBy("digest")
        of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))).over(run), F.lit(0))
        so_far = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = left.withColumn("pairs", F.least(of("s"), of("t")))
        met = met.withColumn("first", so_far(Window.partitionBy("__k", "run", "side").orderBy("digest"), "n"))
        paired = met.where("first < pairs").select("__k", "side", "texts", "run", "first", F.expr("least(first + n, pairs) - first").alias("n"))
        rest = met.where("first + n > pairs").withColumn("n", F.expr("first + n - greatest(first, pairs)"))
        rest = rest.select("__k", "side", "texts", F.lit("").alias("run"), so_far(key, "n").alias("first"), "n")
        each = paired.unionByName(rest).select("__k", "run", "side", "texts", F.explode(F.expr("sequence(first, first + n - 1)")).alias("number"))
        one = lambda x: F.max(F.when(F.col("side") == x, F.col("texts"))).alias(x)
        return each.groupBy("__k", "run", "number").agg(one("s"), one("t")).where("s IS NOT NULL AND t IS NOT NULL")

    def mismatches(self) -> DataFrame:
        """``(key, column_name, source_value, target_value, mismatch_type)``, a row for each column that differs in a pair."""
        items = []
        for i, p in enumerate(self.columns):
            s, t = f"s[{i}]", f"t[{i}]"
            kind = f"IF({p.same_but_format(s, t)}, 'FORMAT', 'VALUE')" if self.detect_format else "'VALUE'"
            items.append(f"IF({p.differs(s, t)}, named_struct('column_name', {lattice.text(p.name)}, 'source_value', {s}, 'target_value', {t}, 'mismatch_type', {kind}), NULL)")
        if not items:
            items = ["CAST(NULL AS STRUCT<column_name: STRING, source_value: STRING, target_value: STRING, mismatch_type: STRING>)"]
        return self.unequal_pairs().selectExpr("CAST(__k AS STRING) AS key", f"explode(array({', '.join(items)})) AS m").where("m IS NOT NULL").select("key", "m.*")


def hashes(values: Sequence[str]) -> tuple[str, str]:
    """SQL of two 64-bit hashes of a row of values (SQL, of any type). NULLs count by their place, which ``xxhash64`` skips."""
    nulls = [f"concat({', '.join(f'isnull({v})' for v in values[i : i + 32])})" for i in range(0, len(values), 32)]
    return tuple(f"xxhash64({', '.join([str(seed), *values, *nulls])})" for seed in (1, 2))


def _named(df: DataFrame, name: str) -> str:
    return next(c for c in df.columns if c.lower() == name.lower())


def within(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows with ``start <= column < end``. The bounds take the column's type, so that the filter reaches the scan."""
    c = _named(df, column)
    kind = df.schema[c].dataType
    return df.where((_c(c) >= F.lit(start).cast(kind)) & (_c(c) < F.lit(end).cast(kind)))


def mismatch_summary(mismatches: DataFrame) -> DataFrame:
    """Per column, how many values differ, and how many of them in value or in format alone."""
    of = lambda kind: F.count(F.when(F.col("mismatch_type") == kind, 1))
    return mismatches.groupBy("column_name").agg(F.count(F.lit(1)).alias("mismatch_count"), of("VALUE").alias("value_mismatch_count"), of("FORMAT").alias("format_mismatch_count"))


def mismatch_examples(mismatches: DataFrame, n: int = 3, key_order: Column | None = None) -> DataFrame:
    """The first ``n`` mismatches of each column by key (then by values), ranked in two levels, so that a column with
    billions of them is ranked by many tasks."""
    from tidemark.operators.windows import first_n_per

    order = [key_order if key_order is not None else F.col("key"), F.col("key"), F.col("source_value"), F.col("target_value")]
    return first_n_per(mismatches, ["column_name"], order, n, "example_rank", salt=F.xxhash64("key", "source_value"))


def column_findings(mismatches: DataFrame, examples: int, salts: int = 64) -> DataFrame:
    """R7 and R8 in one pass: per column the totals and its first ``examples`` as an array of (key, source, target, type).

    Mismatches are ranked within hash buckets first; a bucket hands on its totals and no more than ``examples`` rows.
    """
    one = F.struct("key", "source_value", "target_value", "mismatch_type")
    w = Window.partitionBy("column_name", "salt").orderBy("key", "source_value", "target_value")
    ranked = mismatches.withColumn("salt", F.pmod(F.xxhash64("key", "source_value"), F.lit(salts))).withColumn("rank", F.row_number().over(w))
    of = lambda kind: F.count(F.when(F.col("mismatch_type") == kind, 1))
    parts = ranked.groupBy("column_name", "salt").agg(of("VALUE").alias("v"), of("FORMAT").alias("f"), F.collect_list(F.when(F.col("rank") <= examples, one)).alias("e"))
    return parts.groupBy("column_name").agg(
        F.sum("v").alias("value_mismatches"), F.sum("f").alias("format_mismatches"), F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, examples).alias("examples")
    )


# ------------------------------------------------------------------ hash compare


def row_hash(df: DataFrame, cols: Sequence[str]) -> Column:
    """Unambiguous row hash: every value is length-prefixed, NULL has its own token."""
    parts = []
    for c in sorted(cols, key=str.lower):
        s = _c(c).cast("string")
        parts.append(F.when(s.isNull(), F.lit("N;")).otherwise(F.concat(F.length(s).cast("string"), F.lit(":"), s, F.lit(";"))))
    return F.sha2(F.concat(*parts), 256) if parts else F.sha2(F.lit(""), 256)


def hash_diff(src: DataFrame, tgt: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Multiset difference of row hashes via grouped counts (combined map-side, no row pairs).

    Returns one row ``(source_row_count, target_row_count, rows_only_in_source, rows_only_in_target)``.
    """
    s = src.groupBy(row_hash(src, cols).alias("h")).agg(F.count(F.lit(1)).alias("sn"))
    t = tgt.groupBy(row_hash(tgt, cols).alias("h")).agg(F.count(F.lit(1)).alias("tn"))
    j = s.join(t, "h", "full_outer").select(F.coalesce("sn", F.lit(0)).alias("sn"), F.coalesce("tn", F.lit(0)).alias("tn"))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")  # noqa: E731  (empty inputs give 0, not NULL)
    return j.agg(
        z("sn").alias("source_row_count"),
        z("tn").alias("target_row_count"),
        z(F.greatest(F.col("sn") - F.col("tn"), F.lit(0))).alias("rows_only_in_source"),
        z(F.greatest(F.col("tn") - F.col("sn"), F.lit(0))).alias("rows_only_in_target"),
    )


# ------------------------------------------------------------------ sampling and plan


def key_bucket(col: Column) -> Column:
    """Deterministic 32-bit bucket of a key: first 8 hex digits of md5 of its text form."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("long")


def sample_share(keys: int, source_rows: int) -> int:
    """Buckets (of 2**32) that hold about ``keys`` of the source's keys."""
    return min(1 << 32, (keys << 32) // max(source_rows, 1))


def plan_compare(counts: DataFrame, cfg: ReconConfig) -> DataFrame:
    """R10/R11 for many pairs at once: ``counts`` has ``source_row_count``, ``target_row_count`` and
    ``has_key``; adds ``comparison_mode`` and ``sample_size``. A sample is never chosen by size, only on request."""
    rule = cfg.sample
    if rule is None:
        return counts.withColumn("comparison_mode", F.expr("IF(has_key, 'FULL_KEYED', 'FULL_HASH')")).withColumn("sample_size", F.lit(None).cast("long"))
    mode = "CASE WHEN NOT has_key THEN 'FULL_HASH' WHEN least(source_row_count, target_row_count) = 0 THEN 'FULL_KEYED' ELSE 'SAMPLE_KEYED' END"
    wanted = f"greatest({rule.at_least}, CAST(floor(least(source_row_count, target_row_count) * {rule.share_of_smaller}D) AS BIGINT))"
    most = f"IF(greatest(source_row_count, target_row_count) > {rule.large_from}, {rule.large}, {rule.usual})"
    size = f"greatest(1, least({wanted}, {most}, source_row_count))"
    return counts.withColumn("comparison_mode", F.expr(mode)).withColumn("sample_size", F.expr(f"CAST(IF(comparison_mode = 'SAMPLE_KEYED', {size}, NULL) AS BIGINT)"))


def compare_sampled(src: DataFrame, tgt: DataFrame, key: str, cols: Sequence[str], share: int, detect_format: bool = True):
    """The keys of a deterministic sample of hash buckets, compared in full. Returns (one-row summary, mismatches).

    The sample is of the source's keys: ``rows_only_in_target`` stays NULL (X8).
    """
    both = KeyedCompare(src, tgt, key, cols, detect_format, share=share)
    sampled = both.keys().where("s > 0").agg(F.count(F.lit(1)).alias("sampled_keys"))
    c = both.counts().select("source_row_count", "rows_only_in_source", "matched_row_count", F.lit(1).alias("__one"))
    summary = sampled.withColumn("__one", F.lit(1)).join(c, "__one").select(
        "sampled_keys", F.col("source_row_count").alias("sampled_rows"), "rows_only_in_source", F.lit(None).cast("long").alias("rows_only_in_target"), "matched_row_count"
    )
    return summary, both.mismatches()


# ------------------------------------------------------------------ business cycle


def business_cycle(ts: Column, cutoff_hour: int = 3) -> Column:
    """R3 data form: the business day a timestamp belongs to (cycles start at ``cutoff_hour``)."""
    return F.to_date(ts - F.expr(f"INTERVAL {int(cutoff_hour)} HOURS"))
