"""Quality rules by cross-document line frequency (native).

Lines are normalised (blanks collapsed, lower case) and hashed; for each host the distinct documents
of a line are counted; a line above the host's limit is removed; a document that loses more than a
given share of its words is rejected, as is one that fails the base rules.

Defined results: a null text has no words and fails the base rules; a null host is the empty host;
identical rows are one document in the counts and each keeps its own row in the result; an empty table
gives an empty result. Columns of ``docs`` beyond the ones read are carried along untouched; names the
operator adds start with ``q_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK_CHARS, BLANKS, blank_words, hidden, hidden_name, let, shown, staged, table

SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Words in windows of three that the text holds twice or more.

    A window's sort key is its hash with the window's start in the low bits, so one sort of plain longs
    brings equal windows together; neighbours count only where their words are equal.
    """

    def count(w: Column) -> Column:
        last = F.size(w) - 3
        bits = F.length(F.bin(F.size(w)))
        starts = F.sequence(F.lit(0), last)
        high = lambda k: F.call_function("shiftright", k, bits)
        low = lambda k: k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        hashed = F.transform(starts, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        keys = lambda h: F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", high(x), bits) + i))
        alike = lambda a, b: (w[a] == w[b]) & (w[a + 1] == w[b + 1]) & (w[a + 2] == w[b + 2])
        twin = lambda s, i, j: (high(s[i]) == high(s[j])) & alike(low(s[i]), low(s[j]))
        found = lambda s: F.sort_array(F.transform(F.filter(starts, lambda i: ((i > 0) & twin(s, i - 1, i)) | ((i < last) & twin(s, i, i + 1))), lambda i: low(s[i])))
        covered = lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n")))["n"]
        none = F.lit(0).cast("long")
        # Most texts have no window twice; that is seen from the hashes alone.
        return F.when(last < 0, none).otherwise(let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == last + 1, none).otherwise(let(keys(h), lambda s: let(found(s), covered)))))

    return let(words, count)


def base_columns(text: Column, min_words: int = 50, max_repeat_pct: int = 50) -> dict[str, Column]:
    """The base metrics and the verdict of the base rules, each from the whole text."""
    t = F.coalesce(text, F.lit(""))
    bare = F.translate(t, BLANK_CHARS, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0)
    return {
        "n_words": F.size(blank_words(t)).cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(blank_words(t)),
        "base_failed": (F.col("q_n_words") < min_words) | (100 * F.col("q_n_repeat_words") > max_repeat_pct * F.col("q_n_words")),
    }


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, BLANKS, " ")))


def line_key(line: Column) -> Column:
    """A normal line's 128 bits, as two longs."""
    return let(normal_line(line), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b")))


def frequent_lines(lines: DataFrame, rows: DataFrame, min_docs: int, max_share_pct: float) -> DataFrame:
    """Lines ``(host, line)`` that over ``min_docs`` documents of the host hold, and over the share of them.

    A document counts once for each line; both counts combine before they are shuffled, so a line or
    host of a third of all rows costs no task more than the others.
    """
    one = lines.select("host", "line", "id", "key").distinct()
    counts = one.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > min_docs)
    hosts = rows.select("host", "id", "key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_docs"))
    return counts.join(hosts, "host").filter(100 * F.col("docs") > max_share_pct * F.col("all_docs")).select("host", "line", "docs")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_share_pct: float = 5.0, max_lost_pct: int = 50, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """``docs`` with the base metrics, ``q_lost_words`` (in removed lines), ``q_text`` (the text without
    them), ``q_base_failed`` and ``q_kept``.

    ``min_docs`` and ``max_share_pct``: a line of a host is removed if more distinct documents than both
    hold it. ``max_lost_pct``: a document that loses more of its words is depleted and rejected.
    """
    given, docs = docs, hidden(docs)
    id_col, text_col, host_col = (hidden_name(given, c) for c in (id_col, text_col, host_col))
    text, host = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(host_col), F.lit(""))
    keyed = docs.withColumns({"q_id": F.col(id_col), "q_key": F.xxhash64(host, text)})
    cells = F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0), lambda x: F.struct(line_key(x).alias("line"), F.size(blank_words(x)).alias("n")))
    numbered = keyed.withColumn("q_row", F.monotonically_increasing_id())  # before the lines part, so all of a row's have one number
    lines = numbered.select(F.col("q_row").alias("row"), F.col("q_id").alias("id"), F.col("q_key").alias("key"), host.alias("host"), F.explode(cells).alias("x")).select("row", "id", "key", "host", "x.line", "x.n")
    rows = keyed.select(host.alias("host"), F.col("q_id").alias("id"), F.col("q_key").alias("key"))
    frequent = staged(frequent_lines(lines, rows, min_docs, max_share_pct).select("host", "line"), "frequent-lines")
    # Identical rows give the same sums: one of them is taken.
    hit = lines.join(frequent, ["host", "line"]).groupBy("row", "id", "key").agg(F.sum("n").alias("lost"), F.collect_set("line").alias("bad"))
    lost = hit.groupBy(F.col("id").alias("l_id"), F.col("key").alias("l_key")).agg(F.max("lost").cast("long").alias("lost"), F.first("bad").alias("bad"))
    base = base_columns(F.col(text_col), min_words, max_repeat_pct)
    failed = base.pop("base_failed")
    scored = keyed.withColumns({f"q_{k}": c for k, c in base.items()}).withColumn("q_base_failed", failed)
    out = scored.join(lost, (F.col("q_key") == F.col("l_key")) & F.col("q_id").eqNullSafe(F.col("l_id")), "left")
    gone = F.col("bad")
    kept_lines = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(gone, line_key(x))), "\n")
    lost_words = F.coalesce(F.col("lost"), F.lit(0).cast("long"))
    out = out.select(
        *docs.columns,
        *[F.col(f"q_{k}") for k in [*base, "base_failed"]],
        lost_words.alias("q_lost_words"),
        F.when(gone.isNull(), F.col(text_col)).otherwise(kept_lines).alias("q_text"),
        (~F.col("q_base_failed") & (100 * lost_words <= max_lost_pct * F.col("q_n_words"))).alias("q_kept"),
    )
    return shown(out, given)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"]
    return out.select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names])


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, t FROM d),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines
  FROM w),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS twice FROM g),
r AS (
  SELECT doc_id, count(*) FILTER (WHERE twice OR b1 OR b2) AS n_repeat_words
  FROM (SELECT doc_id, twice, coalesce(lag(twice, 1) OVER o, false) AS b1, coalesce(lag(twice, 2) OVER o, false) AS b2 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  GROUP BY doc_id),
l AS (
  SELECT doc_id, host, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS docs FROM l GROUP BY ALL) JOIN (SELECT host, count(DISTINCT doc_id) AS all_docs FROM d GROUP BY ALL) USING (host)
  WHERE docs > 20 AND 100 * docs > 5.0 * all_docs),
x AS (SELECT doc_id, sum(n) AS lost FROM l JOIN f USING (host, line) GROUP BY doc_id),
z AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words FROM m LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM z)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND 100 * lost_words <= 50 * n_words AS kept, lost_words
FROM y
"""
