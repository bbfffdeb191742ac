"""Benchmark decontamination by a broadcast hash set of normalised n-grams (native).

Every window of ten consecutive words of a benchmark item (an item of fewer is one window) goes into a
hash set that each task holds; every window of every document is looked up in it, on its words, so a hit
is an equality of words and needs no second look. Hit words are removed, or the documents that hold them.

Defined results: null and empty texts have no words and no hits; an item without words has no window;
an item with a null id counts as the item ''; windows that several items share count for each of them;
identical documents give identical rows; empty tables give no hits. Columns of ``docs`` are carried along;
names the operator adds start with ``c_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, hidden, hidden_name, let, shown, table

#: Separators of words: ASCII but digits and letters (after lower-casing).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def item_words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS + "+"), ""), F.array().cast("array<string>"))


def windows(words: Column, width: Column | int) -> Column:
    """``(at, gram)`` of each window of ``width`` words, in one array."""
    width = F.lit(width) if isinstance(width, int) else width
    return let(words, lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i + 1, width), " ").alias("gram")))))


def benchmark_grams(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """One row for each distinct window: ``gram``, ``width`` and the sorted ``items`` that hold it."""
    w = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), item_words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(width)))
    cells = w.select("item", "width", F.explode(windows(F.col("w"), F.col("width"))).alias("x"))
    return cells.groupBy(F.col("x.gram").alias("gram"), "width").agg(F.sort_array(F.collect_set("item")).alias("items"))


def find_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row for each hit window of a document: ``id``, ``key``, ``at``, ``width``, ``items``.

    The set is broadcast if the benchmark's words, ten times over, stay under ``broadcast_bytes``, which is
    checked; a larger one is joined by shuffle, where adaptive execution splits windows that many documents hold.
    """
    grams = benchmark_grams(bench, item_col, item_text_col, width)
    bound = bench.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text_col).cast("string")) + 16), F.lit(0)).alias("n")).first()["n"] * (width + 2)
    widths = [r[0] for r in grams.select("width").distinct().collect()]  # at most `width` rows
    if not widths:
        widths = [width]
    cells = F.concat(*[F.coalesce(F.transform(windows(F.col("w"), n), lambda x: F.struct(F.lit(n).alias("width"), x["at"].alias("at"), x["gram"].alias("gram"))), F.array().cast("array<struct<width:int,at:int,gram:string>>")) for n in sorted(widths)])
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), item_words(F.col(text_col)).alias("w")).select("id", "key", F.explode(cells).alias("x")).select("id", "key", "x.width", "x.at", "x.gram")
    return found.join(F.broadcast(grams) if bound <= broadcast_bytes else grams, ["gram", "width"]).select("id", "key", "at", "width", "items")


def hit_words(cells: Column) -> Column:
    """Words that the windows ``(at, width)`` cover together."""
    step = lambda a, x: F.struct(F.greatest(a["upto"], x["at"] + x["width"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["at"] + x["width"] - F.greatest(a["upto"], x["at"]))).alias("n"))
    return F.aggregate(F.sort_array(cells), F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")), step)["n"]


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with ``c_n_words``, ``c_n_hit``, ``c_n_items``, ``c_items`` (sorted), ``c_spans`` (hit windows
    as ``(at, width)`` in words), ``c_contaminated`` and ``c_text``, the text without its hit words."""
    given, docs = docs, hidden(docs)
    id_col, text_col = hidden_name(given, id_col), hidden_name(given, text_col)
    hits = find_hits(docs, bench, id_col, text_col, **how)
    # A document's hits come from one task, so they combine there before the shuffle.
    per = hits.groupBy(F.col("id").alias("h_id"), F.col("key").alias("h_key")).agg(F.collect_set(F.struct("at", "width")).alias("cells"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    base = docs.withColumns({"c_id": F.col(id_col), "c_key": F.xxhash64(F.col(text_col)), "c_n_words": F.size(item_words(F.col(text_col))).cast("long")})
    out = base.join(per, (F.col("c_key") == F.col("h_key")) & F.col("c_id").eqNullSafe(F.col("h_id")), "left")
    n_hit = F.when(F.col("cells").isNull(), F.lit(0).cast("long")).otherwise(hit_words(F.col("cells")))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    # A piece is a word and the separators behind it, so pieces and words have the same numbers.
    text = F.col(text_col)
    pieces = F.regexp_extract_all(F.regexp_replace(text, f"^{SEPARATORS}+", ""), F.lit(rf"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+{SEPARATORS.replace('x60', 'x40').replace(']', chr(92) + 'x5B-' + chr(92) + 'x60]')}*)"), F.lit(1))
    left = F.array_join(F.filter(pieces, lambda p, i: ~F.exists(F.col("cells"), lambda c: (i >= c["at"]) & (i < c["at"] + c["width"]))), "")
    out = out.select(
        *docs.columns,
        "c_n_words",
        n_hit.alias("c_n_hit"),
        F.size(items).cast("long").alias("c_n_items"),
        items.alias("c_items"),
        F.coalesce(F.sort_array("cells"), F.array().cast("array<struct<at:int,width:int>>")).alias("c_spans"),
        (n_hit > 0).alias("c_contaminated"),
        F.when(F.col("cells").isNull(), text).otherwise(left).alias("c_text"),
    )
    return shown(out, given)


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("c_n_words").alias("n_words"), F.col("c_n_hit").alias("n_hit"), F.col("c_n_items").alias("n_items"), F.sha2(F.array_join("c_items", ","), 256).alias("items_sha256"), F.col("c_contaminated").alias("contaminated"))


OP4_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
dg AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, i, dg.k, item FROM dg JOIN g ON dg.gram = g.gram AND dg.k = g.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
