"""Document-preparation queries (G1-G5) on ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import docs as D
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx

SIZE, OVERLAP = 500, 50


def _chunk_sql(src: str) -> str:
    return f"""SELECT doc_id, CAST(i + 1 AS INTEGER) AS chunk_no, CAST(doc_id AS VARCHAR) || '-' || CAST(i + 1 AS VARCHAR) AS chunk_id,
  CAST(s AS INTEGER) AS chunk_start, substring(text, CAST(s AS INTEGER), {SIZE}) AS chunk_text,
  CAST(length(substring(text, CAST(s AS INTEGER), {SIZE})) AS INTEGER) AS chunk_chars
FROM (SELECT doc_id, text, unnest(generate_series(1, greatest(1, length(text) - {OVERLAP}), {SIZE - OVERLAP})) AS s,
             unnest(range(0, CAST(ceil(greatest(1, length(text) - {OVERLAP}) / {SIZE - OVERLAP}) AS BIGINT))) AS i
      FROM {src} WHERE length(text) > 0)"""


@query("doc_chunks", _chunk_sql("documents"))
def doc_chunks(spark, sf):
    """G1: 500-character chunks with 50 characters of overlap over whole documents."""
    return D.chunk(fx.load(spark, sf, "documents"), size=SIZE, overlap=OVERLAP)


@query(
    "doc_incremental",
    _chunk_sql("(SELECT d.* FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents l WHERE l.doc_id % 2 = 0 AND l.doc_id = d.doc_id))"),
)
def doc_incremental(spark, sf):
    """Chunks only for documents missing from the processed ledger (ledger = even ids)."""
    docs = fx.load(spark, sf, "documents")
    ledger = docs.where(F.col("doc_id") % 2 == 0).select("doc_id")
    return D.chunk(D.unprocessed(docs, ledger), size=SIZE, overlap=OVERLAP)


@query(
    "doc_changes",
    """WITH p AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' (old)' ELSE text END) AS prev_hash FROM documents WHERE doc_id % 10 <> 3),
c AS (SELECT doc_id, sha256(text) AS cur_hash FROM documents WHERE doc_id % 13 <> 5)
SELECT * FROM (SELECT coalesce(p.doc_id, c.doc_id) AS doc_id,
  CASE WHEN prev_hash IS NULL THEN 'INSERT' WHEN cur_hash IS NULL THEN 'DELETE' WHEN prev_hash <> cur_hash THEN 'UPDATE' END AS change, cur_hash
  FROM p FULL OUTER JOIN c ON p.doc_id = c.doc_id) WHERE change IS NOT NULL""",
)
def doc_changes(spark, sf):
    """Changed-rows-only re-index between a previous and a current snapshot."""
    d = fx.load(spark, sf, "documents")
    prev = d.where(F.col("doc_id") % 10 != 3).select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text")).alias("text")
    )
    cur = d.where(F.col("doc_id") % 13 != 5).select("doc_id", "text")
    return D.changed(prev, cur)


@query(
    "vector_topk",
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 4) AS score, label
FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""",
)
def vector_topk(spark, sf):
    """Exact cosine top-10 against the vector of id 0 (the query vector is a 64-float literal)."""
    e = fx.load(spark, sf, "embeddings")
    q = e.where(F.col("vec_id") == 0).select("embedding").first()["embedding"]
    return D.topk(e, q, 10)


@query(
    "doc_chunks_rows",
    f"""SELECT conv_id, turn, CAST(i + 1 AS INTEGER) AS chunk_no,
  CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '-' || CAST(i + 1 AS VARCHAR) AS chunk_id,
  CAST(s AS INTEGER) AS chunk_start, substring(text, CAST(s AS INTEGER), 200) AS chunk_text
FROM (SELECT conv_id, turn, text, unnest(generate_series(1, greatest(1, length(text) - 20), 180)) AS s,
             unnest(range(0, CAST(ceil(greatest(1, length(text) - 20) / 180) AS BIGINT))) AS i
      FROM conversations WHERE length(text) > 0)""",
)
def doc_chunks_rows(spark, sf):
    """The same chunking over structured rows (conversation turns), id = (conversation, turn, chunk)."""
    c = fx.load(spark, sf, "conversations").withColumn("row_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    ch = D.chunk(c, id_col="row_id", size=200, overlap=20, keep=["conv_id", "turn"])
    return ch.select("conv_id", "turn", F.col("chunk_no").cast("int").alias("chunk_no"), "chunk_id", F.col("chunk_start").cast("int").alias("chunk_start"), "chunk_text")


def _pieces(name: str, src: str, sep: str) -> str:
    """Pieces of the texts of ``src`` (doc_id, pos, t) after each separator, with their place ``pos`` in the whole text and
    ``run``: pieces that fit (run 0, 1, ... between those that don't) or not."""
    return f"""{name}0 AS (SELECT doc_id, pos AS base, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i, len(parts) AS n
  FROM (SELECT doc_id, pos, string_split(t, {sep}) AS parts FROM {src})),
{name}1 AS (SELECT doc_id, base, i, p || CASE WHEN i < n THEN {sep} ELSE '' END AS t FROM {name}0),
{name} AS (SELECT doc_id, base, i, t, base + sum(length(t)) OVER (PARTITION BY doc_id, base ORDER BY i) - length(t) AS pos,
  sum(CASE WHEN length(t) > {SIZE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, base ORDER BY i) AS run FROM {name}1 WHERE length(t) > 0)"""


_LEVELS = ["chr(10) || chr(10)", "chr(10)", "' '"]
_fits = lambda i: f"SELECT doc_id, {i} AS level, base, run, pos, length(t) AS len FROM p{i} WHERE length(t) <= {SIZE}"
_SPLIT_SQL = f"""WITH RECURSIVE t0 AS (SELECT doc_id, 0 AS pos, text AS t FROM documents WHERE length(text) > 0),
{", ".join(f"{_pieces(f'p{i}', f't{i}', sep)}, t{i + 1} AS (SELECT doc_id, pos, t FROM p{i} WHERE length(t) > {SIZE})" for i, sep in enumerate(_LEVELS))},
atoms AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level, base, run ORDER BY pos) AS a FROM
  ({" UNION ALL ".join(_fits(i) for i in range(3))}
  UNION ALL SELECT doc_id, 3, pos, 0, pos + k, least({SIZE}, length(t) - k) FROM (SELECT doc_id, pos, t, unnest(range(0, length(t), {SIZE})) AS k FROM t3))),
b AS (SELECT doc_id, level, base, run, a, pos, pos + len AS ending, max(pos + len) OVER w AS last FROM atoms WINDOW w AS (PARTITION BY doc_id, level, base, run)),
reach AS (SELECT x.doc_id, x.level, x.base, x.run, x.a, x.pos, max(y.ending) AS ending, any_value(x.last) AS last
  FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.level = y.level AND x.base = y.base AND x.run = y.run AND y.a >= x.a AND y.a < x.a + {SIZE + 1} AND y.ending <= x.pos + {SIZE} GROUP BY ALL),
follow AS (SELECT r.*, n.ending AS next_ending FROM reach r LEFT JOIN b n ON n.doc_id = r.doc_id AND n.level = r.level AND n.base = r.base AND n.run = r.run AND n.pos = r.ending),
steps AS (SELECT f.doc_id, f.level, f.base, f.run, f.a, f.pos, f.ending, min(y.a) AS nxt FROM follow f LEFT JOIN b y
  ON f.doc_id = y.doc_id AND f.level = y.level AND f.base = y.base AND f.run = y.run AND y.a > f.a AND y.a < f.a + {SIZE + 2} AND f.ending < f.last
  AND y.pos >= greatest(f.ending - {OVERLAP}, f.next_ending - {SIZE}) GROUP BY ALL),
walk AS (SELECT * FROM steps WHERE a = 1
  UNION ALL SELECT s.* FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.level = w.level AND s.base = w.base AND s.run = w.run AND s.a = w.nxt)
SELECT w.doc_id, CAST(row_number() OVER (PARTITION BY w.doc_id ORDER BY w.pos) AS INTEGER) AS chunk_no, CAST(w.pos + 1 AS INTEGER) AS chunk_start,
  substring(d.text, CAST(w.pos + 1 AS BIGINT), CAST(w.ending - w.pos AS BIGINT)) AS chunk_text, CAST(w.ending - w.pos AS INTEGER) AS chunk_chars
FROM walk w JOIN documents d ON d.doc_id = w.doc_id"""


@query("doc_chunks_recursive", _SPLIT_SQL)
def doc_chunks_recursive(spark, sf):
    """2.16: whole documents split at blank lines, lines, blanks, merged up to 500 characters with 50 of overlap."""
    from tidemark.operators.splitter import split_recursive

    return split_recursive(fx.load(spark, sf, "documents"), size=SIZE, overlap=OVERLAP)
