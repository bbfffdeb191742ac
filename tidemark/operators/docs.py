"""Document preparation for retrieval (G1-G5): chunking, processed-file ledger,
changed-rows detection and exact vector top-k.

Chunking is a narrow transformation (``explode`` of chunk starts + ``substring``),
so it runs where the documents are and never shuffles text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 500, overlap: int = 50, keep: Sequence[str] = ()) -> DataFrame:
    """Fixed-size character chunks with overlap over the WHOLE text.

    Chunk starts are ``1, 1 + (size - overlap), ...`` up to ``length - overlap``, so
    the last chunk always reaches the end and no chunk lies inside the previous
    chunk's overlap. Empty or NULL texts give no chunk. ``keep`` columns are
    carried onto every chunk (narrow, no join).
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = F.length(F.col(text_col))
    last = F.greatest(F.lit(1), n - overlap)
    x = df.where(n > 0).select("*", F.posexplode(F.sequence(F.lit(1), last, F.lit(step))).alias("__pos", "chunk_start"))
    return x.select(
        F.col(id_col),
        *[F.col(k) for k in keep],
        (F.col("__pos") + 1).alias("chunk_no"),
        F.concat_ws("-", F.col(id_col).cast("string"), (F.col("__pos") + 1).cast("string")).alias("chunk_id"),
        "chunk_start",
        F.substring(F.col(text_col), F.col("chunk_start"), size).alias("chunk_text"),
    ).withColumn("chunk_chars", F.length("chunk_text"))


def unprocessed(docs: DataFrame, ledger: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents not yet in the ledger (left anti join)."""
    return docs.join(ledger.select(key), key, "left_anti")


def ledger_append(ledger: DataFrame, processed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ledger after a run (idempotent: keys already present are not repeated)."""
    return ledger.select(key).unionByName(processed.select(key)).distinct()


def changed(prev: DataFrame, cur: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """INSERT / UPDATE / DELETE per key from a text hash; unchanged keys are dropped.

    Only ``(key, hash)`` pairs are shuffled, never the texts.
    """
    p = prev.select(key, F.sha2(F.col(text_col), 256).alias("prev_hash"), F.lit(True).alias("in_prev"))
    c = cur.select(key, F.sha2(F.col(text_col), 256).alias("cur_hash"), F.lit(True).alias("in_cur"))
    j = p.join(c, key, "full_outer")
    action = (
        F.when(F.col("in_prev").isNull(), "INSERT")
        .when(F.col("in_cur").isNull(), "DELETE")
        .when(~F.col("prev_hash").eqNullSafe(F.col("cur_hash")), "UPDATE")
    )
    return j.select(key, action.alias("change"), "cur_hash").where(F.col("change").isNotNull())


def cosine(vec: Column, query: Sequence[float]) -> Column:
    """Cosine similarity of an array column with a literal query vector (JVM-side higher-order functions)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vec.cast("array<double>")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    nv = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    nq = float(sum(float(x) * float(x) for x in query)) ** 0.5
    return F.when((nv == 0) | F.lit(nq == 0), F.lit(None)).otherwise(dot / (nv * F.lit(nq)))


def topk(df: DataFrame, query: Sequence[float], k: int = 10, vec_col: str = "embedding", id_col: str = "vec_id", digits: int = 4) -> DataFrame:
    """Exact top-k by cosine similarity (score rounded; ties broken by id).

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each partition keeps
    its own k best rows, only k rows per partition reach the final merge.
    """
    scored = df.select(F.col(id_col), F.round(cosine(F.col(vec_col), query), digits).alias("score"), *[c for c in df.columns if c not in (id_col, vec_col)])
    return scored.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), F.col(id_col)).limit(k)
