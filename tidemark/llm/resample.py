"""Importance resampling of documents: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

Words and pairs of neighbours are hashed into buckets; one model counts them over target texts, one over all
texts. A document's log weight is the sum of its features' log ratios, from both models without the document's
own counts (else a rare word would speak for whatever text holds it), shrunk to no difference for rare features.
The ``k`` documents with the greatest log weight plus Gumbel noise are a sample without replacement by weight. The noise is a hash of the document,
so a rerun draws the same sample.

Target texts are documents whose labels say good quality and not toxic. Labels are used up to ``most_labels``
rows (those of the least hash of the id), so that they can be broadcast; both models count whole texts, and all
texts are scored and drawn from. The driver holds two numbers for each bucket.

Defined results: null and empty texts have no features and the log weight 0; a document without label is raw
text only; several labels of one id count once, by the least of them; rows alike in id and text share their
noise; an empty table gives no rows. Columns of ``docs`` are carried along; names the operator adds start
with ``r_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, in_global_order, staged, table
from tidemark.llm.words import mix, word_hashes


def features(texts, buckets: int):
    """Buckets of a batch's words and pairs, and each text's number of them."""
    import numpy as np

    h, n = word_hashes(texts)
    last = np.cumsum(n)[n > 0] - 1
    pairs = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
    of = np.repeat(np.arange(len(n)), n)
    inside = np.ones(len(h), bool)
    inside[last] = False
    inside = inside[:-1] if len(h) else inside
    half = np.uint64(buckets // 2)
    return np.concatenate([h % half, pairs[inside] % half + half]).astype(np.int64), np.concatenate([of, of[:-1][inside]])


def bucket_counts(marked: DataFrame, buckets: int) -> DataFrame:
    """``marked`` has ``text`` and ``good``; sums over all texts: ``bucket``, ``raw``, ``target``."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros((2, buckets), np.int64)
        for b in by_bytes(batches, 0):
            f, of = features(b.column(0), buckets)
            good = np.asarray(b.column(1))[of]
            sums[0] += np.bincount(f, minlength=buckets)
            sums[1] += np.bincount(f[good], minlength=buckets)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])], ["bucket", "raw", "target"])

    return marked.select("text", "good").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 19, most_labels: int = 200_000, share: float | None = None, keep_pct: float = 97.0, seed: int = 0, smooth: float = 3.0) -> DataFrame:
    """``docs`` with ``r_log_weight``, ``r_rank`` (0: drawn first) and ``r_kept``.

    ``share`` of the documents is drawn; None: as many as weigh no less than ``keep_pct`` per cent of the target
    documents do.
    """
    import numpy as np

    spark = docs.sparkSession
    one = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good"))
    used = staged(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels), "labels-used")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    marked = rows.join(F.broadcast(used.withColumnRenamed("doc_id", "label")), F.col("id") == F.col("label"), "left").select("id", "key", "text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = bucket_counts(marked, buckets)
    sums = np.zeros((2, buckets))
    got = counts.toArrow()  # at most `buckets` rows
    sums[:, got["bucket"].to_numpy()] = got["raw"].to_numpy(), got["target"].to_numpy()
    half = buckets // 2
    part = np.array([s.sum() for s in (sums[0, :half], sums[0, half:], sums[1, :half], sums[1, half:])])
    held = spark.sparkContext.broadcast((sums, (part[2:] + 1) / (part[:2] + 1)))

    def weigh(batches):
        import numpy as np
        import pyarrow as pa

        (raw, target), rate = held.value
        for b in by_bytes(batches, 2):
            f, of = features(b.column(2), buckets)
            cell, own = np.unique(of * buckets + f, return_counts=True)
            of, f = np.divmod(cell, buckets)
            good = np.asarray(b.column(3))[of]
            ratio = np.log(target[f] - own * good + smooth) - np.log((raw[f] - own) * rate[(f >= buckets // 2).astype(int)] + smooth)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(np.bincount(of, own * ratio, minlength=b.num_rows).astype(np.float64))], ["id", "key", "good", "log_weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    weights = staged(marked.mapInArrow(weigh, f"id {kind}, key long, good boolean, log_weight double").distinct(), "weights")
    # Uniform in (0, 1) from 52 bits of a hash, then Gumbel noise.
    uniform = (F.call_function("shiftrightunsigned", F.xxhash64("id", "key", F.lit(seed)), F.lit(12)) + 0.5) / float(1 << 52)
    noisy = weights.withColumn("draw", -(F.col("log_weight") - F.log(-F.log(uniform))))
    if share is None:
        least = weights.filter("good").agg(F.percentile_approx("log_weight", (100 - keep_pct) / 100, 10_000)).first()[0]
        k = weights.filter(F.col("log_weight") >= F.lit(least)).count() if least is not None else 0
    else:
        k = -(-int(share * 1_000_000) * weights.count() // 1_000_000)
    ranked = in_global_order(noisy, ["draw", "id", "key"], int(spark.conf.get("spark.sql.shuffle.partitions")), name="draws")
    picked = ranked.select(F.col("id").alias("r_id"), F.col("key").alias("r_key"), F.col("log_weight").alias("r_log_weight"), F.col("pos").alias("r_rank"), (F.col("pos") < k).alias("r_kept"))
    return docs.withColumn("r_key2", F.xxhash64(text_col)).join(picked, (F.col("r_key2") == F.col("r_key")) & F.col(id_col).eqNullSafe(F.col("r_id"))).drop("r_id", "r_key", "r_key2")


def op10_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("r_log_weight").alias("log_weight"), F.col("r_rank").alias("rank"), F.col("r_kept").alias("kept"))
