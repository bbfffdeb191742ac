"""The corpus pipeline: each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as
the next one's documents.

1. Documents that the quality rules reject go; lines above the limits go from those that stay.
2. Of documents linked by near-equal shingle sets one stays, that of the least id (null ids last; of texts of one id
   that of the least hash), and of rows alike in id and text one.
3. Repeated chunks go; a document of which nothing but blanks is left goes.
4. Documents that hold a window of a benchmark item go.
5. What is left is packed into sequences.

All but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chunks import REGISTERED, dedup_chunks
from tidemark.llm.common import BLANK_CHARS, hidden, hidden_name, shown, shuffles_freed, stage_dir, table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.jaccard import jaccard_join
from tidemark.llm.packing import pack
from tidemark.llm.quality import quality_rules


def over(docs: DataFrame, stage: Callable[[DataFrame, Callable[[str], str]], DataFrame], text: str | None = None) -> DataFrame:
    """``stage`` gets the documents with numbered columns, so that no name of theirs meets one of an operator's, and what
    tells a column's number. Of what it returns the documents' columns stay, with the column ``text`` for their text,
    if there is one, and ``n_chars`` (where documents have it) after that."""
    out = stage(hidden(docs), partial(hidden_name, docs))
    if text:
        out = out.withColumn(hidden_name(docs, "text"), F.col(text))
        if "n_chars" in docs.columns:
            out = out.withColumn(hidden_name(docs, "n_chars"), F.length(text).cast(docs.schema["n_chars"].dataType))
    return shown(out.select(hidden(docs).columns), docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limits.

    Null, empty and short texts fail the base rules and go; a null source is a host of its own; of rows alike each is judged
    alike; an empty table gives none.
    """
    return over(docs, lambda d, name: quality_rules(d, name("doc_id"), name("text"), name("source")).filter("q_kept"), "q_text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the least id (null ids last; of one id that of the least hash of the text).

    Texts without words link with nothing and stay, rows alike in id and text once; an empty table gives none.
    """

    def one_each(d: DataFrame, name: Callable[[str], str]) -> DataFrame:
        id_col, text = name("doc_id"), name("text")
        keep = jaccard_join(d.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).filter("first").select(F.col("id").alias("k_id"), F.col("key").alias("k_key")).distinct()
        keyed = d.withColumn("k_own", F.xxhash64(text, id_col))
        return keyed.join(keep, (F.col("k_own") == F.col("k_key")) & F.col(id_col).eqNullSafe(F.col("k_id"))).dropDuplicates(["k_own", id_col])

    return over(docs, one_each)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs that an earlier document (or place) has; a document of which nothing but blanks is left goes.

    Null texts and texts that lost nothing stay as they are; rows alike in id and text are one document; an empty table gives none.
    """
    left = (F.col("x_n_removed") == 0) | (F.length(F.translate("x_text", BLANK_CHARS, "")) > 0)
    return over(docs, lambda d, name: dedup_chunks(d, name("doc_id"), name("text"), **REGISTERED).filter(left), "x_text")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null texts have none and stay; items without words have no window; an empty table of items takes nothing away.
    """
    bench = table(spark, sf_dir, "benchmark")
    return over(docs, lambda d, name: decontaminate(d, bench, name("doc_id"), name("text")).filter(~F.col("c_contaminated")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2048; null texts count as empty, columns other than id and text end here."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), fold=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Linking, chunking and packing can't be said in SQL: tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = stage_dir(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        with shuffles_freed(spark):
            out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
