"""A corpus pipeline in five stages, from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.llm.common import read, small_batches, stored
from limpid.llm.decontaminate import decontaminate
from limpid.llm.language_id import fit, held_out, predict_language
from limpid.llm.line_dedup import dedup_lines
from limpid.llm.ngram_join import one_of_each
from limpid.llm.packing import pack_documents


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, the only ones that no language is told for.

    Scores reject none: they depend on how many languages were learned. Where
    none could be learned, every document with a letter stays.
    """
    small_batches(spark)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return predict_language(docs, model).where(F.col("language.lang") != "und").select(docs.columns)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many documents share out of all of them but one."""
    small_batches(spark)
    out = dedup_lines(docs)
    text = F.when(F.col("lines.n_dropped") > 0, F.col("lines.kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id."""
    small_batches(spark)
    return one_of_each(docs).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).where("not hits.contaminated").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_common_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("packing", packed),
]

#: Language ID, the tokenizer and packing cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
