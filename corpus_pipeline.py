"""A corpus pipeline over documents: quality, near copies, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents and
no others, and work row by row: rows of a null or repeated id are judged each by its own text. Columns beside those
of documents pass through unchanged; names that begin with two underscores and are in use inside a stage (__row,
__n, __did, __th, __spans) raise ValueError. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import decontaminate, near_copies, piece_lattice, quality_fm, suffix_dedup
from mailsieve.llm.common import saved, table

#: A learnt score, fingerprints, byte spans and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be of good quality.

    Null and empty texts are scored by their statistics; equal rows get equal scores and stay or go together; a null
    n_chars is a value of its own; without labels of both classes the bias alone decides, the same for all rows.
    """
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"), meta_cols=("n_chars",))
    return quality_fm.accepted(docs, model, meta_cols=("n_chars",))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of every group of near copies: five-word Jaccard similarity of 0.8 or more.

    Null and empty texts, and texts without words, are copies of each other; a null id comes after all others; ties
    go to the least hash of the row; equal rows leave one.
    """
    return near_copies.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share; n_chars, if there is such a column, follows the text.

    Null and empty texts stay as they are; a text that is taken out whole becomes empty and stays; equal rows are
    passages of each other and all lose them.
    """
    out = suffix_dedup.clean(docs)
    if "n_chars" not in docs.columns:
        return out
    length = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*(f"`{c}`" for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none; equal rows stay or go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every document left; null and empty texts have no ids, equal rows equal ones."""
    return piece_lattice.encode(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontaminated", decontaminated), ("encoded", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
