"""The training-data pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of `documents`; the last returns packed pieces.
Rows with a null doc_id pass the stages that compare documents. Rows that repeat a doc_id are one document there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, near_dup, packing, quality, queries, substring
from tidewatch.llm.common import cut, table_dir, without

#: No SQL: a classifier is trained, texts are aligned and tokenized. tests/llm holds run() against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose conditional-random-field score is 0.3 or more."""
    labels = table_dir(spark, sf_dir, "labels").where(~queries.held_out())
    scored = quality.score(docs, quality.fit(labels, docs), name="_score")
    return scored.where(F.col("_score") >= 0.3).drop("_score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least id."""
    classes = near_dup.near_duplicates(docs)
    return without(docs, cut(classes.where(F.col("doc_id") != F.col("class_id")).select("doc_id")), "doc_id")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document of lesser id has too."""
    return substring.remove(docs, substring.passages(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document with windows of two or more benchmark items; of the others, texts without the words in such windows."""
    found = decontamination.contamination(docs, table_dir(spark, sf_dir, "benchmark"))
    return decontamination.drop_and_cut(docs, found, items=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with their ids, each a sequence of its own."""
    from public_tokenizers import path

    return packing.pack(docs, path(packing.VOCABULARY))


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_each), ("passages", cut_passages), ("benchmark", drop_leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage but the last is written to the shared folder and read again by the next."""
    docs = table_dir(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
