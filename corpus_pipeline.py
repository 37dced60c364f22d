"""The corpus pipeline: five stages, each over all documents that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of documents.

Defined cases: a null or empty text is kept by the first four stages and has size 0 in the mix; rows without a doc_id are judged by
their own text in the first and the fourth stage, and kept by the second and the third; rows that repeat a doc_id and its text are
one document and share their fate, other texts of a doc_id are documents of their own; without labels of both classes no document
is toxic; with an empty benchmark none is contaminated; columns besides doc_id, text, source and n_chars pass unread, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.llm import decontamination, line_dedup, mixing, near_dedup, toxicity
from pricegrain.llm.common import Scratch, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labels of documents, doesn't reject."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that repeat an earlier line; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, Scratch(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return near_dedup.keep_one(docs, Scratch(spark)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of benchmark."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), Scratch(spark)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words and copies the mix takes of each document."""
    return mixing.mix(docs, Scratch(spark)).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Compression lengths and edit distances have no SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
