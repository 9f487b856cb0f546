"""From raw documents to packed training sequences, in five stages that are each written and read again.

Every stage works on all that the one before kept. The first four return the columns of ``documents``; the last one
returns the pieces of the kept documents with their places in sequences. Columns beyond those of ``documents`` pass through
the first four, whatever their names; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.llm import decontamination, jaccard, packing, quality, toxicity
from plantpulse.llm.common import free_name, table
from plantpulse.storage import stage

# The least P(grade > 0) that a document needs, and the toxicity score that rejects one.
LEAST_QUALITY, TOXIC = 0.5, 0.5
TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose rating is likelier above the lowest grade than not.

    Null and empty texts go; a tail of exactly ``LEAST_QUALITY`` stays; repeated rows and null keys are judged by their text alone.
    Without ratings of two grades all rows stay.
    """
    model = quality.fit(docs, quality.grades_of(table(spark, folder, "labels")))
    if model is None:
        return docs
    out = free_name(docs, "__quality")
    tail = F.get(F.col(out)["tails"], F.lit(0))
    return quality.judged(docs, model, out=out).where(tail >= LEAST_QUALITY).drop(out)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the lexicon scores under ``TOXIC``.

    Null and empty texts have no hits and stay; repeated rows and null keys are scored by their text alone.
    """
    lexicon = toxicity.fit(docs, table(spark, folder, "labels"))
    out = free_name(docs, "__score")
    return docs.withColumn(out, toxicity.score_column(docs, lexicon)).where(F.col(out) < TOXIC).drop(out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of exact and near copies, the one with the smallest id.

    Null ids come last, ties of an id go by the digest of the text, and of repeated rows one stays. Rows without words all stay.
    """
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without benchmark passages: passages are cut out, and texts of which half or more is benchmark go.

    Null and empty texts, and all rows where the benchmark is empty, stay as they are; repeated rows and null keys are cut alike.
    """
    return decontamination.remove(docs, table(spark, folder, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 1024 tokens; null and empty texts are one piece of the end token.

    Equal lengths are interchangeable; repeated rows and null keys are packed like any other row.
    """
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]

# Fitted models and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read back."""
    docs = table(spark, folder, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, folder), name.replace(" ", "-"))
    return docs
