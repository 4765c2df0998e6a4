"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

What holds for every stage but the last: all columns stay, whatever their names; null ids, repeated rows and several texts of one id are
rows of their own unless said otherwise; an empty table gives an empty one; texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenlake.llm import jaccard, packing, quality, repeats, secrets
from wrenlake.llm.common import stash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like others; equal texts have equal scores, so they stay or go together.  Without labels of both
    classes the score is the share of good ones (0.5 without any), which is compared with the same cut.
    """
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id: five words, 0.8.

    Documents without words are near nothing and stay.  Rows with one id are dropped or kept together, so repeated rows stay as they are.
    """
    return jaccard.one_of_each(docs, k=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes and more that a document with a smaller id holds go from the text.

    Rows with one id are one document's and take nothing from each other.  A null text stays null; a text of which nothing is left is
    empty.  ``n_chars`` is counted anew where the text changes.
    """
    return repeats.without_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that one owner (source) holds are masked in the text; those that several hold are examples and stay.

    A null source is an owner of its own; null and empty texts stay as they are.  ``n_chars`` is null where the text is.
    """
    masked = secrets.redact(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts with their place in a sequence.

    A null or empty text is one piece of one token; repeated rows are packed each; an id may be null.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
