"""A corpus pipeline of five stages over the documents table; each stage is written and read again by the next.

The driver of the pipeline is :func:`run`.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import exact_dedup, kneser_ney, mixing, ngram_join, packing
from kindred.llm.common import free_name, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit.

    Null and empty texts go; repeated rows are judged alike; an empty table gives no rows; all columns pass through,
    whatever their names.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    names = tuple(free_name(docs, c) for c in ("perplexity", "threshold", "kept"))
    return kneser_ney.quality_classifier(docs, trusted, names=names).filter(F.col(names[2])).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest id (null ids last, repeated rows once).

    Null and empty texts are one text; an empty table gives no rows; all columns pass through, whatever their names.
    """
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that with the smallest id.

    Null and empty texts link with nothing and stay, null ids come last, repeated rows stay once; an empty table gives
    no rows; all columns pass through, whatever their names.
    """
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source; texts without words follow their source's rate; rows that share id and source are drawn
    alike; an empty table gives no rows; all columns pass through, whatever their names.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences.

    Null and empty texts have the closing id alone; repeated rows and copies are packed each for itself; an empty table
    gives no rows; columns other than id and text are left behind.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), piece_bytes=1 << 20)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mix), ("packing", pack)]

#: SQL can express neither the model, the similarity join nor the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
