"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again before the next one.

Toxic documents go; of equal texts one row stays; of each group of near copies (word shingles of five, Jaccard of 0.8 or
more) one document stays; sources are mixed to their target weights, which drops and repeats rows; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import exact_dedup, piece_codec, shingle_join, source_mix, toxic_segments
from lorekeep.llm.common import table
from lorekeep.operators.skew import cut


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half."""
    model = toxic_segments.fit(docs, table(spark, sf_dir, "labels"))
    return toxic_segments.without_toxic(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return shingle_join.first_of_groups(docs, width=5, num=4, den=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix takes them."""
    return source_mix.repeated(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to, for each row of the mix."""
    import public_tokenizers

    return piece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("shingle_join", near),
    ("source_mix", mixing),
    ("piece_codec", encoding),
]
#: Toxicity scores and the Newton steps of the mix are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
