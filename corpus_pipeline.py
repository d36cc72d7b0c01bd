"""From raw documents to packed sequences: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberline.llm import chosen_path, packing, quality_net, suffix_dedup, toxicity
from emberline.llm.common import prepare, release, table
from emberline.session import job_folder

#: Learned scores, confirmed near-duplicates, byte-wise removal and tokenizers are beyond SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None

#: A passage of fifty words, most of them short, has over 200 bytes. The operator's own query takes 400.
REPEATED_BYTES = 200


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on labelled ones among them, doesn't call toxic."""
    prepare(spark)
    return toxicity.clean_rows(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on labelled ones among them, calls good."""
    prepare(spark)
    return quality_net.good_rows(docs, quality_net.train(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    prepare(spark)
    return chosen_path.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the strings of ``REPEATED_BYTES`` bytes that occur more than once among them."""
    prepare(spark)
    return suffix_dedup.without_repeats(docs, REPEATED_BYTES)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: their pieces with ids and places."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", not_toxic),
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each keeps is a written table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = job_folder(spark, "pipeline", f"{name.replace(' ', '_')}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark)
        docs = spark.read.parquet(path)
    return docs
