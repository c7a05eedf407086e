"""The corpus pipeline: stages of (spark, docs, sf_dir), each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeqc.llm.common import shared_folder
from latticeqc.llm.compression import keep_documents
from latticeqc.llm.minhash_forest import one_of_each_class
from latticeqc.llm.mixing import mix_documents, word_tokens
from latticeqc.llm.queries import PIPELINE_TARGETS, levels
from latticeqc.llm.sentencepiece_table import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands and the base rules keep."""
    return keep_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return one_of_each_class(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the token budgets; at most one epoch, so no document comes twice."""
    return mix_documents(docs, levels(), PIPELINE_TARGETS, word_tokens(F.col("text"))).select(*docs.columns)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document that is left, with digests of the ids and of the text that they decode to."""
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=outputs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]

#: Compression ratios, signatures and token ids are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
