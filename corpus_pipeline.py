"""A corpus pipeline over `documents`: quality, near copies, benchmark leaks, secrets, then token ids.

Each stage gets the documents that the one before kept and returns them with their columns; the last returns a row of
counts and digests per document. Null and empty texts pass every stage but the first, which judges them like any
other; repeated rows are one document to the second stage; an empty table passes as an empty table.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import bpe, decontaminate, jaccard, quality, secret_scan
from shelfspark.sources.storage import stage

#: No SQL says what the first stage learns; tests/llm holds run() against its stages in plain Python.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, learned from the labelled ones among them, does not reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secret_scan.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    return bpe.encode_documents(docs, bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
