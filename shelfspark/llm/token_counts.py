"""Token counts with a cache of counts by content digest and tokenizer digest.

A document's content is normalised (runs of ASCII white space become one space, ends are trimmed, null becomes
empty) and digested. Digests meet the stored counts of this tokenizer; of those without one, a single document per
digest is encoded, and its count is appended to the store. Texts move once, hashed by digest and id, so a group of
copies of any size is one small row before its text moves.

Only `tokenizers` vocabularies whose pre-tokeniser drops white space may be used: their tokens never reach over
white space, so a text's count is the sum over its words, and a memo of words spares most of the encoding. The
memo is bounded and belongs to the worker.
"""

import hashlib

import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.words import Memo, claim, with_columns
from shelfspark.sources.storage import path_exists

CACHE = "version STRING, digest BINARY, n_tokens LONG"
_COUNTERS: dict[str, Memo] = {}


def tokenizer_version(data: bytes) -> str:
    """Digest of the vocabulary file and the library that reads it."""
    return hashlib.sha256(data + tokenizers.__version__.encode()).hexdigest()


def normalised(text):
    """Content that has the same tokens for every text with equal words."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def _counter(version: str, data: bytes) -> Memo:
    if version not in _COUNTERS:
        known = tokenizers.Tokenizer.from_str(data.decode())
        known.no_truncation()
        known.no_padding()
        _COUNTERS[version] = Memo(lambda word: len(known.encode(word, add_special_tokens=False)), 1 << 19)
    return _COUNTERS[version]


def encoded_counts(df: DataFrame, text: str, data: bytes) -> DataFrame:
    """`df` with n_tokens in place of its text, by the tokenizer file `data`."""
    shared, version = df.sparkSession.sparkContext.broadcast(data), tokenizer_version(data)

    def compute(texts):
        memo = _counter(version, shared.value)
        claim(memo)
        count = memo.__getitem__
        return {"n_tokens": [sum(map(count, (t or "").split(" "))) if t else 0 for t in texts]}

    return with_columns(df, text, "n_tokens LONG", compute)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer, one row per digest; runs that stored the same digest agree."""
    stored = spark.read.schema(CACHE).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], CACHE)
    return stored.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, identity: str = "doc_id", text: str = "text", limit: int = 2048
) -> DataFrame:
    """(identity, n_bytes, n_tokens, over_limit) of every row of `docs`; counts that `cache` lacks are added to it.

    This runs jobs at once: the missing counts are encoded and written before the result is planned. Null and
    empty texts have 0 bytes and 0 tokens; repeated rows and ids each give a row; a null id stays null; an empty
    table gives no rows. Other columns are not read. A run that fails leaves the cache as it was or complete.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        data = file.read()
    version = tokenizer_version(data)
    rows = docs.select(
        F.col(identity).alias("id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        normalised(F.col(text)).alias("content"),
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    missing = (
        rows.groupBy("digest").agg(F.min("id").alias("first"))
        .join(read_cache(spark, cache, version).select("digest"), "digest", "left_anti")
    )
    # Ids meet as text with a mark for null, so that repeated rows of an id are in one place and encoded once.
    spot = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    texts = (
        rows.select("digest", spot("id").alias("spot"), "content")
        .join(missing.select("digest", spot("first").alias("spot")), ["digest", "spot"])
        .dropDuplicates(["digest", "spot"])
    )
    (
        encoded_counts(texts.select("digest", "content"), "content", data)
        .select(F.lit(version).alias("version"), "digest", "n_tokens")
        .write.mode("append").parquet(cache)
    )
    counts = read_cache(spark, cache, version)
    return rows.select("id", "n_bytes", "digest").join(counts, "digest").select(
        F.col("id").alias(identity), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
