"""Turning text columns into vectors with a pluggable embedder."""

import threading
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.functions.analysis import tokens
from shelfspark.functions.text import compose_text
from shelfspark.schemas import VECTORS
from shelfspark.sources.lines import slice_in_order
from shelfspark.sources.storage import folder_names, snapshot_versions, write_snapshot

BATCH_TEXTS = 10


class ContextLengthError(Exception):
    """A text of the batch is longer than the model accepts."""


class Embedder(Protocol):
    """A model; it is pickled to the workers and should load its weights on first use."""

    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed word counts hashed to `dim` buckets and scaled to unit length, computed by Spark itself.

    Bucket and sign come from the word's MD5, so any engine can reproduce the vector.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.name = f"hashing-{dim}"

    def embed_frame(self, df: DataFrame, text_col: str, id_col: str) -> DataFrame:
        digest = F.md5(F.col("word").cast("binary"))
        bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(self.dim)).cast("int")
        sign = F.when(F.pmod(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int"), F.lit(2)) == 0, 1).otherwise(-1)
        # Words are added up by bucket in the task that read the text; only those sums are shuffled.
        each = df.select(id_col, F.explode_outer(tokens(F.col(text_col))).alias("word"))
        totals = each.select(id_col, bucket.alias("bucket"), F.when(F.col("word").isNotNull(), sign).alias("sign"))
        summed = totals.groupBy(id_col, "bucket").agg(F.sum("sign").alias("total"))
        entry = F.when(F.col("bucket").isNotNull(), F.struct("bucket", "total"))
        whole = summed.groupBy(id_col).agg(
            F.map_from_entries(F.collect_list(entry)).alias("totals"),
            F.sqrt(F.sum((F.col("total") * F.col("total")).cast("double"))).alias("length"),
        )

        def component(i):
            total = F.coalesce(F.try_element_at("totals", i), F.lit(0))
            return F.when(F.col("length") > 0, total / F.col("length")).otherwise(F.lit(0.0)).cast("float")

        return whole.select(
            id_col, F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), component).alias("embedding")
        )


def embed_with_backoff(embedder: Embedder, texts: list[str]) -> np.ndarray:
    """Embed a batch. If the model finds it too long, each text is tried alone, and one that is too long is embedded in
    halves, whose vectors are averaged by length and scaled to the length of a unit vector; no text is cut.
    """
    try:
        return np.asarray(embedder.embed(texts))
    except ContextLengthError:
        if len(texts) > 1:
            return np.concatenate([embed_with_backoff(embedder, [t]) for t in texts])
        if len(texts[0]) <= 1:
            raise
        half = len(texts[0]) // 2
        parts = [texts[0][:half], texts[0][half:]]
        vectors = np.concatenate([embed_with_backoff(embedder, [p]) for p in parts])
        mean = np.average(vectors, axis=0, weights=[len(p) for p in parts])
        length = float(np.sqrt((mean * mean).sum()))
        return (mean / length if length else mean)[None, :]


class Patient:
    """An embedder whose calls may take `timeout` seconds, and are made again up to `retries` times if they fail or hang.

    A call that hangs keeps its thread until the worker ends; its result is not waited for.
    """

    def __init__(self, embedder: Embedder, timeout: float = 30.0, retries: int = 2):
        self.embedder, self.timeout, self.retries = embedder, timeout, retries
        self.name, self.dim = embedder.name, embedder.dim

    def embed(self, texts: list[str]) -> np.ndarray:
        for attempt in range(self.retries + 1):
            answer: list = []

            def call(answer=answer):
                try:
                    answer.append((np.asarray(self.embedder.embed(texts)), None))
                except Exception as e:
                    answer.append((None, e))

            thread = threading.Thread(target=call, daemon=True)
            thread.start()
            thread.join(self.timeout)
            vectors, problem = answer[0] if answer else (None, TimeoutError(f"no answer within {self.timeout} s"))
            if problem is None:
                return vectors
            if isinstance(problem, ContextLengthError) or attempt == self.retries:
                raise problem


def embed(df: DataFrame, text_col: str, embedder, id_col: str = "id") -> DataFrame:
    """Rows (id, embedding) for every text; `id_col` must be unique."""
    if hasattr(embedder, "embed_frame"):
        return embedder.embed_frame(df, text_col, id_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), BATCH_TEXTS):
                part = frame.iloc[start : start + BATCH_TEXTS]
                vectors = embed_with_backoff(embedder, part[text_col].fillna("").tolist())
                yield pd.DataFrame({
                    id_col: part[id_col].to_numpy(),
                    "embedding": [np.asarray(v, np.float32) for v in vectors],
                })

    narrow = df.select(id_col, text_col)
    id_type = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInPandas(run, f"{id_col} {id_type}, embedding array<float>")


def rating_text(ratings: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(id, text) that represents a rating row for the embedder, cut only where the model states its input limit."""
    text = compose_text(F.col("title"), F.col("author"), F.col("description"), F.col("genres"), max_chars)
    return ratings.select("id", text.alias("text"))


def check_model(vectors: DataFrame, model: str) -> None:
    """Refuse to mix vectors of different models."""
    stored = vectors.filter(F.col("model") != model).select("model").limit(1).collect()
    if stored:
        raise ValueError(
            f"embedding model mismatch: stored={stored[0]['model']!r} current={model!r}; "
            "remove the stored vectors to embed again"
        )


def embed_missing(texts: DataFrame, vectors: DataFrame, embedder, limit: int | None = None) -> DataFrame:
    """Vectors (id, embedding, model) for rows that have none yet, lowest ids first under a limit."""
    have = vectors.filter(F.col("embedding").isNotNull()).select("id")
    todo = texts.join(have, "id", "left_anti")
    if limit is not None:
        todo = slice_in_order(todo, [], "id", 0, limit, span=65_536)
    return embed(todo, "text", embedder).withColumn("model", F.lit(embedder.name))


def embed_in_ranges(texts: DataFrame, root: str, embedder, ranges: int = 16) -> int:
    """Embed the rows (id, text) that have no vector under `root`, one share of the ids after the other.

    Each share is committed as a version of its own folder, so a run that stops or loses its executors repeats at most
    the share it was at. Vectors of another model are refused. Returns the number of rows embedded.
    """
    spark, done = texts.sparkSession, 0
    check_model(read_ranges(spark, root), embedder.name)
    share = F.pmod(F.xxhash64("id"), F.lit(ranges))
    for k in range(ranges):
        own = read_ranges(spark, root).filter(share == k)
        todo = texts.filter(share == k).join(own.select("id"), "id", "left_anti")
        if todo.isEmpty():
            continue
        made = embed(todo, "text", embedder).withColumn("model", F.lit(embedder.name))
        folder = f"{root}/share={k}-of-{ranges}"
        version = write_snapshot(made, folder)
        done += spark.read.schema(VECTORS).parquet(f"{folder}/version={version:012d}").count()
    return done


def read_ranges(spark: SparkSession, root: str) -> DataFrame:
    """All vectors (id, embedding, model) that complete shares under `root` hold."""
    parts = [
        f"{root}/{share}/version={version:012d}" for share in folder_names(spark, root) if share.startswith("share=")
        for version in snapshot_versions(spark, f"{root}/{share}")]
    return spark.read.schema(VECTORS).parquet(*parts) if parts else spark.createDataFrame([], VECTORS)


def export_vectors(df: DataFrame, path: str) -> None:
    """Save id and vector of every embedded row as JSON lines."""
    df.filter(F.col("embedding").isNotNull()).select("id", "embedding").write.mode("overwrite").json(path)


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id LONG, embedding ARRAY<FLOAT>").json(path)


def restore_vectors(ratings: DataFrame, vectors: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Vectors of existing rows taken from the cache, only while no row has a vector at all."""
    if not vectors.filter(F.col("embedding").isNotNull()).limit(1).isEmpty():
        return vectors
    return (
        cache.join(ratings.select("id"), "id", "left_semi")
        .select("id", "embedding", F.lit(model).alias("model"))
    )
