"""Key-value notes about ingest runs, kept as an append-only table."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.schemas import RUN_META


def meta_read(spark: SparkSession, path: str) -> DataFrame:
    """All notes ever written, oldest included; empty before the first one."""
    from shelfspark.sources.storage import path_exists

    if not path_exists(spark, path):
        return spark.createDataFrame([], RUN_META)
    return spark.read.schema(RUN_META).parquet(path)


def meta_put(spark: SparkSession, path: str, entries: dict[str, str | None]) -> None:
    """Set keys; a NULL value deletes the key."""
    rows = spark.createDataFrame(list(entries.items()), "key STRING, value STRING")
    rows.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def meta_delete(spark: SparkSession, path: str, keys: list[str]) -> None:
    meta_put(spark, path, dict.fromkeys(keys))


def meta_current(notes: DataFrame) -> DataFrame:
    """Latest value per key, deleted keys left out."""
    # Of notes written at the same moment the greatest value counts, a deletion last.
    latest = notes.groupBy("key").agg(F.max(F.struct("ts", F.col("value").isNotNull().alias("set"), "value")).alias("last"))
    return latest.select("key", "last.value").filter(F.col("value").isNotNull())


def meta_get(notes: DataFrame, key: str) -> str | None:
    row = meta_current(notes.filter(F.col("key") == key)).first()
    return row["value"] if row else None
