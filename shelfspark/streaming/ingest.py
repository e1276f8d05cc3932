"""Continuous ingest of feed files with Structured Streaming."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.merge import dedupe_last, split_blank_keys
from shelfspark.plans.ingest import merge_feed, rejects
from shelfspark.sources.seekable import read_frame_stream
from shelfspark.sources.storage import (
    delete_versions, folder_bytes, make_folder, path_exists, read_snapshot, snapshot_versions, write_snapshot,
)

ORDER = ["modified", "file", "block", "row"]


def read_line_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of files appearing in a folder, with the columns that give their order."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select(
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )


def _base_version(spark: SparkSession, table: str, path: str) -> int:
    """Newest version of the table when the stream first began, -1 for none; kept at `path`."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        newest = max(snapshot_versions(spark, table), default=-1)
        spark.createDataFrame([(newest,)], "version INT").coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("version INT").json(path).first()["version"]


def stream_ingest(
    spark: SparkSession, folder: str, table: str, schema: str, checkpoint: str,
    parse: Callable[..., DataFrame], values: list[str], mode: str = "quarantine",
    max_files: int | None = None, rejected: str | None = None,
) -> StreamingQuery:
    """Merge every new file of `folder` into the table and stop when all are in.

    The checkpoint remembers finished files, and beside it the newest version that the table had when the stream was
    first started. Batch n writes the version n + 1 after that one from the version before it, so a batch repeated
    after a crash replaces its own output and counts once. A version that somebody else has written meanwhile is
    refused. Refused lines and rows of batch n are kept in `rejected`/batch=n. The query's progress reports rows per
    batch.
    """
    base = _base_version(spark, table, f"{checkpoint}-base")

    def merge(batch: DataFrame, batch_id: int) -> None:
        version, mark = base + 1 + batch_id, f"{checkpoint}-written/batch={batch_id}"
        if not path_exists(spark, mark):
            if max(snapshot_versions(spark, table), default=-1) >= version:
                raise RuntimeError(f"version {version} of {table} was written by somebody else")
            make_folder(spark, mark)
        # Rows of one file block are read by one task in file order.
        rows_in = batch.withColumn("row", F.monotonically_increasing_id()).filter(F.trim("value") != "")
        rows = parse(rows_in, mode)
        if rejected is not None:
            refused = rejects(rows_in, rows, ORDER, mode)
            refused.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        target = read_snapshot(spark, table, schema, before=version)
        write_snapshot(merge_feed(target, rows, values, ORDER), table, version)

    return (
        read_line_stream(spark, folder, max_files)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _fold(spark: SparkSession, table: str, schema: str, checkpoint: str, values: list[str]) -> None:
    """Merge the pending rows of all batches into the table as one version, and give them up.

    A fold repeated after a crash finds its rows in the table and changes none.
    """
    pending, versions = f"{checkpoint}-pending", snapshot_versions(spark, f"{checkpoint}-pending")
    if not versions:
        return
    base, newest = _base_version(spark, table, f"{checkpoint}-base"), max(snapshot_versions(spark, table), default=-1)
    if newest > base and not path_exists(spark, f"{checkpoint}-written/batch={newest - base - 1}"):
        raise RuntimeError(f"version {newest} of {table} was written by somebody else")
    make_folder(spark, f"{checkpoint}-written/batch={newest - base}")
    paths = [f"{pending}/version={v:012d}" for v in versions]
    rows = spark.read.option("basePath", pending).parquet(*paths)
    write_snapshot(merge_feed(read_snapshot(spark, table, schema), rows, values, ["version"]), table, newest + 1)
    delete_versions(spark, pending, versions[-1] + 1)


def ingest_frames(
    spark: SparkSession, folder: str, table: str, schema: str, checkpoint: str, parse: Callable[..., DataFrame],
    values: list[str], mode: str = "quarantine", max_frames: int | None = None, rejected: str | None = None,
) -> int:
    """Merge seekable zstd files in batches of `max_frames` frames until all are in; the number of batches.

    One query runs all batches. A batch keeps its last row per source_id as pending; once pending rows take as much
    room as the table, and at the end, also of a run that fails, they are merged into it as one version. So the table is
    not rewritten for each batch, and work grows with the feed. A stopped or failed run is taken up by the next call
    where its last finished batch ended, inside a file if need be; what a killed run left pending is merged first.
    """
    pending, batches, room = f"{checkpoint}-pending", 0, 0

    def fold() -> None:
        nonlocal room
        _fold(spark, table, schema, checkpoint, values)
        newest = max(snapshot_versions(spark, table), default=-1)
        room = folder_bytes(spark, f"{table}/version={newest:012d}")

    def keep(batch: DataFrame, batch_id: int) -> None:
        nonlocal batches
        # Rows of one run of frames are read by one task in file order.
        rows_in = batch.withColumn("row", F.monotonically_increasing_id()).filter(F.trim("value") != "")
        rows = parse(rows_in, mode)
        if rejected is not None:
            refused = rejects(rows_in, rows, ORDER, mode)
            refused.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        keyed, _ = split_blank_keys(rows, "source_id")
        write_snapshot(dedupe_last(keyed, ["source_id"], ORDER).drop(*ORDER), pending, batch_id)
        if folder_bytes(spark, pending) > room:
            fold()
        batches += 1

    _base_version(spark, table, f"{checkpoint}-base")
    fold()
    query = (
        read_frame_stream(spark, folder, max_frames)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        fold()
    return batches
