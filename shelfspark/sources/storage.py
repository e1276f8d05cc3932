"""Shared work folder, staged tables and versioned snapshots on the cluster's file system."""

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; a temporary one only when Spark runs in a single process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="shelfspark-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def as_uri(path: str) -> str:
    """Path as a URI for readers outside the JVM."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path.removeprefix("file:")
    if path.startswith("s3a://"):
        return "s3://" + path.removeprefix("s3a://")
    return path if "://" in path else f"file://{path}"


_STEPS = threading.local()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For rows of up to megabytes: bytes of a page, a row group and an Arrow batch, rows of a batch read.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.page.size": str(1 << 18), "parquet.block.size": str(1 << 22)}
FEW = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22), "spark.sql.parquet.columnarReaderBatchSize": "16"}


def stage(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage is cut, sizes are known.

    Pages and row groups of `wide` rows are measured after each row, not after a hundred.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/stage-{uuid.uuid4().hex}"
    for made in getattr(_STEPS, "open", [])[-1:]:
        made.append(path)
    df.write.options(**WIDE if wide else {}, compression="zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def few_rows_at_once(spark: SparkSession) -> Iterator[None]:
    """Jobs begun in here pass few of their rows at once between files, Spark and Python, as each may be large."""
    before = {k: spark.conf.get(k) for k in FEW}
    for k, v in FEW.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stages in here are deleted at the end, so what is read later must not come from them.

    Shuffle files of a job begun in here go when it ends, not when the driver happens to collect its garbage.
    """
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    _STEPS.open = [*getattr(_STEPS, "open", []), made := []]
    try:
        yield
    finally:
        _STEPS.open = _STEPS.open[:-1]
        spark.conf.set(CLEANUP, before)
        for path in made:
            fs, folder = _folder(spark, path)
            fs.delete(folder, True)


def unstage(df: DataFrame) -> None:
    """Delete a table made by `stage` that nothing will read again."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if path.rsplit("/", 1)[1].startswith("stage-"):
            fs, folder = _folder(spark, path)
            fs.delete(folder, True)


def clear_stages(spark: SparkSession) -> None:
    """Delete all staged tables of the work folder; for use between runs, when nothing reads them any more."""
    fs, folder = _folder(spark, work_dir(spark))
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "stage-*")) or []:
        fs.delete(status.getPath(), True)


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.mkdirs(folder)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder; 0 where it does not exist."""
    fs, folder = _folder(spark, path)
    return fs.getContentSummary(folder).getLength() if fs.exists(folder) else 0


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none where it does not exist."""
    fs, folder = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders inside a folder, but for those that Spark does not read either."""
    fs, folder = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def snapshot_versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of a table, oldest first; a version counts once its success marker is there."""
    fs, folder = _folder(spark, root)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(
        int(n.removeprefix("version="))
        for n in names
        if n.startswith("version=") and path_exists(spark, f"{root}/{n}/_SUCCESS")
    )


def delete_versions(spark: SparkSession, root: str, before: int) -> None:
    """Delete the versions of a table that are older than `before`."""
    fs, folder = _folder(spark, root)
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if name.startswith("version=") and int(name.removeprefix("version=")) < before:
            fs.delete(status.getPath(), True)


def write_snapshot(
    df: DataFrame, root: str, version: int | None = None, partition_by: list[str] | None = None
) -> int:
    """Write `df` as a new version of the table at `root`; readers switch when it is complete.

    Naming the version makes a repeated write replace its own earlier attempt.
    """
    spark = df.sparkSession
    if version is None:
        version = max(snapshot_versions(spark, root), default=-1) + 1
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/version={version:012d}")
    return version


def read_snapshot(
    spark: SparkSession, root: str, schema: str | None = None, before: int | None = None
) -> DataFrame:
    """Newest complete version, or an empty table of `schema` when there is none."""
    versions = [v for v in snapshot_versions(spark, root) if before is None or v < before]
    if not versions:
        if schema is None:
            raise FileNotFoundError(f"no complete version under {root}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/version={versions[-1]:012d}")
