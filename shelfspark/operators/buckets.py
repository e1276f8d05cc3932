"""Tables kept by key bucket, where a merge rewrites only the buckets in which something changes.

`root` holds `data/version=…/bucket=…` and `manifest/version=…` (bucket, version, buckets): the newest complete manifest
names, for each bucket, the version whose folder holds its rows. A merge writes the folders of changed buckets under a
new version and then a manifest that keeps all other entries, so files of other buckets stay as they are and a run that
fails half-way is never read. Old versions can be read until `expire_versions` removes what no kept manifest names.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.operators.merge import compare, invalidate_vectors, upsert
from shelfspark.sources.storage import _folder, path_exists, snapshot_versions, stage

#: A bucket is read and rewritten as a whole; choose the number so that one is some hundred MB.
BUCKETS = 64
MANIFEST = "bucket INT, version INT, buckets INT"


def key_bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> list[tuple[int, int, int]]:
    """(bucket, version, buckets) of a table, one entry per bucket that has rows; none for a new table."""
    versions = [v for v in snapshot_versions(spark, f"{root}/manifest") if version is None or v <= version]
    if not versions:
        return []
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={versions[-1]}").collect()
    return sorted(tuple(r) for r in rows)


def _next_version(spark: SparkSession, root: str) -> int:
    return max(snapshot_versions(spark, f"{root}/manifest"), default=-1) + 1


def _write(rows: DataFrame, root: str, keys: list[str], buckets: int, version: int, kept: list[tuple], changed: list[int]) -> int:
    spark, path = rows.sparkSession, f"{root}/data/version={version}"
    placed = rows.withColumn("bucket", key_bucket(keys, buckets))
    # By bucket and key, so that a bucket of a skewed size is still cut over several tasks and files.
    placed.repartitionByRange("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(path)
    filled = [b for b in changed if path_exists(spark, f"{path}/bucket={b}")]
    entries = [e for e in kept if e[0] not in set(changed)] + [(b, version, buckets) for b in filled]
    # A table without rows still has its number of buckets, in an entry that names no folder.
    entries = entries or [(-1, version, buckets)]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    return version


def write_bucketed(df: DataFrame, root: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Write all of `df` as a new version, whose number is returned."""
    return _write(df, root, keys, buckets, _next_version(df.sparkSession, root), [], list(range(buckets)))


def read_bucketed(
    spark: SparkSession, root: str, schema: str, version: int | None = None, only: list[int] | None = None
) -> DataFrame:
    """Rows of the table, of the newest or another version, of the buckets `only` where given."""
    entries = [e for e in read_manifest(spark, root, version) if e[0] >= 0 and (only is None or e[0] in set(only))]
    paths = [f"{root}/data/version={v}/bucket={b}" for b, v, _ in entries]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket_versions(spark: SparkSession, root: str, version: int | None = None) -> dict[int, int]:
    """The version that holds each bucket."""
    return {b: v for b, v, _ in read_manifest(spark, root, version) if b >= 0}


def _buckets_of(rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """Buckets that hold some of these keys: at most `buckets` numbers."""
    return sorted(r[0] for r in rows.select(key_bucket(keys, buckets).alias("b")).distinct().collect())


def merge_bucketed(
    source: DataFrame, root: str, schema: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame],
    changes: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS,
) -> int | None:
    """Rewrite the buckets in which `source` changes something; the new version, or None where nothing changes.

    `changes(target, source)` are the source rows, or their keys, that change the table, and `merge(target, source)` the
    rows after the merge. Both see only buckets that the source mentions. `buckets` counts for a new table.
    """
    spark = source.sparkSession
    entries = read_manifest(spark, root)
    buckets = entries[0][2] if entries else buckets
    source = stage(source)
    touched = read_bucketed(spark, root, schema, only=_buckets_of(source, keys, buckets))
    changed = _buckets_of(changes(touched, source), keys, buckets)
    if not changed:
        return None
    target = read_bucketed(spark, root, schema, only=changed)
    wanted = source.filter(key_bucket(keys, buckets).isin(changed))
    return _write(merge(target, wanted), root, keys, buckets, _next_version(spark, root), [e for e in entries if e[0] >= 0], changed)


def upsert_bucketed(
    source: DataFrame, root: str, schema: str, keys: list[str], values: list[str], now: Column,
    reset: dict[str, list[str]] | None = None, buckets: int = BUCKETS,
) -> int | None:
    """`upsert` of a table kept by bucket: buckets without an inserted or updated row keep their files."""
    used = [*keys, *values]

    def changes(target: DataFrame, rows: DataFrame) -> DataFrame:
        both = compare(target.select(used), rows.select(used), keys, values)
        return both.filter(F.col("change_type").isin("inserted", "updated")).select(*keys)

    return merge_bucketed(
        source, root, schema, keys, lambda target, rows: upsert(target, rows, keys, values, now, reset), changes, buckets)


def invalidate_bucketed(vectors_root: str, schema: str, old: DataFrame, new: DataFrame, include_genres: bool = False) -> int | None:
    """Set the vectors of rows whose embedded text changed to null; `old` and `new` need hold the changed rows only.

    Vector buckets without such a row keep their files.
    """
    probe = new.select("id", F.lit(True).alias("embedding"))
    stale = stage(invalidate_vectors(probe, old, new, include_genres=include_genres).filter("embedding IS NULL").select("id"))

    def changes(target: DataFrame, rows: DataFrame) -> DataFrame:
        return target.filter("embedding IS NOT NULL").join(rows, "id", "left_semi").select("id")

    def without(target: DataFrame, rows: DataFrame) -> DataFrame:
        marked = target.join(rows.distinct().withColumn("_stale", F.lit(True)), "id", "left")
        return marked.withColumn("embedding", F.when(F.col("_stale").isNull(), F.col("embedding"))).select(target.columns)

    return merge_bucketed(stale, vectors_root, schema, ["id"], without, changes)


def expire_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest `keep` versions and the bucket folders that only they name; number of folders deleted."""
    versions = snapshot_versions(spark, f"{root}/manifest")
    dropped, kept = versions[:-keep], versions[-keep:]
    named = {(b, v) for version in kept for b, v, _ in read_manifest(spark, root, version)}
    deleted = 0
    for version in dropped:
        fs, folder = _folder(spark, f"{root}/manifest/version={version}")
        fs.delete(folder, True)
    fs, data = _folder(spark, f"{root}/data")
    if not versions or not fs.exists(data):
        return 0
    for of_version in fs.listStatus(data):
        number = int(of_version.getPath().getName().removeprefix("version="))
        if number > versions[-1]:
            continue  # a merge that is still being written
        for status in fs.listStatus(of_version.getPath()):
            name = status.getPath().getName()
            if name.startswith("bucket=") and (int(name.removeprefix("bucket=")), number) not in named:
                fs.delete(status.getPath(), True)
                deleted += 1
    return deleted
