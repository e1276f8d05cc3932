"""Finding input files, releases and links."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.sources.storage import folder_names, path_exists, subfolders

PARTIAL_SUFFIX = ".aria2"


def list_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, name, modified, length) of the files in folders; their content is not read."""
    found = spark.read.format("binaryFile").load(list(folders))
    return found.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("modificationTime").alias("modified"), "length",
    )


def complete_inputs(files: DataFrame) -> DataFrame:
    """Compressed files without the marker of an unfinished download beside them."""
    partial = files.select(F.col("path").alias("_partial"))
    return files.filter(F.col("name").endswith(".zst")).join(
        partial, F.concat("path", F.lit(PARTIAL_SUFFIX)) == F.col("_partial"), "left_anti"
    )


def discover_input(spark: SparkSession, folder: str, pattern: str) -> str:
    """Path of the one complete file whose name contains `pattern`, or of the folder that holds such a feed in parts.

    A folder with an unfinished part, or the marker of an unfinished download beside it, is not complete.
    """
    matching = complete_inputs(list_files(spark, folder)).filter(F.col("name").contains(pattern))
    paths = [r["path"] for r in matching.select("path").limit(2).collect()]
    for name in subfolders(spark, folder):
        if pattern in name and not path_exists(spark, f"{folder}/{name}{PARTIAL_SUFFIX}"):
            parts = folder_names(spark, f"{folder}/{name}")
            if any(p.endswith(".zst") for p in parts) and not any(p.endswith(PARTIAL_SUFFIX) for p in parts):
                paths.append(f"{folder}/{name}")
    if len(paths) != 1:
        raise FileNotFoundError(f"expected 1 {pattern} file, found {'none' if not paths else 'several'}")
    return paths[0]


def newest_input(spark: SparkSession, folder: str):
    """Modification time of the newest complete file, also inside a feed's folder, None when there is none."""
    inside = [f"{folder}/{name}" for name in subfolders(spark, folder)]
    return complete_inputs(list_files(spark, folder, *inside)).agg(F.max("modified")).first()[0]


def latest_release(manifest: DataFrame, sources: list[str]) -> DataFrame:
    """Per source text: the greatest current display name that contains it, with its size in GiB."""
    wanted = F.array(*[F.lit(s) for s in sources])
    current = manifest.filter(~F.col("obsolete")).select(
        "display_name", "data_size",
        F.explode(F.filter(wanted, lambda s: F.contains(F.col("display_name"), s))).alias("source"),
    )
    best = current.groupBy("source").agg(F.max(F.struct("display_name", "data_size")).alias("best"))
    return best.select(
        "source", F.col("best.display_name").alias("display_name"),
        F.round(F.col("best.data_size") / 1024**3, 1).alias("size_gib"),
    )


def extract_hosts(pages: DataFrame, pattern: str, text: str = "html", key: str = "page_id") -> DataFrame:
    """Distinct matches of `pattern` in each page, numbered in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    return pages.select(key, F.posexplode(found).alias("place", "match"))
