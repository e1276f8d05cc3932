"""Inverted lists kept on disk: vectors by list, list figures by version, and searches that read the lists they need.

`path` holds `centroids` (list_id, embedding), `vectors/version=…/list_id=…` (id, embedding, marks),
`replaced/version=…` (id) and `lists/version=…` (list_id, embedding, size, radius, most). The radius is the widest angle
between a list's centre and its vectors, `most` the largest of each mark. An update adds a version of vectors, notes the
ids it replaces, and writes new figures last; a reader takes the newest figures and the vectors of no later version.

Centres come from two levels of k-means: coarse cells over a bounded sample, then a small k-means inside each cell's part
of it. Every vector is put in the list of its nearest centre.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfspark.functions.vectors import norm
from shelfspark.operators.nearest import list_count, topk_exact, topk_listed
from shelfspark.operators.paging import top_rows
from shelfspark.sources.storage import snapshot_versions, stage

#: Vectors looked at for each list when centres are fitted.
SAMPLE_PER_LIST = 64
FIRST_PROBES = 8
#: Beyond so many further visits of queries to lists, the queries left are sent past all vectors.
ROUTED_VISITS = 1 << 22
NO_LIST = -1
#: Angles are compared with this much room for rounding.
SLACK = 1e-4


def _small_kmeans(points: np.ndarray, count: int, iterations: int) -> np.ndarray:
    """Centres of unit vectors by cosine, begun at rows spread evenly over the points; empty ones go."""
    centres = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)]
    for _ in range(iterations):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = (sums / np.where(length > 0, length, 1))[length[:, 0] > 0]
    return centres


def fit_centroids(vectors: DataFrame, lists: int | None = None, iterations: int = 8, seed: int = 42) -> DataFrame:
    """(list_id, cell, embedding) of unit centres, fitted on SAMPLE_PER_LIST vectors a list, spread by hash of the id."""
    nonzero = vectors.filter(F.col("embedding").isNotNull()).select("id", "embedding", norm(F.col("embedding")).alias("_norm")).filter("_norm > 0")
    total = nonzero.count()
    lists = lists or list_count(total)
    share = min(1.0, SAMPLE_PER_LIST * lists / max(total, 1))
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    unit = F.transform("embedding", lambda x: (x / F.col("_norm")).cast("float"))
    sample = stage(nonzero.filter(place < int(share * (1 << 30)) if share < 1 else F.lit(True)).select("id", unit.alias("embedding")))
    if not total:
        return vectors.sparkSession.createDataFrame([], "list_id INT, cell INT, embedding ARRAY<FLOAT>")
    cells = max(1, round(lists**0.5))
    kmeans = KMeans(k=cells, distanceMeasure="cosine", maxIter=iterations, seed=seed, featuresCol="_features", predictionCol="cell")
    featured = sample.withColumn("_features", array_to_vector("embedding"))
    # A cell may hold a large part of the sample; its centres are fitted on so many of its rows at most.
    room = 4 * SAMPLE_PER_LIST * -(-lists // cells)
    per_cell = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    celled = stage(kmeans.fit(featured).transform(featured).select("cell", "id", "embedding"))
    sizes = celled.groupBy("cell").agg(F.count("*").alias("_n"))
    wanted = F.greatest(F.lit(1), F.round(F.col("_n") * lists / sample.count()).cast("int")).alias("_lists")
    bounded = celled.withColumn("_at", F.row_number().over(per_cell)).filter(F.col("_at") <= room).join(sizes.select("cell", wanted), "cell")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        centres = _small_kmeans(np.stack(rows["embedding"].to_numpy()).astype(np.float64), int(rows["_lists"].iloc[0]), iterations)
        return pd.DataFrame({"cell": rows["cell"].iloc[0], "embedding": [c.astype(np.float32).tolist() for c in centres]})

    fitted = stage(bounded.select("cell", "id", "embedding", "_lists").groupBy("cell").applyInPandas(fit, "cell INT, embedding ARRAY<FLOAT>"))
    number = F.row_number().over(Window.orderBy("cell", "embedding")) - 1
    return fitted.select(number.cast("int").alias("list_id"), "cell", "embedding")


def assign_lists(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """`vectors` with list_id and angle to the centre; a zero vector has the list NO_LIST and the angle 0.

    A vector goes to the list of the nearest of all centres.
    """
    vectors = vectors.filter(F.col("embedding").isNotNull())
    queries = vectors.select(F.col("id").alias("query_id"), "embedding").filter(norm(F.col("embedding")) > 0)
    nearest = topk_exact(centroids.select(F.col("list_id").cast("long").alias("id"), "embedding"), queries, 1)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance"))))
    found = nearest.select(F.col("query_id").alias("id"), F.col("id").cast("int").alias("list_id"), angle.alias("angle"))
    return vectors.join(found, "id", "left").withColumn("list_id", F.coalesce("list_id", F.lit(NO_LIST))).withColumn(
        "angle", F.coalesce("angle", F.lit(0.0)))


def _with_marks(vectors: DataFrame, marks: list[str]) -> DataFrame:
    return vectors.select("id", "embedding", F.array(*[F.col(c).cast("double") for c in marks]).cast("array<double>").alias("marks"))


def _figures(listed: DataFrame, marks: int) -> DataFrame:
    most = [F.max(F.col("marks")[i]) for i in range(marks)]
    return listed.groupBy("list_id").agg(
        F.count("*").alias("size"), F.max("angle").alias("radius"), F.array(*most).cast("array<double>").alias("most"))


def _write_version(listed: DataFrame, path: str, version: int) -> None:
    rows = listed.select("id", "embedding", "marks", "list_id")
    # Ranges over (list, id): a large list is cut over several tasks, small ones share a task.
    rows.repartitionByRange("list_id", "id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/vectors/version={version}")


def write_lists(vectors: DataFrame, path: str, marks: list[str] | None = None, lists: int | None = None) -> None:
    """Build lists over all `vectors` (id, embedding and the numeric columns `marks`) as a new base version."""
    spark, marks = vectors.sparkSession, marks or []
    version = max(snapshot_versions(spark, f"{path}/lists"), default=-1) + 1
    centroids = stage(fit_centroids(vectors, lists))
    listed = stage(assign_lists(_with_marks(vectors, marks), centroids))
    _write_version(listed, path, version)
    figures = _figures(listed, len(marks)).join(centroids, "list_id", "left").withColumn("base", F.lit(version))
    empty = centroids.join(listed.select("list_id").distinct(), "list_id", "left_anti").select(
        "list_id", F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("radius"), F.lit(None).cast("array<double>").alias("most"),
        "cell", "embedding", F.lit(version).alias("base"))
    figures.unionByName(empty).write.mode("overwrite").parquet(f"{path}/lists/version={version}")


def update_lists(changed: DataFrame, path: str, marks: list[str] | None = None) -> None:
    """Put new or `changed` vectors into the stored lists without touching stored files.

    A null embedding removes the id. Lists keep their centres; sizes only grow until `write_lists` builds anew.
    """
    spark, marks = changed.sparkSession, marks or []
    old = read_figures(spark, path)
    version = max(snapshot_versions(spark, f"{path}/lists")) + 1
    listed = stage(assign_lists(_with_marks(changed, marks), old.filter("embedding IS NOT NULL")))
    changed.select("id").distinct().write.mode("overwrite").parquet(f"{path}/replaced/version={version}")
    _write_version(listed, path, version)
    new = _figures(listed, len(marks)).select(
        "list_id", F.col("size").alias("more"), F.col("radius").alias("wider"), F.col("most").alias("higher"))
    both = old.join(new, "list_id", "full")
    merged = both.select(
        "list_id", (F.coalesce("size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("size"),
        F.greatest("radius", "wider").alias("radius"),
        F.when(F.col("most").isNull(), F.col("higher")).when(F.col("higher").isNull(), F.col("most")).otherwise(
            F.zip_with("most", "higher", lambda a, b: F.greatest(a, b))).alias("most"),
        "cell", "embedding", F.coalesce("base", F.lit(old.agg(F.max("base")).first()[0])).alias("base"))
    merged.write.mode("overwrite").parquet(f"{path}/lists/version={version}")


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    """Newest figures of the lists: (list_id, embedding, size, radius, most, cell, base)."""
    versions = snapshot_versions(spark, f"{path}/lists")
    if not versions:
        raise FileNotFoundError(f"no complete lists under {path}")
    return spark.read.parquet(f"{path}/lists/version={versions[-1]}")


def read_lists(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(list_id, id, embedding, marks) as the updates left them; of the lists in `wanted` (list_id) only, where given.

    `wanted` prunes the folders of the lists when it is known (dynamic partition pruning).
    """
    versions = snapshot_versions(spark, f"{path}/lists")
    base = read_figures(spark, path).agg(F.max("base")).first()[0] or 0
    used = [v for v in versions if v >= base]
    parts = []
    for version in used:
        folder = f"{path}/vectors/version={version}"
        rows = spark.read.schema("id LONG, embedding ARRAY<FLOAT>, marks ARRAY<DOUBLE>, list_id INT").parquet(folder)
        if wanted is not None:
            rows = rows.join(F.broadcast(wanted), "list_id", "left_semi")
        later = [f"{path}/replaced/version={v}" for v in used if v > version]
        if later:
            rows = rows.join(spark.read.schema("id LONG").parquet(*later).distinct(), "id", "left_anti")
        parts.append(rows.select("list_id", "id", "embedding", "marks"))
    return reduce(DataFrame.unionByName, parts)


def _bound(distances: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Least angle that a vector of a list can have to a query."""
    return np.maximum(np.arccos(np.clip(1.0 - distances, -1.0, 1.0)) - marks[None, :, 0], 0.0)


def _ranked_lists(figures: DataFrame, queries: DataFrame, floors: int, depth: int, score=None) -> DataFrame:
    """(query_id, list_id, bound, rank_no): lists that may hold vectors for a query, by `score` or nearest centre first."""
    most = [F.col("most")[i] for i in range(floors)]
    centres = figures.filter("size > 0 AND embedding IS NOT NULL").select(
        F.col("list_id").cast("long").alias("id"), "embedding", F.array("radius", *most).alias("marks"))
    asked = queries.withColumn("floors", F.concat(F.array(F.lit(None).cast("double")), F.col("floors")))
    return topk_exact(centres, asked, depth, score=score).select(
        "query_id", F.col("id").cast("int").alias("list_id"), F.col("distance").alias("bound"), "rank_no")


def search_lists(
    spark: SparkSession, path: str, queries: DataFrame, k: int, floors: list[str] | None = None, probes: int | None = None,
) -> DataFrame:
    """k nearest stored vectors of each query (query_id, embedding, columns `floors`): (query_id, id, distance, rank_no).

    A vector counts where its marks reach the query's floors; a null floor asks nothing. With `probes` that many lists
    are visited, whose recall is to be measured. Without, the answer is exact: after the first lists a query visits those
    that may still hold a vector nearer than its k-th, or, where all these visits are many, it is sent past all vectors in
    blocks. A query without a direction finds nothing.
    """
    floors = floors or []
    array = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in floors]).cast("array<double>")
    asked = stage(queries.select("query_id", "embedding", array.alias("floors")).filter(
        F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0)))
    figures = read_figures(spark, path)
    sizes = figures.select("list_id", "size")
    total = figures.filter("size > 0 AND embedding IS NOT NULL").count()
    depth, found, swept = min(probes or FIRST_PROBES, total), None, None
    if total:
        ranked = stage(_ranked_lists(figures, asked, len(floors), depth + (probes is None), None if probes else _bound))
        visits = ranked.filter(F.col("rank_no") <= depth).select("query_id", "list_id")
        found = _merged(None, _visited(spark, path, asked, visits, sizes, k), k)
    if probes is not None:
        return found
    if total > depth:
        # The bound of the first list not visited; a query without one is finished.
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance"))))
        reached = found.filter(F.col("rank_no") == k).select("query_id", angle.alias("reach"))
        near = F.col("reach").isNull() | (F.col("bound") <= F.col("reach") + SLACK)
        ahead = ranked.filter(F.col("rank_no") == depth + 1).select("query_id", "bound")
        still = stage(ahead.join(reached, "query_id", "left").filter(near).select("query_id", "reach"))
        waiting = asked.join(still, "query_id", "left_semi")
        left = still.count()
        if left * total > ROUTED_VISITS:
            marked = read_lists(spark, path)
            swept = stage(topk_exact(marked if floors else marked.drop("marks"), waiting, k))
            asked, found = asked.join(still, "query_id", "left_anti"), found.join(still, "query_id", "left_anti")
        elif left:
            ranked = _ranked_lists(figures, waiting, len(floors), total, _bound).filter(F.col("rank_no") > depth)
            visits = ranked.join(still, "query_id").filter(near).select("query_id", "list_id")
            found = _merged(found, _visited(spark, path, waiting, stage(visits), sizes, k), k)
    # Vectors without a direction are in no list's cone; they come last, where fewer than k others qualify.
    short = asked.join(found.filter(F.col("rank_no") == k), "query_id", "left_anti") if found is not None else asked
    visits = short.select("query_id", F.lit(NO_LIST).alias("list_id")).filter("list_id < 0")
    found = _merged(found, _visited(spark, path, asked, visits, sizes, k), k)
    return found if swept is None else found.unionByName(swept)


def _visited(spark, path: str, asked: DataFrame, visits: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    vectors = read_lists(spark, path, visits.select("list_id").distinct())
    return topk_listed(vectors, asked, visits, sizes, k)


def _merged(found: DataFrame | None, more: DataFrame, k: int) -> DataFrame:
    more = more.select("query_id", "id", "distance")
    both = more if found is None else found.select("query_id", "id", "distance").unionByName(more)
    order = [F.isnan("distance"), F.col("distance"), F.col("id")]
    return stage(top_rows(both, ["query_id"], order, k))
