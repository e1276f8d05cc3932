"""Progress and size figures."""

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.sources.meta import meta_current


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, halves rounded up; 0 of nothing is 0."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def phase(done: Column, running: Column) -> Column:
    return F.when(done, "done").when(running, "importing").otherwise("pending")


def embedding_progress(rows: DataFrame, embedded: Column) -> DataFrame:
    """Rows, rows with a vector, their share and the highest id, in one pass."""
    counted = rows.agg(
        F.count("*").alias("total"), F.count_if(embedded).alias("embedded"),
        F.coalesce(F.max("id"), F.lit(0)).alias("max_id"),
    )
    return counted.select("*", percent(F.col("embedded"), F.col("total")).alias("percent"))


def stats(notes: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: counts and state of items, ratings and embeddings, and of the last run."""
    def note(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value"))).alias(key)

    keys = ["items_count", "items_done", "ratings_count", "ratings_done", "run_started", "run_finished", "run_error"]
    embedded = vectors.agg(F.count("embedding")).scalar()
    run = meta_current(notes).agg(*[note(k) for k in keys]).withColumn("embedded", embedded)

    def count(key: str) -> Column:
        return F.coalesce(F.col(key).try_cast("long"), F.lit(0))

    def flag(key: str) -> Column:
        return F.coalesce(F.col(key) == "true", F.lit(False))

    items_done, ratings_done = flag("items_done"), flag("ratings_done")
    total = count("ratings_count")
    vectors_done = (total > 0) & (F.col("embedded") >= total)
    started, finished = F.nullif("run_started", F.lit("")), F.nullif("run_finished", F.lit(""))
    running = started.isNotNull() & finished.isNull() & ~(items_done & ratings_done & vectors_done)
    return run.select(
        count("items_count").alias("items_count"), phase(items_done, running).alias("items_status"),
        total.alias("ratings_count"), phase(ratings_done, items_done & running).alias("ratings_status"),
        F.col("embedded").alias("embeddings_count"), total.alias("embeddings_total"),
        percent(F.col("embedded"), total).alias("embeddings_percent"),
        phase(vectors_done, ratings_done & running).alias("embeddings_status"),
        started.alias("started_at"), finished.alias("finished_at"),
        F.nullif("run_error", F.lit("")).alias("error"),
    )
