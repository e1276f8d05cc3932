"""Key lookups, availability and candidate joins that never pair all rows with all requests."""

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions.text import present
from shelfspark.operators.filters import contains_ci

GRAM = 3


def first_ids(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Smallest id per wanted key; map tasks reduce a frequent key before the shuffle."""
    wanted = keys.select(key).distinct()
    return rows.select(key, "id").join(wanted, key, "left_semi").groupBy(key).agg(F.min("id").alias("id"))


def first_rows(rows: DataFrame, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One whole row per wanted key that exists, the one with the smallest id."""
    return rows.select(columns).join(first_ids(rows, keys, key).select("id"), "id", "left_semi")


def with_availability(df: DataFrame, items: DataFrame) -> DataFrame:
    """Flag rows whose non-empty isbn occurs among the items."""
    # Rows without isbn get a key of their own each, so they spread over all tasks and match nothing.
    key = F.when(present(F.col("isbn")), F.col("isbn")).otherwise(F.concat(F.lit("\0"), F.col("id")))
    held = items.filter(present(F.col("isbn"))).select(F.col("isbn").alias("_isbn")).distinct()
    return (
        df.withColumn("_isbn", key)
        .join(held.withColumn("available", F.lit(True)), "_isbn", "left")
        .withColumn("available", F.coalesce("available", F.lit(False)))
        .drop("_isbn")
    )


def contains_pairs(values: DataFrame, needles: DataFrame, key: str = "request_id") -> DataFrame:
    """(request_id, value) for every distinct value that holds the request's needle, case-blind.

    Values and needles meet on a piece of at most three characters: of the pieces of the needle's longest run without
    wildcards the one that fewest values have. A needle of wildcards only meets every value on the empty piece.
    """
    runs = F.split(F.lower(F.col("needle")), r"[%_\\]")
    longest = F.array_sort(
        runs, lambda a, b: (F.length(b) - F.length(a))
    )
    run = longest[0]
    size = F.least(F.length(run), F.lit(GRAM))
    starts = F.sequence(F.lit(1), F.greatest(F.length(run) - size + 1, F.lit(1)))
    offered = needles.select(
        key, "needle", F.explode(F.transform(starts, lambda at: F.substr(run, at, size))).alias("piece"))
    low = F.lower(F.col("value"))

    def grams(size: int):
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (size - 1), F.lit(1)))
        return F.transform(starts, lambda at: F.substr(low, at, F.lit(size)))

    every = F.array_distinct(F.concat(F.array(F.lit("")), *[grams(n) for n in range(1, GRAM + 1)]))
    distinct = values.filter(F.col("value").isNotNull()).distinct()
    cut = distinct.select("value", F.explode(every).alias("piece"))
    held = cut.groupBy("piece").agg(F.count("*").alias("held"))
    pieces = offered.join(held, "piece").groupBy(key, "needle").agg(
        F.min_by("piece", F.struct("held", "piece")).alias("piece"))
    return (
        cut.join(pieces, "piece")
        .filter(contains_ci(F.col("value"), F.col("needle")))
        .select(key, "value")
    )
