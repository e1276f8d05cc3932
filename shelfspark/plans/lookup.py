"""Lookups by checksum and isbn."""

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions.text import suggested_filename
from shelfspark.operators.lookups import first_rows
from shelfspark.schemas import LOOKUP_COLUMNS, RATING_COLUMNS


def lookup_md5(keys: DataFrame, items: DataFrame) -> DataFrame:
    """One item row per checksum; `found` is false and the row NULL for an unknown one."""
    rows = first_rows(items, keys, "md5", LOOKUP_COLUMNS)
    joined = keys.select("md5").distinct().join(rows, "md5", "left")
    return joined.select(*LOOKUP_COLUMNS, F.col("id").isNotNull().alias("found"))


def lookup_isbn(keys: DataFrame, items: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per isbn the first item and the first rating row as structs, each NULL if there is none."""
    def packed(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        return first_rows(rows, keys, "isbn", columns).select("isbn", F.struct(*columns).alias(name))

    return (
        keys.select("isbn").distinct()
        .join(packed(items, LOOKUP_COLUMNS, "item"), "isbn", "left")
        .join(packed(ratings, RATING_COLUMNS, "rating"), "isbn", "left")
    )


def suggest_filename(keys: DataFrame, items: DataFrame) -> DataFrame:
    """Download name per checksum; an unknown one gives '<md5>.bin'."""
    rows = lookup_md5(keys, items)
    name = suggested_filename(F.col("title"), F.col("author"), F.col("extension"), F.col("md5"))
    return rows.select("md5", name.alias("suggested_filename"))
