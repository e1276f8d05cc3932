"""Joins on keys of which one may hold a large part of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 1024


def by_key(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows` with their key's `facts`, one row per key with a count `n` of its rows out of `total`.

    Keys with more than a 1024th of all rows, of which there are fewer than 1024, are broadcast with their facts; the
    others are joined by a shuffle, where no key weighs much.
    """
    heavy = facts.filter(F.col("n") * HEAVY > total)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(light.join(facts.filter(F.col("n") * HEAVY <= total), keys))
