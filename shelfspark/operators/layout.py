"""Placement of rows for steps that are heavy per row."""

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by `keys` over all shuffle partitions.

    The stated number keeps adaptive execution from merging partitions that are small in bytes but
    multiply their rows, or work long on them, in the next step.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
