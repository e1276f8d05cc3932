"""Slices of ordered rows without gathering them in one task."""

from pyspark.sql import DataFrame, Window, functions as F

SPAN_BYTES = 64 * 1024 * 1024


def slice_in_order(
    df: DataFrame, files: list[str], pos: str, skip: int, limit: int | None, span: int = SPAN_BYTES
) -> DataFrame:
    """Rows skip+1 … skip+limit in the order of (files, pos), where (files, pos) is unique.

    Rows are counted per span of `pos`. Spans wholly inside the slice pass as they are; only the one
    or two spans cut by its ends are numbered row by row. The window over all spans sees one small
    row per span, never the data.
    """
    if skip <= 0 and limit is None:
        return df
    end = F.lit(None).cast("long") if limit is None else F.lit(skip + limit)
    spanned = df.withColumn("_span", F.floor(F.col(pos) / span))
    key = [*files, "_span"]
    before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        spanned.groupBy(*key).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter(F.col("_before") + F.col("_n") > skip)
        .filter(end.isNull() | (F.col("_before") < end))
    )
    kept = spanned.join(spans, key)
    inside = (F.col("_before") >= skip) & (end.isNull() | (F.col("_before") + F.col("_n") <= end))
    number = F.col("_before") + F.row_number().over(Window.partitionBy(*key).orderBy(pos))
    cut = (
        kept.filter(~inside).withColumn("_number", number)
        .filter(F.col("_number") > skip)
        .filter(end.isNull() | (F.col("_number") <= end))
    )
    return kept.filter(inside).select(df.columns).unionByName(cut.select(df.columns))


def window_lines(df: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Non-blank lines of (file, pos, value) after the first `skip`, at most `limit` of them."""
    filled = df.filter(F.col("value").rlike(r"[^\s\p{Z}\x{FEFF}]"))
    return slice_in_order(filled, ["file"], "pos", skip, limit)


def limit_accepted(parsed: DataFrame, limit: int | None) -> DataFrame:
    """First `limit` parsed records in file order."""
    return parsed if limit is None else slice_in_order(parsed, ["file"], "pos", 0, limit)
