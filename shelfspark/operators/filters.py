"""Row predicates and key filters used by the public queries."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import present


def contains_ci(c: Column, needle: Column) -> Column:
    """Case-blind containment; % and _ in the needle act as wildcards."""
    # A pattern from a column is compiled for every row, so plain needles take the cheaper test.
    plain = F.contains(F.lower(c), F.lower(needle))
    pattern = F.ilike(c, F.concat(F.lit("%"), needle, F.lit("%")))
    return F.when(needle.rlike(r"[%_\\]"), pattern).otherwise(plain)


def equals_folded(c: Column, wanted: Column) -> Column:
    """Equality with the lower-cased parameter; the column itself is compared as stored."""
    return c == F.lower(wanted)


def and_all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def when_given(param: Column, condition: Column) -> Column:
    """Apply `condition` only where the request parameter is present."""
    return F.when(present(param), F.coalesce(condition, F.lit(False))).otherwise(F.lit(True))


def any_given(params: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [present(p) for p in params], F.lit(False))


def check_requests(requests: DataFrame, required: list[str]) -> DataFrame:
    """Add `error`: text for a request that gives none of the required parameters, else NULL."""
    message = f"provide q and/or one of: {', '.join(c for c in required if c != 'q')}"
    return requests.withColumn(
        "error", F.when(~any_given([F.col(c) for c in required]), F.lit(message))
    )


def at_least(c: Column, minimum: float) -> Column:
    """`c >= minimum` for a positive minimum, otherwise no condition; NULL never passes a minimum."""
    return F.coalesce(c >= minimum, F.lit(False)) if minimum > 0 else F.lit(True)


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def any_distinct(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda x, y: x | y, [distinct_from(a, b) for a, b in pairs], F.lit(False))


def id_in(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def id_after(df: DataFrame, cursor: int, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) > cursor)


def is_collected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("downloaded_at").isNotNull())


def has_vector(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNotNull())


def missing_vector(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNull())


def exists_missing(df: DataFrame) -> bool:
    """Whether any row still lacks its vector; stops at the first one found."""
    return not missing_vector(df).limit(1).isEmpty()
