"""Vector column expressions."""

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of the angle; NaN when either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot(a, b) / length)


def similarity(distance: Column) -> Column:
    """Similarity to three digits, halves rounded up; NULL where a vector has no direction."""
    return F.when(~F.isnan(distance), F.floor((F.lit(1.0) - distance) * 1000 + 0.5) / 1000)


def parse_vector(text: Column) -> Column:
    """'[0.1,0.2]' to an array of floats."""
    return F.from_json(text, "array<float>")


def format_vector(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))
