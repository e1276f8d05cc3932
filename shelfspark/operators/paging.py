"""Top rows per request, format de-duplication and paging."""

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 64
# Above this depth Spark no longer trims a ranked window before its shuffle.
TRIMMED_DEPTH = 1000


def format_order(extension: Column) -> Column:
    return F.when(extension == "pdf", 0).when(extension == "epub", 1).otherwise(2)


def top_rows(df: DataFrame, groups: list[str], order: list[Column], depth: int, rank: str = "rank_no") -> DataFrame:
    """First `depth` rows of every group with their place in `rank`.

    A shallow depth is trimmed inside each map task before the shuffle. A deep one first ranks
    salted parts of the group, so that no task sorts a whole group.
    """
    if depth > TRIMMED_DEPTH:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        parts = Window.partitionBy(*groups, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", part)
            .withColumn(rank, F.row_number().over(parts))
            .filter(F.col(rank) <= depth)
            .drop("_salt", rank)
        )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col(rank) <= depth)


def first_per_group(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    return top_rows(df, groups, order, 1, "_first").drop("_first")


def page(
    df: DataFrame, groups: list[str], order: list[Column], limit: int, offset: int = 0, rank: str = "rank_no",
) -> DataFrame:
    """Rows offset+1 … offset+limit of every group."""
    top = top_rows(df, groups, order, offset + limit, rank)
    return top.filter(F.col(rank) > offset).withColumn(rank, (F.col(rank) - offset).cast("int"))


def page_as_asked(
    df: DataFrame, requests: DataFrame, key: str, order: list[Column], limit: int, offset: int = 0, rank: str = "rank_no",
) -> DataFrame:
    """The page of every request, by its own `limit` and `offset` where the request table has such columns.

    Rows are trimmed to the deepest page that any request asks for before requests are told apart.
    """
    if not {"limit", "offset"} & set(requests.columns):
        return page(df, [key], order, limit, offset, rank)

    def asked(name: str, default: int) -> Column:
        own = F.col(name).cast("int") if name in requests.columns else F.lit(None).cast("int")
        return F.greatest(F.coalesce(own, F.lit(default)), F.lit(0))

    pages = requests.select(key, asked("limit", limit).alias("_limit"), asked("offset", offset).alias("_offset")).distinct()
    depth = pages.agg(F.max(F.col("_limit") + F.col("_offset"))).first()[0] or 0
    place = F.col(rank) - F.col("_offset")
    top = top_rows(df, [key], order, depth, rank).join(pages, key)
    return top.filter((place >= 1) & (place <= F.col("_limit"))).withColumn(rank, place.cast("int")).drop("_limit", "_offset")


def dedupe_formats(df: DataFrame, groups: list[str], order: list[Column], wanted: Column | None = None) -> DataFrame:
    """Keep the first row in `order` of every (title, author), compared in lower case; rows not `wanted` all stay."""
    keyed = df.withColumn("_title", F.lower(F.coalesce("title", F.lit("")))).withColumn(
        "_author", F.lower(F.coalesce("author", F.lit("")))
    )
    if wanted is not None:
        own = F.concat(F.lit("\0"), F.col("id").cast("string"))
        keyed = keyed.withColumn("_title", F.when(wanted, F.col("_title")).otherwise(own))
    return first_per_group(keyed, [*groups, "_title", "_author"], order).drop("_title", "_author")


def fetch_ranked(rows: DataFrame, ranked: DataFrame, key: str = "id") -> DataFrame:
    """Full rows of the ranked ids; the ranking columns come along."""
    return ranked.join(rows, key)
