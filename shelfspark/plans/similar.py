"""Works similar to a named one."""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions.text import is_isbn_query, normalize_isbn, present, title_words, words
from shelfspark.functions.vectors import similarity
from shelfspark.operators.embedding import embed, rating_text
from shelfspark.operators.filters import at_least
from shelfspark.operators.fulltext import search_fts
from shelfspark.operators.lists import search_lists, write_lists
from shelfspark.operators.lookups import first_ids, with_availability
from shelfspark.operators.nearest import topk_exact, topk_ivf
from shelfspark.operators.paging import fetch_ranked, top_rows
from shelfspark.schemas import ITEM_COLUMNS, RATING_COLUMNS
from shelfspark.sources.storage import stage

KEY = "request_id"
MIN_COVERAGE = 0.6
RATING_MARKS = ["rating", "ratings_count"]


def title_covered(query, title):
    """Every query word is a whole word of the main title, and they make up 60 % of its words."""
    asked, have = words(query), title_words(title)
    all_in = F.forall(asked, lambda w: F.array_contains(have, w))
    return all_in & (F.size(asked) >= F.size(have) * F.lit(MIN_COVERAGE)) & (F.size(asked) > 0)


def resolve_source(requests: DataFrame, ratings: DataFrame, postings: DataFrame | str, config: str = "english") -> DataFrame:
    """(request_id, id) of the rating row each request names, by isbn or else by title.

    The title test is applied to all matches before they are ranked, so no crowd of better ranked rows hides a title.
    """
    asked = requests.filter(present(F.col("q")))
    by_number = asked.filter(is_isbn_query(F.col("q"))).select(KEY, normalize_isbn(F.col("q")).alias("isbn"))
    by_isbn = by_number.join(first_ids(ratings, by_number, "isbn"), "isbn").select(KEY, "id")
    rest = asked.join(by_isbn.select(KEY), KEY, "left_anti").select(KEY, "q")

    def named(pairs: DataFrame) -> DataFrame:
        titled = pairs.join(ratings.select("id", "title"), "id").join(rest, KEY)
        return titled.filter(title_covered(F.col("q"), F.col("title"))).select(pairs.columns)

    by_title = search_fts(postings, rest, config, 1, allowed=named).select(KEY, "id")
    return by_isbn.unionByName(by_title)


def _minimums(queries: DataFrame, min_rating: float, min_reviews: int) -> DataFrame:
    """Queries with `_rating` and `_reviews`, their own minimums or the given ones; null where nothing is asked."""
    def own(name: str, default: float):
        given = F.col(name).cast("double") if name in queries.columns else F.lit(None).cast("double")
        value = F.coalesce(given, F.lit(float(default)))
        return F.when(value > 0, value)

    return queries.withColumn("_rating", own("min_rating", min_rating)).withColumn("_reviews", own("min_reviews", min_reviews))


def store_lists(vectors: DataFrame, ratings: DataFrame, path: str, lists: int | None = None) -> None:
    """Inverted lists of all rating vectors at `path`, with rating and number of reviews beside each vector."""
    known = ratings.select("id", *RATING_MARKS)
    write_lists(vectors.select("id", "embedding").join(known, "id"), path, RATING_MARKS, lists)


def neighbours(
    queries: DataFrame, vectors: DataFrame | None, ratings: DataFrame, items: DataFrame,
    limit: int = 10, min_rating: float = 0, min_reviews: int = 0,
    centroids: DataFrame | None = None, probes: int | None = None, lists: str | None = None,
) -> DataFrame:
    """Rating rows nearest to (query_id, source_id, embedding), the source itself left out.

    Minimums choose the vectors that are searched, so `limit` rows are found wherever as many qualify. Columns min_rating
    and min_reviews of a query go before the arguments. With `lists`, a path that `store_lists` filled, only lists that
    can hold a neighbour are read: the answer is exact, or that of `probes` lists.
    """
    depth = limit + 1
    asked = _minimums(queries, min_rating, min_reviews)
    floors = ["_rating", "_reviews"]
    if lists is not None:
        found = search_lists(queries.sparkSession, lists, asked, depth, floors, probes)
    elif centroids is not None:
        plain = at_least(F.col("rating"), min_rating) & at_least(F.col("ratings_count"), min_reviews)
        wanted = ratings.filter(plain).select("id")
        found = topk_ivf(vectors.join(wanted, "id", "left_semi"), centroids, queries, depth, probes or 1)
    else:
        marks = ratings.select("id", F.array(*[F.col(c).cast("double") for c in RATING_MARKS]).alias("marks"))
        asked = asked.withColumn("floors", F.array(*floors))
        found = topk_exact(vectors.select("id", "embedding").join(marks, "id"), asked, depth)
    others = found.join(queries.select("query_id", "source_id"), "query_id").filter("id <> source_id")
    kept = fetch_ranked(ratings.select(RATING_COLUMNS), others.withColumnRenamed("rank_no", "_place"))
    shown = top_rows(kept, ["query_id"], [F.col("_place")], limit).drop("_place", "source_id")
    return with_availability(shown, items).withColumn("similarity", similarity(F.col("distance")))


class Similar(NamedTuple):
    sources: DataFrame
    results: DataFrame
    downloads: DataFrame


def similar(
    requests: DataFrame, ratings: DataFrame, rating_postings: DataFrame | str, items: DataFrame,
    item_postings: DataFrame | str, vectors: DataFrame | None, embedder, config: str = "english",
    limit: int = 10, min_rating: float = 0, min_reviews: int = 0,
    centroids: DataFrame | None = None, probes: int | None = None, lists: str | None = None,
) -> Similar:
    """Sources found, their neighbours, and for requests without a source the best matching item.

    Columns min_rating and min_reviews of a request go before the arguments. The resolved ids and their vectors are written once; several branches read them.
    """
    resolved = stage(resolve_source(requests, ratings, rating_postings, config))
    named = ratings.select(RATING_COLUMNS).join(resolved, "id")
    ids = resolved.select("id").distinct()
    texts = rating_text(ratings.join(ids, "id", "left_semi"))
    embedded = embed(texts, "text", embedder).join(resolved, "id")
    own = [c for c in ("min_rating", "min_reviews") if c in requests.columns]
    if own:
        embedded = embedded.join(requests.select(KEY, *own), KEY)
    queries = stage(embedded.select(F.col(KEY).alias("query_id"), F.col("id").alias("source_id"), "embedding", *own))
    results = neighbours(
        queries, vectors, ratings, items, limit, min_rating, min_reviews, centroids, probes, lists
    ).withColumnRenamed("query_id", KEY)
    missing = requests.filter(present(F.col("q"))).join(resolved, KEY, "left_anti")
    best = search_fts(item_postings, missing, config, 1).select(KEY, "id", "rank")
    return Similar(named, results, fetch_ranked(items.select(ITEM_COLUMNS), best))
