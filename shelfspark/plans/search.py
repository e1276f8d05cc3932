"""Ranked and filtered search over items, ratings and the collection, for a table of requests.

A request table has `request_id` (bigint or string) and any of the parameter columns; a missing
column means that no request gives this parameter.
"""

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfspark.functions.text import present
from shelfspark.operators.embedding import embed
from shelfspark.operators.filters import (
    and_all, any_given, check_requests, contains_ci, equals_folded, is_collected, when_given,
)
from shelfspark.operators.fulltext import search_fts
from shelfspark.operators.lookups import contains_pairs
from shelfspark.operators.nearest import ranked_rows, search_vectors, topk_grouped
from shelfspark.operators.paging import dedupe_formats, fetch_ranked, format_order, page_as_asked
from shelfspark.schemas import COLLECTED_COLUMNS, ITEM_COLUMNS, RATING_COLUMNS
from shelfspark.sources.storage import stage

KEY = "request_id"
# Request parameter -> (row column, way of comparing). A search without q must give one of the
# parameters marked as sufficient; the first one given finds its candidate rows.
ITEM_PARAMS = {
    "author": ("author", "contains"), "publisher": ("publisher", "contains"),
    "year": ("year", "equals"), "language": ("language", "folded"), "ext": ("extension", "folded"),
}
ITEM_SUFFICIENT = ["author", "publisher", "year", "language"]
RATING_PARAMS = {
    "author": ("author", "contains"), "genre": ("genres", "contains"), "year": ("year", "equals"),
}
RATING_SUFFICIENT = ["author", "genre", "year"]


def _with_params(requests: DataFrame, params: list[str]) -> DataFrame:
    """Requests with every parameter column, NULL where the table has none."""
    return requests.select(KEY, *[
        F.col(p) if p in requests.columns else F.lit(None).cast("string").alias(p) for p in params
    ])


def once_per_combination(search: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Answer requests with the same parameters once, and give the trimmed answer to each of them.

    A combination stands under its smallest request id, so the search makes rows for each distinct combination only.
    """
    @wraps(search)
    def run(rows: DataFrame, postings: DataFrame | str, requests: DataFrame, *args, **kwargs) -> DataFrame:
        params = [c for c in requests.columns if c != KEY]
        asked = stage(requests.distinct().withColumn("_first", F.min(KEY).over(Window.partitionBy(*params))))
        found = search(rows, postings, asked.filter(F.col(KEY) == F.col("_first")).drop("_first"), *args, **kwargs)
        others = asked.select(KEY, "_first")
        return found.withColumnRenamed(KEY, "_first").join(others, "_first").select(found.columns)

    return run


def _matches(column: str, way: str, param: Column) -> Column:
    if way == "contains":
        return contains_ci(F.col(column), param)
    if way == "folded":
        return equals_folded(F.col(column), param)
    return F.col(column) == param


def _filtered(candidates: DataFrame, requests: DataFrame, params: dict, given: list[str], by: str = KEY) -> DataFrame:
    """Candidates (`by`, id, …row columns) that meet every parameter of their request; of all requests that share `by`."""
    if not given and by == KEY:
        return candidates
    wanted = requests.select(*dict.fromkeys([by, KEY]), *[F.col(p).alias(f"_p_{p}") for p in given])
    keep = and_all([
        when_given(F.col(f"_p_{p}"), _matches(*params[p], F.col(f"_p_{p}"))) for p in given
    ])
    return candidates.join(wanted, by).filter(keep).drop(*[f"_p_{p}" for p in given], *([by] if by != KEY else []))


def _texts(requests: DataFrame, params: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests with `_text`, the smallest id that asks for their q, and these texts, each once.

    A text keeps the parameters of its request where no other request asks for it, and has NULL in their place otherwise.
    """
    own = [F.when(F.count("*") == 1, F.first(p)).alias(p) for p in params]
    texts = stage(requests.groupBy("q").agg(F.min(KEY).alias(KEY), *own))
    return requests.join(texts.select("q", F.col(KEY).alias("_text")), "q"), texts


def _browse(rows: DataFrame, requests: DataFrame, params: dict, sufficient: list[str]) -> DataFrame | None:
    """Candidate rows of requests without a text, found through the first parameter each one gives."""
    found, unused = [], requests
    for p in sufficient:
        if p not in requests.columns:
            continue
        column, way = params[p]
        by_param = unused.filter(present(F.col(p))).select(KEY, F.col(p).alias("needle"))
        if way == "contains":
            values = rows.select(F.col(column).alias("value"))
            pairs = contains_pairs(values, by_param).withColumnRenamed("value", "_value")
        else:
            value = F.lower("needle") if way == "folded" else F.col("needle")
            pairs = by_param.select(KEY, value.alias("_value"))
        found.append(rows.join(pairs, F.col(column) == F.col("_value")).drop("_value"))
        unused = unused.filter(~present(F.col(p)))
    return reduce(DataFrame.unionByName, found) if found else None


def _candidates(
    rows: DataFrame, postings: DataFrame | str, requests: DataFrame, params: dict, sufficient: list[str],
    config: str, part_of_index: bool = False,
) -> DataFrame:
    """(request_id, id, rank, …row columns) that satisfy each request; rank is NULL without a text.

    A text that several requests ask for, with different filters, is searched and ranked once, and its matches are
    filtered for each of them. Otherwise filters apply before ranking, and so does the choice of rows where the index
    covers more than `rows` (`part_of_index`): only documents that can be shown are ranked.
    """
    given = [p for p in params if p in requests.columns]
    has_q = "q" in requests.columns
    parts = []
    if has_q:
        asked, texts = _texts(requests.filter(present(F.col("q"))), given)

        def allowed(pairs: DataFrame) -> DataFrame:
            return _filtered(pairs.join(rows, "id"), texts, params, given)

        first = part_of_index or given and not texts.filter(any_given([F.col(p) for p in given])).isEmpty()
        ranked = search_fts(postings, texts.select(KEY, "q"), config, allowed=allowed if first else None)
        parts.append(_filtered(ranked.withColumnRenamed(KEY, "_text").join(rows, "id"), asked, params, given, "_text"))
        requests = requests.filter(~present(F.col("q")))
    browsed = _browse(rows, requests, params, sufficient)
    if browsed is not None:
        met = _filtered(browsed, requests, params, given)
        parts.append(met.withColumn("rank", F.lit(None).cast("double")))
    if not parts:
        raise ValueError(f"requests need a column q or one of {sufficient}")
    return reduce(DataFrame.unionByName, parts)


def rejected_items(requests: DataFrame) -> DataFrame:
    """Requests of search_items that give neither a text nor a sufficient parameter, with the error."""
    checked = check_requests(_with_params(requests, ["q", *ITEM_SUFFICIENT]), ["q", *ITEM_SUFFICIENT])
    return checked.filter("error IS NOT NULL").select(KEY, "error")


def rejected_ratings(requests: DataFrame) -> DataFrame:
    checked = check_requests(_with_params(requests, ["q", *RATING_SUFFICIENT]), ["q", *RATING_SUFFICIENT])
    return checked.filter("error IS NOT NULL").select(KEY, "error")


@once_per_combination
def search_items(
    items: DataFrame, postings: DataFrame | str, requests: DataFrame, config: str = "english",
    limit: int = 20, offset: int = 0, dedupe: bool = True,
) -> DataFrame:
    """Items for each request, best text match first (PDF before EPUB before others on equal rank).

    Without a text the newest come first. `dedupe` keeps the first row per title and author. Columns limit, offset
    and dedupe of a request go before the arguments. Rows
    that cannot be on the page are cut from narrow columns; whole rows are fetched for the page only.
    """
    used = {c for p, (c, _) in ITEM_PARAMS.items() if p in requests.columns}
    used |= {"title", "author", "extension"} if dedupe or "dedupe" in requests.columns else {"extension"}
    narrow = items.select("id", *sorted(used))
    hits = _candidates(narrow, postings, requests, ITEM_PARAMS, ITEM_SUFFICIENT, config)
    by_text = F.col("rank").isNotNull()
    order = [
        F.desc("rank"),
        F.when(by_text, format_order(F.col("extension"))),
        F.when(by_text, F.col("id")).otherwise(-F.col("id")),
    ]
    if "dedupe" in requests.columns:
        choice = requests.select(KEY, F.coalesce(F.col("dedupe").cast("boolean"), F.lit(dedupe)).alias("_dedupe")).distinct()
        hits = dedupe_formats(hits.join(choice, KEY), [KEY], order, F.col("_dedupe"))
    elif dedupe:
        hits = dedupe_formats(hits, [KEY], order)
    shown = page_as_asked(hits, requests, KEY, order, limit, offset).select(KEY, "id", "rank", "rank_no")
    return fetch_ranked(items.select(ITEM_COLUMNS), shown)


def library_list(items: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Collected items, latest first."""
    collected = is_collected(items).select(COLLECTED_COLUMNS)
    return collected.orderBy(F.desc("downloaded_at"), "id").offset(offset).limit(limit)


def library_total(items: DataFrame) -> DataFrame:
    return is_collected(items).agg(F.count("*").alias("total"))


@once_per_combination
def library_search(
    items: DataFrame, postings: DataFrame | str, requests: DataFrame, config: str = "english",
    limit: int = 20, offset: int = 0,
) -> DataFrame:
    """Collected items for each request, by rank with a text and latest first without."""
    collected = is_collected(items)
    used = {c for p, (c, _) in ITEM_PARAMS.items() if p in requests.columns}
    narrow = collected.select("id", "downloaded_at", *sorted(used))
    hits = _candidates(narrow, postings, requests, ITEM_PARAMS, ITEM_SUFFICIENT, config, part_of_index=True)
    latest = F.when(F.col("rank").isNull(), F.col("downloaded_at"))
    order = [F.desc("rank"), F.desc(latest), F.col("id")]
    shown = page_as_asked(hits, requests, KEY, order, limit, offset).select(KEY, "id", "rank", "rank_no")
    return fetch_ranked(collected.select(COLLECTED_COLUMNS), shown)


@once_per_combination
def search_ratings_fts(
    ratings: DataFrame, postings: DataFrame | str, requests: DataFrame, config: str = "english",
    limit: int = 20, offset: int = 0,
) -> DataFrame:
    """Rating rows by text rank, or by rating (unrated last) for requests without a text."""
    used = {c for p, (c, _) in RATING_PARAMS.items() if p in requests.columns}
    narrow = ratings.select("id", "rating", *sorted(used))
    hits = _candidates(narrow, postings, requests, RATING_PARAMS, RATING_SUFFICIENT, config)
    best = F.when(F.col("rank").isNull(), F.col("rating"))
    order = [F.desc("rank"), F.desc_nulls_last(best), F.col("id")]
    shown = page_as_asked(hits, requests, KEY, order, limit, offset).select(KEY, "id", "rank", "rank_no")
    return fetch_ranked(ratings.select(RATING_COLUMNS), shown)


def _asked_vectors(requests: DataFrame, embedder) -> DataFrame:
    """(query_id, embedding) of the requests with a text, written once for the several steps that read them."""
    asked = requests.filter(present(F.col("q")))
    return stage(embed(asked, "q", embedder, KEY).withColumnRenamed(KEY, "query_id"))


def search_ratings_vector(
    ratings: DataFrame, vectors: DataFrame, requests: DataFrame, embedder,
    limit: int = 20, offset: int = 0, centroids: DataFrame | None = None, probes: int = 1,
) -> DataFrame:
    """Rating rows nearest to the text of each request.

    A request with filters is compared with the rows that meet them, one without with all rows.
    """
    given = [p for p in RATING_PARAMS if p in requests.columns]
    queries = _asked_vectors(requests, embedder)
    rows = ratings.select(RATING_COLUMNS)
    if not given:
        return search_vectors(rows, vectors, queries, limit, offset, centroids, probes).withColumnRenamed("query_id", KEY)
    filtered = requests.filter(present(F.col("q")) & any_given([F.col(p) for p in given]))
    plain = queries.join(filtered.select(F.col(KEY).alias("query_id")), "query_id", "left_anti")
    nearest = search_vectors(rows, vectors, plain, limit, offset, centroids, probes)
    narrow = ratings.select("id", *sorted({RATING_PARAMS[p][0] for p in given}))
    # The rows that meet a combination of filters are found once, and make the group that its requests are compared with.
    combinations = stage(filtered.select(given).distinct().withColumn(KEY, F.monotonically_increasing_id()))
    met = _filtered(_browse(narrow, combinations, RATING_PARAMS, RATING_SUFFICIENT), combinations, RATING_PARAMS, given)
    met = stage(met.select(F.col(KEY).alias("_group"), "id"))
    own = combinations.select(F.col(KEY).alias("_group"), *[F.col(p).alias(f"_p_{p}") for p in given])
    grouped = filtered.join(own, and_all([F.col(p).eqNullSafe(F.col(f"_p_{p}")) for p in given]))
    asked = queries.join(grouped.select(F.col(KEY).alias("query_id"), "_group"), "query_id")
    found = topk_grouped(
        vectors.select("id", "embedding").join(met, "id"), asked, limit + offset, "_group",
        sizes=met.groupBy("_group").agg(F.count("*").alias("size")))
    shown = ranked_rows(rows, found, offset)
    return nearest.unionByName(shown).withColumnRenamed("query_id", KEY)


def search_ratings(
    ratings: DataFrame, postings: DataFrame | str, vectors: DataFrame, requests: DataFrame, embedder,
    config: str = "english", limit: int = 20, offset: int = 0,
    centroids: DataFrame | None = None, probes: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Both kinds of search in one call: (results with `search_type`, errors).

    `search_type` of a request is 'fts', 'vector' or empty. Empty means vector when the request is a
    text alone, with text search in its place if that finds nothing. A forced vector search without a
    text, or one that finds nothing, is an error.
    """
    full = _with_params(requests, ["q", *RATING_SUFFICIENT, "search_type"])
    filters = any_given([F.col(p) for p in RATING_SUFFICIENT])
    forced = F.coalesce(F.col("search_type") == "vector", F.lit(False))
    by_vector = present(F.col("q")) & (forced | (~present(F.col("search_type")) & ~filters))
    nearest = stage(search_ratings_vector(
        ratings, vectors, full.filter(by_vector), embedder, limit, offset, centroids, probes
    ))
    served = nearest.select(KEY).distinct()
    rest = full.join(served, KEY, "left_anti")
    text_requests = rest.filter(~forced).select(requests.columns)
    ranked = search_ratings_fts(ratings, postings, text_requests, config, limit, offset)
    results = nearest.withColumn("search_type", F.lit("vector")).unionByName(
        ranked.withColumn("search_type", F.lit("fts")), allowMissingColumns=True
    )
    said = F.when(present(F.col("q")), "vector search found nothing").otherwise("a vector search needs q")
    unavailable = rest.filter(forced).select(KEY, said.alias("error"))
    rejected = rejected_ratings(requests).join(unavailable.select(KEY), KEY, "left_anti")
    return results, rejected.unionByName(unavailable)
