import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators.embedding import HashingEmbedder, embed, rating_text
from shelfspark.operators.lookups import contains_pairs
from shelfspark.operators.paging import first_per_group, page
from shelfspark.plans.search import (
    library_list, library_search, library_total, rejected_items, search_items, search_ratings,
    search_ratings_fts,
)


def ask(spark, **params):
    row = {"request_id": 1, **params}
    schema = "request_id LONG, " + ", ".join(f"{k} STRING" for k in params)
    return spark.createDataFrame([tuple(row.values())], schema)


def ids(df):
    return [r.id for r in df.orderBy("request_id", "rank_no").collect()]


@pytest.mark.parametrize(
    "params,dedupe,expected",
    [
        (dict(q="ferries"), True, [3]),
        (dict(q="ferries"), False, [3, 1]),
        (dict(q="mining"), True, [2]),
        (dict(q="copper", ext="pdf"), True, [2]),
        (dict(q="copper", ext="PDF"), True, [2]),
        (dict(q="copper", ext="epub"), True, []),
        (dict(publisher="Harbour"), False, [3, 1]),
        (dict(publisher="harbour & l%e"), False, [3, 1]),
        (dict(author="om_ve"), False, [2]),
        (dict(author="%"), False, [3, 2, 1]),
        (dict(language="EN"), False, [3, 2, 1]),
        (dict(language="en", year="1988"), True, [3]),
        (dict(year="1974"), True, [2]),
        (dict(q="nothing here"), True, []),
        (dict(q="9780000000232"), True, [2]),
    ],
)
def test_search_items(spark, items, item_postings, params, dedupe, expected):
    assert ids(search_items(items, item_postings, ask(spark, **params), dedupe=dedupe)) == expected


def test_many_requests_and_paging(spark, items, item_postings):
    requests = spark.createDataFrame(
        [(1, "ferries", None, None), (2, None, "quill", None), (3, None, None, "1974"), (4, None, None, None), (5, "", "", "")],
        "request_id LONG, q STRING, author STRING, year STRING")
    got = search_items(items, item_postings, requests, dedupe=False)
    assert [(r.request_id, r.id) for r in got.orderBy("request_id", "rank_no").collect()] == [
        (1, 3), (1, 1), (2, 3), (2, 1), (3, 2)]
    second = search_items(items, item_postings, requests, dedupe=False, limit=1, offset=1)
    assert [(r.request_id, r.id, r.rank_no) for r in second.orderBy("request_id").collect()] == [(1, 1, 1), (2, 1, 1)]
    assert sorted(r.request_id for r in rejected_items(requests).collect()) == [4, 5]


def test_library(spark, items, item_postings):
    assert [r.id for r in library_list(items).collect()] == [1]
    assert library_list(items, offset=1).count() == 0
    assert library_total(items).first().total == 1
    assert ids(library_search(items, item_postings, ask(spark, q="ferries"))) == [1]
    assert ids(library_search(items, item_postings, ask(spark, q="copper"))) == []
    assert ids(library_search(items, item_postings, ask(spark, author="quill"))) == [1]


@pytest.mark.parametrize(
    "params,expected",
    [(dict(genre="Memoir"), [1]), (dict(q="adventure", author="Quill"), [1]), (dict(year="2011"), [2]),
     (dict(author="l"), [1, 2]), (dict(q="ledger"), [2])],
)
def test_search_ratings_fts(spark, ratings, rating_postings, params, expected):
    assert ids(search_ratings_fts(ratings, rating_postings, ask(spark, **params))) == expected


def test_search_ratings_routes(spark, ratings, rating_postings):
    embedder = HashingEmbedder(32)
    vectors = embed(rating_text(ratings), "text", embedder)
    requests = spark.createDataFrame(
        [(1, "ferries quill", None, None), (2, "adventure", "Quill", None), (3, "ferries", "nobody", "vector"),
         (4, "ledger", None, "fts"), (5, None, None, "vector"), (6, None, "holt", None), (7, "ferries", "Holt", "vector"),
         (8, None, "Quill", "vector")],
        "request_id LONG, q STRING, author STRING, search_type STRING")
    results, errors = search_ratings(ratings, rating_postings, vectors, requests, embedder)
    got = {}
    for r in results.orderBy("request_id", "rank_no").collect():
        got.setdefault((r.request_id, r.search_type), []).append(r.id)
    assert got == {(1, "vector"): [1, 2], (2, "fts"): [1], (4, "fts"): [2], (6, "fts"): [2], (7, "vector"): [2]}
    said = {r.request_id: r.error for r in errors.collect()}
    assert set(said) == {3, 5, 8} and "found nothing" in said[3] and "needs q" in said[5] and "needs q" in said[8]

    none = vectors.filter("id < 0")
    results, errors = search_ratings(ratings, rating_postings, none, requests, embedder)
    kinds = {r.request_id: r.search_type for r in results.collect()}
    assert kinds == {1: "fts", 2: "fts", 4: "fts", 6: "fts"}
    assert sorted(r.request_id for r in errors.collect()) == [3, 5, 7, 8]


def test_contains_pairs_equals_ilike(spark):
    values = spark.createDataFrame([("Allen & Unwin",), ("ab",), ("",), ("Chilton",), (None,), ("a%b",)], "value STRING")
    needles = spark.createDataFrame(
        list(enumerate(["allen", "A", "%", "", "n%n", "_b", "x", "hil", "a\\%b", "zz%chi"])), "request_id INT, needle STRING")
    got = {(r.request_id, r.value) for r in contains_pairs(values, needles).collect()}
    every = needles.crossJoin(values).filter(F.ilike("value", F.concat(F.lit("%"), "needle", F.lit("%"))))
    assert got == {(r.request_id, r.value) for r in every.collect()} and len(got) > 10


def test_deep_page_equals_sort(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % 5003).alias("v"), "id")
    got = page(df, ["g"], [F.col("v")], 10, 3000).orderBy("rank_no").collect()
    everything = sorted((i * 7919) % 5003 for i in range(5000))
    assert [r.v for r in got] == everything[3000:3010] and [r.rank_no for r in got] == list(range(1, 11))


def test_first_per_group_is_trimmed_before_its_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = first_per_group(df, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
