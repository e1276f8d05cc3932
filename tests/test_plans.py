from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.operators.embedding import HashingEmbedder, embed, rating_text
from shelfspark.operators.fulltext import build_index
from shelfspark.operators.lookups import with_availability
from shelfspark.operators.pages import flatten_outline, nest_outline, split_pages
from shelfspark.plans.lookup import lookup_isbn, lookup_md5, suggest_filename
from shelfspark.plans.reader import (
    embed_eligibility, embed_pages, image_eligibility, index_eligibility, page_search, page_text, reader_status,
)
from shelfspark.plans.similar import neighbours, resolve_source, similar, title_covered
from shelfspark.plans.stats import embedding_progress, stats
from shelfspark.schemas import DOC_PAGES, OUTLINE, RATING_FIELDS, RUN_META


def test_split_pages(spark):
    df = spark.createDataFrame([("a", "one\ftwo\f"), ("b", "x"), ("c", ""), ("d", "\fy")], "doc_id STRING, text STRING")
    got = [tuple(r) for r in split_pages(df).orderBy("doc_id", "page_number").collect()]
    assert got == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "x"), ("d", 1, ""), ("d", 2, "y")]


XML = """<pdf2xml><item page="9">before</item><outline>
<item page="1"> Part &amp; One </item><outline><item page="2">1.1</item><item page="3">1.2 &#233;</item>
<outline><item page="4">1.2.1</item></outline></outline>
<item page="5">Part Two</item><outline><item page="6">2.1</item></outline></outline></pdf2xml>"""


def test_flatten_outline(spark):
    df = spark.createDataFrame([("a", XML), ("b", "no outline")], "doc_id STRING, xml STRING")
    flat = flatten_outline(df)
    assert [tuple(r)[1:] for r in flat.orderBy("seq").collect()] == [
        (1, 1, None, "Part & One", 1), (2, 2, 1, "1.1", 2), (3, 2, 1, "1.2 é", 3), (4, 3, 3, "1.2.1", 4),
        (5, 1, None, "Part Two", 5), (6, 2, 5, "2.1", 6)]
    assert nest_outline(flat).count() == 1


def test_lookup_md5(spark, items):
    keys = spark.createDataFrame([("sum-ferries-1",), ("nope",), ("sum-ferries-1",)], "md5 STRING")
    got = {r.md5: (r.found, r.title) for r in lookup_md5(keys, items).collect()}
    assert got == {"sum-ferries-1": (True, "Salt Road Ferries"), "nope": (False, None)}
    names = {r.md5: r.suggested_filename for r in suggest_filename(keys, items).collect()}
    assert names == {"sum-ferries-1": "Salt Road Ferries - Ada Quill.epub", "nope": "nope.bin"}


def test_lookup_isbn(spark, items, ratings):
    keys = spark.createDataFrame([("9780000000171",), ("9780000000232",), ("000",)], "isbn STRING")
    got = {r.isbn: (r.item and r.item.id, r.rating and r.rating.id) for r in lookup_isbn(keys, items, ratings).collect()}
    assert got == {"9780000000171": (1, 1), "9780000000232": (2, None), "000": (None, None)}


def test_availability(spark, items, ratings):
    got = {r.id: r.available for r in with_availability(ratings, items).collect()}
    assert got == {1: True, 2: False}


@pytest.mark.parametrize(
    "q,title,ok",
    [("ferries", "Salt Ferries", False), ("salt ferries", "Salt Ferries: Tides and Timetables", True),
     ("copper", "Copper — its valleys", True), ("ferry", "Salt Ferries", False),
     ("a b c", "a b c d e", True), ("a b c", "a b c d e f", False), ("catch 22", "Catch-22", True), ("", "x", False)],
)
def test_title_covered(spark, q, title, ok):
    assert spark.range(1).select(title_covered(F.lit(q), F.lit(title))).first()[0] is ok


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [(i, f"s{i}", t, a, r, n, d, "", isbn, "", "") for i, t, a, r, n, d, isbn in [
        (1, "Sea Tales", "Ann", 4.5, 100, "ships and whales", "1111111111"),
        (2, "Whale Ships", "Bob", 4.0, 50, "ships and whales at sea", "2222222222"),
        (3, "Sea Tales: Revisited and Extended", "Cid", 3.0, 5, "ships whales sea", ""),
        (4, "Desert", "Dan", None, 500, "sand", "4444444444"),
        (5, "Many More Great Sea Tales", "Eve", 2.0, 70, "sea tales whales", "5555555555")]]
    return spark.createDataFrame(
        rows, """id LONG, source_id STRING, title STRING, author STRING, rating FLOAT, ratings_count INT,
        description STRING, genres STRING, isbn STRING, pages STRING, year STRING""")


def test_similar(spark, shelf, items, item_postings):
    from shelfspark.operators.fulltext import build_index
    from shelfspark.sources.storage import stage

    embedder = HashingEmbedder(64)
    postings = stage(build_index(shelf, RATING_FIELDS, "english"))
    vectors = stage(embed(rating_text(shelf), "text", embedder))
    requests = spark.createDataFrame(
        [(1, "sea tales"), (2, "222-222 2222"), (3, "copper"), (4, "no such thing"), (5, "")], "request_id LONG, q STRING")
    named = {r.request_id: r.id for r in resolve_source(requests, shelf, postings).collect()}
    assert named == {1: 3, 2: 2}
    got = similar(requests, shelf, postings, items, item_postings, vectors, embedder, limit=2)
    assert {r.request_id: r.title for r in got.sources.collect()} == {1: "Sea Tales: Revisited and Extended", 2: "Whale Ships"}
    found = got.results.collect()
    assert len(found) == 4 and all(r.id != named[r.request_id] for r in found)
    assert all(0 <= r.similarity <= 1 and r.similarity == round(r.similarity, 3) for r in found)
    assert {r.request_id: r.title for r in got.downloads.collect()} == {3: "Copper Valley"}


def test_a_title_is_found_behind_a_crowd_of_better_ranked_rows(spark):
    rows = [(i, f"c{i}", f"dust dust companion volume {i}", "A") for i in range(1, 31)] + [(99, "own", "dust", "B")]
    ratings = spark.createDataFrame(
        [(i, s, t, a, 4.0, 9, "", "", "", "", "") for i, s, t, a in rows],
        """id LONG, source_id STRING, title STRING, author STRING, rating FLOAT, ratings_count INT, description STRING,
        genres STRING, isbn STRING, pages STRING, year STRING""")
    requests = spark.createDataFrame([(1, "dust")], "request_id LONG, q STRING")
    assert [r.id for r in resolve_source(requests, ratings, build_index(ratings, RATING_FIELDS, "english")).collect()] == [99]


def test_neighbours_are_as_many_as_qualify(spark, shelf, items):
    vectors = embed(rating_text(shelf), "text", HashingEmbedder(64))
    queries = vectors.filter("id = 1").selectExpr("1L AS query_id", "id AS source_id", "embedding")
    got = neighbours(queries, vectors, shelf, items, limit=5, min_rating=2.5, min_reviews=10).collect()
    assert [r.id for r in got] == [2]
    crowd = spark.range(100, 160).selectExpr(
        "id", "concat('s', id) AS source_id", "'Sea Tales' AS title", "'Ann' AS author", "cast(1.0 AS float) AS rating",
        "1 AS ratings_count", "'ships and whales' AS description", "'' AS genres", "'' AS isbn", "'' AS pages", "'' AS year")
    more = shelf.unionByName(crowd)
    vectors = embed(rating_text(more), "text", HashingEmbedder(64))
    queries = vectors.filter("id = 1").selectExpr("1L AS query_id", "id AS source_id", "embedding")
    got = neighbours(queries, vectors, more, items, limit=1, min_rating=2.5, min_reviews=10).collect()
    assert [r.id for r in got] == [2]
    assert len(neighbours(queries, vectors, more, items, limit=60).collect()) == 60


@pytest.fixture(scope="module")
def book_pages(spark):
    return spark.createDataFrame(
        [("sum-ferries-1", 1, "ships at sea", None, None), ("sum-ferries-1", 2, "desert sand", None, None),
         ("sum-ferries-2", 1, "whales", [1.0, 0.0], None)], DOC_PAGES)


def test_reader(spark, items, book_pages):
    keys = spark.createDataFrame([("sum-ferries-1",), ("sum-copper",), ("sum-ferries-2",), ("nope",)], "doc_id STRING")
    outline = spark.createDataFrame([("sum-ferries-1", 1, 1, None, "One", 1)], OUTLINE)
    got = {r.doc_id: r for r in reader_status(keys, items, book_pages, outline).collect()}
    assert set(got) == {"sum-ferries-1", "sum-copper", "sum-ferries-2"}
    row = got["sum-ferries-1"]
    assert (row.downloaded, row.indexed, row.pages_extracted, row.pages_embedded, row.ready_for_search) == (True, True, 2, 0, False)
    assert '"One"' in row.outline and got["sum-copper"].outline == "[]"
    assert not got["sum-copper"].indexed and got["sum-ferries-2"].ready_for_search

    why = {r.doc_id: r.reason for r in index_eligibility(keys, items.withColumn("extension", F.lit("pdf")), book_pages).collect()}
    assert why == {"sum-ferries-1": "already indexed", "sum-copper": "not downloaded", "sum-ferries-2": "not downloaded", "nope": "not found"}
    forced = {r.doc_id: r.reason for r in index_eligibility(keys, items, book_pages, force=True).collect()}
    assert forced["sum-ferries-1"] == "not a pdf"
    assert {r.doc_id: r.reason for r in image_eligibility(keys, items).collect()}["sum-ferries-1"] == "not a pdf"
    state = {r.doc_id: r.state for r in embed_eligibility(keys, book_pages).collect()}
    assert state == {"sum-ferries-1": "to do", "sum-copper": "not indexed", "sum-ferries-2": "complete", "nope": "not indexed"}


def test_page_text(spark, book_pages):
    keys = spark.createDataFrame([("sum-ferries-1", 1), ("sum-ferries-1", 999), ("sum-ferries-1", 0)], "doc_id STRING, page_number INT")
    got = {r.page_number: (r.content, r.error) for r in page_text(keys, book_pages).collect()}
    assert got == {1: ("ships at sea", None), 999: (None, "page not found"), 0: (None, "invalid page number")}


def test_page_search(spark, book_pages):
    embedder = HashingEmbedder(64)
    filled = embed_pages(book_pages.filter("doc_id = 'sum-ferries-1'"), embedder)
    assert filled.filter("embedding IS NULL").count() == 0
    requests = spark.createDataFrame([(1, "sum-ferries-1", "sea ships"), (2, "other", "sea")], "request_id LONG, doc_id STRING, q STRING")
    got = page_search(requests, filled, embedder, 1).collect()
    assert [(r.request_id, r.page_number, r.content) for r in got] == [(1, 1, "ships at sea")]


def test_stats(spark):
    def note(**kv):
        return spark.createDataFrame([(k, v, datetime(2024, 1, 1)) for k, v in kv.items()], RUN_META)

    vectors = spark.createDataFrame([(1, None), (2, [1.0])], "id LONG, embedding ARRAY<FLOAT>")
    row = stats(note(items_count="3", items_done="true", ratings_count="2", ratings_done="true"), vectors.filter("id = 1")).first()
    assert (row.items_count, row.items_status, row.ratings_count, row.ratings_status) == (3, "done", 2, "done")
    assert (row.embeddings_count, row.embeddings_total, row.embeddings_percent, row.embeddings_status) == (0, 2, 0.0, "pending")
    row = stats(note(items_count="3", run_started="x", run_finished="", ratings_count="3"), vectors).first()
    assert (row.items_status, row.ratings_status, row.embeddings_percent, row.started_at) == ("importing", "pending", 33.3, "x")
    row = stats(note(), vectors).first()
    assert (row.items_count, row.items_status, row.embeddings_percent) == (0, "pending", 0.0)


def test_embedding_progress(spark):
    row = embedding_progress(spark.range(1, 9).withColumn("e", F.col("id") <= 3), F.col("e")).first()
    assert tuple(row) == (8, 3, 8, 37.5)
