import json

import pytest

from shelfspark.operators.parse import parse_items, parse_ratings, quarantine

RECORD = {
    "aacid": "x", "metadata": {
        "zlibrary_id": 4711, "extension": "djvu", "filesize_reported": 90210, "md5_reported": "0123456789abcdef0123456789abcdef",
        "title": " Lantern Law ", "author": "Q\x00uill", "publisher": "Lane", "language": "welsh", "series": "Lights", "edition": "2",
        "year": "1968", "pages": "77", "description": "e\U0001f600f", "isbns": [],
    },
}


def lines(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value STRING")


def test_full_item(spark):
    row = parse_items(lines(spark, RECORD)).first()
    assert (row.source, row.source_id, row.title, row.author) == ("zlib3", "4711", "Lantern Law", "Quill")
    assert (row.filesize, row.isbn, row.description, row.year) == (90210, "", "ef", "1968")


def test_item_isbn_and_fallbacks(spark):
    got = parse_items(lines(
        spark,
        {"metadata": {"title": "a", "zlibrary_id": 1, "isbns": ["978", "979"]}},
        {"metadata": {"title": "b", "z_library_id": 2, "isbn": "111", "md5": "m", "filesize": "12"}},
        {"title": "c", "zlibrary_id": "3", "year": 1999},
        {"metadata": {"zlibrary_id": 4}},
        {"metadata": {"title": "  ", "zlibrary_id": 5}},
    )).orderBy("source_id").collect()
    assert [(r.source_id, r.title, r.isbn, r.md5, r.filesize, r.year) for r in got] == [
        ("1", "a", "978", "", 0, ""), ("2", "b", "111", "m", 12, ""), ("3", "c", "", "", 0, "1999"),
    ]


@pytest.mark.parametrize("bad", ["not json", "", '{"a":', "[1,"])
def test_bad_json(spark, bad):
    frame = lines(spark, bad, {"title": "ok"})
    with pytest.raises(Exception, match="invalid JSON line"):
        parse_items(frame).collect()
    assert [r.title for r in parse_items(frame, "quarantine").collect()] == ["ok"]
    assert [r.value for r in quarantine(frame).collect()] == [bad]


@pytest.mark.parametrize("bad", [
    '4355 words', '{"title": "x"} y', '{"title": "x"}{"title": "y"}', '"a"],[2', '1,2', '{"a": 1, "a": 2} x', "{'a': 1}"])
def test_a_value_with_a_rest_is_no_json(spark, bad):
    frame = lines(spark, bad, {"title": "ok"})
    assert [r.title for r in parse_items(frame, "quarantine").collect()] == ["ok"]
    assert [r.value for r in quarantine(frame).collect()] == [bad]


def xml(body, wrap=True):
    book = f"<book>{body}</book>"
    return f'<?xml version="1.0"?><GoodreadsResponse>{book}</GoodreadsResponse>' if wrap else book


def rating(body, wrap=True, id_=7):
    return {"metadata": {"id": id_, "record": xml(body, wrap)}}


FULL = (
    "<id>7</id><title>T (S #1)</title><title_without_series><![CDATA[T & U]]></title_without_series>"
    "<isbn>0111</isbn><isbn13>9780000000111</isbn13><publication_year>2001</publication_year>"
    "<description><![CDATA[<b>d</b>]]></description><average_rating>4.00</average_rating>"
    "<num_pages>12</num_pages><ratings_count>2</ratings_count>"
    "<authors><author><id>1</id><name> A One </name></author><author><name>B</name></author></authors>"
)


@pytest.mark.parametrize("wrap", [True, False])
def test_full_rating(spark, wrap):
    row = parse_ratings(lines(spark, rating(FULL, wrap))).first()
    assert (row.source_id, row.title, row.author, row.rating) == ("7", "T & U", "A One", 4.0)
    assert (row.ratings_count, row.isbn, row.pages, row.year) == (2, "9780000000111", "12", "2001")
    assert row.description == "<b>d</b>"


def test_rating_fallbacks(spark):
    got = parse_ratings(lines(
        spark,
        rating("<title>T</title><title_without_series></title_without_series><isbn>0111</isbn>"
               "<average_rating>0.00</average_rating>", id_=1),
        rating("<title>One</title><authors><author><name>Solo</name></author></authors>", id_=2),
        {"metadata": {"id": 3}}, {"metadata": {"id": 4, "record": ""}}, {"x": 1},
    )).orderBy("source_id").collect()
    assert [(r.source_id, r.title, r.isbn, r.rating, r.author, r.ratings_count) for r in got] == [
        ("1", "T", "0111", None, "", 0), ("2", "One", "", None, "Solo", 0),
    ]


def test_rating_bad_json(spark):
    with pytest.raises(Exception, match="invalid JSON line"):
        parse_ratings(lines(spark, "nope")).collect()


@pytest.mark.parametrize("odd", ["[1, 2]", "5", "null", '"text"', '{"a": 1, "a": 2}', '{"metadata": "x"}', '{"metadata": {"title": ["a"]}}'])
def test_valid_json_of_another_shape_is_no_error(spark, odd):
    frame = lines(spark, odd, {"title": "ok"})
    assert "ok" in [r.title for r in parse_items(frame).collect()]
    assert parse_ratings(frame).collect() == [] and quarantine(frame).collect() == []
