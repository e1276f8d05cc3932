import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.functions.stemmer import stem


def one(spark, expr, *values):
    cols = [F.lit(v) for v in values]
    return spark.range(1).select(expr(*cols)).first()[0]


def test_trim_blanks_takes_unicode_blanks(spark):
    assert one(spark, X.trim_blanks, " ﻿ a b  \n") == "a b"


def test_clean_strict_drops_control_and_astral(spark):
    assert one(spark, X.clean_strict, "a\x00\x07b\tc\nd\x7fe\x9ff�g\U0001f600h") == "ab\tc\ndefgh"


def test_clean_lenient_keeps_astral(spark):
    assert one(spark, X.clean_lenient, "a\x00b\x07�\U0001f600") == "ab\x07\U0001f600"


def test_compose_text(spark):
    got = one(spark, X.compose_text, "Salt Roads", "Ada Quill", "Ferries at dusk", "Travel, Memoir")
    assert got == "Salt Roads | Ada Quill | Ferries at dusk | Travel, Memoir"
    assert one(spark, X.compose_text, "Tides", "", None, "x") == "Tides | x"
    assert len(one(spark, X.compose_text, "A" * 10000, "", "", "")) == 10000
    long = spark.range(1).select(X.compose_text(*[F.lit(x) for x in ("A" * 10000, "", "", "")], max_chars=8000).alias("t"))
    assert len(long.first().t) == 8000


@pytest.mark.parametrize(
    "value,norm,ok",
    [("978-0-000-00017-1", "9780000000171", True), ("0 000 00017 5", "0000000175", True),
     ("026110334X", "026110334X", False), ("123456789", "123456789", False), ("dune", "dune", False)],
)
def test_isbn(spark, value, norm, ok):
    assert one(spark, X.normalize_isbn, value) == norm
    assert one(spark, X.is_isbn_query, value) is ok


@pytest.mark.parametrize(
    "value,f,i", [("4.00", 4.0, 4), ("0.00", None, 0), (" 3.5abc", 3.5, 3), ("abc", None, 0), ("", None, 0),
                  (".5", 0.5, 0), ("-2", -2.0, -2), ("1e2", 100.0, 1)],
)
def test_number_prefix(spark, value, f, i):
    assert one(spark, X.float_prefix, value) == f
    assert one(spark, lambda c: X.int_prefix(c, 0), value) == i


def test_titles(spark):
    assert one(spark, X.main_title, "The Ferry: Tides and Times") == "the ferry"
    assert one(spark, X.main_title, "Copper — its valleys") == "copper"
    assert one(spark, X.title_words, "Catch-22, Again : x") == ["catch", "22", "again"]
    assert one(spark, X.words, "  The  Ferry the ") == ["the", "ferry", "the"]


def test_filenames(spark):
    assert one(spark, X.served_filename, "A/B (x).", "C: D", "pdf", "m") == "AB (x). - C D.pdf"
    assert one(spark, X.served_filename, None, None, "", "m") == "m.bin"
    assert one(spark, X.suggested_filename, "A/B (x).", "", "epub", "m") == "AB x.epub"
    assert one(spark, X.suggested_filename, "书", "人", None, "m") == "m.bin"
    assert len(one(spark, X.suggested_filename, "t" * 300, "a", "pdf", "m")) == 204


def test_content_type(spark):
    assert one(spark, X.content_type, "epub") == "application/epub+zip"
    assert one(spark, X.content_type, "exe") == "application/octet-stream"


def test_decode_entities(spark):
    assert one(spark, X.decode_entities, "a &amp; b &lt;c&gt; &quot;d&quot; &#233;&#65;x") == 'a & b <c> "d" éAx'
    assert one(spark, X.decode_entities, "plain") == "plain"
    assert one(spark, X.decode_entities, "&#65601;") == "A"


# Golden values of the published stemmer description.
@pytest.mark.parametrize(
    "word,expected",
    [("yearly", "year"), ("consigned", "consign"), ("consistency", "consist"), ("consolatory", "consolatori"), ("knack", "knack"),
     ("knightly", "knight"), ("knitting", "knit"), ("knots", "knot"), ("hopping", "hop"), ("hoped", "hope"),
     ("generous", "generous"), ("communism", "communism"), ("skies", "sky"), ("dying", "die"),
     ("happily", "happili"), ("relational", "relat"), ("conditional", "condit"), ("national", "nation"),
     ("running", "run"), ("flies", "fli"), ("ties", "tie"), ("adventure", "adventur"), ("books", "book"),
     ("fantasy", "fantasi"), ("by", "by"), ("say", "say"), ("cry", "cri"), ("agreed", "agre"), ("gas", "gas"),
     ("this", "this"), ("gaps", "gap"), ("kiwis", "kiwi"), ("luxuriated", "luxuri"), ("controlling", "control"),
     ("rationalize", "ration"), ("hopefulness", "hope"), ("bookish", "bookish"), ("theologies", "theolog")],
)
def test_stem(word, expected):
    assert stem(word) == expected
