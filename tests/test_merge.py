from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.operators.merge import (
    assign_ids, change_report, dedupe_last, insert_absent, invalidate_vectors, mark_collected, set_outline,
    split_blank_keys, unmark_collected, upsert, upsert_pages,
)

OLD, NEW = datetime(2020, 1, 1), datetime(2024, 1, 1)
TARGET = "id LONG, source_id STRING, title STRING, year STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP, updated_at TIMESTAMP"
VALUES = ["title", "year"]


@pytest.fixture(scope="module")
def merged(spark):
    target = spark.createDataFrame(
        [(1, "a", "A", "1", [1.0], OLD, OLD), (2, "b", "B", None, [2.0], OLD, OLD),
         (3, "c", "C", "3", [3.0], OLD, OLD), (4, "d", "D", "4", [4.0], OLD, OLD)], TARGET)
    source = spark.createDataFrame(
        [("a", "A", "1"), ("b", "B", "2"), ("c", "CC", "3"), ("e", "E", None)], "source_id STRING, title STRING, year STRING")
    out = upsert(target, source, ["source_id"], VALUES, F.lit(NEW), reset={"embedding": ["title"]})
    return target, source, {r.source_id: r for r in out.collect()}


def test_unchanged_row_keeps_its_time(merged):
    row = merged[2]["a"]
    assert (row.id, row.updated_at, row.embedding) == (1, OLD, [1.0])


def test_changed_row(merged):
    row = merged[2]["b"]
    assert (row.id, row.year, row.created_at, row.updated_at, row.embedding) == (2, "2", OLD, NEW, [2.0])
    row = merged[2]["c"]
    assert (row.title, row.updated_at, row.embedding) == ("CC", NEW, None)


def test_kept_and_new_rows(merged):
    assert merged[2]["d"].updated_at == OLD and merged[2]["d"].title == "D"
    row = merged[2]["e"]
    assert (row.id, row.title, row.year, row.created_at, row.updated_at) == (None, "E", None, NEW, NEW)


def test_change_report(merged):
    got = {r.change_type: r.n for r in change_report(merged[0], merged[1], ["source_id"], VALUES).collect()}
    assert got == {"inserted": 1, "updated": 2, "unchanged": 1, "kept": 1}


def test_insert_absent(spark):
    a = spark.createDataFrame([("x", 1)], "k STRING, v INT")
    b = spark.createDataFrame([("x", 9), ("y", 2)], "k STRING, v INT")
    assert sorted(map(tuple, insert_absent(a, b, ["k"]).collect())) == [("x", 1), ("y", 2)]


def test_dedupe_last_with_one_frequent_key(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = dedupe_last(df, ["k"], ["id"])
    assert got.count() == 667
    assert got.filter("k = 'hot'").first()["id"] == 999


def test_blank_keys(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "k STRING")
    good, blank = split_blank_keys(df, "k")
    assert (good.count(), blank.count()) == (1, 2)


def test_assign_ids_follow_the_order(spark):
    df = spark.range(1000).select((F.lit(2000) - F.col("id")).alias("k"))
    got = assign_ids(df, ["k"], start=50).collect()
    assert all(r.id == r.k - 1001 + 51 for r in got) and len(got) == 1000


def test_invalidate_vectors(spark):
    schema = "id LONG, title STRING, author STRING, description STRING, genres STRING"
    old = spark.createDataFrame([(1, "a", "b", "c", "g"), (2, "a", "b", None, "g"), (3, "a", "b", "c", "g")], schema)
    new = spark.createDataFrame([(1, "a", "b", "c", "h"), (2, "a", "b", "x", "g"), (3, "a", "b", "c", "g")], schema)
    vectors = spark.createDataFrame([(i, [1.0], "m") for i in (1, 2, 3)], "id LONG, embedding ARRAY<FLOAT>, model STRING")
    got = {r.id: r.embedding for r in invalidate_vectors(vectors, old, new).collect()}
    assert got == {1: [1.0], 2: None, 3: [1.0]}
    got = {r.id: r.embedding for r in invalidate_vectors(vectors, old, new, include_genres=True).collect()}
    assert got == {1: None, 2: None, 3: [1.0]}


def test_collect_marks(spark, items):
    keys = spark.createDataFrame([("sum-copper",), ("sum-copper",), ("unknown",)], "md5 STRING")
    marked = mark_collected(items, keys, F.lit(NEW))
    assert marked.count() == items.count()
    assert sorted(r.id for r in marked.filter("downloaded_at IS NOT NULL").collect()) == [1, 2]
    gone = unmark_collected(marked, spark.createDataFrame([("sum-ferries-1",), ("sum-ferries-1",)], "md5 STRING"))
    assert gone.count() == items.count()
    assert [r.id for r in gone.filter("downloaded_at IS NOT NULL").collect()] == [2]
    assert gone.columns == items.columns


def test_upsert_pages_drops_outdated_vector(spark):
    schema = "doc_id STRING, page_number INT, content STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP"
    pages = spark.createDataFrame([("d", 1, "x", [1.0], OLD), ("d", 2, "y", [2.0], OLD)], schema)
    new = spark.createDataFrame([("d", 1, "x"), ("d", 2, "z"), ("d", 3, "w")], "doc_id STRING, page_number INT, content STRING")
    got = {r.page_number: (r.content, r.embedding) for r in upsert_pages(pages, new, F.lit(NEW)).collect()}
    assert got == {1: ("x", [1.0]), 2: ("z", None), 3: ("w", None)}


def test_set_outline(spark):
    schema = "doc_id STRING, seq INT"
    got = set_outline(spark.createDataFrame([("a", 1), ("b", 1)], schema), spark.createDataFrame([("b", 7)], schema))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 7)]


@pytest.mark.parametrize("step", [1, -1])
def test_a_mean_just_at_the_bound_does_not_depend_on_the_order_of_rows(spark, tmp_path, step):
    from checks.merge_checks import OLD_ROWS
    from checks.registry import view

    # Their mean is 45; added as doubles in one order it comes out as 45.00000000000001.
    values = [73.44, 18.54, 31.94, 57.02, 75.79, 41.09, 17.18][::step]
    rows = [(7, i, "view", v) for i, v in enumerate(values)] + [(8, 9, "view", 45.01)]
    events = spark.createDataFrame(rows, "user_id LONG, event_id LONG, event_type STRING, value DOUBLE")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.user_id for r in view(spark, str(tmp_path), OLD_ROWS).collect()] == [8]
