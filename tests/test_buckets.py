import pytest
from pyspark.sql import functions as F

from shelfspark.operators.buckets import (
    bucket_versions, expire_versions, invalidate_bucketed, key_bucket, merge_bucketed, read_bucketed, upsert_bucketed, write_bucketed,
)

SCHEMA = "id LONG, title STRING, author STRING, description STRING, updated_at TIMESTAMP"
NOW = "2024-05-01"


def rows(spark, values):
    return spark.createDataFrame([(i, t, "a", "d", None) for i, t in values], SCHEMA)


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in (root / "data").rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    write_bucketed(rows(spark, [(i, f"t{i}") for i in range(200)]), str(tmp_path), ["id"], 8)
    return tmp_path


def merged(spark, root, values, **more):
    return upsert_bucketed(rows(spark, values), str(root), SCHEMA, ["id"], ["title"], F.lit(NOW).cast("timestamp"), **more)


def held(spark, root, version=None):
    return {r["id"]: r["title"] for r in read_bucketed(spark, str(root), SCHEMA, version).collect()}


def test_one_row_leaves_all_other_files_as_they_are(spark, table):
    before = files(table)
    assert merged(spark, table, [(5, "new")]) == 1
    after = files(table)
    assert {k: after[k] for k in before} == before
    bucket = spark.range(5, 6).select(key_bucket(["id"], 8)).first()[0]
    added = set(after) - set(before)
    assert added and all(f"/version=1/bucket={bucket}/" in f for f in added)
    assert held(spark, table) == {i: "new" if i == 5 else f"t{i}" for i in range(200)}
    moved = read_bucketed(spark, str(table), SCHEMA).filter("updated_at IS NOT NULL").collect()
    assert [r["id"] for r in moved] == [5]


def test_nothing_changed_writes_nothing(spark, table):
    before = files(table)
    assert merged(spark, table, [(i, f"t{i}") for i in range(50)]) is None
    assert files(table) == before


def test_many_merges_equal_one_table(spark, table):
    wanted = {i: f"t{i}" for i in range(200)}
    for turn in range(4):
        change = {i: f"turn{turn}" for i in range(turn * 3, 260, 37 + turn)}
        wanted |= change
        merged(spark, table, list(change.items()))
    assert held(spark, table) == wanted
    assert held(spark, table, 0) == {i: f"t{i}" for i in range(200)}


def test_new_and_empty_tables(spark, tmp_path):
    assert held(spark, tmp_path) == {}
    assert merged(spark, tmp_path, [], buckets=4) is None
    assert merged(spark, tmp_path, [(1, "x"), (2, "y")], buckets=4) == 0
    assert held(spark, tmp_path) == {1: "x", 2: "y"}
    emptied = merge_bucketed(rows(spark, [(1, "x"), (2, "y")]), str(tmp_path), SCHEMA, ["id"], lambda t, s: t.filter("false"), lambda t, s: s)
    assert emptied == 1 and held(spark, tmp_path) == {}
    assert merged(spark, tmp_path, [(3, "z")], buckets=99) == 2
    assert set(bucket_versions(spark, str(tmp_path))) <= set(range(4))


def test_a_failed_merge_is_not_read(spark, table):
    def fail(target, source):
        return target.withColumn("title", F.raise_error(F.lit("stop")).cast("string"))

    with pytest.raises(Exception, match="stop"):
        merge_bucketed(rows(spark, [(1, "q")]), str(table), SCHEMA, ["id"], fail, lambda t, s: s)
    assert held(spark, table) == {i: f"t{i}" for i in range(200)}
    assert merged(spark, table, [(1, "after")]) == 1 and held(spark, table)[1] == "after"


def test_expired_versions_are_deleted_and_the_rest_stays(spark, table):
    for turn in range(3):
        merged(spark, table, [(turn, f"turn{turn}")])
    now, last = held(spark, table), held(spark, table, 2)
    assert expire_versions(spark, str(table), keep=2) >= 1
    assert held(spark, table) == now and held(spark, table, 2) == last
    named = bucket_versions(spark, str(table)) | {}
    folders = {tuple(int(x.split("=")[1]) for x in p.relative_to(table / "data").parts[::-1]) for p in (table / "data").glob("version=*/bucket=*")}
    assert set(named.items()) <= folders
    assert held(spark, table, 0) == {} and expire_versions(spark, str(table), keep=2) == 0


def test_only_buckets_with_stale_vectors_are_rewritten(spark, tmp_path):
    schema = "id LONG, embedding ARRAY<FLOAT>"
    write_bucketed(spark.range(100).select("id", F.array(F.lit(1.0).cast("float")).alias("embedding")), str(tmp_path), ["id"], 8)
    old, new = rows(spark, [(7, "a"), (8, "b")]), rows(spark, [(7, "changed"), (8, "b")])
    assert invalidate_bucketed(str(tmp_path), schema, old, new) == 1
    gone = read_bucketed(spark, str(tmp_path), schema).filter("embedding IS NULL").collect()
    assert [r["id"] for r in gone] == [7]
    assert sorted(bucket_versions(spark, str(tmp_path)).values()).count(1) == 1
    assert invalidate_bucketed(str(tmp_path), schema, old, new) is None
