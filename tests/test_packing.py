"""Postings are stored as lists by term and read back as they were."""

import pytest

from shelfspark.operators import packing
from shelfspark.operators.fulltext import (
    build_index, compact_index, doc_freq, read_doc_freq, read_index, tokenize, update_index, write_index,
)

FIELDS, SCHEMA = [("title", "A"), ("body", "D")], "id LONG, title STRING, body STRING"
ROWS = [(i, f"oar tide w{i % 3}", "tide tide the boats " * (i % 4)) for i in range(24)]
ODD = [(3, "tide again", None), (None, "lost oar", "oar"), (None, None, ""), (50, "", " . ")]


def in_order(df):
    return sorted(df.collect(), key=repr)


@pytest.mark.parametrize("config", ["simple", "english"])
def test_stored_rows_are_terms_and_read_as_occurrences(spark, tmp_path, config):
    docs, path = spark.createDataFrame(ROWS + ODD, SCHEMA).coalesce(1), f"{tmp_path}/index"
    index = build_index(docs, FIELDS, config)
    write_index(index, path)
    stored = spark.read.parquet(f"{path}/postings/version=0")
    assert stored.count() == stored.select("term").distinct().count() < index.count()
    assert in_order(read_index(spark, path)) == in_order(index)
    assert in_order(read_doc_freq(spark, path)) == in_order(doc_freq(index))


def test_first_marks_follow_the_words(spark):
    docs = spark.createDataFrame(ROWS + ODD, SCHEMA)
    found = [(r.id, r.term, r.pos, r.weight) for r in build_index(docs, FIELDS, "simple").collect()]
    assert sorted(found, key=repr) == sorted(((r.id, r.surface, r.pos, r.weight) for r in tokenize(docs, FIELDS, "simple").collect()), key=repr)
    firsts = build_index(docs, FIELDS, "simple").filter("first and id <> 3").collect()
    words = {(r.id, r.surface): r.pos for r in tokenize(docs, FIELDS, "simple").orderBy("pos", ascending=False).collect()}
    assert sorted((r.id, r.term, r.pos) for r in firsts) == sorted((i, t, p) for (i, t), p in words.items() if i not in (None, 3))


def test_other_postings_are_packed_as_they_come(spark, tmp_path):
    docs, path = spark.createDataFrame(ROWS + ODD, SCHEMA), f"{tmp_path}/index"
    some = build_index(docs, FIELDS, "simple").filter("term <> 'tide' or pos > 2")
    write_index(some, path)
    assert in_order(read_index(spark, path)) == in_order(some)
    assert in_order(read_doc_freq(spark, path)) == in_order(doc_freq(some))
    update_index(path, spark.createDataFrame([(3, "calm", "calm")], SCHEMA), FIELDS, "simple")
    compact_index(spark, path)
    wanted = [r for r in some.collect() if r.id != 3] + build_index(spark.createDataFrame([(3, "calm", "calm")], SCHEMA), FIELDS, "simple").collect()
    assert in_order(read_index(spark, path)) == sorted(wanted, key=repr)


def test_long_lists_are_cut():
    import pyarrow as pa

    n = packing.LIST_PLACES * 2 + 5
    block = pa.RecordBatch.from_pydict({
        "term": ["a", None] + ["oar"] * n, "id": [1, None, *range(n)], "pos": pa.array([1] * (n + 2), pa.int32()), "weight": [0.1] * (n + 2),
        "first": [True, False] + [True] * n})
    made = packing._postings_block([block])
    assert made["docs"].to_pylist() == [1, 0, packing.LIST_PLACES, packing.LIST_PLACES, 5]
    assert made["term"].to_pylist() == ["a", None, "oar", "oar", "oar"]
    assert made["id"].flatten().to_pylist() == block["id"].to_pylist()
