import math
import random
import re

import pytest

from shelfspark.functions.analysis import STOP_WORDS, WEIGHTS
from shelfspark.functions.stemmer import stem
from shelfspark.operators.fulltext import (
    build_index, compact_index, doc_freq, expire_index, plain_query, read_doc_freq, read_index, search_fts, search_index, tokenize,
    update_index, vocabulary, write_index,
)
from shelfspark.sources.storage import stage

FIELDS = [("title", "A"), ("body", "D")]


def brute_index(docs, config):
    """{id: [(term, pos, weight)]} by plain loops."""
    out = {}
    for id_, *texts in docs:
        base, found = 0, []
        for text, (_, label) in zip(texts, FIELDS):
            last = 0
            for i, word in enumerate(re.findall(r"[^\W_]+", (text or "").lower()), 1):
                if config == "english" and word in STOP_WORDS:
                    continue
                found.append((stem(word) if config == "english" else word, base + i, WEIGHTS[label]))
                last = i
            base += last
        out[id_] = found
    return out


def brute_rank(found, terms):
    hits = sorted((p, w, t) for t, p, w in found if t in terms)
    if {t for _, _, t in hits} != set(terms) or not terms:
        return None
    if len(terms) == 1:
        ws = [w for _, w, _ in hits]
        m = ws.index(max(ws)) + 1
        series = sum(w / (j * j) for j, w in enumerate(ws, 1))
        return (max(ws) + series - max(ws) / (m * m)) / 1.64493406685
    miss = 1.0
    for i, (p1, w1, t1) in enumerate(hits):
        for p2, w2, t2 in hits[:i]:
            if t1 != t2 and p1 - p2 <= 100:
                miss *= 1 - math.sqrt(w1 * w2 / (1.005 + 0.05 * math.exp((p1 - p2) / 1.5 - 2)))
    return 1 - miss


@pytest.mark.parametrize("config,broadcast", [("simple", "10m"), ("simple", "-1"), ("english", "10m")])
def test_rank_equals_brute_force(spark, monkeypatch, config, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rng = random.Random(3)
    pool = ["whale", "whales", "sea", "the", "of", "ship", "ships", "captain", "running", "ran"]
    docs = [
        (i, " ".join(rng.choices(pool, k=rng.randint(0, 4))), " ".join(rng.choices(pool, k=rng.randint(0, 150))))
        for i in range(60)
    ]
    requests = [(1, "whale"), (2, "The Whale"), (3, "sea ship captain"), (4, "of the"), (5, "zebra sea"), (6, "ship ship")]
    items = spark.createDataFrame(docs, "id LONG, title STRING, body STRING")
    queries = spark.createDataFrame(requests, "request_id LONG, q STRING")
    got = {(r.request_id, r.id): r["rank"] for r in search_fts(build_index(items, FIELDS, config), queries, config).collect()}

    index = brute_index(docs, config)
    expected = {}
    for rid, q in requests:
        words = [w for w in q.lower().split() if config == "simple" or w not in STOP_WORDS]
        terms = {stem(w) if config == "english" else w for w in words}
        for id_, found in index.items():
            rank = brute_rank(found, terms)
            if rank is not None:
                expected[rid, id_] = rank
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) <= 1e-6 for k in got)
    assert not any(r == 5 for r, _ in got)


def test_positions_continue_over_fields(spark):
    df = spark.createDataFrame([(1, "The Ferry of the", "Quill's oar")], "id LONG, title STRING, body STRING")
    simple = sorted((r.pos, r.surface, r.weight) for r in tokenize(df, FIELDS, "simple").collect())
    assert simple[3:] == [(4, "the", 1.0), (5, "quill", 0.1), (6, "s", 0.1), (7, "oar", 0.1)]
    english = sorted((r.pos, r.surface) for r in tokenize(df, FIELDS, "english").collect())
    assert english == [(2, "ferry"), (3, "quill"), (5, "oar")]


def test_vocabulary_and_doc_freq(spark):
    df = spark.createDataFrame([(1, "ship ships", ""), (2, "Ship", "")], "id LONG, title STRING, body STRING")
    assert {(r.surface, r.term, r.occurrences) for r in vocabulary(df, FIELDS, "english").collect()} == {
        ("ship", "ship", 2), ("ships", "ship", 1)}
    assert [tuple(r) for r in doc_freq(build_index(df, FIELDS, "english")).collect()] == [("ship", 2)]


def test_stop_word_query_has_no_terms(spark):
    queries = spark.createDataFrame([(1, "of the"), (2, "the sea")], "request_id LONG, q STRING")
    assert [tuple(r) for r in plain_query(queries, "english").collect()] == [(2, "sea", 1)]


def test_written_index_gives_the_same_answer(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i % 5} common", "x y") for i in range(50)], "id LONG, title STRING, body STRING")
    index = build_index(df, FIELDS, "simple")
    write_index(index, f"{tmp_path}/index")
    queries = spark.createDataFrame([(1, "common word3")], "request_id LONG, q STRING")
    a = search_fts(index, queries, "simple", 4).orderBy("rank_no").collect()
    assert a == search_index(f"{tmp_path}/index", queries, "simple", 4).orderBy("rank_no").collect()
    assert [r.id for r in a] == [3, 8, 13, 18]
    assert sorted(read_index(spark, f"{tmp_path}/index").collect()) == sorted(index.collect())


def test_updated_index_equals_a_new_one(spark, tmp_path):
    rows = {i: (i, f"word{i % 5} common", "x y") for i in range(20)}
    schema, path = "id LONG, title STRING, body STRING", f"{tmp_path}/index"
    write_index(build_index(spark.createDataFrame(list(rows.values()), schema), FIELDS, "simple"), path)
    for changes in ([(3, "other words", "x"), (30, "word3 common", "new")], [(3, "word3", "common again"), (8, "", "")]):
        rows.update({r[0]: r for r in changes})
        update_index(path, spark.createDataFrame(changes, schema), FIELDS, "simple")
        fresh = build_index(spark.createDataFrame(list(rows.values()), schema), FIELDS, "simple")
        assert sorted(read_index(spark, path).collect()) == sorted(fresh.collect())
        queries = spark.createDataFrame([(1, "common word3"), (2, "new")], "request_id LONG, q STRING")
        assert sorted(search_index(path, queries, "simple").collect()) == sorted(search_fts(fresh, queries, "simple").collect())
    write_index(build_index(spark.createDataFrame([(3, "a new base", ""), (40, "common", "")], schema), FIELDS, "simple"), path)
    assert {r.id for r in read_index(spark, path).collect()} == {3, 40}
    update_index(path, spark.createDataFrame([(40, "word3", "")], schema), FIELDS, "simple")
    assert {(r.id, r.term) for r in read_index(spark, path).collect()} == {(3, "a"), (3, "new"), (3, "base"), (40, "word3")}


def test_many_updates_then_compaction_equal_a_new_index(spark, tmp_path):
    rows = {i: (i, f"word{i % 5} common", "x y") for i in range(30)}
    schema, path = "id LONG, title STRING, body STRING", f"{tmp_path}/index"
    write_index(build_index(spark.createDataFrame(list(rows.values()), schema), FIELDS, "simple"), path)
    for turn in range(5):
        changes = [(i, f"turn{turn} common", "") for i in range(turn, 34, 7)]
        rows.update({r[0]: r for r in changes})
        update_index(path, spark.createDataFrame(changes, schema), FIELDS, "simple")
    plan = read_index(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Relation") == 2
    fresh = build_index(spark.createDataFrame(list(rows.values()), schema), FIELDS, "simple")
    assert sorted(read_index(spark, path).collect()) == sorted(fresh.collect())
    compact_index(spark, path)
    assert sorted(read_index(spark, path).collect()) == sorted(fresh.collect())
    assert sorted(read_doc_freq(spark, path).collect()) == sorted(doc_freq(fresh).collect())
    expire_index(spark, path)
    assert [p.name for p in (tmp_path / "index/postings").glob("version=*")] == ["version=6"]
    assert sorted(read_index(spark, path).collect()) == sorted(fresh.collect())


def test_terms_prune_the_buckets_of_a_stored_index(spark, tmp_path):
    schema, path = "id LONG, title STRING, body STRING", f"{tmp_path}/index"
    write_index(build_index(spark.createDataFrame([(i, f"word{i}", "") for i in range(40)], schema), FIELDS, "simple"), path)
    asked = stage(plain_query(spark.createDataFrame([(1, "word7")], "request_id LONG, q STRING"), "simple"))
    found = read_index(spark, path, asked.select("term").distinct())
    assert [r.id for r in found.collect()] == [7]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_unknown_config(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id LONG, title STRING, body STRING")
    with pytest.raises(ValueError, match="unknown text configuration"):
        build_index(df, FIELDS, "klingon")


def test_faint_ranks_keep_their_order(spark):
    gaps = [90, 70, 50, 46]
    docs = [(i, "", "oar " + "x " * (gap - 1) + "tide") for i, gap in enumerate(gaps)]
    index = build_index(spark.createDataFrame(docs, "id LONG, title STRING, body STRING"), FIELDS, "simple")
    found = search_fts(index, spark.createDataFrame([(1, "oar tide")], "request_id LONG, q STRING"), "simple", 10)
    rows = found.orderBy("rank_no").collect()
    assert [r.id for r in rows] == [3, 2, 1, 0] and all(r.rank > 0 for r in rows)


def test_index_is_built_where_the_text_is_read(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id LONG, title STRING, body STRING")
    for config in ("simple", "english"):
        assert "Exchange" not in build_index(df, FIELDS, config)._jdf.queryExecution().executedPlan().toString()


def test_postings_are_stored_by_one_pass(spark, tmp_path):
    from shelfspark.sources.storage import snapshot_versions

    cuts = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            cuts.add(batch.num_rows)
            yield batch

    docs = spark.range(50).selectExpr("id", "'oar' AS title", "concat_ws(' ', 'tide', array_repeat(concat('w', id), 3)) AS body")
    read = docs.mapInArrow(counted, docs.schema)
    write_index(build_index(read, FIELDS, "simple"), f"{tmp_path}/index")
    # Cutting the order into ranges would need a second pass over the texts.
    assert cuts.value == 50 and snapshot_versions(spark, f"{tmp_path}/index/state") == [0]
    assert sorted(read_index(spark, f"{tmp_path}/index").collect()) == sorted(build_index(docs, FIELDS, "simple").collect())
    files = spark.read.parquet(f"{tmp_path}/index/postings/version=0").inputFiles()
    assert len(files) <= 64 * 8


def test_a_search_reads_the_postings_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.range(20).selectExpr("id", "'oar' AS title", "concat('tide w', id) AS body")
    index = stage(build_index(docs, FIELDS, "simple"))
    requests = spark.createDataFrame([(1, "oar tide"), (2, "w7")], "request_id LONG, q STRING")
    found = search_fts(index.mapInArrow(counted, index.schema), requests, "simple")
    assert sorted((r.request_id, r.id) for r in found.collect()) == [(1, i) for i in range(20)] + [(2, 7)]
    assert read.value == index.count() == 60
