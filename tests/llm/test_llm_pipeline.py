import public_tokenizers
import pytest
import tiktoken
from llm_samples import SCHEMA, empty, messy

import corpus_pipeline
from shelfspark.llm import bpe, decontaminate, quality, queries, secret_scan
from test_llm_jaccard import brute, shingles

SF_DIR = "/root/testdata/sf0.01"


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "secrets", "encoding"]
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_run_as_its_stages_in_plain_python(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    machine = quality.train(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = [r for r in documents.collect() if machine.scores([quality.describe(r.text, r.n_chars)])[0] >= 0.5]
    components = {d: c for d, _, c in brute([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if components[r.doc_id] == r.doc_id]
    leaks = {r.doc_id for r in decontaminate.find_leaks(documents, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for r in rows:
        if r.doc_id not in leaks:
            ids = library.encode_ordinary(secret_scan.redacted(r.text))
            expected[r.doc_id] = (len(ids), bpe.sha256(" ".join(map(str, ids))))
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in found} == expected and len(found) == len(expected)


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    made = {}
    for name, docs in (("messy", messy(spark)), ("empty", empty(spark))):
        path = tmp_path_factory.mktemp(name)
        docs.write.parquet(f"{path}/documents.parquet")
        labels = [(i, i % 2, 0) for i in range(14)] if name == "messy" else []
        spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id LONG, text STRING").write.parquet(f"{path}/benchmark.parquet")
        made[name] = str(path)
    return made


@pytest.mark.parametrize("name", ["messy", "empty"])
def test_stages_keep_columns_of_awkward_tables(spark, tables, name):
    docs = spark.read.parquet(f"{tables[name]}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        made = step(spark, docs, tables[name])
        assert made.dtypes == docs.dtypes
        docs = made
    found = corpus_pipeline.run(spark, tables[name])
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert (found.count() > 0) == (name == "messy")


def test_sql_agrees_on_the_smallest_tables(spark):
    from checks.compare import connect, difference

    con = connect("/root/testdata/sf0.001")
    for name, sql in queries.SQL.items():
        assert difference(spark, con, queries.QUERIES[name], sql, "/root/testdata/sf0.001")[0] == ""
