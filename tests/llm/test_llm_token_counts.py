import public_tokenizers
import pytest
from llm_samples import empty, messy, rows_of
from tokenizers import Tokenizer

from shelfspark.llm.token_counts import CACHE, count_tokens, read_cache, tokenizer_version

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ("doc_id", "n_bytes", "n_tokens", "over_limit")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, docs):
    out = []
    for r in docs.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        out.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    return sorted(out, key=repr)


def test_counts_are_the_library_s(spark, tokenizer, tmp_path):
    docs = messy(spark)
    assert rows_of(count_tokens(docs, PATH, str(tmp_path / "c")), *COLUMNS) == expected(tokenizer, docs)


def test_second_run_encodes_only_what_is_new(spark, tokenizer, tmp_path):
    cache = str(tmp_path / "c")
    with open(PATH, "rb") as file:
        version = tokenizer_version(file.read())
    rows_of(count_tokens(messy(spark), PATH, cache), *COLUMNS)
    stored = spark.read.parquet(cache).count()
    assert stored == read_cache(spark, cache, version).count()
    rows_of(count_tokens(messy(spark), PATH, cache), *COLUMNS)
    assert spark.read.parquet(cache).count() == stored
    more = messy(spark, ["quite new words", "quite  new\nwords "])
    assert rows_of(count_tokens(more, PATH, cache), *COLUMNS) == expected(tokenizer, more)
    assert spark.read.parquet(cache).count() == stored + 1


def test_stored_counts_are_used_and_other_versions_are_not(spark, tmp_path):
    import hashlib

    cache, docs = str(tmp_path / "c"), spark.createDataFrame([(1, "a b")], "doc_id LONG, text STRING")
    with open(PATH, "rb") as file:
        version = tokenizer_version(file.read())
    digest = bytearray(hashlib.sha256(b"a b").digest())
    spark.createDataFrame([("other", digest, 9), (version, digest, 77), (version, digest, 77)], CACHE).write.parquet(cache)
    assert rows_of(count_tokens(docs, PATH, cache), *COLUMNS) == [(1, 3, 77, False)]


def test_empty_table(spark, tmp_path):
    assert rows_of(count_tokens(empty(spark), PATH, str(tmp_path / "c")), *COLUMNS) == []


def test_words_count_as_whole_texts(tokenizer):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def holds(text):
        words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", text) if w]
        whole = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert whole == sum(len(tokenizer.encode(w, add_special_tokens=False).ids) for w in words)

    holds()
