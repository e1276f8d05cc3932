import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from llm_samples import empty, messy, rows_of

from shelfspark.llm import bpe

COLUMNS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_documents_as_the_library_encodes_them(spark, ranks, library):
    docs, expected = messy(spark), []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(ids), digest(" ".join(map(str, ids)).encode()), digest(library.decode_bytes(ids))))
    assert rows_of(bpe.encode_documents(docs, ranks), *COLUMNS) == sorted(expected, key=repr)
    assert rows_of(bpe.encode_documents(empty(spark), ranks), *COLUMNS) == []


def test_ids_offsets_and_decoding(spark, ranks, library):
    docs = messy(spark).select("doc_id", "text").withColumnRenamed("text", "whole")
    rows = bpe.decode_ids(bpe.encode_texts(docs.withColumn("text", docs.whole), ranks), ranks).collect()
    for r in rows:
        text = r.whole or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert len(r.starts) == len(r.piece_ids) and sum(r.piece_ids) == r.n_tokens
        at = 0
        for start, end, n in zip(r.starts, [*r.starts[1:], len(text)], r.piece_ids):
            assert library.decode_bytes(r.ids[at : at + n]).decode() == text[start:end]
            at += n


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\u00a0'strevmld aB1é.,!\u3000中\u0301\u0663", max_size=40), min_size=1, max_size=8))
def test_pieces_by_scan(ranks, library, texts):
    codec = bpe.Codec(ranks)
    for text, pieces in zip(texts, codec.pieces(texts)):
        assert "".join(pieces) == text
        assert [int(i) for i in codec.encode(pieces).split()] == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(ranks, library, text):
    codec = bpe.Codec(ranks)
    ids = codec.encode(codec.pieces([text])[0])
    assert [int(i) for i in ids.split()] == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_scan_over_many_blocks(ranks, library):
    text = ("it's  we'll\n\nrun 12345 !!'s " * 40000)[:-3]
    assert len(text) > bpe.BLOCK * bpe.BLOCK
    assert [int(i) for i in bpe.Codec(ranks).encode(bpe.Codec(ranks).pieces([text])[0]).split()] == library.encode_ordinary(text)


@pytest.mark.parametrize("piece", ["x" * 300, "ab" * 900, "abc" * 257, "é" * 400])
def test_long_pieces_by_heap(ranks, library, piece):
    assert bpe.merge(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_two_tables_that_share_their_bytes_keep_apart_in_one_worker(spark):
    single = {bytes([i]): i for i in range(256)}
    docs = spark.createDataFrame([(1, "abc")], "doc_id LONG, text STRING").coalesce(1)
    found = [bpe.encode_texts(docs, single | {pair: 256}).first()["ids"] for pair in (b"ab", b"bc", b"ab")]
    assert found == [[256, 99], [97, 256], [256, 99]]
