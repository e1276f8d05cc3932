import math
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from llm_samples import ascii_words, empty, messy, prose, rows_of

from shelfspark.llm import fertility

COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def brute(text):
    text = text or ""
    words = ascii_words(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    earlier, doubled = set(), 0
    for line in text.split("\n"):
        if ascii_words(line):
            doubled += line in earlier
            earlier.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(covered), n < 50 or 100 * len(covered) > 50 * n)


EXTRA = ["# a b c a b c # <p> | a", "one two three\n\tone two three \none two three", "a a a a a", prose(3, 49), prose(3, 50)]


def test_plain_counts(spark, model):
    docs = messy(spark, EXTRA)
    expected = sorted([(r.doc_id, *brute(r.text)) for r in docs.collect()], key=repr)
    found = fertility.judge_documents(docs, model)
    assert rows_of(found, *COUNTS) == expected
    assert not [r for r in found.collect() if r.base_failed and r.kept]
    assert rows_of(fertility.judge_documents(empty(spark), model), *COUNTS) == []


def test_measures_by_the_library(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = messy(spark, EXTRA)
    for r in fertility.judge_documents(docs.select("doc_id", "text"), model).join(
            docs.select("doc_id", "text").distinct(), "doc_id").collect():
        words = ascii_words(r.text)
        if len([x for x in docs.collect() if x.doc_id == r.doc_id]) > 1:
            continue
        ids = [i for w in words for i in library.encode(w)]
        assert r.n_tokens == len(ids)
        if ids:
            shares = [n / len(ids) for n in Counter(ids).values()]
            assert abs(r.chars_per_token - sum(map(len, words)) / len(ids)) < 1e-9
            assert abs(r.byte_share - sum(library.is_byte(i) for i in ids) / len(ids)) < 1e-9
            assert abs(r.token_entropy - -sum(p * math.log2(p) for p in shares) / max(math.log2(len(ids)), 1)) < 1e-9


def test_bands_reject_what_is_far_from_its_language(spark, model):
    rows = [(i, prose(i, 80), "en") for i in range(80)] + [(i, "これは本の話です" * 9 + " " + prose(i, 60), None) for i in range(100, 104)]
    rows += [(200, " ".join(f"§{i}¤▒{i}¶" for i in range(80)), "en"), (201, " ".join(f"{i}q#" for i in range(80)), "en")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    found = {r.doc_id: r for r in fertility.judge_documents(docs, model).collect()}
    assert all(found[i].kept for i in range(80)) and not found[200].kept and not found[201].kept
    assert found[200].reason is not None and found[100].kept and found[100].band.startswith("script ")


def test_clean_documents_of_the_given_tables_are_kept(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = fertility.judge_documents(docs, model).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    clean = found.filter("quality = 1 AND NOT base_failed")
    assert clean.count() > 200 and clean.filter("NOT kept").count() <= 0.01 * clean.count()


def few_words():
    """Four words of which each three follow each other once."""
    order, seen = [0, 0], set()
    while left := [k for k in (3, 2, 1, 0) if (*order[-2:], k) not in seen]:
        seen.add((*order[-2:], left[0]))
        order.append(left[0])
    return " ".join("the ship sea of".split()[k] for k in order)


NOISE = " ".join(f"§{i}¤▒{i}¶" for i in range(80))


def test_entropy_has_a_band_that_can_bind(spark, model):
    rows = [(i, prose(i, 60 + 2 * i), "en") for i in range(90)] + [(200, few_words(), "en")]
    found = {r.doc_id: r for r in fertility.judge_documents(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"), model).collect()}
    assert not found[200].base_failed and found[200].reason == "token_entropy"
    assert all(found[i].kept for i in range(90))


def test_texts_of_thin_bands_are_judged_by_wider_ones(spark, model):
    for n, by in ((80, "any latin"), (40, "all")):
        rows = [(i, prose(i, 80), "en") for i in range(n)] + [(300, prose(7, 70), "xx"), (301, NOISE + " " + "é1q#" * 9, "xx")]
        rows += [(302, " ".join(f"q{i}#{i}" for i in range(80)), "xx")]
        found = {r.doc_id: r for r in fertility.judge_documents(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"), model).collect()}
        assert found[300].kept and found[300].judged_by == by and all(found[i].kept for i in range(n))
        assert not found[301].kept and found[301].reason is not None
        assert not found[302].kept and found[302].reason is not None and not found[302].base_failed


def test_held_out_labels(spark, model):
    """Fences were set on the even ids of sf0.1; the odd ones show what they reject."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("doc_id % 2 = 1")
    found = fertility.judge_documents(docs, model).filter("NOT base_failed AND reason IS NOT NULL").join(labels, "doc_id")
    rejected = [(r.reason, r.quality) for r in found.collect()]
    assert ("token_entropy", 0) in rejected and not [r for r in rejected if r[1] == 1]


def test_scripts():
    names = [fertility.script_of(w) for w in ("abc", "Ж", "東京", "ひ", "한", "12", "é", "Ω", "ع")]
    assert names == ["latin", "cyrillic", "han", "kana", "hangul", "none", "latin", "greek", "arabic"]
