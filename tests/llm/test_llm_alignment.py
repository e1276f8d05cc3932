import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from llm_samples import empty, messy, rows_of
from tokenizers import Tokenizer

from shelfspark.llm import token_alignment
from shelfspark.llm.token_alignment import align_tokens, load_byte_bpe

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
EXTRA = [
    " ", "  ", " a", "a ", "a  b\n c\t d  ", "\n a", "x \n y", "  x 　 y᠎ z ᠎", " <s> </s> <|endoftext|> <unk>",
    "▁a b", "x▁", "\x00 a\x1c b\x85 c", "👍🏽 😀", " " * 40 + "x" + " " * 17, "\n\n\n", " \n ", "tab\t tab", "\r\n x", "a  b",
]


@pytest.fixture(scope="module")
def vocabularies():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return load_byte_bpe(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN, file.read()


def brute(rows, model):
    """Every overlap of byte ranges, by the libraries over whole texts."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=model)
    letters = token_alignment.byte_letters()

    def a_bytes(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def b_bytes(i):
        return bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc_id, text in rows:
        sides = [[], []]
        if text:
            sides = [[(i, a_bytes(i)) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, b_bytes(i)) for i in b.encode(text)]]
            if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
                sides = [[], []]
        spans = []
        for side in sides:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        common = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, low = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= end) for side in spans))
            low = end
        docs.append((doc_id, len(sides[0]), len(sides[1]), len(common), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(((d, na, nb, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else "") for d, na, nb, g, links, text in docs), key=repr)


@pytest.mark.parametrize("head", [1 << 19, 5, 0])
def test_as_the_libraries_have_it(spark, vocabularies, head):
    docs = messy(spark, EXTRA)
    small = docs.filter("text IS NULL OR length(text) < 5000")
    found = align_tokens(small, *vocabularies, head=head)
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert rows_of(found, *COLUMNS) == brute(rows, vocabularies[2])


def test_long_texts_and_slices_count_together(spark, vocabularies):
    rows = [(i, "the whale  sails on, isn't it? " * n) for i, n in enumerate([1, 40, 3000])]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    found = {r["doc_id"]: r for r in align_tokens(docs, *vocabularies).collect()}
    assert found[2]["n_links"] > 70 * found[1]["n_links"] and found[0]["count_sum"] > 3000 * found[0]["n_links"]


def test_slices_of_an_array_keep_their_texts():
    texts = [*EXTRA, None, "", *[f"é{i} ü  {i}" for i in range(40)]]
    whole = pa.array(texts)
    for start in range(0, len(texts), 7):
        found = token_alignment.chunk_lists(whole.slice(start, 7)).to_pylist()
        assert [None if c is None else " ".join(c) for c in found] == [t or None for t in texts[start : start + 7]]


def test_empty_tables(spark, vocabularies):
    assert align_tokens(empty(spark), *vocabularies).columns == list(COLUMNS)
    assert align_tokens(empty(spark), *vocabularies).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id LONG, text STRING")
    assert [r[1:] for r in rows_of(align_tokens(nothing, *vocabularies), *COLUMNS)] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_ids_out_of_order_are_refused(tmp_path):
    path = tmp_path / "own.json"
    path.write_text('{"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "aba": 2}, "merges": ["a b", "ab a"]}}')
    with pytest.raises(ValueError, match="order of merges"):
        load_byte_bpe(str(path))


def test_slices_pass_few_at_once(spark, vocabularies, monkeypatch):
    key, seen, scored = "spark.sql.execution.arrow.maxBytesPerBatch", [], token_alignment._scored
    before = spark.conf.get(key)

    def watched(parts, head):
        seen.append((int(spark.conf.get(key)), dict(parts.dtypes)["places"]))
        return scored(parts, head)

    monkeypatch.setattr(token_alignment, "_scored", watched)
    rows = [(1, "salt roads and ferries"), (2, None), (3, "ferries and salt")]
    found = align_tokens(spark.createDataFrame(rows, "doc_id LONG, text STRING"), *vocabularies)
    assert rows_of(found, *COLUMNS) == brute(rows, vocabularies[2])
    assert seen == [(1 << 22, "binary")] and spark.conf.get(key) == before
