import hashlib
import random

import pytest
from llm_samples import ascii_words, empty, messy, prose, rows_of

from shelfspark.llm.substring_dedup import SuffixAutomaton, find_repeats, matched, repeat_counts, word_codes

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def brute(rows, n=20, reference=()):
    """Counts and digests of (id, text) rows of different ids or equal texts, null ids last."""
    seen, out = {}, []
    for text in reference:
        own = ascii_words(text)
        for s in range(len(own) - n + 1):
            seen[tuple(own[s : s + n])] = None
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own = ascii_words(text)
        gone = set()
        for s in range(len(own) - n + 1):
            if seen.setdefault(tuple(own[s : s + n]), (i, s)) != (i, s):
                gone |= set(range(s, s + n))
        kept = " ".join(w for j, w in enumerate(own) if j not in gone)
        out.append((i, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    """Passages shared in part and in whole, near copies, copies, a text that repeats itself, and edges of 19 and 20 words."""
    rng = random.Random(seed)
    shared = [prose(seed * 10 + k, rng.choice([19, 20, 21, 40, 90])) for k in range(6)]
    out = []
    for k in range(60):
        parts = [prose(seed * 1000 + k * 3, rng.randint(0, 40)), rng.choice(shared), prose(seed * 1000 + k * 3 + 1, rng.randint(0, 40))]
        out.append(" ".join(p for p in parts if p))
    for k in range(20):
        own = shared[5].split() + shared[4].split()
        own[rng.randrange(len(own))] = f"other{k}"
        out.append("\n ".join(own))
    return out + [out[3], out[3], f"{shared[4]} {shared[4]} {shared[4]}", "a " * 70, "a b " * 50, "a b " * 30 + "c"]


@pytest.mark.parametrize(("seed", "hot", "shard_words"), [(1, 4096, 100_000), (2, 4, 200), (3, 1, 50)])
def test_windows_that_start_earlier(spark, seed, hot, shard_words):
    rows = list(enumerate(passages(seed)))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    found = find_repeats(docs, hot=hot, shard_words=shard_words)
    assert rows_of(found, "id", *COLUMNS[1:]) == brute(rows)


def test_spans_and_kept_words(spark):
    passage = prose(5, 25)
    docs = spark.createDataFrame([(1, passage), (2, f"x {passage} y z")], "doc_id LONG, text STRING")
    first, second = sorted(find_repeats(docs).collect())
    assert (first["n_removed"], first["spans"], first["kept"]) == (0, None, None)
    assert ([tuple(s) for s in second["spans"]], second["kept"]) == ([(1, 26)], "x y z")


def test_reference_comes_first(spark):
    reference = [prose(8, 60), None, ""]
    rows = [(0, prose(8, 60)), (1, "a " + prose(8, 30)), (2, prose(9, 40))]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    other = spark.createDataFrame([(900, t) for t in reference], "doc_id LONG, text STRING")
    found = find_repeats(docs, reference=other)
    assert rows_of(found, "id", *COLUMNS[1:]) == brute(rows, reference=[t for t in reference if t])


def test_awkward_rows(spark):
    docs = messy(spark)
    found = rows_of(repeat_counts(docs), *COLUMNS)
    assert len(found) == docs.count()
    # Repeated rows are one document: judged once, returned each time. Id 7 has two texts.
    once = brute(list(dict.fromkeys((r["doc_id"], r["text"]) for r in docs.collect())))
    assert {r for r in found if r[0] != 7} == {r for r in once if r[0] != 7}
    assert {r[0]: r for r in found}[8][2] == 60 and sum(r[0] == 6 for r in found) == 3


def test_empty_tables(spark):
    assert repeat_counts(empty(spark)).columns == list(COLUMNS)
    assert repeat_counts(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id LONG, text STRING")
    assert [r[1:3] for r in rows_of(repeat_counts(nothing), *COLUMNS)] == [(0, 0)] * 3


def test_codes_of_words_differ_as_the_words_do():
    text = "a b ab ba aa\t\x0b\x0c\r\n b  a é è \x1c \u00a0 " + "x" * 4096 + " " + "x" * 4097 + " " + "x" * 9000 + " " + prose(6, 300)
    own, found = ascii_words(text), word_codes(text).tolist()
    assert len(own) == len(found) and len(set(zip(own, found))) == len(set(own)) == len(set(found))
    long = prose(7, 200_000)
    assert len(word_codes(long)) == 200_000 and len(word_codes("")) == len(word_codes(None)) == len(word_codes(" \n")) == 0
    assert word_codes(long)[-5:].tolist() == word_codes(" ".join(long.split()[-5:])).tolist()


def test_matching_statistics_are_those_of_a_search():
    rng = random.Random(4)
    for _ in range(200):
        held = [[rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 5))]
        query = [rng.randint(0, 3) for _ in range(12)]
        automaton = SuffixAutomaton()
        for words in held:
            automaton.add(words)
        runs = {tuple(w[a:b]) for w in held for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        longest = [max([s for s in range(1, i + 1) if tuple(query[i - s : i]) in runs], default=0) for i in range(1, 13)]
        assert automaton.statistics(query) == longest
        assert matched(automaton, query, 4) == sum((tuple(query[i : i + 4]) in runs) << i for i in range(9))
