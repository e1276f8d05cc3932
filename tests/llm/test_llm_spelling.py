import random
import re
import zlib
from collections import Counter

import pytest
from llm_samples import empty, messy, rows_of

from shelfspark.llm.spelling import near_pairs, near_words, spelling_variants

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= 7
    return {w: n for w, n in out.items() if n >= 2}


def brute(rows):
    known, forms, near = counted(rows), {}, {}
    for w, n in known.items():
        near[w] = [x for x in known if x != w and one_edit(w, x)]
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        if best is not None and known[best] >= 10 * n:
            forms[w] = best

    def root(w):
        return root(forms[w]) if w in forms else w

    return sorted(((w, forms.get(w), root(w), n, len(near[w]), known.get(forms.get(w))) for w, n in known.items()), key=repr)


def corpus(seed):
    """Words with variants of variants, runs of one letter, umlauts and capitals, some a hundred times as frequent."""
    rng = random.Random(seed)
    words = ["lanterns", "harbour", "captains", "anchorage", "aaaaaaaa", "abababab", "Fähnrich", "ÀÉÎÕÜÿß×÷"]
    for _ in range(160):
        w = rng.choice(words)
        i = rng.randrange(len(w) + 1)
        words.append(rng.choice([w[:i] + rng.choice("abRé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abRé") + w[i + 1 :]]))
    out = [(d, " ".join(rng.choices(words, [1 / (k + 1) ** 1.5 for k in range(len(words))], k=60))) for d in range(60)]
    return [*out, (None, "lanterns' lantern_s 7anterns lanterns"), (3, None), (4, "")]


@pytest.mark.parametrize(("seed", "group"), [(1, 256), (2, 3), (3, 2)])
def test_as_all_pairs_have_it(spark, seed, group):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    assert rows_of(spelling_variants(docs, group=group), *COLUMNS) == brute(rows)


def test_chains_of_forms_end_at_the_root(spark):
    words = [("lantern", 5000), ("lanterns", 400), ("lanternss", 30), ("lanternsss", 2), ("anterns", 39)]
    text = " ".join(" ".join([w] * n) for w, n in words)
    rows = [(d, text) for d in range(1, 4) if all(zlib.crc32(f"{d}:{w}".encode()) % 31 for w, _ in words)]
    found = spelling_variants(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    assert {r["word"]: (r["form"], r["root"]) for r in found.collect()} == {
        "lantern": (None, "lantern"), "lanterns": ("lantern", "lantern"), "lanternss": ("lanterns", "lantern"),
        "lanternsss": ("lanternss", "lantern"), "anterns": ("lanterns", "lantern")}


def test_equal_counts_take_the_first_word(spark):
    words = spark.createDataFrame([("xanterns", 9), ("anterns", 9), ("lanterns", 1)], "word STRING, n LONG")
    found = {r["word"]: tuple(r)[1:] for r in near_words(words).collect()}
    assert found == {"lanterns": (2, 9, "anterns"), "anterns": (2, 9, "xanterns"), "xanterns": (2, 9, "anterns")}


def test_sorted_lists_against_all_pairs():
    rng = random.Random(5)
    for t in range(600):
        cores = sorted({"".join(rng.choice("abc"[: 2 + t % 2]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 14))})
        wanted = [(i, j) for i in range(len(cores)) for j in range(i + 1, len(cores)) if one_edit(cores[i], cores[j])]
        assert sorted(near_pairs(cores)) == wanted


def test_awkward_rows_and_empty_tables(spark):
    docs = messy(spark)
    assert rows_of(spelling_variants(docs), *COLUMNS) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert spelling_variants(empty(spark)).columns == list(COLUMNS)
    assert spelling_variants(empty(spark)).count() == 0
