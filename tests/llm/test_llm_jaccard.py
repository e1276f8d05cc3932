import random

import pytest
from llm_samples import WORDS, ascii_words, empty, messy, prose, rows_of

from shelfspark.llm import jaccard

COLUMNS = ("doc_id", "n_shingles", "component_id")


def shingles(text):
    own = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in ascii_words(text)]
    return frozenset(tuple(own[i : i + 5]) for i in range(max(len(own) - 4, 1))) if own else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                head[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[find(i)] = min(best.get(find(i), doc_id), doc_id)
    return sorted([(d, len(s), best.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=repr)


def edited(rng, text, share):
    own = text.split()
    for _ in range(max(1, int(len(own) * share))):
        own[rng.randrange(len(own))] = rng.choice(WORDS) + str(rng.randint(100, 999))
    return " ".join(own)


def crowd(seed):
    """Chains and crowds of near copies, shared passages, short texts and texts just beside the threshold."""
    rng, out = random.Random(seed), []
    passage = prose(seed + 100, 60)
    for k in range(6):
        base = prose(seed * 50 + k, rng.choice([5, 8, 20, 60, 150]))
        out += [base, base.upper()]
        for _ in range(12):
            base = edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.03]))
            out.append(base)
    hub = prose(seed + 7, 120)
    out += [edited(rng, hub, 0.02) for _ in range(40)]
    out += [prose(seed * 900 + k, rng.randint(10, 90)) + " " + passage for k in range(40)]
    out += [passage + " " + prose(seed * 800 + k, rng.randint(1, 18)) for k in range(40)]
    out += [" ".join(prose(seed, 40).split()[: rng.randint(1, 40)]) for _ in range(30)]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_as_all_pairs_give_them(spark, seed):
    rows = list(enumerate(crowd(seed)))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5)
    assert rows_of(jaccard.jaccard_components(docs), *COLUMNS) == brute(rows)


def test_strangers_that_share_many_rare_tokens_are_paired_once(spark):
    """Texts that share a passage but do not link: one pair comes out per two of them, or few more, and no link is lost."""
    passage = prose(77, 60)
    rows = [(i, f"{prose(500 + i, 10)} {passage} {prose(700 + i, 45)}") for i in range(30)]
    rows += [(100 + i, edited(random.Random(i), rows[i][1], 0.02)) for i in range(0, 30, 3)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert rows_of(jaccard.jaccard_components(docs), *COLUMNS) == brute(rows)
    members = jaccard._members(docs, "doc_id", "text", 5)
    texts = jaccard._texts_of(docs, members, members.select("key"), "doc_id", "text", 5)
    postings = jaccard._labelled(jaccard._second_postings(texts, 5, 75), None)
    made = jaccard._rest_pairs(postings, texts, 75)
    linked = {(a, b) for a in dict(rows) for b in dict(rows) if a < b
              and 100 * len(shingles(dict(rows)[a]) & shingles(dict(rows)[b])) >= 75 * len(shingles(dict(rows)[a]) | shingles(dict(rows)[b]))}
    keys = {r["key"]: r["id"] for r in members.collect()}
    found = {tuple(sorted((keys[r["a"]], keys[r["b"]]))) for r in made.collect()}
    assert linked and linked <= found


def test_edges(spark):
    docs = messy(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(jaccard.jaccard_components(docs), *COLUMNS) == brute(rows)
    assert rows_of(jaccard.jaccard_components(empty(spark)), *COLUMNS) == []


def test_only_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a  B"), (4, None)], "doc_id LONG, text STRING")
    assert rows_of(jaccard.jaccard_components(docs), *COLUMNS) == [(4, 0, 4), (None, 1, None), (None, 1, None)]


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150), (300, 300)]
    found = jaccard.components(spark.createDataFrame(edges, "a LONG, b LONG"))
    expected = [(i, 0) for i in range(61)] + [(100, 100), (150, 100), (200, 100)]
    assert sorted(tuple(r) for r in found.select("key", "component").collect()) == expected


def test_one_row_of_each_component_stays(spark):
    docs = messy(spark, crowd(4))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = jaccard.keep_one_of_each(docs)
    assert kept.schema == docs.schema
    found = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {}
    for k, _, c in brute([(k, t) for k, (_, t) in enumerate(rows) if shingles(t)]):
        groups.setdefault(c, []).append(rows[k][0])
    smallest = [min((d for d in g if d is not None), default=None) for g in groups.values()]
    worded = [(d, t) for d, t in found if shingles(t)]
    assert sorted((d for d, _ in worded), key=repr) == sorted(smallest, key=repr)
    assert set(found) <= set(rows)
    assert sorted(((d, t) for d, t in found if not shingles(t)), key=repr) == sorted(((d, t) for d, t in rows if not shingles(t)), key=repr)
    assert rows_of(jaccard.keep_one_of_each(empty(spark)), "doc_id") == []
