"""Requests that share a text or a combination of filters: one search, the answers of each."""

import numpy as np

from shelfspark.operators.embedding import HashingEmbedder, embed, rating_text
from shelfspark.operators.fulltext import build_index
from shelfspark.plans import search
from shelfspark.schemas import RATING_FIELDS
from shelfspark.sources.storage import stage

AUTHORS = ["Ada Quill", "Nora Holt", "ada holt", "Quill"]
ASKED = "request_id LONG, q STRING, author STRING, year STRING"


def many_ratings(spark):
    rows = [(i, f"s{i}", f"{['salt', 'copper'][i % 2]} {['road', 'valley', 'road road'][i % 3]}", AUTHORS[i % 4], float(i % 5), i,
             "", "Travel", "", "9", str(1990 + i % 3)) for i in range(40)]
    rows.append((40, "s40", "", "", 1.0, 1, "", "", "", "", "1990"))
    return spark.createDataFrame(
        rows, """id LONG, source_id STRING, title STRING, author STRING, rating FLOAT, ratings_count INT,
        description STRING, genres STRING, isbn STRING, pages STRING, year STRING""")


def meets(row, author, year):
    return (not author or author.lower() in row.author.lower()) and (not year or row.year == year)


def test_a_text_is_searched_once_whatever_its_filters(spark, monkeypatch):
    ratings = stage(many_ratings(spark))
    postings = stage(build_index(ratings, RATING_FIELDS, "simple"))
    wanted = [(1, "salt road", "quill", None), (2, "salt road", "HOLT", None), (3, "salt road", None, "1991"), (4, "salt road", None, None),
              (5, "copper", "quill", "1990"), (6, "valley", None, None), (7, "salt road", "nobody", None), (8, "salt road", "quill", None)]
    texts, ranked = [], search.search_fts

    def counted(index, asked, *args, **kwargs):
        texts.extend(r.q for r in asked.collect())
        return ranked(index, asked, *args, **kwargs)

    monkeypatch.setattr(search, "search_fts", counted)
    together = search.search_ratings_fts(ratings, postings, spark.createDataFrame(wanted, ASKED), "simple", limit=7)
    found = {i: [] for i, *_ in wanted}
    for r in together.orderBy("request_id", "rank_no").collect():
        found[r.request_id].append(r.id)
    assert sorted(texts) == ["copper", "salt road", "valley"]
    each = spark.createDataFrame([(4, "salt road"), (5, "copper"), (6, "valley")], "request_id LONG, q STRING")
    ranks, rows = {(r.request_id, r.id): r.rank for r in ranked(postings, each, "simple").collect()}, ratings.collect()
    numbers = {"salt road": 4, "copper": 5, "valley": 6}
    for i, q, author, year in wanted:
        met = [r.id for r in rows if set(q.split()) <= set(r.title.split()) and meets(r, author, year)]
        assert found[i] == sorted(met, key=lambda n: (-ranks[numbers[q], n], n))[:7]
    assert found[7] == [] and found[1] and found[2] and found[5]


def test_requests_of_a_combination_share_its_rows(spark, monkeypatch):
    embedder, ratings = HashingEmbedder(16), stage(many_ratings(spark))
    vectors = stage(embed(rating_text(ratings), "text", embedder))
    wanted = [(i, q, author, year) for i, (q, author, year) in enumerate(
        (q, author, year) for q in ("salt", "copper road", "--") for author, year in (("quill", None), ("%", "1991"), ("", "1990"), (None, None)))]
    sent, grouped = [], search.topk_grouped

    def counted(held, *args, **kwargs):
        sent.append(held.count())
        return grouped(held, *args, **kwargs)

    monkeypatch.setattr(search, "topk_grouped", counted)
    got = search.search_ratings_vector(ratings, vectors, spark.createDataFrame(wanted, ASKED), embedder, limit=6, offset=2)
    found = {i: [] for i, *_ in wanted}
    for r in got.orderBy("request_id", "rank_no").collect():
        found[r.request_id].append((r.id, r.rank_no))
    rows = ratings.collect()
    held = {r.id: np.array(r.embedding, float) for r in vectors.collect()}
    asked = {r.request_id: np.array(r.embedding, float) for r in embed(spark.createDataFrame(wanted, ASKED), "q", embedder, "request_id").collect()}
    met = {(author, year): [r.id for r in rows if meets(r, author and author.strip("%"), year)] for _, _, author, year in wanted}
    for i, _, author, year in wanted:
        def distance(n, a=asked[i]):
            length = np.sqrt(a @ a) * np.sqrt(held[n] @ held[n])
            return round(1 - a @ held[n] / length, 9) if length else np.inf

        best = sorted((distance(n), n) for n in met[author, year])[2:8]
        assert found[i] == [(n, place) for place, (_, n) in enumerate(best, 1)]
    assert sent == [sum(len(ids) for (author, year), ids in met.items() if author or year)]
