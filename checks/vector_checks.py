"""Vector search, embedding and similarity queries."""

import uuid

from pyspark.sql import functions as F

from checks.registry import check, table, view
from checks.views import (
    DOC_PAGES, NAME_REQUESTS, PRODUCTS, RATING_WEIGHTS, RATINGS, SHELF, VECTORS, ctes, hashed, occurrences, ranked,
)
from shelfspark.functions.vectors import cosine_distance, format_vector, parse_vector
from shelfspark.operators.embedding import (
    HashingEmbedder, embed, embed_missing, export_vectors, rating_text, read_exported, restore_vectors,
)
from shelfspark.operators.fulltext import build_index
from shelfspark.operators.layout import spread
from shelfspark.operators.lists import read_figures, search_lists, update_lists, write_lists
from shelfspark.operators.nearest import build_ivf, knn_join, topk_exact, topk_grouped
from shelfspark.operators.paging import top_rows
from shelfspark.plans.reader import embed_pages, page_search
from shelfspark.plans.search import search_ratings, search_ratings_vector
from shelfspark.plans.similar import neighbours, similar, store_lists
from shelfspark.schemas import ITEM_FIELDS, RATING_FIELDS
from shelfspark.sources.storage import stage, work_dir

EMBEDDER = HashingEmbedder(64)


def distance(a: str, b: str) -> str:
    return f"round(list_cosine_distance({a}::double[], {b}::double[]), 9)"


V = f"WITH {ctes(v=VECTORS)}"
RATING_OCC = f"{ctes(items=RATINGS)}, {occurrences('items', RATING_WEIGHTS)}"
PAIRS = f"""{V}, d AS (SELECT a.id AS query_id, b.id, a.label AS label, b.label AS other, {distance('a.embedding', 'b.embedding')} AS distance
    FROM v a, v b WHERE a.id <> b.id)"""


def shown(df):
    return df.select("query_id", "id", F.round("distance", 4).alias("distance"), "rank_no")


@check(f"""{V}, m AS (SELECT label, list(c ORDER BY i) AS embedding FROM (
      SELECT label, i, avg(x::double)::float AS c FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM v)
      GROUP BY label, i) GROUP BY label)
    SELECT v.id, round({distance('v.embedding', 'm.embedding')}, 4) AS distance FROM v JOIN m USING (label)""")
def cosine_expression(spark, sf):
    vectors = view(spark, sf, VECTORS)
    return vectors.join(label_means(vectors), "label").select(
        "id", F.round(F.round(cosine_distance(F.col("embedding"), F.col("mean")), 9), 4).alias("distance"))


def label_means(vectors):
    """Mean vector of each label, every component averaged with map-side partial sums."""
    each = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).cast("float").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "c")))
    return means.groupBy("label").agg(ordered.alias("cs")).select("label", F.col("cs.c").alias("mean"))


@check(f"""{V}, m AS (SELECT label, list(c ORDER BY i) AS embedding FROM (
      SELECT label, i, avg(x::double)::float AS c FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM v)
      GROUP BY label, i) GROUP BY label),
    d AS (SELECT m.label::bigint AS query_id, v.id, {distance('v.embedding', 'm.embedding')} AS distance FROM v, m),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank_no FROM d)
    SELECT query_id, id, round(distance, 4) AS distance, rank_no FROM r WHERE rank_no <= 20""")
def cosine_topk(spark, sf):
    vectors = view(spark, sf, VECTORS)
    queries = label_means(vectors).select(F.col("label").cast("long").alias("query_id"), F.col("mean").alias("embedding"))
    return shown(topk_exact(vectors, queries, 20))


@check(f"""{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank_no
    FROM d WHERE label = other) SELECT query_id, id, round(distance, 4) AS distance, rank_no FROM r WHERE rank_no <= 5""")
def cosine_topk_in_group(spark, sf):
    vectors = view(spark, sf, VECTORS)
    found = topk_grouped(vectors, vectors.withColumnRenamed("id", "query_id"), 6, "label")
    others = found.filter("id <> query_id").withColumn("rank_no", F.col("rank_no") - 1)
    return shown(others)


KNN_SQL = f"""{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank_no FROM d)
    SELECT query_id, id, round(distance, 4) AS distance, rank_no FROM r WHERE rank_no <= 5"""


@check(KNN_SQL)
def knn_join_exact(spark, sf):
    vectors = view(spark, sf, VECTORS)
    return shown(knn_join(vectors, vectors, 5))


def ivf(spark, sf, lists=None):
    listed, centroids = build_ivf(view(spark, sf, VECTORS), lists, iterations=5)
    return stage(listed), stage(centroids)


@check(KNN_SQL)
def knn_join_all_lists(spark, sf):
    """Visiting every list must give the exact answer."""
    vectors = view(spark, sf, VECTORS)
    listed, centroids = ivf(spark, sf, 16)
    return shown(knn_join(vectors, listed, 5, centroids, probes=16))


@check(f"""{V} SELECT id, 1::bigint AS n_lists, true AS nearest FROM v""")
def ivf_lists(spark, sf):
    """Every vector is in exactly one list, and no other list's centre is nearer than that of its own."""
    listed, centroids = ivf(spark, sf, 16)
    vectors = listed.select("id", "list_id", "embedding")
    centres = centroids.select(F.col("list_id").cast("long").alias("id"), "embedding")
    nearest = topk_exact(centres, vectors.select(F.col("id").alias("query_id"), "embedding"), 1)
    own = vectors.join(centroids.select("list_id", F.col("embedding").alias("centre")), "list_id").select(
        "id", F.round(cosine_distance(F.col("embedding"), F.col("centre")), 4).alias("own"))
    both = own.join(nearest.select(F.col("query_id").alias("id"), F.round("distance", 4).alias("best")), "id", "left")
    return both.groupBy("id").agg(
        F.count("*").alias("n_lists"), F.bool_and(F.col("own") - F.col("best") <= 0.05).alias("nearest"))


def work_path(spark, name):
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@check(KNN_SQL)
def knn_stored_lists(spark, sf):
    """Stored lists, read no further than a list may still hold a nearer vector, give the exact answer."""
    vectors = view(spark, sf, VECTORS)
    path = work_path(spark, "lists")
    write_lists(vectors, path)
    found = search_lists(spark, path, vectors.select(F.col("id").alias("query_id"), "embedding"), 6)
    others = found.filter("id <> query_id").drop("rank_no")
    return shown(top_rows(others, ["query_id"], [F.col("distance"), F.col("id")], 5))


@check(KNN_SQL)
def knn_updated_lists(spark, sf):
    """Lists built over part of the vectors, with the rest and a correction put in later, give the exact answer."""
    vectors = view(spark, sf, VECTORS)
    path = work_path(spark, "lists")
    early = vectors.filter("label % 2 = 0").withColumn("embedding", F.when(F.col("id") % 3 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    write_lists(early, path)
    update_lists(vectors.filter("label % 2 = 1"), path)
    update_lists(vectors.filter("label % 2 = 0 AND id % 3 = 0"), path)
    found = search_lists(spark, path, vectors.select(F.col("id").alias("query_id"), "embedding"), 6)
    return shown(top_rows(found.filter("id <> query_id").drop("rank_no"), ["query_id"], [F.col("distance"), F.col("id")], 5))


@check("SELECT true AS half_read, true AS recall_enough")
def lists_recall(spark, sf):
    """A probed search of half of the lists finds 0.9 of the ten nearest vectors or more."""
    vectors = view(spark, sf, VECTORS)
    path = work_path(spark, "lists")
    write_lists(vectors, path)
    queries = vectors.select(F.col("id").alias("query_id"), "embedding")
    probes = read_figures(spark, path).filter("size > 0").count() // 2
    exact = stage(topk_exact(vectors, queries, 10)).select("query_id", "id")
    found = search_lists(spark, path, queries, 10, probes=probes).select("query_id", "id")
    hits = found.join(exact, ["query_id", "id"], "left_semi").agg(F.count("*")).scalar()
    return exact.agg(F.lit(probes > 0).alias("half_read"), (hits / F.count("*") >= 0.9).alias("recall_enough"))


@check(f"""{V} SELECT id, round(list_sum(embedding::double[]), 4) AS total, len(embedding)::bigint AS n FROM v""")
def vector_text(spark, sf):
    """Vectors written as text and read back."""
    text = view(spark, sf, VECTORS).select("id", format_vector(F.col("embedding")).alias("text"))
    back = text.select("id", parse_vector(F.col("text")).alias("embedding"))
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return back.select("id", F.round(total, 4).alias("total"), F.size("embedding").cast("long").alias("n"))


@check()
def ivf_recall(spark, sf):
    """Share of the exact neighbours found when visiting some of the lists."""
    vectors = view(spark, sf, VECTORS)
    listed, centroids = ivf(spark, sf)
    exact = stage(knn_join(vectors, vectors, 10)).select("query_id", "id")
    parts = []
    for probes in (1, 10, 30):
        hits = knn_join(vectors, listed, 10, centroids, probes).join(exact, ["query_id", "id"], "left_semi")
        parts.append(hits.agg(F.count("*").alias("hits")).withColumn("probes", F.lit(probes)))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    total = exact.agg(F.count("*")).scalar()
    return found.select("probes", F.round(F.col("hits") / total, 3).alias("recall"))


@check(f"""WITH {ctes(v=VECTORS, ratings=RATINGS, shelf=SHELF)},
    d AS (SELECT a.id AS query_id, b.id, {distance('a.embedding', 'b.embedding')} AS distance FROM v a, v b),
    kept AS (SELECT d.*, r.title, r.rating, r.isbn FROM d JOIN ratings r USING (id)
             WHERE d.id <> d.query_id AND r.rating >= 905 AND r.ratings_count >= 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM kept QUALIFY rn <= 10)
    SELECT query_id, id, title, rating, floor((1 - distance) * 1000 + 0.5) / 1000 AS similarity,
           isbn <> '' AND isbn IN (SELECT isbn FROM shelf) AS available FROM r""")
def similar_filtered(spark, sf):
    vectors = view(spark, sf, VECTORS)
    queries = vectors.selectExpr("id AS query_id", "id AS source_id", "embedding")
    found = neighbours(
        queries, vectors, view(spark, sf, RATINGS), view(spark, sf, SHELF), 10, min_rating=905, min_reviews=10)
    return found.select("query_id", "id", "title", "rating", "similarity", "available")


@check(f"""WITH {ctes(v=VECTORS, ratings=RATINGS, shelf=SHELF)},
    q AS (SELECT id, embedding, CASE WHEN id % 3 = 0 THEN 905 + id % 7 WHEN id % 3 = 1 THEN 0 END AS min_rating,
                 CASE WHEN id % 2 = 0 THEN id % 50 END AS min_reviews FROM v),
    d AS (SELECT a.id AS query_id, b.id, {distance('a.embedding', 'b.embedding')} AS distance, min_rating, min_reviews FROM q a, v b),
    kept AS (SELECT d.*, r.rating FROM d JOIN ratings r USING (id) WHERE d.id <> d.query_id
             AND r.rating >= coalesce(min_rating, 0) AND r.ratings_count >= coalesce(min_reviews, 20)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM kept QUALIFY rn <= 10)
    SELECT query_id, id, rating, floor((1 - distance) * 1000 + 0.5) / 1000 AS similarity FROM r""")
def similar_own_minimums(spark, sf):
    """Minimums of each request over stored lists; a request without min_reviews takes the given 20."""
    vectors, ratings = view(spark, sf, VECTORS), view(spark, sf, RATINGS)
    path = work_path(spark, "lists")
    store_lists(vectors, ratings, path)
    queries = vectors.selectExpr(
        "id AS query_id", "id AS source_id", "embedding",
        "CASE WHEN id % 3 = 0 THEN 905 + id % 7 WHEN id % 3 = 1 THEN 0 END AS min_rating",
        "CASE WHEN id % 2 = 0 THEN id % 50 END AS min_reviews")
    found = neighbours(queries, None, ratings, view(spark, sf, SHELF), 10, min_reviews=20, lists=path)
    return found.select("query_id", "id", "rating", "similarity")


DOC_TEXTS = "SELECT doc_id AS id, text FROM {documents}"


@check(f"""WITH {ctes(t=DOC_TEXTS)}, {hashed('t', 'id', 'text', 'e')},
    x AS (SELECT id, unnest(embedding) AS x, unnest(range(64)) AS i FROM e)
    SELECT id, i, round(x::double, 5) AS x FROM x""")
def embed_hashing(spark, sf):
    vectors = embed(view(spark, sf, DOC_TEXTS), "text", EMBEDDER)
    each = vectors.select("id", F.posexplode("embedding").alias("i", "x"))
    return each.select("id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))


@check("""SELECT d.doc_id AS id, 'hashing-64' AS model, 64::bigint AS dim FROM documents d
    WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def embed_missing_rows(spark, sf):
    have = table(spark, sf, "labels").selectExpr("doc_id AS id", "array(cast(quality AS float)) AS embedding")
    made = embed_missing(view(spark, sf, DOC_TEXTS), have, EMBEDDER)
    return made.select("id", "model", F.size("embedding").cast("long").alias("dim"))


@check("""SELECT vec_id AS id, 'm' AS model, round(list_sum(embedding::double[]), 4) AS total FROM embeddings
    WHERE vec_id IN (SELECT p_partkey FROM part)""")
def export_restore_vectors(spark, sf):
    vectors = view(spark, sf, VECTORS)
    path = f"{work_dir(spark)}/exported-vectors-{sf.rstrip('/').rsplit('/', 1)[-1]}"
    export_vectors(vectors, path)
    none = vectors.selectExpr("id", "embedding", "'m' AS model").limit(0)
    back = restore_vectors(view(spark, sf, RATINGS), none, read_exported(spark, path), "m")
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return back.select("id", "model", F.round(total, 4).alias("total"))


RATING_TEXT = """SELECT id, concat_ws(' | ', nullif(title, ''), nullif(author, ''), nullif(description, ''), nullif(genres, '')) AS text
    FROM ratings"""


@check(f"""WITH {ctes(ratings=RATINGS, requests=NAME_REQUESTS)}, t AS ({RATING_TEXT}),
    {hashed('t', 'id', 'text', 'e')}, {hashed('requests', 'request_id', 'q', 'q')},
    d AS (SELECT q.request_id, e.id, {distance('q.embedding', 'e.embedding')} AS distance FROM q, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) - 5 AS rank_no FROM d)
    SELECT request_id, id, rank_no, floor((1 - distance) * 1000 + 0.5) / 1000 AS similarity FROM r WHERE rank_no BETWEEN 1 AND 10""")
def search_ratings_nearest(spark, sf):
    ratings = view(spark, sf, RATINGS)
    vectors = stage(embed(rating_text(ratings), "text", EMBEDDER))
    found = search_ratings_vector(ratings, vectors, view(spark, sf, NAME_REQUESTS), EMBEDDER, 10, 5)
    return found.select("request_id", "id", "rank_no", "similarity")


ROUTED_REQUESTS = """
    SELECT DISTINCT p_name AS request_id, p_name AS q, cast(NULL AS string) AS author, cast(NULL AS string) AS search_type FROM {part}
    UNION SELECT DISTINCT concat(p_name, '/', p_brand), p_name, p_brand, cast(NULL AS string) FROM {part}
    UNION SELECT DISTINCT p_type, p_type, cast(NULL AS string), 'fts' FROM {part}
    UNION SELECT DISTINCT concat(p_brand, '/', p_type), p_type, p_brand, 'vector' FROM {part}
    UNION SELECT DISTINCT concat('none/', p_type), p_type, p_type, 'vector' FROM {part}
    UNION SELECT DISTINCT concat('author/', p_brand), cast(NULL AS string), p_brand, 'vector' FROM {part}"""


@check(f"""WITH {RATING_OCC}, {ctes(requests=ROUTED_REQUESTS)}, {ranked('requests')}, t AS ({RATING_TEXT.replace('FROM ratings', 'FROM items')}),
    routed AS (SELECT *, CASE WHEN search_type = 'fts' OR author IS NOT NULL AND search_type IS NULL THEN 'fts' ELSE 'vector' END AS kind FROM requests),
    {hashed('t', 'id', 'text', 'e')}, {hashed('requests', 'request_id', 'q', 'h')},
    met AS (SELECT q.request_id, q.kind, i.id FROM routed q JOIN items i ON q.author IS NULL OR i.author ILIKE '%' || q.author || '%'
            WHERE q.q IS NOT NULL),
    placed AS (
      SELECT m.request_id, kind, m.id, row_number() OVER (PARTITION BY m.request_id ORDER BY r.rank DESC, m.id) AS rank_no
      FROM met m JOIN ranked r USING (request_id, id) WHERE kind = 'fts'
      UNION ALL
      SELECT request_id, kind, id, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) FROM (
        SELECT m.request_id, m.kind, m.id, {distance('h.embedding', 'e.embedding')} AS distance
        FROM met m JOIN h USING (request_id) JOIN e USING (id) WHERE kind = 'vector'))
    SELECT request_id, kind AS search_type, id, rank_no, NULL AS error FROM placed WHERE rank_no <= 5
    UNION ALL SELECT request_id, NULL, NULL, NULL, CASE WHEN q IS NULL THEN 'a vector search needs q' ELSE 'vector search found nothing' END
    FROM routed WHERE kind = 'vector' AND request_id NOT IN (SELECT request_id FROM placed)""")
def search_ratings_routed(spark, sf):
    ratings = view(spark, sf, RATINGS)
    index = stage(build_index(spread(ratings, "id"), RATING_FIELDS, "simple"))
    vectors = stage(embed(rating_text(ratings), "text", EMBEDDER))
    results, errors = search_ratings(ratings, index, vectors, view(spark, sf, ROUTED_REQUESTS), EMBEDDER, "simple", limit=5)
    found = results.select("request_id", "search_type", "id", "rank_no", F.lit(None).cast("string").alias("error"))
    return found.unionByName(errors.select("request_id", "error"), allowMissingColumns=True)


@check(f"""WITH {RATING_OCC}, {ctes(requests=NAME_REQUESTS, shelf=PRODUCTS)}, {ranked('requests')},
    t AS ({RATING_TEXT.replace('FROM ratings', 'FROM items')}), {hashed('t', 'id', 'text', 'e')},
    named AS (SELECT r.request_id, r.id, row_number() OVER (PARTITION BY r.request_id ORDER BY r.rank DESC, r.id) AS rn
              FROM ranked r JOIN items i USING (id) JOIN requests q USING (request_id)
              WHERE list_has_all(string_split(lower(i.title), ' '), string_split(lower(q.q), ' '))
                AND len(string_split(q.q, ' ')) / len(string_split(i.title, ' ')) >= 0.6),
    d AS (SELECT n.request_id, o.id, {distance('s.embedding', 'o.embedding')} AS distance
          FROM named n JOIN e s ON s.id = n.id, e o WHERE n.rn = 1 AND o.id <> n.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS rn FROM d QUALIFY rn <= 10)
    SELECT request_id, id, title, author, floor((1 - distance) * 1000 + 0.5) / 1000 AS similarity,
           isbn <> '' AND isbn IN (SELECT isbn FROM shelf) AS available FROM r JOIN items USING (id)""")
def similar_by_name(spark, sf):
    ratings, items = view(spark, sf, RATINGS), view(spark, sf, PRODUCTS)
    index = stage(build_index(spread(ratings, "id"), RATING_FIELDS, "simple"))
    item_index = stage(build_index(spread(items, "id"), ITEM_FIELDS, "simple"))
    vectors = stage(embed(rating_text(ratings), "text", EMBEDDER))
    found = similar(view(spark, sf, NAME_REQUESTS), ratings, index, items, item_index, vectors, EMBEDDER, "simple")
    return found.results.select("request_id", "id", "title", "author", "similarity", "available")


PAGE_REQUESTS = """
    SELECT concat(cast(conv_id AS string), '/', cast(turn AS string)) AS request_id, cast(conv_id AS string) AS doc_id, text AS q
    FROM {conversations} WHERE role = 'user'"""


@check(f"""WITH {ctes(pages=DOC_PAGES, requests=PAGE_REQUESTS)},
    p AS (SELECT doc_id || '#' || page_number AS k, * FROM pages),
    {hashed('p', 'k', 'content', 'e')}, {hashed('requests', 'request_id', 'q', 'h')},
    d AS (SELECT r.request_id, p.doc_id, p.page_number, {distance('h.embedding', 'e.embedding')} AS distance
          FROM requests r JOIN h USING (request_id) JOIN p ON p.doc_id = r.doc_id JOIN e ON e.k = p.k),
    n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY isnan(distance), distance, page_number) AS rank_no FROM d)
    SELECT request_id, doc_id, page_number::bigint AS page_number, rank_no, round(distance, 4) AS distance FROM n WHERE rank_no <= 3""")
def search_pages(spark, sf):
    pages = view(spark, sf, DOC_PAGES).withColumn("embedding", F.lit(None).cast("array<float>"))
    filled = stage(embed_pages(pages, EMBEDDER))
    found = page_search(view(spark, sf, PAGE_REQUESTS), filled, EMBEDDER, 3)
    return found.select(
        "request_id", "doc_id", F.col("page_number").cast("long").alias("page_number"), "rank_no",
        F.round("distance", 4).alias("distance"))
