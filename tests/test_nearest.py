import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions.vectors import cosine_distance, format_vector, parse_vector, similarity
from shelfspark.operators.embedding import (
    ContextLengthError, HashingEmbedder, check_model, embed, embed_missing, embed_with_backoff, export_vectors,
    read_exported, restore_vectors,
)
from shelfspark.operators.nearest import build_ivf, knn_join, list_count, topk_exact, topk_grouped, topk_ivf


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(300, 8)).astype(np.float32)
    matrix[50:60] = matrix[40]  # equal distances
    matrix[70] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return matrix, spark.createDataFrame(rows, "id LONG, embedding ARRAY<FLOAT>").cache()


def brute(matrix, queries, k):
    out = {}
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = matrix.astype(float) / np.linalg.norm(matrix.astype(float), axis=1, keepdims=True)
    for q in queries:
        distance = np.round(1 - unit @ unit[q], 9)
        out[q] = sorted(range(len(matrix)), key=lambda i: (np.isnan(distance[i]), distance[i], i))[:k]
    return out


@pytest.mark.parametrize("tile_rows,block_rows", [(32768, 4096), (16, 7), (1000, 3), (10, 1000)])
def test_exact_equals_brute_force(spark, data, tile_rows, block_rows):
    matrix, vectors = data
    wanted = [0, 7, 40, 55, 299]
    queries = vectors.filter(F.col("id").isin(wanted)).withColumnRenamed("id", "query_id")
    got = {}
    for r in topk_exact(vectors, queries, 15, tile_rows=tile_rows, block_rows=block_rows).orderBy("rank_no").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute(matrix, wanted, 15)


def test_more_wanted_than_there_are(spark, data):
    _, vectors = data
    few = vectors.filter("id BETWEEN 69 AND 72")
    queries = vectors.filter("id = 1").withColumnRenamed("id", "query_id")
    got = topk_exact(few, queries, 10).orderBy("rank_no").collect()
    assert len(got) == 4 and got[-1].id == 70 and np.isnan(got[-1].distance)
    assert topk_exact(few.filter("id < 0"), queries, 10).count() == 0
    assert topk_exact(few, queries.filter("query_id < 0"), 10).count() == 0


def test_grouped(spark, data):
    matrix, vectors = data
    parted = vectors.withColumn("part", F.col("id") % 3)
    queries = parted.filter("id IN (4, 5)").withColumnRenamed("id", "query_id").withColumn("query_id", F.col("query_id").cast("string"))
    got = {}
    for r in topk_grouped(parted, queries, 5, "part", tile_rows=20).orderBy("rank_no").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in (4, 5):
        own = [i for i in brute(matrix, [q], 300)[q] if i % 3 == q % 3][:5]
        assert got[str(q)] == own


def test_ivf_with_all_lists_is_exact(spark, data):
    matrix, vectors = data
    listed, centroids = build_ivf(vectors, lists=8, iterations=4)
    listed, centroids = listed.cache(), centroids.cache()
    assert listed.count() == 300 and listed.filter("list_id = -1").count() == 1
    exact = {(r.query_id, r.id) for r in knn_join(vectors.filter("id < 20"), vectors, 5).collect()}
    whole = {(r.query_id, r.id) for r in knn_join(vectors.filter("id < 20"), listed, 5, centroids, 8).collect()}
    assert whole == exact
    some = {(r.query_id, r.id) for r in knn_join(vectors.filter("id < 20"), listed, 5, centroids, 3).collect()}
    assert len(some & exact) / len(exact) > 0.4


def test_list_count():
    assert (list_count(10), list_count(11_000_000)) == (100, 3317)


def test_column_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], "[0.5,-2]")], "a ARRAY<FLOAT>, b ARRAY<FLOAT>, t STRING")
    row = df.select(
        cosine_distance(F.col("a"), F.col("b")).alias("d"), similarity(F.lit(0.0405)).alias("s"),
        parse_vector(F.col("t")).alias("v"), format_vector(F.col("a")).alias("x")).first()
    assert abs(row.d - 0.04) < 1e-12 and row.s == 0.96 and row.v == [0.5, -2.0] and row.x == "[3.0,4.0]"


class Counting:
    name, dim = "counting", 2

    def embed(self, texts):
        if max(map(len, texts)) > 10:
            raise ContextLengthError()
        return np.array([[len(t), 1.0] for t in texts])


def test_backoff():
    whole = embed_with_backoff(Counting(), ["a" * 35, "b", "cc"])
    assert whole.shape == (3, 2) and whole[1:, 0].tolist() == [1, 2]
    assert abs(float((whole[0] ** 2).sum()) - 1) < 1e-9

    class Never(Counting):
        def embed(self, texts):
            raise ContextLengthError()

    with pytest.raises(ContextLengthError):
        embed_with_backoff(Never(), ["abc"])


def test_hashing_embedder(spark):
    df = spark.createDataFrame([(1, "Sea ship sea"), (2, ""), (3, "sea SHIP, sea!")], "id LONG, text STRING")
    got = {r.id: r.embedding for r in embed(df, "text", HashingEmbedder(16)).collect()}
    assert got[1] == got[3] and got[2] == [0.0] * 16
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6


def test_embed_missing_and_model_check(spark):
    class Model:
        name, dim = "counting", 2

        def embed(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    texts = spark.createDataFrame([(i, "x" * i) for i in range(1, 31)], "id LONG, text STRING")
    have = spark.createDataFrame([(1, [1.0, 1.0], "counting"), (2, None, "counting")], "id LONG, embedding ARRAY<FLOAT>, model STRING")
    made = embed_missing(texts, have, Model())
    assert made.count() == 29 and made.filter("model <> 'counting'").count() == 0
    assert sorted(r.id for r in embed_missing(texts, have, Model(), 3).collect()) == [2, 3, 4]
    check_model(have, "counting")
    with pytest.raises(ValueError, match="mismatch"):
        check_model(have, "other")


def test_export_and_restore(spark, tmp_path):
    schema = "id LONG, embedding ARRAY<FLOAT>, model STRING"
    have = spark.createDataFrame([(1, [0.5, 1.0], "m"), (2, None, "m"), (9, [1.0, 0.0], "m")], schema)
    export_vectors(have, f"{tmp_path}/v")
    cache = read_exported(spark, f"{tmp_path}/v")
    rows = spark.createDataFrame([(1,), (2,)], "id LONG")
    empty = spark.createDataFrame([], schema)
    assert [tuple(r) for r in restore_vectors(rows, empty, cache, "m").collect()] == [(1, [0.5, 1.0], "m")]
    assert restore_vectors(rows, have, cache, "m").count() == 3


@pytest.mark.parametrize("dim", [3, 64])
def test_the_best_of_a_block_are_those_of_brute_force(dim):
    from shelfspark.operators.nearest import _BestK

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(700, dim))
    vectors[100:400] = vectors[0] + 1e-6 * rng.normal(size=(300, dim))
    vectors[[7, 8]] = 0.0
    queries = np.concatenate([vectors[:20], rng.normal(size=(10, dim))])
    best = _BestK(list(range(30)), queries, 6)
    places = np.arange(0, 30, 2)
    for start in range(0, 700, 50):
        best.offer(np.arange(start, start + 50), vectors[start:start + 50], None, places)
    best._trim()
    with np.errstate(invalid="ignore"):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        asked = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    for q in range(30):
        distances = np.nan_to_num(np.round(1 - unit @ asked[q], 9), nan=np.inf)
        wanted = np.lexsort((np.arange(700), distances))[:6].tolist() if q % 2 == 0 else []
        assert best.ids[best.rows == q].tolist() == wanted
