import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import lists
from shelfspark.operators.lists import assign_lists, fit_centroids, read_figures, read_lists, search_lists, update_lists, write_lists
from shelfspark.operators.nearest import topk_exact

SCHEMA = "id LONG, embedding ARRAY<FLOAT>, rating DOUBLE, reviews INT"


def points(n, seed=1, first=0):
    """Vectors around eight directions, a few null, zero and equal ones, some without a rating."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    out = []
    for i in range(first, first + n):
        v = [m + rng.gauss(0, 0.15) for m in middles[i % 8]]
        out.append((i, None if i % 97 == 5 else [0.0] * 6 if i % 89 == 7 else v, None if i % 11 == 3 else float(i % 5), i % 7))
    return out


def answers(df):
    rows = df.select("query_id", "id", F.when(~F.isnan("distance"), F.round("distance", 6)).alias("d"), "rank_no").collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lists"))
    vectors = spark.createDataFrame(points(900), SCHEMA)
    write_lists(vectors, path, ["rating", "reviews"], lists=24)
    return path, vectors


def queries(spark):
    asked = [(i, v, 2.0 if i % 2 else None, i % 4) for i, v, _, _ in points(40, seed=3) if v and any(v)]
    return spark.createDataFrame(asked, "query_id LONG, embedding ARRAY<FLOAT>, min_rating DOUBLE, min_reviews INT")


def test_each_vector_is_in_one_list_within_its_radius(spark, stored):
    path, vectors = stored
    held = read_lists(spark, path)
    assert held.count() == held.select("id").distinct().count() == vectors.filter("embedding IS NOT NULL").count()
    sizes = {r["list_id"]: r["size"] for r in read_figures(spark, path).collect()}
    counted = {r["list_id"]: r["count"] for r in held.groupBy("list_id").count().collect()}
    assert {k: v for k, v in sizes.items() if v} == counted and 8 <= len(counted) <= 40


def test_search_without_probes_is_exact(spark, stored):
    path, vectors = stored
    asked = queries(spark)
    assert answers(search_lists(spark, path, asked, 5)) == answers(topk_exact(vectors, asked, 5))
    assert answers(search_lists(spark, path, asked, 890)) == answers(topk_exact(vectors, asked, 890))


@pytest.mark.parametrize("most", [0, 1 << 22])
def test_further_lists_and_a_sweep_of_all_vectors_give_the_same(spark, stored, monkeypatch, most):
    path, vectors = stored
    monkeypatch.setattr(lists, "FIRST_PROBES", 1)
    monkeypatch.setattr(lists, "ROUTED_VISITS", most)
    asked = queries(spark)
    assert answers(search_lists(spark, path, asked, 200)) == answers(topk_exact(vectors, asked, 200))


def test_every_vector_is_in_the_list_of_the_nearest_of_all_centres(spark):
    centroids = spark.createDataFrame(
        [(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 1, [0.6, 0.8])], "list_id INT, cell INT, embedding ARRAY<FLOAT>")
    # Its nearest centre is in the cell whose mean is farther away.
    vectors = spark.createDataFrame([(1, [1.0, 0.1])], "id LONG, embedding ARRAY<FLOAT>")
    assert [r["list_id"] for r in assign_lists(vectors, centroids).collect()] == [0]


def test_floors_of_each_query_are_met_exactly(spark, stored):
    path, vectors = stored
    asked = queries(spark)
    found = search_lists(spark, path, asked, 5, ["min_rating", "min_reviews"])
    marked = vectors.withColumn("marks", F.array(F.col("rating"), F.col("reviews").cast("double")))
    floored = asked.withColumn("floors", F.array(F.coalesce("min_rating", F.lit(float("-inf"))), F.col("min_reviews").cast("double")))
    assert answers(found) == answers(topk_exact(marked, floored, 5))
    lowest = found.join(vectors, "id").join(asked.select("query_id", "min_rating", "min_reviews"), "query_id").filter(
        "rating < min_rating OR rating IS NULL AND min_rating IS NOT NULL OR reviews < min_reviews")
    assert lowest.count() == 0


def test_a_few_probes_find_most(spark, stored):
    path, vectors = stored
    asked = queries(spark)
    exact = topk_exact(vectors, asked, 5)
    hits = search_lists(spark, path, asked, 5, probes=4).join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    assert hits >= 0.9 * exact.count()


def test_updates_replace_and_remove(spark, tmp_path):
    path, old = str(tmp_path), points(300)
    write_lists(spark.createDataFrame(old, SCHEMA), path, ["rating", "reviews"], lists=9)
    changed = points(60, seed=9, first=250) + [(3, None, 1.0, 1)]
    update_lists(spark.createDataFrame(changed, SCHEMA), path, ["rating", "reviews"])
    update_lists(spark.createDataFrame([(4, [9.0] + [0.0] * 5, 5.0, 9)], SCHEMA), path, ["rating", "reviews"])
    now = {r[0]: r for r in [*old, *changed, (4, [9.0] + [0.0] * 5, 5.0, 9)]}
    vectors = spark.createDataFrame(list(now.values()), SCHEMA)
    asked = queries(spark)
    assert answers(search_lists(spark, path, asked, 4)) == answers(topk_exact(vectors, asked, 4))
    write_lists(vectors, path, ["rating", "reviews"], lists=9)
    assert answers(search_lists(spark, path, asked, 4)) == answers(topk_exact(vectors, asked, 4))


def test_only_visited_folders_are_read(spark, stored):
    path, _ = stored
    figures = read_figures(spark, path)
    wanted = figures.filter("list_id < 3").select("list_id").distinct()
    text = read_lists(spark, path, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text.lower()


def test_empty_and_tiny_tables(spark, tmp_path):
    path = str(tmp_path)
    write_lists(spark.createDataFrame([], SCHEMA), path)
    asked = queries(spark)
    assert search_lists(spark, path, asked, 3).count() == 0
    one = spark.createDataFrame([(1, [0.0] * 6, 1.0, 1), (2, [1.0] + [0.0] * 5, 1.0, 1)], SCHEMA)
    write_lists(one, path)
    assert {r["id"] for r in search_lists(spark, path, asked, 3).collect()} == {1, 2}


def test_new_vectors_go_to_the_nearest_centre_of_their_cell(spark):
    vectors = spark.createDataFrame(points(400), SCHEMA)
    centroids = fit_centroids(vectors, 16)
    listed = assign_lists(vectors, centroids)
    assert listed.filter("embedding IS NULL").count() == 0
    assert listed.filter("list_id = -1").count() == sum(1 for p in points(400) if p[1] and not any(p[1]))
    assert listed.agg(F.max("angle")).first()[0] < 1.2
