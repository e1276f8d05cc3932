import zlib

import numpy as np
import pytest
from llm_samples import SCHEMA, empty, messy, rows_of

from shelfspark.llm import language, quality

SF_DIR = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


@pytest.fixture(scope="module")
def machine(spark):
    return quality.train(table(spark, "documents"), table(spark, "labels"))


@pytest.fixture(scope="module")
def identifier(spark):
    return language.train(table(spark, "documents"))


def test_quality_of_held_out_documents(spark, machine):
    scored = quality.score_documents(table(spark, "documents"), machine).toPandas()
    truth = table(spark, "labels").toPandas()
    held = scored.merge(truth, on="doc_id")
    held = held[held.held_out]
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in scored.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 0].predicted.mean() < 0.2 and scored.score.between(0, 1).all()


def test_pairs_by_the_identity_equal_pairs_one_by_one(machine):
    for text in ("a few plain words here", "### *** $$$ 12 12", ""):
        buckets, weights, stats = quality.describe(text, None)
        x = np.concatenate([weights, np.clip((stats - machine.mean) / machine.scale, -6, 6)])
        at = [*buckets, *range(quality.BUCKETS, quality.BUCKETS + quality.STATS)]
        y = machine.bias + x @ machine.linear[at]
        for i in range(len(at)):
            for j in range(i):
                y += float(machine.factors[at[i]] @ machine.factors[at[j]]) * x[i] * x[j]
        assert abs(machine.scores([(buckets, weights, stats)])[0] - 1 / (1 + np.exp(-np.clip(y, -30, 30)))) < 1e-9


def test_quality_ignores_what_it_must_not_see(spark, machine):
    docs = table(spark, "documents").limit(50)
    changed = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source", "n_chars")
    a = rows_of(quality.score_documents(docs, machine), "doc_id", "score")
    assert a == rows_of(quality.score_documents(changed, machine), "doc_id", "score")


def test_quality_edges(spark, machine):
    docs = messy(spark)
    scored = quality.score_documents(docs, machine).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in scored)
    kept = quality.keep_good(docs, machine)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in scored)
    assert quality.score_documents(empty(spark), machine).count() == 0


def test_quality_without_labels(spark):
    for rows in ([], [(None, 1, 0), (1, None, 0)]):
        labels = spark.createDataFrame(rows, "doc_id LONG, quality INT, toxic INT")
        found = quality.train(messy(spark), labels)
        assert {r.score for r in quality.score_documents(messy(spark), found).collect()} == {0.5}
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (4, 1, 0)], "doc_id LONG, quality INT, toxic INT")
    assert quality.score_documents(messy(spark), quality.train(messy(spark), labels)).count() == messy(spark).count()


def test_language_of_held_out_documents(spark, identifier):
    found = language.predict_languages(table(spark, "documents"), identifier).toPandas()
    truth = table(spark, "documents").select("doc_id", "lang").toPandas()
    held = found.merge(truth, on="doc_id")
    held = held[held.held_out]
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert (held.lang_pred == held.lang).mean() > 0.97 and found.score.between(0, 1).all()


def test_words_add_up_to_the_profile(identifier):
    reader = language.Reader(identifier)
    for text in ("Die Schiffe fahren", "le bateau à l'eau " * 50, "x" * 5000):
        counts = language.profile(text)
        margins = counts @ identifier.weights / counts.sum() + identifier.bias
        (lang, score, _), = reader.predict_all([text])
        assert lang == identifier.decode(margins)[0] and abs(score - identifier.decode(margins)[1]) < 1e-3


def test_language_edges(spark, identifier):
    docs = messy(spark)
    found = language.predict_languages(docs, identifier).collect()
    known = {*identifier.languages, "und"}
    assert len(found) == docs.count() and all(r.lang_pred in known and 0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (0, 1, 2)) and by_id[3].lang_pred != "und"
    assert language.predict_languages(empty(spark), identifier).count() == 0


def test_language_without_examples(spark):
    nothing = language.train(empty(spark))
    assert {r.lang_pred for r in language.predict_languages(messy(spark), nothing).collect()} == {"und"}
    alone = spark.createDataFrame([(i, "alpha beta", "aa") for i in range(8)], "doc_id LONG, text STRING, lang STRING")
    assert {r.lang_pred for r in language.predict_languages(alone, language.train(alone)).collect()} == {"aa"}


def test_codewords_are_apart():
    for n in (2, 4, 20):
        words = language.codewords(n)
        assert len({tuple(w) for w in words}) == n


def test_samples_stay_small_where_ids_are_null_or_repeated(spark, monkeypatch):
    """What reaches the driver is bounded by distinct rows of the sample, whatever ids are."""
    taken = []
    fit = language.fit
    monkeypatch.setattr(language, "fit", lambda profiles, langs: taken.append(len(langs)) or fit(profiles, langs))
    texts = [f"the whale number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {'sea' * (i % 7)}" for i in range(3000)]
    null_ids = spark.createDataFrame([(None, t, "en") for t in texts], "doc_id LONG, text STRING, lang STRING")
    language.train(null_ids, per_language=64)
    repeated = spark.createDataFrame([(8, "one and the same", "en")] * 2000, "doc_id LONG, text STRING, lang STRING")
    language.train(repeated, per_language=2000)
    assert 20 < taken[0] < 160 and taken[1] <= 1
    again = spark.createDataFrame([(i % 40, f"row {i}", 5) for i in range(4000)], "doc_id LONG, text STRING, n_chars LONG")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id LONG, quality INT")
    seen = []
    monkeypatch.setattr(quality, "fit_machine", lambda rows, truth: seen.append(len(rows)))
    quality.train(again, labels)
    assert 20 <= seen[0] <= 40
