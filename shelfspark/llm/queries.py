"""One query per operator, over whole tables, and SQL where it can say the same."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import (
    bpe, decontaminate, fertility, jaccard, language, license_scan, quality, secret_scan, spelling,
    substring_dedup, token_alignment, token_counts, url_rules,
)
from shelfspark.sources.storage import work_dir

# The stated rules by (host, path).
URL_RULES = {
    ("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts; each call begins with an empty cache of its own, so all distinct texts are encoded."""
    cache = f"{work_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict_languages(docs, language.train(docs))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return fertility.judge_documents(_table(spark, sf_dir, "documents"), file.read())


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_counts(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    ranks = token_alignment.load_byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    return token_alignment.align_tokens(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, model)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f for f in (
        op1_token_counts, op2_byte_bpe, op3_url_rules, op4_quality, op5_language, op6_secrets, op7_licenses,
        op8_jaccard, op9_decontaminate, op10_fertility, op11_substring_dedup,
        op12_token_alignment, op13_spelling,
    )
}

SQL = {
    "op8_jaccard": r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM cut),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.s)""",
    "op11_substring_dedup": r"""
WITH cut AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
runs AS (
    SELECT doc_id, unnest(range(1, len(w) - 18)) AS s,
        unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS run
    FROM cut WHERE len(w) >= 20),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(run) ORDER BY doc_id, s) AS r FROM runs),
gone AS (SELECT DISTINCT doc_id, s + j AS place FROM ranked, (SELECT unnest(range(20)) AS j) WHERE r > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM cut),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
    FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT c.doc_id, len(c.w)::BIGINT AS n_words, (len(c.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
    sha256(coalesce(k.text, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k ON c.doc_id = k.doc_id""",
}
