"""De-duplication, upsert, id and run-note queries."""

import uuid

from pyspark.sql import functions as F

from checks.registry import check, table, view
from checks.views import DOC_PAGES, RATINGS, ctes
from shelfspark.operators.buckets import expire_versions, invalidate_bucketed, read_bucketed, upsert_bucketed, write_bucketed
from shelfspark.operators.filters import at_least, id_in
from shelfspark.operators.merge import (
    assign_ids, change_report, dedupe_last, insert_absent, invalidate_vectors, number_new_rows, set_outline,
    split_blank_keys, upsert, upsert_pages,
)
from shelfspark.sources.meta import meta_current
from shelfspark.sources.storage import stage, work_dir

EVENTS = "SELECT user_id, ts, event_id, event_type, value FROM {events}"
# The table before the merge holds the last event that was no error or signup of users whose such events have a fair
# mean, the feed the last one that was no click of users whose such events have no high mean: most users are in both.
OLD = """
    SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value,
           user_id + 1000 AS id, timestamp '2023-01-01 00:00:00' AS updated_at
    FROM {events} WHERE event_type NOT IN ('error', 'signup') GROUP BY user_id HAVING avg(value) > 45"""
NEW = """
    SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value
    FROM {events} WHERE event_type <> 'click' GROUP BY user_id HAVING avg(value) < 56"""
# Here the means are compared exactly: a sum of doubles depends on the order in which tasks add them, and a mean that is
# just 45 then falls on either side.
EXACT = "sum(cast(value AS decimal(20, 6))) {} * count(value)"
OLD_ROWS = OLD.replace("avg(value) > 45", EXACT.format("> 45"))
NEW_ROWS = NEW.replace("avg(value) < 56", EXACT.format("< 56"))
MERGED = f"""WITH {ctes(o=OLD, n=NEW)}, j AS (
    SELECT coalesce(o.user_id, n.user_id) AS user_id, o.id, o.event_type AS old_type, o.value AS old_value, o.updated_at,
           n.event_type AS new_type, n.value AS new_value,
           CASE WHEN o.user_id IS NULL THEN 'inserted' WHEN n.user_id IS NULL THEN 'kept'
                WHEN o.event_type IS DISTINCT FROM n.event_type OR o.value IS DISTINCT FROM n.value THEN 'updated'
                ELSE 'unchanged' END AS change_type
    FROM o FULL JOIN n ON o.user_id = n.user_id)"""
VALUES = ["event_type", "value"]
NEXT_RATINGS = """
    SELECT p_partkey AS id, p_name AS title, CASE WHEN length(p_name) > 12 THEN concat(p_brand, ' Ltd') ELSE p_brand END AS author,
           CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS description, 'new' AS genres FROM {part}"""


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


@check("""SELECT user_id, event_id, event_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def dedupe_last_event(spark, sf):
    events = view(spark, sf, EVENTS)
    return dedupe_last(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@check(f"""{MERGED} SELECT user_id, id, CASE WHEN change_type IN ('inserted', 'updated') THEN new_type ELSE old_type END AS event_type,
    CASE WHEN change_type IN ('inserted', 'updated') THEN new_value ELSE old_value END AS value,
    CASE WHEN change_type IN ('inserted', 'updated') THEN timestamp '2024-06-01 00:00:00' ELSE updated_at END AS updated_at FROM j""")
def upsert_changed_only(spark, sf):
    return upsert(view(spark, sf, OLD_ROWS), view(spark, sf, NEW_ROWS), ["user_id"], VALUES, now()).select(
        "user_id", "id", "event_type", "value", "updated_at")


@check(f"""{MERGED} SELECT user_id, id, CASE WHEN change_type IN ('inserted', 'updated') THEN new_type ELSE old_type END AS event_type,
    CASE WHEN change_type IN ('inserted', 'updated') THEN new_value ELSE old_value END AS value,
    CASE WHEN change_type IN ('inserted', 'updated') THEN timestamp '2024-06-01 00:00:00' ELSE updated_at END AS updated_at FROM j""")
def upsert_by_bucket(spark, sf):
    """The same merge over a stored table of key buckets, first the inserted half, then all, then all again for nothing."""
    root, source = f"{work_dir(spark)}/users-{uuid.uuid4().hex}", view(spark, sf, NEW_ROWS)
    schema = "user_id LONG, event_type STRING, value DOUBLE, id LONG, updated_at TIMESTAMP"
    write_bucketed(view(spark, sf, OLD_ROWS).withColumn("user_id", F.col("user_id").cast("long")).withColumn("id", F.col("id").cast("long")), root, ["user_id"], 32)
    for rows in (source.filter("user_id % 2 = 0"), source, source):
        last = upsert_bucketed(rows.withColumn("user_id", F.col("user_id").cast("long")), root, schema, ["user_id"], VALUES, now())
    assert last is None
    expire_versions(spark, root, 1)
    return read_bucketed(spark, root, schema).select("user_id", "id", "event_type", "value", "updated_at")


@check(f"""WITH {ctes(o=RATINGS, n=NEXT_RATINGS)} SELECT e.vec_id AS id,
    n.title IS DISTINCT FROM o.title OR n.author IS DISTINCT FROM o.author OR n.description IS DISTINCT FROM o.description AS stale
    FROM embeddings e JOIN o ON o.id = e.vec_id JOIN n ON n.id = e.vec_id""")
def invalidate_by_bucket(spark, sf):
    """Vectors of changed texts nulled in a stored table of key buckets."""
    root = f"{work_dir(spark)}/vectors-{uuid.uuid4().hex}"
    old, new = view(spark, sf, RATINGS), view(spark, sf, NEXT_RATINGS)
    write_bucketed(table(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding"), root, ["id"], 32)
    invalidate_bucketed(root, "id LONG, embedding ARRAY<FLOAT>", old, new)
    both = old.select("id").join(new.select("id"), "id", "left_semi")
    return read_bucketed(spark, root, "id LONG, embedding ARRAY<FLOAT>").join(both, "id", "left_semi").select(
        "id", F.col("embedding").isNull().alias("stale"))


@check(f"{MERGED} SELECT change_type, count(*) AS n FROM j GROUP BY change_type")
def change_counts(spark, sf):
    return change_report(view(spark, sf, OLD_ROWS), view(spark, sf, NEW_ROWS), ["user_id"], VALUES)


@check(f"""{MERGED} SELECT user_id, CASE WHEN change_type = 'inserted' THEN new_type ELSE old_type END AS event_type,
    CASE WHEN change_type = 'inserted' THEN new_value ELSE old_value END AS value FROM j""")
def insert_absent_rows(spark, sf):
    old = view(spark, sf, OLD_ROWS).select("user_id", *VALUES)
    return insert_absent(old, view(spark, sf, NEW_ROWS), ["user_id"])


@check(f"""{MERGED}, top AS (SELECT max(id) AS m FROM o)
    SELECT user_id, coalesce(id, (SELECT m FROM top) + row_number() OVER (PARTITION BY id IS NULL ORDER BY user_id)) AS id FROM j""")
def number_inserted_rows(spark, sf):
    merged = upsert(view(spark, sf, OLD_ROWS), view(spark, sf, NEW_ROWS), ["user_id"], VALUES, now())
    return number_new_rows(stage(merged), ["user_id"]).select("user_id", "id")


@check("SELECT event_id, row_number() OVER (ORDER BY value, event_id) + 500 AS id FROM events")
def assign_event_ids(spark, sf):
    return assign_ids(view(spark, sf, EVENTS).select("event_id", "value"), ["value", "event_id"], 500).select("event_id", "id")


# The rating feed of the next release: larger products get a new description, long names a new author.


@check(f"""WITH {ctes(o=RATINGS, n=NEXT_RATINGS)} SELECT e.vec_id AS id,
    CASE WHEN o.author IS DISTINCT FROM n.author OR o.description IS DISTINCT FROM n.description THEN NULL
         ELSE round(list_sum(e.embedding::double[]), 4) END AS total
    FROM embeddings e LEFT JOIN o ON o.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id""")
def invalidate_changed_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding", "'m' AS model")
    kept = invalidate_vectors(vectors, view(spark, sf, RATINGS), view(spark, sf, NEXT_RATINGS))
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return kept.select("id", F.round(total, 4).alias("total"))


# A second extraction changed the assistant's pages and found one more page per document.
NEW_PAGES = """
    SELECT cast(conv_id AS string) AS doc_id, cast(turn + 1 AS int) AS page_number,
           CASE WHEN role = 'assistant' THEN concat(text, ' (revised)') ELSE text END AS content FROM {conversations}
    UNION ALL SELECT cast(conv_id AS string), cast(max(turn) + 2 AS int), 'end' FROM {conversations} GROUP BY conv_id"""


@check(f"""WITH {ctes(o=DOC_PAGES, n=NEW_PAGES)} SELECT n.doc_id, n.page_number::bigint AS page_number, n.content,
    coalesce(o.content = n.content, false) AS has_vector FROM n LEFT JOIN o USING (doc_id, page_number)""")
def upsert_page_text(spark, sf):
    pages = view(spark, sf, DOC_PAGES).drop("role").withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    merged = upsert_pages(pages, view(spark, sf, NEW_PAGES), now())
    return merged.select(
        "doc_id", F.col("page_number").cast("long").alias("page_number"), "content",
        F.col("embedding").isNotNull().alias("has_vector"))


OUTLINES = """
    SELECT cast(conv_id AS string) AS doc_id, turn + 1 AS seq, concat(role, ' ', cast(turn AS string)) AS title FROM {conversations}"""
NEW_OUTLINES = """
    SELECT cast(conv_id AS string) AS doc_id, count(*) AS seq, 'whole' AS title FROM {conversations}
    GROUP BY conv_id HAVING count(*) > 4"""


@check(f"""WITH {ctes(o=OUTLINES, n=NEW_OUTLINES)}
    SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""")
def replace_outlines(spark, sf):
    return set_outline(view(spark, sf, OUTLINES), view(spark, sf, NEW_OUTLINES))


NOTES = "SELECT event_type AS key, CASE WHEN value > 5 THEN cast(event_id AS string) END AS value, ts FROM {events}"


@check(f"""WITH {ctes(n=NOTES)} SELECT key, value FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, value DESC NULLS LAST) AS rn FROM n) WHERE rn = 1 AND value IS NOT NULL""")
def run_notes_current(spark, sf):
    return meta_current(view(spark, sf, NOTES))


KEYED = "SELECT event_id, CASE WHEN event_type = 'view' THEN '' WHEN event_type <> 'click' THEN event_type END AS source_id FROM {events}"


@check(f"WITH {ctes(k=KEYED)} SELECT event_id FROM k WHERE coalesce(source_id, '') = ''")
def blank_key_rows(spark, sf):
    _, blank = split_blank_keys(view(spark, sf, KEYED), "source_id")
    return blank.select("event_id")


@check(f"""WITH {ctes(r=RATINGS)} SELECT id, title, rating FROM r
    WHERE rating >= 905 AND ratings_count >= 20 AND id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)""")
def rating_filters(spark, sf):
    busy = table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("id"))
    rows = id_in(view(spark, sf, RATINGS), busy)
    return rows.filter(at_least(F.col("rating"), 905) & at_least(F.col("ratings_count"), 20)).select("id", "title", "rating")
