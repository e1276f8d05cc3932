"""Reading, discovery, progress and streaming queries."""

import uuid

from pyspark.sql import functions as F

from checks.feeds import write_seekable
from checks.registry import check, table, view
from checks.text_checks import item_lines, rating_lines
from checks.views import ctes
from shelfspark.operators.embedding import HashingEmbedder
from shelfspark.operators.filters import exists_missing, id_after
from shelfspark.operators.fulltext import read_index
from shelfspark.operators.parse import parse_items
from shelfspark.plans.ingest import ITEM_FEED, RATING_FEED, run_ingest
from shelfspark.plans.stats import embedding_progress, stats
from shelfspark.schemas import ITEM_VALUES, ITEMS, RATINGS, VECTORS
from shelfspark.sources.discovery import extract_hosts, latest_release
from shelfspark.sources.lines import slice_in_order, window_lines
from shelfspark.sources.seekable import read_seekable_jsonl
from shelfspark.sources.storage import read_snapshot, work_dir, write_snapshot
from shelfspark.streaming.ingest import ingest_frames, stream_ingest

# Every document with the vector of its id, where there is one.
VECTOR_STATE = "SELECT d.doc_id AS id, e.embedding FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id"
LINK = 'href="/[^"]*"'


def new_folder(spark, name):
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@check("SELECT doc_id::varchar AS source_id, length(text) AS n, 1::bigint AS times FROM documents")
def seekable_read(spark, sf):
    """Every document once, whatever frames and tasks its line falls into."""
    folder = new_folder(spark, "feed")
    write_seekable(item_lines(spark, sf).repartition(4), folder)
    rows = parse_items(window_lines(read_seekable_jsonl(spark, folder, split_bytes=500_000)))
    return rows.groupBy("source_id").agg(
        F.max(F.length("description")).cast("long").alias("n"), F.count("*").alias("times"))


@check("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_type, event_id) AS n FROM events)
    WHERE n > 250 AND n <= 5250""")
def slice_of_lines(spark, sf):
    """Skip and limit over an ordered feed of several files."""
    return slice_in_order(
        table(spark, sf, "events").select("event_type", "event_id"), ["event_type"], "event_id", 250, 5000, span=256)


@check(f"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}')) AS match,
      unnest(range(len(regexp_extract_all(html, '{LINK}')))) AS idx FROM pages),
    f AS (SELECT page_id, match, min(idx) AS idx FROM m GROUP BY page_id, match)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS place, match FROM f""")
def extract_links(spark, sf):
    found = extract_hosts(table(spark, sf, "pages"), LINK)
    return found.select("page_id", F.col("place").cast("long").alias("place"), "match")


MANIFEST = """
    SELECT concat(event_type, '_records__', lpad(cast(event_id AS string), 8, '0')) AS display_name,
           value * 1000000000 AS data_size, value < 30 AS obsolete, event_type FROM {events}"""


@check(f"""WITH {ctes(m=MANIFEST)}, b AS (SELECT event_type, max(display_name) AS display_name FROM m WHERE NOT obsolete GROUP BY event_type)
    SELECT b.event_type || '_records' AS source, b.display_name, round(m.data_size / (1024 * 1024 * 1024), 1) AS size_gib
    FROM b JOIN m USING (display_name)""")
def newest_release(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view", "nothing"]
    return latest_release(view(spark, sf, MANIFEST), [f"{k}_records" for k in kinds])


@check("""SELECT count(*) AS total, count(l.doc_id) AS embedded, max(d.doc_id) AS max_id,
    floor(count(l.doc_id) / count(*) * 1000 + 0.5) / 10 AS percent FROM documents d LEFT JOIN labels l USING (doc_id)""")
def stats_progress(spark, sf):
    labelled = table(spark, sf, "labels").select("doc_id", "quality")
    rows = table(spark, sf, "documents").join(labelled, "doc_id", "left").withColumnRenamed("doc_id", "id")
    return embedding_progress(rows, F.col("quality").isNotNull())


RUN_NOTES = """
    SELECT 'items_count' AS key, cast(count(*) AS string) AS value, timestamp '2024-01-02 00:00:00' AS ts FROM {documents}
    UNION ALL SELECT 'items_count', '1', timestamp '2024-01-01 00:00:00' FROM {region}
    UNION ALL SELECT 'items_done', 'true', timestamp '2024-01-02 00:00:00' FROM {region}
    UNION ALL SELECT 'ratings_count', cast(count(*) AS string), timestamp '2024-01-02 00:00:00' FROM {labels}
    UNION ALL SELECT 'run_started', cast(count(*) AS string), timestamp '2024-01-02 00:00:00' FROM {events}
    UNION ALL SELECT 'run_finished', '', timestamp '2024-01-02 00:00:00' FROM {region}"""


@check("""SELECT (SELECT count(*) FROM documents) AS items_count, 'done' AS items_status, count(*) AS ratings_count,
    'importing' AS ratings_status, count_if(quality = 1)::bigint AS embeddings_count, count(*) AS embeddings_total,
    floor(count_if(quality = 1) / count(*) * 1000 + 0.5) / 10 AS embeddings_percent, 'pending' AS embeddings_status,
    (SELECT count(*)::varchar FROM events) AS started_at, NULL::varchar AS finished_at, NULL::varchar AS error FROM labels""")
def stats_overview(spark, sf):
    vectors = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.array(F.lit(1.0))).alias("embedding"))
    return stats(view(spark, sf, RUN_NOTES), vectors)


@check("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def newest_snapshot(spark, sf):
    """Of two complete versions the reader takes the newer one."""
    root, lines = new_folder(spark, "snapshot"), table(spark, sf, "lineitem")
    write_snapshot(lines.withColumn("l_quantity", F.lit(0.0)), root)
    write_snapshot(lines, root)
    return read_snapshot(spark, root).select("l_orderkey", "l_linenumber", "l_quantity")


LAST_OF_USER = """SELECT user_id::varchar AS source_id, event_type AS title, event_id::varchar AS year FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


def _event_lines(spark, sf):
    """Each user in one partition in time order."""
    events = table(spark, sf, "events").repartition(4, "user_id").sortWithinPartitions("user_id", "ts", "event_id")
    fields = F.struct(F.col("user_id").alias("zlibrary_id"), F.col("event_type").alias("title"), F.col("event_id").alias("year"))
    return events.select(F.to_json(F.struct(fields.alias("metadata"))).alias("value"))


@check(LAST_OF_USER)
def stream_upsert_frames(spark, sf):
    """Events in compressed feed files, read by frames: batches end inside files."""
    folder = new_folder(spark, "frames")
    write_seekable(_event_lines(spark, sf), f"{folder}/in")
    ingest_frames(
        spark, f"{folder}/in", f"{folder}/items", ITEMS, f"{folder}/checkpoint", parse_items, ITEM_VALUES, max_frames=50)
    return read_snapshot(spark, f"{folder}/items", ITEMS).select("source_id", "title", "year")


@check(LAST_OF_USER)
def stream_upsert(spark, sf):
    """Events written as feed files, each user in one file in time order; the stream keeps the last one."""
    folder = new_folder(spark, "events")
    _event_lines(spark, sf).write.text(f"{folder}/in")
    stream_ingest(
        spark, f"{folder}/in", f"{folder}/items", ITEMS, f"{folder}/checkpoint", parse_items, ITEM_VALUES, max_files=2
    ).awaitTermination()
    return read_snapshot(spark, f"{folder}/items", ITEMS).select("source_id", "title", "year")


@check(f"""SELECT 'items' AS kind, row_number() OVER (ORDER BY doc_id::varchar) AS id, doc_id::varchar AS source_id, source AS title FROM documents
    UNION ALL SELECT 'ratings', row_number() OVER (ORDER BY doc_id::varchar), doc_id::varchar, CASE WHEN lang = 'en' THEN lang ELSE source END FROM documents
    UNION ALL SELECT 'vectors', row_number() OVER (ORDER BY doc_id::varchar), NULL, 'hashing-16' FROM documents
    UNION ALL SELECT 'indexed', row_number() OVER (ORDER BY doc_id::varchar), NULL, NULL FROM documents""")
def ingest_run(spark, sf):
    """A whole run from two compressed feeds in parts: discovery, merge, ids, postings and vectors; a second run finds nothing new."""
    folder = new_folder(spark, "run")
    for lines, name in ((item_lines(spark, sf), ITEM_FEED), (rating_lines(spark, sf), RATING_FEED)):
        write_seekable(lines, f"{folder}/in/{name}")
    for _ in range(2):
        status = run_ingest(spark, f"{folder}/in", f"{folder}/tables", HashingEmbedder(16), text_config="simple").first()
    assert (status["items_count"], status["embedded"]) == (None, 0)
    items = read_snapshot(spark, f"{folder}/tables/items", ITEMS)
    ratings = read_snapshot(spark, f"{folder}/tables/ratings", RATINGS)
    vectors = read_snapshot(spark, f"{folder}/tables/vectors", VECTORS)
    words = read_index(spark, f"{folder}/tables/index/items").select("id").distinct()
    none = F.lit(None).cast("string")
    return (
        items.select(F.lit("items").alias("kind"), "id", "source_id", "title")
        .unionByName(ratings.select(F.lit("ratings").alias("kind"), "id", "source_id", "title"))
        .unionByName(vectors.select(F.lit("vectors").alias("kind"), "id", none.alias("source_id"), F.col("model").alias("title")))
        .unionByName(words.select(F.lit("indexed").alias("kind"), "id", none.alias("source_id"), none.alias("title"))))


@check(f"""WITH {ctes(v=VECTOR_STATE)} SELECT id, (SELECT count(*) > 0 FROM v WHERE embedding IS NULL) AS some_missing
    FROM v WHERE id > (SELECT max(id) // 2 FROM v)""")
def ids_after_cursor(spark, sf):
    """Rows above a cursor, and whether any row lacks its vector."""
    rows = view(spark, sf, VECTOR_STATE)
    cursor = rows.agg(F.max("id")).first()[0] // 2
    return id_after(rows, cursor).select("id", F.lit(exists_missing(rows)).alias("some_missing"))
