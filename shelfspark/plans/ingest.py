"""One ingest run: find the feeds, parse, merge, embed and note the outcome."""

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.operators.embedding import (
    check_model, embed_missing, export_vectors, rating_text, read_exported, restore_vectors,
)
from shelfspark.operators.filters import has_vector
from shelfspark.operators.fulltext import build_index, update_index, write_index
from shelfspark.operators.merge import (
    dedupe_last, invalidate_vectors, number_new_rows, split_blank_keys, upsert,
)
from shelfspark.operators.parse import parse_items, parse_ratings, quarantine
from shelfspark.schemas import ITEM_FIELDS, ITEM_VALUES, ITEMS, RATING_FIELDS, RATING_VALUES, RATINGS, VECTORS
from shelfspark.sources.discovery import discover_input, newest_input
from shelfspark.sources.lines import limit_accepted, window_lines
from shelfspark.sources.meta import meta_delete, meta_get, meta_put, meta_read
from shelfspark.sources.seekable import read_seekable_jsonl
from shelfspark.sources.storage import read_snapshot, snapshot_versions, stage, step, write_snapshot

# Name parts of the two feeds.
ITEM_FEED = "zlib3_records"
RATING_FEED = "goodreads_records"

MAX_ERROR_CHARS = 500
ORDER = ["file", "pos"]
STATUS = """
    started_at STRING, finished_at STRING, error STRING, items_file STRING, items_count LONG,
    ratings_count LONG, rejected LONG, embedded LONG, restored LONG
"""


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def merge_feed(
    target: DataFrame, rows: DataFrame, values: list[str], order: list[str], keep_blank_key: bool = False,
    now: Column | None = None,
) -> DataFrame:
    """Target with the last row per source_id merged in and new rows numbered.

    Rows without a source_id are left out (see `rejects`) or, on request, count as one row. `now` dates what changes.
    """
    if not keep_blank_key:
        rows, _ = split_blank_keys(rows, "source_id")
    latest = dedupe_last(rows, ["source_id"], order).drop(*order)
    merged = upsert(target, latest, ["source_id"], values, F.current_timestamp() if now is None else now)
    return number_new_rows(stage(merged), ["source_id"])


def rejects(lines: DataFrame, rows: DataFrame, order: list[str], mode: str, keep_blank_key: bool = False) -> DataFrame:
    """What a feed holds but the table will not: invalid lines, and rows without a source_id as JSON."""
    out = []
    if mode == "quarantine":
        out.append(quarantine(lines).select(*order, F.lit("invalid JSON").alias("reason"), "value"))
    if not keep_blank_key:
        _, blank = split_blank_keys(rows, "source_id")
        packed = F.to_json(F.struct(*[c for c in rows.columns if c not in order]))
        out.append(blank.select(*order, F.lit("no source_id").alias("reason"), packed.alias("value")))
    return reduce(DataFrame.unionByName, out) if out else lines.limit(0).select(*order, F.lit("").alias("reason"), "value")


def _import(
    spark: SparkSession, path: str, root: str, name: str, schema: str, parse, values: list[str],
    limit: int | None, mode: str, keep_blank_key: bool, fields: list[tuple[str, str]], config: str | None,
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Merge one feed into the newest version of its table: (before, after, rows that changed, rejected rows).

    The rows that changed are those dated with this merge; with a text configuration the stored postings follow.
    """
    moment = datetime.now(timezone.utc)
    now = F.lit(moment)
    lines = window_lines(read_seekable_jsonl(spark, path))
    rows = limit_accepted(parse(lines, mode), limit)
    table, refused = f"{root}/{name}", f"{root}/rejected/{name}"
    before = read_snapshot(spark, table, schema)
    with step(spark):
        rejects(lines, rows, ORDER, mode, keep_blank_key).write.mode("overwrite").parquet(refused)
        write_snapshot(merge_feed(before, rows, values, ORDER, keep_blank_key, now), table)
    after = read_snapshot(spark, table, schema)
    changed = after.filter(F.col("updated_at") == now)
    if config is not None:
        # Rows dated after the last update of the index, so that a run that failed in between leaves none out.
        index, indexed = f"{root}/index/{name}", meta_get(meta_read(spark, f"{root}/notes"), f"{name}_indexed")
        with step(spark):
            if indexed is None:
                write_index(build_index(after, fields, config), index)
            else:
                update_index(index, after.filter(F.col("updated_at") > F.lit(indexed).cast("timestamp")), fields, config)
        meta_put(spark, f"{root}/notes", {f"{name}_indexed": moment.isoformat()})
    return before, after, changed, spark.read.parquet(refused).count()


def run_ingest(
    spark: SparkSession, inputs: str, root: str, embedder=None, limit: int | None = None,
    mode: str = "fail", keep_blank_key: bool = False, vector_cache: str | None = None,
    item_feed: str = ITEM_FEED, rating_feed: str = RATING_FEED, text_config: str | None = None,
) -> DataFrame:
    """Bring the tables under `root` up to date with the feeds in `inputs`; returns a status row.

    Feeds finished by an earlier run are skipped until newer files appear. Every table is replaced
    as a whole version, so a run that fails half-way leaves the previous version in use. Lines and
    rows that cannot be stored are kept under `root`/rejected. With `text_config` the postings under `root`/index follow
    the tables. With `vector_cache` the vectors are exported there at the end of a run that embedded some.
    """
    notes = f"{root}/notes"
    status = dict.fromkeys(["started_at", "finished_at", "error", "items_file", "items_count", "ratings_count", "rejected", "embedded", "restored"])
    status["started_at"] = _now()

    newest = newest_input(spark, inputs)
    seen = meta_get(meta_read(spark, notes), "newest_input")
    changed = newest is not None and (seen is None or newest.isoformat() > seen)
    if changed:
        meta_delete(spark, notes, ["items_done", "ratings_done"])
    meta_put(spark, notes, {"run_started": status["started_at"], "run_finished": "", "run_error": ""})
    try:
        done = meta_read(spark, notes)
        if newest is not None and meta_get(done, "items_done") != "true":
            path = discover_input(spark, inputs, item_feed)
            highest = read_snapshot(spark, f"{root}/items", ITEMS).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            remaining = None if limit is None else limit - highest
            if remaining is None or remaining > 0:
                _, after, _, refused = _import(
                    spark, path, root, "items", ITEMS, parse_items, ITEM_VALUES, remaining, mode, keep_blank_key,
                    ITEM_FIELDS, text_config,
                )
                status["rejected"] = refused
                status["items_file"] = path.rsplit("/", 1)[-1]
                status["items_count"] = after.count()
                meta_put(spark, notes, {"items_count": str(status["items_count"])})
            if limit is None:
                meta_put(spark, notes, {"items_done": "true"})
        if newest is not None and meta_get(done, "ratings_done") != "true":
            path = discover_input(spark, inputs, rating_feed)
            before, after, changed_rows, refused = _import(
                spark, path, root, "ratings", RATINGS, parse_ratings, RATING_VALUES, limit, mode, keep_blank_key,
                RATING_FIELDS, text_config,
            )
            status["rejected"] = (status["rejected"] or 0) + refused
            if snapshot_versions(spark, f"{root}/vectors"):
                vectors = read_snapshot(spark, f"{root}/vectors", VECTORS)
                with step(spark):
                    write_snapshot(invalidate_vectors(vectors, before, changed_rows), f"{root}/vectors")
            status["ratings_count"] = after.count()
            meta_put(spark, notes, {"ratings_count": str(status["ratings_count"])})
            if limit is None:
                meta_put(spark, notes, {"ratings_done": "true"})
        if limit is None and changed:
            meta_put(spark, notes, {"newest_input": newest.isoformat()})
        if embedder is not None:
            status["embedded"], status["restored"] = embed_table(spark, root, embedder, vector_cache)
            if vector_cache is not None and status["embedded"]:
                export_vectors(read_snapshot(spark, f"{root}/vectors", VECTORS), vector_cache)
    except Exception as e:
        text = str(e)
        short = text if len(text) <= MAX_ERROR_CHARS else text[:MAX_ERROR_CHARS] + "…"
        meta_put(spark, notes, {"run_finished": _now(), "run_error": short})
        raise
    status["finished_at"] = _now()
    meta_put(spark, notes, {"run_finished": status["finished_at"]})
    return spark.createDataFrame([tuple(status.values())], STATUS)


def embed_table(
    spark: SparkSession, root: str, embedder, cache: str | None = None, limit: int | None = None
) -> tuple[int, int]:
    """Embed the rating rows that have no vector, after restoring exported vectors if there are none at all.

    Returns the numbers of embedded and of restored rows.
    """
    with step(spark):
        ratings = read_snapshot(spark, f"{root}/ratings", RATINGS)
        vectors = read_snapshot(spark, f"{root}/vectors", VECTORS)
        check_model(vectors, embedder.name)
        restored = 0
        if cache is not None and has_vector(vectors).isEmpty():
            vectors = stage(restore_vectors(ratings, vectors, read_exported(spark, cache), embedder.name))
            restored = vectors.count()
        made = stage(embed_missing(rating_text(ratings, getattr(embedder, "max_chars", None)), vectors, embedder, limit))
        embedded = made.count()
        if embedded or restored:
            write_snapshot(has_vector(vectors).unionByName(made), f"{root}/vectors")
    return embedded, restored
