"""Pages, outlines and search inside documents."""

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions.text import present
from shelfspark.operators.embedding import embed
from shelfspark.operators.lookups import first_rows
from shelfspark.operators.nearest import topk_grouped
from shelfspark.operators.pages import nest_outline
from shelfspark.sources.storage import stage


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("pages_extracted"), F.count("embedding").alias("pages_embedded")
    )


def page_text(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """Text of (doc_id, page_number), with the reason where there is none."""
    found = keys.join(pages.select("doc_id", "page_number", "content"), ["doc_id", "page_number"], "left")
    error = (
        F.when(F.col("page_number").isNull() | (F.col("page_number") < 1), "invalid page number")
        .when(F.col("content").isNull(), "page not found")
    )
    return found.select(
        "doc_id", "page_number", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error")
    )


def page_search(
    requests: DataFrame, pages: DataFrame, embedder, limit: int = 5
) -> DataFrame:
    """Pages of the requested document nearest to each text (request_id, doc_id, q)."""
    asked = requests.filter(present(F.col("q")))
    texts = embed(asked, "q", embedder, "request_id")
    # Written once: the search counts the queries of each document before it uses them.
    queries = stage(
        texts.join(asked.select("request_id", "doc_id"), "request_id").withColumnRenamed("request_id", "query_id")
    )
    vectors = pages.select("doc_id", F.col("page_number").alias("id"), "embedding")
    found = topk_grouped(vectors, queries, limit, group="doc_id")
    located = found.join(queries.select("query_id", "doc_id"), "query_id").withColumnRenamed("id", "page_number")
    return (
        located.join(pages.select("doc_id", "page_number", "content"), ["doc_id", "page_number"])
        .withColumnRenamed("query_id", "request_id")
    )


def embed_pages(pages: DataFrame, embedder) -> DataFrame:
    """Pages with the missing vectors filled in; existing ones are kept."""
    todo = pages.filter("embedding IS NULL").select(
        F.to_json(F.struct("doc_id", "page_number")).alias("id"), F.col("content").alias("text")
    )
    made = embed(todo, "text", embedder).select(
        F.from_json("id", "doc_id STRING, page_number INT").alias("k"), F.col("embedding").alias("_new")
    ).select("k.doc_id", "k.page_number", "_new")
    filled = pages.join(made, ["doc_id", "page_number"], "left")
    return filled.withColumn("embedding", F.coalesce("embedding", "_new")).select(pages.columns)


def _documents(keys: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Requested documents with their first item row, `known` false where there is none."""
    wanted = keys.select(F.col("doc_id").alias("md5")).distinct()
    rows = first_rows(items, wanted, "md5", list(dict.fromkeys(["id", "md5", *columns])))
    return (
        wanted.join(rows, "md5", "left").withColumn("known", F.col("id").isNotNull())
        .drop("id").withColumnRenamed("md5", "doc_id")
    )


def reader_status(keys: DataFrame, items: DataFrame, pages: DataFrame, outline: DataFrame) -> DataFrame:
    """Collection, extraction and embedding state of each known document, with its outline."""
    docs = _documents(keys, items, ["title", "author", "extension", "downloaded_at"]).filter("known")
    extracted = F.coalesce("pages_extracted", F.lit(0))
    embedded = F.coalesce("pages_embedded", F.lit(0))
    wanted = docs.select("doc_id")
    return (
        docs.join(page_counts(pages.join(wanted, "doc_id", "left_semi")), "doc_id", "left")
        .join(nest_outline(outline.join(wanted, "doc_id", "left_semi")), "doc_id", "left")
        .select(
            "doc_id", "title", "author", "extension",
            F.col("downloaded_at").isNotNull().alias("downloaded"),
            (extracted > 0).alias("indexed"),
            extracted.alias("pages_extracted"), embedded.alias("pages_embedded"),
            ((embedded > 0) & (embedded == extracted)).alias("ready_for_search"),
            F.coalesce("outline", F.lit("[]")).alias("outline"),
        )
    )


def index_eligibility(
    keys: DataFrame, items: DataFrame, pages: DataFrame, force: bool = False
) -> DataFrame:
    """Whether each document may be cut into pages now, and if not, why."""
    docs = _documents(keys, items, ["extension", "downloaded_at"])
    counted = docs.join(page_counts(pages.join(docs.select("doc_id"), "doc_id", "left_semi")), "doc_id", "left")
    extracted = F.coalesce("pages_extracted", F.lit(0))
    reason = (
        F.when(~F.col("known"), "not found")
        .when(F.col("downloaded_at").isNull(), "not downloaded")
        .when(~F.coalesce(F.col("extension") == "pdf", F.lit(False)), "not a pdf")
    )
    if not force:
        reason = reason.when(extracted > 0, "already indexed")
    return counted.select(
        "doc_id", extracted.alias("pages"), reason.isNull().alias("eligible"), reason.alias("reason")
    )


def image_eligibility(keys: DataFrame, items: DataFrame) -> DataFrame:
    """Whether page images of each document can be made, and if not, why."""
    docs = _documents(keys, items, ["extension", "downloaded_at"])
    reason = (
        F.when(~F.col("known"), "not found")
        .when(F.col("downloaded_at").isNull(), "not downloaded")
        .when(~F.coalesce(F.col("extension") == "pdf", F.lit(False)), "not a pdf")
    )
    return docs.select("doc_id", reason.isNull().alias("eligible"), reason.alias("reason"))


def embed_eligibility(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether pages of each document still lack vectors."""
    wanted = keys.select("doc_id").distinct()
    counted = wanted.join(page_counts(pages.join(wanted, "doc_id", "left_semi")), "doc_id", "left")
    total = F.coalesce("pages_extracted", F.lit(0))
    embedded = F.coalesce("pages_embedded", F.lit(0))
    state = F.when(total == 0, "not indexed").when(total == embedded, "complete").otherwise("to do")
    return counted.select("doc_id", total.alias("total"), embedded.alias("embedded"), state.alias("state"))
