"""Documents to pages and outlines."""

from pyspark.sql import DataFrame, Window, functions as F

from shelfspark.functions.text import decode_entities, trim_blanks

OUTLINE_TOKEN = r'<item page="[0-9]+">.*?</item>|<outline>|</outline>'


def split_pages(docs: DataFrame, separator: str = "\f", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per page, numbered from 1; the empty piece after a final separator is no page."""
    pieces = F.split(F.col(text), separator)
    pages = F.when(
        F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    ).otherwise(pieces)
    split = docs.select(F.col(key).alias("doc_id"), F.posexplode(pages).alias("_at", "content"))
    return split.select("doc_id", (F.col("_at") + 1).alias("page_number"), "content")


def flatten_outline(docs: DataFrame, text: str = "xml", key: str = "doc_id") -> DataFrame:
    """Outline entries (doc_id, seq, depth, parent_seq, title, page) in document order.

    The parent of an entry is the last entry before the section that holds it was opened. Tokens
    before the first <outline> do not count.
    """
    outline = F.when(
        F.col(text).contains("<outline>"), F.expr(f"substring(`{text}`, length(substring_index(`{text}`, '<outline>', 1)) + 1)")
    )
    tokens = docs.select(
        F.col(key).alias("doc_id"),
        F.posexplode(F.regexp_extract_all(outline, F.lit(OUTLINE_TOKEN), F.lit(0))).alias("at", "token"),
    )
    so_far = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("token") == "<outline>", 1).when(F.col("token") == "</outline>", -1).otherwise(0)
    is_item = F.col("token").startswith("<item")
    nested = (
        tokens.withColumn("step", step)
        .withColumn("depth", F.sum("step").over(so_far))
        .withColumn("seq", F.sum(is_item.cast("int")).over(so_far))
    )
    # An opened section belongs to the last entry before it; items look up the section they are in.
    at_depth = Window.partitionBy("doc_id", "depth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    opener = F.when((F.col("step") == 1) & (F.col("depth") > 1) & (F.col("seq") > 0), F.col("seq"))
    # A section without an entry before it hangs from the top, so later lookups must see that too.
    section = F.when(F.col("step") == 1, F.struct(opener.alias("parent")))
    placed = nested.withColumn("section", F.last(section, ignorenulls=True).over(at_depth))
    title = F.regexp_extract("token", r'<item page="[0-9]+">(.*?)</item>', 1)
    return placed.filter(is_item).select(
        "doc_id", F.col("seq").cast("int").alias("seq"), F.col("depth").cast("int").alias("depth"),
        F.col("section.parent").cast("int").alias("parent_seq"),
        decode_entities(trim_blanks(title)).alias("title"),
        F.regexp_extract("token", r'<item page="([0-9]+)"', 1).cast("int").alias("page"),
    )


def nest_outline(outline: DataFrame) -> DataFrame:
    """Outline of each document as one JSON array in document order."""
    entries = F.array_sort(F.collect_list(F.struct("seq", "depth", "parent_seq", "title", "page")))
    return outline.groupBy("doc_id").agg(F.to_json(entries).alias("outline"))
