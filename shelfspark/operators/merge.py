"""De-duplication, change-detecting upserts and id assignment over table snapshots."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfspark.operators.filters import any_distinct
from shelfspark.operators.paging import first_per_group
from shelfspark.sources.storage import stage

EMBEDDED_TEXT = ["title", "author", "description"]


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in `order`; map tasks keep one row per key before the shuffle."""
    return first_per_group(df, keys, [F.desc(c) for c in order])


def split_blank_keys(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a key, rows whose key is NULL or '')."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    return df.filter(~blank), df.filter(blank)


def compare(target: DataFrame, source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full join of two snapshots, both unique on non-NULL `keys`, with `change_type` of every key."""
    old = target.select(*keys, F.struct(*target.columns).alias("old"))
    new = source.select(*keys, F.struct(*source.columns).alias("new"))
    changed = any_distinct([(F.col(f"old.{c}"), F.col(f"new.{c}")) for c in values])
    change = (
        F.when(F.col("old").isNull(), "inserted")
        .when(F.col("new").isNull(), "kept")
        .when(changed, "updated")
        .otherwise("unchanged")
    )
    return old.join(new, keys, "full").withColumn("change_type", change)


def upsert(
    target: DataFrame, source: DataFrame, keys: list[str], values: list[str], now: Column,
    reset: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Target after the merge: new keys inserted, changed rows rewritten, all others untouched.

    A row counts as changed when some value column is distinct; only then does `updated_at` move.
    `reset` names columns set to NULL when any of the listed columns changed. Target columns the
    source does not have are kept, and NULL for inserted rows.
    """
    rows = compare(target, source, keys, values)
    change, reset = F.col("change_type"), reset or {}
    written = change.isin("inserted", "updated")
    out = []
    for c in target.columns:
        old = F.col(f"old.{c}")
        if c in keys:
            column = F.col(c)
        elif c == "updated_at":
            column = F.when(written, now).otherwise(old)
        elif c == "created_at":
            column = F.when(change == "inserted", now).otherwise(old)
        elif c in reset:
            differs = any_distinct([(F.col(f"old.{d}"), F.col(f"new.{d}")) for d in reset[c]])
            column = F.when((change == "updated") & differs, None).otherwise(old)
        elif c in values or c in source.columns and c != "id":
            new = F.col(f"new.{c}")
            column = F.when(written if c in values else change == "inserted", new).otherwise(old)
        else:
            column = old
        out.append(column.cast(target.schema[c].dataType).alias(c))
    return rows.select(*out)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the source rows whose key it does not hold."""
    absent = source.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(absent, allowMissingColumns=True)


def change_report(target: DataFrame, source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Number of keys per change type; `kept` counts keys the source does not mention."""
    used = [*keys, *values]
    return compare(target.select(used), source.select(used), keys, values).groupBy("change_type").agg(F.count("*").alias("n"))


def invalidate_vectors(
    vectors: DataFrame, old: DataFrame, new: DataFrame, key: str = "id", include_genres: bool = False
) -> DataFrame:
    """Vectors with `embedding` set to NULL where the embedded text changed between two snapshots."""
    texts = EMBEDDED_TEXT + (["genres"] if include_genres else [])
    pairs = [(F.col(f"o.{c}"), F.col(f"n.{c}")) for c in texts]
    stale = (
        old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
        .filter(any_distinct(pairs)).select(F.col(f"o.{key}").alias(key), F.lit(True).alias("_stale"))
    )
    fresh = F.when(F.col("_stale"), None).otherwise(F.col("embedding"))
    return vectors.join(stale, key, "left").withColumn("embedding", fresh).select(vectors.columns)


def assign_ids(df: DataFrame, order: list[str], start: int = 0, id_col: str = "id") -> DataFrame:
    """Number rows start+1, start+2, … in `order`, which must be unique.

    Rows are range-partitioned by the order and written once, so partitions cannot move between
    counting and numbering. The running total is taken over one row per partition.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    # The generated number holds the partition above bit 33 and the row within it below.
    located = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = located.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    # One row per written partition: always small enough to send to every task.
    numbered = located.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(id_col, F.lit(start) + F.col("_offset") + F.col("_row") + 1).drop(
        "_at", "_part", "_row", "_offset"
    )


def number_new_rows(table: DataFrame, order: list[str]) -> DataFrame:
    """Give ids above the highest one to the rows that have none."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = assign_ids(table.filter("id IS NULL").drop("id"), order, top)
    return table.filter("id IS NOT NULL").unionByName(fresh)


def mark_collected(items: DataFrame, keys: DataFrame, when: Column, key: str = "md5") -> DataFrame:
    """Set `downloaded_at` for the listed keys; `when` may use columns of `keys`. Of a repeated key the latest counts."""
    marks = keys.select(F.col(key), when.cast("timestamp").alias("_when")).groupBy(key).agg(F.max("_when").alias("_when"))
    at = F.when(F.col("_when").isNotNull(), F.col("_when")).otherwise(F.col("downloaded_at"))
    return items.join(marks, key, "left").withColumn("downloaded_at", at).select(items.columns)


def unmark_collected(items: DataFrame, keys: DataFrame, key: str = "md5") -> DataFrame:
    marks = keys.select(F.col(key), F.lit(True).alias("_gone")).distinct()
    at = F.when(F.col("_gone"), None).otherwise(F.col("downloaded_at"))
    return items.join(marks, key, "left").withColumn("downloaded_at", at).select(items.columns)


def upsert_pages(pages: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Replace page content by (doc_id, page_number); a changed page loses its outdated vector."""
    return upsert(
        pages, new, ["doc_id", "page_number"], ["content"], now, reset={"embedding": ["content"]}
    )


def set_outline(outline: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the outline of every document the new rows mention; others keep theirs."""
    kept = outline.join(new.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(new)
