"""Raw lines to catalogue rows."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from shelfspark.functions.text import (
    clean_lenient, clean_strict, first_present, float_prefix, int_prefix, or_empty, trim_blanks,
)

# Source label and the field names of the item feed.
ITEM_SOURCE = "zlib3"
ITEM_JSON_FIELDS = [
    "zlibrary_id", "z_library_id", "title", "author", "publisher", "language", "year", "extension",
    "filesize_reported", "filesize", "pages", "description", "md5_reported", "md5", "isbns", "isbn",
    "series", "edition",
]
# Element names of the rating feed.
RATING_XML_FIELDS = [
    "title_without_series", "title", "isbn", "isbn13", "publication_year", "description",
    "average_rating", "num_pages", "ratings_count",
]


def _strings(names: list[str]) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


_ITEM_JSON = StructType([StructField("metadata", StructType(_strings(ITEM_JSON_FIELDS))), *_strings(ITEM_JSON_FIELDS)])
_RATING_JSON = StructType([StructField("metadata", StructType(_strings(["id", "record"])))])
_PERSON = StructType(_strings(["name"]))
_BOOK = [*_strings(RATING_XML_FIELDS),
         StructField("authors", StructType([StructField("author", ArrayType(_PERSON))]))]
_RATING_XML = StructType([StructField("book", StructType(_BOOK)), *_BOOK])


def _read_json(lines: DataFrame, schema: StructType) -> DataFrame:
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.withColumn("_json", parsed)


def _is_bad() -> Column:
    """Whether `value` is not JSON at all; valid JSON of another shape merely lacks the fields that are read."""
    # Spark's parsers leave what follows a first value unread. Inside brackets only `]` could hide a rest, inside braces
    # only `,` or `}`, so a line that is one value in both holds nothing else.
    whole = """json_array_length(concat('[', value, ']')) = 1
        AND get_json_object(concat('{"v":', value, '}'), '$') IS NOT NULL"""
    # The first test refuses objects that name a key twice, which are valid; the second one reads them.
    strict = """try_parse_json(value) IS NOT NULL
        OR from_json(concat('{"v":', value, ',"read":1}'), 'v STRING, read INT',
                     map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')).read = 1"""
    return F.expr(f"NOT coalesce({whole} AND ({strict}), false)")


def _good(read: DataFrame, mode: str) -> DataFrame:
    if mode == "fail":
        message = F.concat(F.lit("invalid JSON line: "), or_empty(F.col("value")))
        checked = F.when(_is_bad(), F.raise_error(message).cast(read.schema["_json"].dataType))
        return read.withColumn("_json", checked.otherwise(F.col("_json")))
    if mode == "quarantine":
        return read.filter(~_is_bad())
    raise ValueError(f"unknown mode {mode!r}, expected 'fail' or 'quarantine'")


def quarantine(lines: DataFrame) -> DataFrame:
    """Lines that are not valid JSON, whatever feed they belong to."""
    return lines.filter(_is_bad())


def _order_columns(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c != "value"]


def parse_items(lines: DataFrame, mode: str = "fail") -> DataFrame:
    """Item rows of JSON lines (`value`); other columns of `lines` are passed through for ordering."""
    read = _good(_read_json(lines, _ITEM_JSON), mode)
    root = F.struct(*[F.col(f"_json.{n}").alias(n) for n in ITEM_JSON_FIELDS])
    rows = read.withColumn("_m", F.coalesce(F.col("_json.metadata"), root))

    def field(*names: str) -> Column:
        return F.coalesce(*[F.col(f"_m.{n}") for n in names], F.lit(""))

    isbns = F.col("_m.isbns")
    first_isbn = F.get(F.from_json(isbns, ArrayType(StringType())), F.lit(0))
    size = F.coalesce(F.col("_m.filesize_reported"), F.col("_m.filesize"))
    return rows.select(
        *_order_columns(lines),
        F.lit(ITEM_SOURCE).alias("source"),
        field("zlibrary_id", "z_library_id").alias("source_id"),
        clean_strict(trim_blanks(field("title"))).alias("title"),
        trim_blanks(field("title")).alias("_raw_title"),
        clean_strict(field("author")).alias("author"),
        clean_strict(field("publisher")).alias("publisher"),
        field("language").alias("language"),
        field("year").alias("year"),
        field("extension").alias("extension"),
        F.coalesce(size.try_cast("double").cast("long"), F.lit(0).cast("long")).alias("filesize"),
        field("pages").alias("pages"),
        clean_strict(field("description")).alias("description"),
        field("md5_reported", "md5").alias("md5"),
        F.when(isbns.startswith("["), or_empty(first_isbn)).otherwise(field("isbn")).alias("isbn"),
        clean_strict(field("series")).alias("series"),
        clean_strict(field("edition")).alias("edition"),
    ).filter("_raw_title <> ''").drop("_raw_title")


def parse_ratings(lines: DataFrame, mode: str = "fail") -> DataFrame:
    """Rating rows of JSON lines that hold an XML record; lines without a record are dropped."""
    read = _good(_read_json(lines, _RATING_JSON), mode)
    records = read.select(
        *_order_columns(lines),
        or_empty(F.col("_json.metadata.id")).alias("source_id"),
        F.col("_json.metadata.record").alias("_record"),
    ).filter("_record <> ''")
    first_tag = F.regexp_extract("_record", r"<([A-Za-z_][\w.\-]*)", 1)
    parsed = records.withColumn("_tag", first_tag).withColumn("_xml", F.from_xml("_record", _RATING_XML))
    bare = F.struct(*[F.col(f"_xml.{f.name}").alias(f.name) for f in _BOOK])
    rows = parsed.withColumn("_b", F.when(F.col("_tag") == "book", bare).otherwise(F.col("_xml.book")))

    def field(*names: str) -> Column:
        return first_present(*[trim_blanks(F.col(f"_b.{n}")) for n in names])

    author = F.get(F.col("_b.authors.author"), F.lit(0))["name"]
    return rows.select(
        *_order_columns(lines),
        "source_id",
        clean_lenient(field("title_without_series", "title")).alias("title"),
        clean_lenient(trim_blanks(author)).alias("author"),
        float_prefix(field("average_rating")).cast("float").alias("rating"),
        int_prefix(field("ratings_count"), 0).cast("int").alias("ratings_count"),
        clean_lenient(field("description")).alias("description"),
        F.lit("").alias("genres"),
        field("isbn13", "isbn").alias("isbn"),
        field("num_pages").alias("pages"),
        field("publication_year").alias("year"),
    )
