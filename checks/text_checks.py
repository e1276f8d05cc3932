"""Cleaning, normalising, parsing, page and outline queries."""

from pyspark.sql import functions as F

from checks.registry import check, table, view
from checks.views import CONV_ITEMS, DOC_ITEMS, DOC_PAGES, ctes
from shelfspark.functions import text as X
from shelfspark.operators.pages import flatten_outline, split_pages
from shelfspark.operators.parse import parse_items, parse_ratings, quarantine
from shelfspark.plans.reader import embed_eligibility, image_eligibility, index_eligibility, page_text, reader_status

# Document texts with control, astral and replacement characters worked in.
DIRTY = """
    SELECT doc_id, replace(replace(replace(text, 'th', concat('t', chr(7), 'h')), 'o', 'o\U0001f600'), 'a', 'a�') AS t,
           replace(replace(text, 'th', concat('t', chr(7), 'h')), 'o', 'o\U0001f600') AS astral, text FROM {documents}"""
STRICT = r"'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}\x{10000}-\x{10FFFF}]'"


@check(f"WITH {ctes(d=DIRTY)} SELECT doc_id, regexp_replace(text, {STRICT}, '', 'g') AS t FROM d")
def clean_strict(spark, sf):
    return view(spark, sf, DIRTY).select("doc_id", X.clean_strict(F.col("t")).alias("t"))


@check(f"WITH {ctes(d=DIRTY)} SELECT doc_id, replace(astral, '�', '') AS t FROM d")
def clean_lenient(spark, sf):
    return view(spark, sf, DIRTY).select("doc_id", X.clean_lenient(F.col("t")).alias("t"))


@check(f"""WITH {ctes(d=DOC_ITEMS)} SELECT id, concat_ws(' | ', title, nullif(author, ''), description) AS t FROM d""")
def compose_text(spark, sf):
    items = view(spark, sf, DOC_ITEMS)
    text = X.compose_text(F.col("title"), F.col("author"), F.col("description"), F.col("isbn"))
    return items.select("id", text.alias("t"))


HYPHENED = """
    SELECT l_orderkey, l_linenumber, concat('978-', cast(l_partkey AS string), ' - ', lpad(cast(l_suppkey AS string), 5, '0'), '-',
           CASE WHEN l_linenumber = 1 THEN 'X' ELSE cast(l_linenumber AS string) END) AS v FROM {lineitem}"""


@check(f"""WITH {ctes(d=HYPHENED)}, n AS (SELECT *, replace(replace(v, '-', ''), ' ', '') AS isbn FROM d)
    SELECT l_orderkey, l_linenumber, isbn, length(isbn) BETWEEN 10 AND 13 AND NOT contains(isbn, 'X') AS is_isbn FROM n""")
def normalize_isbn(spark, sf):
    return view(spark, sf, HYPHENED).select(
        "l_orderkey", "l_linenumber", X.normalize_isbn(F.col("v")).alias("isbn"), X.is_isbn_query(F.col("v")).alias("is_isbn"))


NUMBERS = """
    SELECT event_id, concat(' ', cast(value AS string), 'x', event_type) AS s, event_type AS none, value FROM {events}"""


@check(f"WITH {ctes(n=NUMBERS)} SELECT event_id, nullif(value, 0) AS f, trunc(value)::bigint AS i, 7::bigint AS d FROM n")
def parse_number_prefix(spark, sf):
    return view(spark, sf, NUMBERS).select(
        "event_id", X.float_prefix(F.col("s")).alias("f"), X.int_prefix(F.col("s"), 0).alias("i"),
        X.int_prefix(F.col("none"), 7).alias("d"))


TITLES = "SELECT doc_id, concat(source, '-', lang, ',  ', upper(source), CASE WHEN lang = 'en' THEN ': ' ELSE ' — ' END, text) AS title FROM {documents}"


@check("""SELECT doc_id, source || '-' || lang || ',  ' || source AS main, [source, lang, source] AS words FROM documents""")
def title_parts(spark, sf):
    title = F.col("title")
    return view(spark, sf, TITLES).select("doc_id", X.main_title(title).alias("main"), X.title_words(title).alias("words"))


FILES = "SELECT doc_id, text, source, CASE WHEN lang = 'en' THEN 'pdf' WHEN lang = 'de' THEN 'cbz' WHEN lang = 'fr' THEN '' ELSE 'doc' END AS extension FROM {documents}"
BLANKS = r"'^\s+|\s+$'"


@check(rf"""WITH {ctes(d=FILES)}, k AS (SELECT *,
      regexp_replace(regexp_replace(text, '[^a-zA-Z0-9_\- .()]', '', 'g'), {BLANKS}, '', 'g') AS served,
      regexp_replace(regexp_replace(text, '[^a-zA-Z0-9_\- ]', '', 'g'), {BLANKS}, '', 'g') AS short,
      CASE WHEN extension = '' THEN 'bin' ELSE extension END AS ext FROM d)
    SELECT doc_id, served || ' - ' || source || '.' || ext AS served,
      substr((CASE WHEN short = '' THEN 'm' ELSE short END) || ' - ' || source, 1, 200) || '.' || ext AS suggested,
      CASE extension WHEN 'pdf' THEN 'application/pdf' WHEN 'cbz' THEN 'application/x-cbz' ELSE 'application/octet-stream' END AS media_type
    FROM k""")
def file_names(spark, sf):
    cols = [F.col("text"), F.col("source"), F.col("extension"), F.lit("m")]
    return view(spark, sf, FILES).select(
        "doc_id", X.served_filename(*cols).alias("served"), X.suggested_filename(*cols).alias("suggested"),
        X.content_type(F.col("extension")).alias("media_type"))


def item_lines(spark, sf):
    """Documents as raw item lines: nested or flat, with either spelling of the alternative fields."""
    docs = table(spark, sf, "documents")
    flat = docs.select(
        F.col("doc_id").alias("z_library_id"), F.concat(F.lit(" "), "source", F.lit(" ")).alias("title"),
        F.col("lang").alias("language"), F.col("n_chars").alias("filesize"), F.col("text").alias("description"),
        F.concat(F.lit("i"), F.col("doc_id")).alias("isbn"))
    nested = docs.select(F.struct(
        F.col("doc_id").alias("zlibrary_id"), F.col("source").alias("title"), F.col("lang").alias("language"),
        F.col("n_chars").alias("filesize_reported"), F.col("text").alias("description"),
        F.array(F.concat(F.lit("i"), F.col("doc_id")), F.lit("other")).alias("isbns")).alias("metadata"), "lang")
    is_en = F.col("lang") == "en"
    return (
        nested.filter(is_en).select(F.to_json(F.struct("metadata")).alias("value"))
        .unionByName(flat.filter(F.col("language") != "en").select(F.to_json(F.struct(*flat.columns)).alias("value")))
    )


@check(f"""SELECT doc_id::varchar AS source_id, source AS title, lang AS language, n_chars AS filesize,
    regexp_replace(text, {STRICT}, '', 'g') AS description, 'i' || doc_id AS isbn, '' AS author FROM documents""")
def parse_items_json(spark, sf):
    rows = parse_items(item_lines(spark, sf))
    return rows.select("source_id", "title", "language", "filesize", "description", "isbn", "author")


@check("SELECT text AS value FROM documents WHERE NOT json_valid(text)")
def quarantine_lines(spark, sf):
    good = item_lines(spark, sf)
    bad = table(spark, sf, "documents").select(F.col("text").alias("value"))
    return quarantine(good.unionByName(bad))


def rating_lines(spark, sf):
    """Documents as raw rating lines: a wrapped record, or a bare one where the language is not English."""
    def tag(name, content):
        return F.concat(F.lit(f"<{name}>"), content, F.lit(f"</{name}>"))

    def cdata(c):
        return F.concat(F.lit("<![CDATA["), c, F.lit("]]>"))

    people = F.concat(
        tag("author", F.concat(tag("id", F.lit("1")), tag("name", F.col("source")))),
        F.when(F.col("n_chars") > 1000, tag("author", tag("name", F.lit("second")))).otherwise(""))
    book = tag("book", F.concat(
        tag("title", F.col("source")), tag("title_without_series", F.when(F.col("lang") == "en", F.col("lang")).otherwise("")),
        tag("isbn", F.lit("0123")), tag("isbn13", F.when(F.col("lang") == "de", F.lit("978")).otherwise("")),
        tag("average_rating", F.when(F.col("lang") == "fr", F.lit("0.00")).otherwise(F.lit("3.50"))),
        tag("ratings_count", F.col("n_chars").cast("string")), tag("description", cdata(F.col("text"))),
        tag("authors", people)))
    record = F.when(F.col("lang") == "en", F.concat(F.lit('<?xml version="1.0"?>'), tag("GoodreadsResponse", book))).otherwise(book)
    meta = F.struct(F.col("doc_id").alias("id"), record.alias("record"))
    return table(spark, sf, "documents").select(F.to_json(F.struct(meta.alias("metadata"))).alias("value"))


@check(rf"""SELECT doc_id::varchar AS source_id, CASE WHEN lang = 'en' THEN lang ELSE source END AS title, source AS author,
    CASE WHEN lang <> 'fr' THEN 3.5::double END AS rating, n_chars AS ratings_count,
    regexp_replace(text, {BLANKS}, '', 'g') AS description, CASE WHEN lang = 'de' THEN '978' ELSE '0123' END AS isbn FROM documents""")
def parse_ratings_xml(spark, sf):
    rows = parse_ratings(rating_lines(spark, sf))
    return rows.select(
        "source_id", "title", "author", F.col("rating").cast("double").alias("rating"),
        F.col("ratings_count").cast("long").alias("ratings_count"), "description", "isbn")


@check(r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
    c AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[:len(a) - 1] ELSE a END AS a FROM p)
    SELECT doc_id, unnest(range(1, len(a) + 1)) AS page_number, unnest(a) AS content FROM c""")
def split_document_pages(spark, sf):
    pages = split_pages(table(spark, sf, "documents"), "\n")
    return pages.select("doc_id", F.col("page_number").cast("long").alias("page_number"), "content")


def outline_xml(spark, sf):
    """One outline per conversation: even turns on the top level, each odd turn nested under the one before."""
    turns = table(spark, sf, "conversations")
    item = F.concat(
        F.lit('<item page="'), (F.col("turn") + 1).cast("string"), F.lit('"> '), "role", F.lit(" &amp; &#233;"),
        F.col("turn").cast("string"), F.lit("</item>"))
    nested = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("<outline>"), item, F.lit("</outline>"))).otherwise(item)
    ordered = F.array_sort(F.collect_list(F.struct("turn", nested.alias("token"))))
    joined = turns.groupBy("conv_id").agg(F.array_join(ordered["token"], "\n").alias("body"))
    return joined.select(
        "conv_id", F.concat(F.lit('<item page="99">stray</item><outline>'), "body", F.lit("</outline>")).alias("xml"))


@check("""SELECT conv_id AS doc_id, turn + 1 AS seq, 1 + turn % 2 AS depth, CASE WHEN turn % 2 = 1 THEN turn END AS parent_seq,
    role || ' & é' || turn AS title, turn + 1 AS page FROM conversations""")
def outline_flatten(spark, sf):
    flat = flatten_outline(outline_xml(spark, sf), key="conv_id")
    return flat.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("seq", "depth", "parent_seq")], "title",
        F.col("page").cast("long").alias("page"))


PAGE_KEYS = """
    SELECT cast(conv_id AS string) AS doc_id, cast(turn AS int) AS page_number FROM {conversations}
    UNION SELECT concat('s', cast(s_suppkey AS string)), 1 FROM {supplier}"""


@check(f"""WITH {ctes(k=PAGE_KEYS, p=DOC_PAGES)} SELECT doc_id, page_number::bigint AS page_number,
    CASE WHEN page_number >= 1 THEN content END AS content,
    CASE WHEN page_number < 1 THEN 'invalid page number' WHEN content IS NULL THEN 'page not found' END AS error
    FROM k LEFT JOIN p USING (doc_id, page_number)""")
def page_texts(spark, sf):
    found = page_text(view(spark, sf, PAGE_KEYS), view(spark, sf, DOC_PAGES))
    return found.withColumn("page_number", F.col("page_number").cast("long"))


DOC_KEYS = """
    SELECT DISTINCT cast(conv_id AS string) AS doc_id FROM {conversations}
    UNION SELECT concat('s', cast(s_suppkey AS string)) FROM {supplier}"""
# What the user said is embedded, and short documents entirely.
READ_PAGES = """
    SELECT doc_id, page_number, content, CASE WHEN role = 'user' OR n < 6 THEN 1 END AS embedded FROM (
      SELECT cast(conv_id AS string) AS doc_id, cast(turn + 1 AS int) AS page_number, text AS content, role,
             count(*) OVER (PARTITION BY conv_id) AS n FROM {conversations}) x"""
READ = f"""WITH {ctes(k=DOC_KEYS, i=CONV_ITEMS, p=READ_PAGES)},
    c AS (SELECT doc_id, count(*) AS total, count(embedded) AS embedded FROM p GROUP BY doc_id),
    d AS (SELECT k.doc_id, i.id, i.title, i.author, i.extension, i.downloaded_at, coalesce(c.total, 0) AS total,
                 coalesce(c.embedded, 0) AS embedded FROM k LEFT JOIN i ON i.md5 = k.doc_id LEFT JOIN c ON c.doc_id = k.doc_id)"""


def read_pages(spark, sf):
    return view(spark, sf, READ_PAGES).withColumn(
        "embedding", F.when(F.col("embedded") == 1, F.array(F.lit(1.0).cast("float"))))


@check(f"""{READ}, o AS (SELECT conv_id::varchar AS doc_id, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT d.doc_id, title, author, extension, downloaded_at IS NOT NULL AS downloaded, total > 0 AS indexed,
           total AS pages_extracted, embedded AS pages_embedded, embedded > 0 AND embedded = total AS ready_for_search,
           coalesce(o.n, 0) AS outline_entries FROM d LEFT JOIN o USING (doc_id) WHERE id IS NOT NULL""")
def reader_states(spark, sf):
    outline = table(spark, sf, "conversations").selectExpr(
        "cast(conv_id AS string) AS doc_id", "turn + 1 AS seq", "1 AS depth", "cast(NULL AS int) AS parent_seq",
        "role AS title", "turn + 1 AS page")
    state = reader_status(view(spark, sf, DOC_KEYS), view(spark, sf, CONV_ITEMS), read_pages(spark, sf), outline)
    return state.withColumn("outline_entries", F.json_array_length("outline").cast("long")).drop("outline")


REASON = "WHEN id IS NULL THEN 'not found' WHEN downloaded_at IS NULL THEN 'not downloaded' WHEN extension <> 'pdf' THEN 'not a pdf'"


@check(f"""{READ}, r AS (SELECT doc_id, total AS pages, CASE {REASON} WHEN total > 0 THEN 'already indexed' END AS reason FROM d)
    SELECT doc_id, pages, reason IS NULL AS eligible, reason FROM r""")
def index_states(spark, sf):
    return index_eligibility(view(spark, sf, DOC_KEYS), view(spark, sf, CONV_ITEMS), read_pages(spark, sf))


@check(f"""{READ}, r AS (SELECT doc_id, total AS pages, CASE {REASON} END AS reason FROM d)
    SELECT doc_id, pages, reason IS NULL AS eligible, reason FROM r""")
def index_states_forced(spark, sf):
    return index_eligibility(view(spark, sf, DOC_KEYS), view(spark, sf, CONV_ITEMS), read_pages(spark, sf), force=True)


@check(f"""{READ}, r AS (SELECT doc_id, CASE {REASON} END AS reason FROM d) SELECT doc_id, reason IS NULL AS eligible, reason FROM r""")
def image_states(spark, sf):
    return image_eligibility(view(spark, sf, DOC_KEYS), view(spark, sf, CONV_ITEMS))


@check(f"""{READ} SELECT doc_id, total, embedded,
    CASE WHEN total = 0 THEN 'not indexed' WHEN total = embedded THEN 'complete' ELSE 'to do' END AS state FROM d""")
def embed_states(spark, sf):
    return embed_eligibility(view(spark, sf, DOC_KEYS), read_pages(spark, sf))
