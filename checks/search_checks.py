"""Full-text, filter, library, lookup and title queries."""

import uuid

from pyspark.sql import functions as F

from checks.registry import check, view
from checks.views import (
    BENCHMARK_REQUESTS, DOC_FIELDS, DOC_ITEMS, DOC_WEIGHTS, LANG_REQUESTS, NAME_BRAND_REQUESTS, NAME_REQUESTS,
    PRODUCTS, RATING_WEIGHTS, RATINGS, SHELF, SOURCE_REQUESTS, TOKEN, ctes, occurrences, ranked,
)
from shelfspark.operators.fulltext import (
    build_index, compact_index, doc_freq, match_terms, plain_query, read_doc_freq, search_fts, search_index, tokenize, update_index,
    vocabulary, write_index,
)
from shelfspark.operators.layout import spread
from shelfspark.operators.lookups import with_availability
from shelfspark.operators.merge import mark_collected, unmark_collected
from shelfspark.plans.lookup import lookup_isbn, lookup_md5, suggest_filename
from shelfspark.plans.search import (
    library_list, library_search, library_total, rejected_items, search_items, search_ratings_fts,
)
from shelfspark.plans.similar import resolve_source
from shelfspark.schemas import ITEM_FIELDS, RATING_FIELDS
from shelfspark.sources.storage import stage, work_dir

DOC_OCC = f"{ctes(items=DOC_ITEMS)}, {occurrences('items', DOC_WEIGHTS)}"
PRODUCT_OCC = f"{ctes(items=PRODUCTS)}, {occurrences('items', DOC_WEIGHTS)}"
RATING_OCC = f"{ctes(items=RATINGS)}, {occurrences('items', RATING_WEIGHTS)}"
FORMAT = "CASE extension WHEN 'pdf' THEN 0 WHEN 'epub' THEN 1 ELSE 2 END"


def doc_index(spark, sf, config="simple"):
    return stage(build_index(spread(view(spark, sf, DOC_ITEMS), "id"), DOC_FIELDS, config))


@check(f"""WITH {ctes(items=DOC_ITEMS)}, w AS (
    SELECT id, unnest(regexp_extract_all(lower(description), '{TOKEN}')) AS t FROM items)
    SELECT id, count(*) AS n_tokens, count(DISTINCT t) AS n_distinct, sum(length(t))::bigint AS n_letters
    FROM w GROUP BY id""")
def tokenize_simple(spark, sf):
    words = tokenize(view(spark, sf, DOC_ITEMS), [("description", "D")], "simple")
    return words.groupBy("id").agg(
        F.count("*").alias("n_tokens"), F.countDistinct("surface").alias("n_distinct"),
        F.sum(F.length("surface")).alias("n_letters"))


@check(f"WITH {DOC_OCC} SELECT term, count(DISTINCT id) AS doc_freq FROM occ GROUP BY term")
def postings_doc_freq(spark, sf):
    return doc_freq(build_index(spread(view(spark, sf, DOC_ITEMS), "id"), DOC_FIELDS, "simple"))


@check(f"""WITH {DOC_OCC} SELECT term, id, count(*) AS n, sum(pos)::bigint AS sum_pos, round(sum(w), 4) AS sum_weight
    FROM occ GROUP BY term, id""")
def postings_positions(spark, sf):
    index = build_index(spread(view(spark, sf, DOC_ITEMS), "id"), DOC_FIELDS, "simple")
    return index.groupBy("term", "id").agg(
        F.count("*").alias("n"), F.sum("pos").alias("sum_pos"), F.round(F.sum("weight"), 4).alias("sum_weight"))


@check()
def vocabulary_english(spark, sf):
    return vocabulary(view(spark, sf, DOC_ITEMS), DOC_FIELDS, "english")


@check(f"WITH {DOC_OCC}, {ctes(requests=BENCHMARK_REQUESTS)}, {ranked('requests')} SELECT request_id, id FROM matched")
def fts_match_all_terms(spark, sf):
    terms = plain_query(view(spark, sf, BENCHMARK_REQUESTS), "simple")
    return match_terms(doc_index(spark, sf), terms).select("request_id", "id").distinct()


@check(f"WITH {DOC_OCC}, {ctes(requests=BENCHMARK_REQUESTS)}, {ranked('requests')} SELECT request_id, id, rank FROM ranked")
def fts_rank_benchmark(spark, sf):
    return search_fts(doc_index(spark, sf), view(spark, sf, BENCHMARK_REQUESTS), "simple")


@check(f"WITH {DOC_OCC}, {ctes(requests=LANG_REQUESTS)}, {ranked('requests')} SELECT request_id, id, rank FROM ranked")
def fts_rank_single(spark, sf):
    return search_fts(doc_index(spark, sf), view(spark, sf, LANG_REQUESTS), "simple")


@check(f"WITH {DOC_OCC}, {ctes(requests=SOURCE_REQUESTS)}, {ranked('requests')} SELECT request_id, id, rank FROM ranked")
def fts_rank_multi(spark, sf):
    return search_fts(doc_index(spark, sf), view(spark, sf, SOURCE_REQUESTS), "simple")


@check(f"""WITH {DOC_OCC}, {ctes(requests=SOURCE_REQUESTS)}, {ranked('requests')},
    placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, id) AS rank_no FROM ranked)
    SELECT request_id, id, rank, rank_no FROM placed WHERE rank_no <= 10""")
def fts_top_k(spark, sf):
    return search_fts(doc_index(spark, sf), view(spark, sf, SOURCE_REQUESTS), "simple", 10)


@check(f"""WITH {DOC_OCC}, {ctes(requests=BENCHMARK_REQUESTS)}, {ranked('requests')},
    placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, id) AS rank_no FROM ranked)
    SELECT request_id, id, rank, rank_no FROM placed WHERE rank_no <= 10""")
def fts_stored_and_updated(spark, sf):
    """Search over a stored index whose odd documents were first stored with another text and then updated."""
    items, path = spread(view(spark, sf, DOC_ITEMS), "id"), f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    first = items.withColumn("description", F.when(F.col("id") % 2 == 1, F.reverse("description")).otherwise(F.col("description")))
    write_index(build_index(first, DOC_FIELDS, "simple"), path)
    update_index(path, items.filter("id % 2 = 1"), DOC_FIELDS, "simple")
    return search_index(path, view(spark, sf, BENCHMARK_REQUESTS), "simple", 10)


@check(f"""WITH {DOC_OCC}, {ctes(requests=BENCHMARK_REQUESTS)}, {ranked('requests')},
    placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, id) AS rank_no FROM ranked)
    SELECT request_id, id, rank, rank_no FROM placed WHERE rank_no <= 10""")
def fts_stored_rebuilt_compacted(spark, sf):
    """Search after write, update, rebuild over other texts, two more updates and compaction."""
    items, path = spread(view(spark, sf, DOC_ITEMS), "id"), f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    reversed_texts = items.withColumn("description", F.reverse("description"))
    write_index(build_index(reversed_texts, DOC_FIELDS, "simple"), path)
    update_index(path, items.filter("id % 2 = 1"), DOC_FIELDS, "simple")
    write_index(build_index(items.withColumn("description", F.when(F.col("id") % 4 != 2, F.col("description"))), DOC_FIELDS, "simple"), path)
    update_index(path, reversed_texts.filter("id % 4 = 2"), DOC_FIELDS, "simple")
    update_index(path, items.filter("id % 4 = 2"), DOC_FIELDS, "simple")
    compact_index(spark, path)
    return search_index(path, view(spark, sf, BENCHMARK_REQUESTS), "simple", 10)


@check(f"""WITH {DOC_OCC} SELECT term, count(DISTINCT id) AS doc_freq FROM occ GROUP BY term""")
def stored_doc_freq(spark, sf):
    """Document frequencies kept beside a stored index."""
    path = f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    write_index(build_index(spread(view(spark, sf, DOC_ITEMS), "id"), DOC_FIELDS, "simple"), path)
    return read_doc_freq(spark, path)


@check()
def fts_rank_english(spark, sf):
    return search_fts(doc_index(spark, sf, "english"), view(spark, sf, BENCHMARK_REQUESTS), "english")


def products_and_index(spark, sf):
    items = view(spark, sf, PRODUCTS)
    return items, stage(build_index(spread(items, "id"), ITEM_FIELDS, "simple"))


SHOWN = "request_id, id, title, author, extension, rank, rank_no"


@check(f"""WITH {PRODUCT_OCC}, {ctes(requests=NAME_REQUESTS)}, {ranked('requests')},
    hits AS (SELECT r.*, i.title, i.author, i.extension FROM ranked r JOIN items i USING (id)),
    kept AS (SELECT *, row_number() OVER (PARTITION BY request_id, lower(title), lower(author)
             ORDER BY rank DESC, {FORMAT}, id) AS first FROM hits),
    placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, {FORMAT}, id) AS rank_no
               FROM kept WHERE first = 1)
    SELECT {SHOWN} FROM placed WHERE rank_no <= 20""")
def search_items_dedupe(spark, sf):
    items, index = products_and_index(spark, sf)
    return search_items(items, index, view(spark, sf, NAME_REQUESTS), "simple").select(*SHOWN.split(", "))


@check(f"""WITH {PRODUCT_OCC}, {ctes(requests=NAME_REQUESTS)}, {ranked('requests')},
    hits AS (SELECT r.*, i.title, i.author, i.extension FROM ranked r JOIN items i USING (id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, {FORMAT}, id) - 5 AS rank_no FROM hits)
    SELECT {SHOWN} FROM placed WHERE rank_no BETWEEN 1 AND 10""")
def search_items_all(spark, sf):
    items, index = products_and_index(spark, sf)
    return search_items(
        items, index, view(spark, sf, NAME_REQUESTS), "simple", limit=10, offset=5, dedupe=False
    ).select(*SHOWN.split(", "))


# Each request has its own page, and two of three want one row per title and author.
PAGED_REQUESTS = """
    SELECT DISTINCT p_name AS request_id, p_name AS q, CASE WHEN length(p_name) % 2 = 0 THEN 3 END AS "limit",
           length(p_name) % 4 AS "offset", length(p_name) % 3 > 0 AS dedupe FROM {part}"""


@check(f"""WITH {PRODUCT_OCC}, {ctes(requests=PAGED_REQUESTS)}, {ranked('requests')},
    hits AS (SELECT r.*, i.title, i.author, i.extension, q."limit" AS lim, q."offset" AS off, q.dedupe
             FROM ranked r JOIN items i USING (id) JOIN requests q USING (request_id)),
    kept AS (SELECT *, row_number() OVER (PARTITION BY request_id, lower(title), lower(author)
             ORDER BY rank DESC, {FORMAT}, id) AS first FROM hits),
    placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, {FORMAT}, id) - off AS rank_no
               FROM kept WHERE first = 1 OR NOT dedupe)
    SELECT {SHOWN} FROM placed WHERE rank_no BETWEEN 1 AND coalesce(lim, 20)""")
def search_items_paged(spark, sf):
    items, index = products_and_index(spark, sf)
    requests = view(spark, sf, PAGED_REQUESTS.replace('"', "`"))
    return search_items(items, index, requests, "simple").select(*SHOWN.split(", "))


@check(f"""WITH {PRODUCT_OCC}, {ctes(requests=NAME_BRAND_REQUESTS)}, {ranked('requests')},
    hits AS (SELECT r.*, i.title, i.author, i.extension FROM ranked r JOIN items i USING (id) JOIN requests q USING (request_id)
             WHERE i.author ILIKE '%' || q.author || '%'),
    placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, {FORMAT}, id) AS rank_no FROM hits)
    SELECT {SHOWN} FROM placed WHERE rank_no <= 20""")
def search_items_filters(spark, sf):
    items, index = products_and_index(spark, sf)
    requests = view(spark, sf, NAME_BRAND_REQUESTS)
    return search_items(items, index, requests, "simple", dedupe=False).select(*SHOWN.split(", "))


@check(f"""WITH {PRODUCT_OCC}, {ctes(requests=NAME_BRAND_REQUESTS)}, {ranked('requests')},
    hits AS (SELECT r.*, i.title, i.author, i.extension FROM ranked r JOIN items i USING (id) JOIN requests q USING (request_id)
             WHERE i.author ILIKE '%' || q.author || '%'),
    placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, {FORMAT}, id) AS rank_no FROM hits)
    SELECT {SHOWN} FROM placed WHERE rank_no <= 20""")
def search_items_stored(spark, sf):
    """The public search over a stored index given by its path."""
    items, path = view(spark, sf, PRODUCTS), f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    write_index(build_index(spread(items, "id"), ITEM_FIELDS, "simple"), path)
    return search_items(items, path, view(spark, sf, NAME_BRAND_REQUESTS), "simple", dedupe=False).select(*SHOWN.split(", "))


# Requests without a text: by brand with a type, by type and size, by size alone, by upper-case type.
BROWSE_REQUESTS = """
    SELECT DISTINCT concat('b', p_brand, p_type) AS request_id, p_brand AS author, p_type AS publisher,
           cast(NULL AS string) AS year, cast(NULL AS string) AS language, 'PDF' AS ext FROM {part}
    UNION SELECT DISTINCT concat('p', p_type, cast(p_size AS string)), cast(NULL AS string), lower(p_type),
           cast(p_size AS string), cast(NULL AS string), '' FROM {part}
    UNION SELECT DISTINCT concat('y', cast(p_size AS string)), '', '', cast(p_size AS string), cast(NULL AS string),
           cast(NULL AS string) FROM {part}
    UNION SELECT DISTINCT concat('l', p_type), cast(NULL AS string), cast(NULL AS string), cast(NULL AS string), p_type,
           'epub' FROM {part}"""


@check(f"""WITH {ctes(items=PRODUCTS, requests=BROWSE_REQUESTS)},
    hits AS (SELECT q.request_id, i.id, i.title, i.author, i.extension, row_number() OVER (PARTITION BY q.request_id ORDER BY i.id DESC) AS rank_no
      FROM items i, requests q
      WHERE (coalesce(q.author, '') = '' OR i.author ILIKE '%' || q.author || '%')
        AND (coalesce(q.publisher, '') = '' OR i.publisher ILIKE '%' || q.publisher || '%')
        AND (coalesce(q.year, '') = '' OR i.year = q.year)
        AND (coalesce(q.language, '') = '' OR i.language = lower(q.language))
        AND (coalesce(q.ext, '') = '' OR i.extension = lower(q.ext)))
    SELECT request_id, id, title, author, extension, rank_no FROM hits WHERE rank_no <= 20""")
def search_items_no_query(spark, sf):
    items, index = products_and_index(spark, sf)
    found = search_items(items, index, view(spark, sf, BROWSE_REQUESTS), "simple", dedupe=False)
    return found.select("request_id", "id", "title", "author", "extension", "rank_no")


CHECK_REQUESTS = """
    SELECT event_id AS request_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS q,
           CASE WHEN value > 20 THEN event_type END AS author FROM {events}"""


@check(f"""WITH {ctes(r=CHECK_REQUESTS)} SELECT request_id,
    'provide q and/or one of: author, publisher, year, language' AS error FROM r
    WHERE coalesce(q, '') = '' AND coalesce(author, '') = ''""")
def rejected_requests(spark, sf):
    return rejected_items(view(spark, sf, CHECK_REQUESTS))


@check(f"""WITH {ctes(items=PRODUCTS)} SELECT id, title, author, extension, downloaded_at FROM items
    WHERE downloaded_at IS NOT NULL ORDER BY downloaded_at DESC, id LIMIT 500 OFFSET 20""")
def library_listing(spark, sf):
    return library_list(view(spark, sf, PRODUCTS), 500, 20).select("id", "title", "author", "extension", "downloaded_at")


@check(f"WITH {ctes(items=PRODUCTS)} SELECT count(*) AS total FROM items WHERE downloaded_at IS NOT NULL")
def library_count(spark, sf):
    return library_total(view(spark, sf, PRODUCTS))


LIBRARY_REQUESTS = """
    SELECT DISTINCT concat(p_name, '/', p_type) AS request_id, p_name AS q, p_type AS publisher FROM {part}
    UNION SELECT DISTINCT p_type, cast(NULL AS string), p_type FROM {part}"""


@check(f"""WITH {PRODUCT_OCC}, {ctes(requests=LIBRARY_REQUESTS)}, {ranked('requests')},
    hits AS (SELECT q.request_id, i.id, i.title, i.publisher, i.downloaded_at, r.rank FROM items i JOIN requests q ON i.publisher ILIKE '%' || q.publisher || '%'
             LEFT JOIN ranked r ON r.request_id = q.request_id AND r.id = i.id
             WHERE i.downloaded_at IS NOT NULL AND (q.q IS NULL OR r.id IS NOT NULL)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY request_id
      ORDER BY rank DESC, CASE WHEN rank IS NULL THEN downloaded_at END DESC, id) AS rank_no FROM hits)
    SELECT request_id, id, title, publisher, downloaded_at, rank, rank_no FROM placed WHERE rank_no <= 20""")
def library_search_text(spark, sf):
    items, index = products_and_index(spark, sf)
    found = library_search(items, index, view(spark, sf, LIBRARY_REQUESTS), "simple")
    return found.select("request_id", "id", "title", "publisher", "downloaded_at", "rank", "rank_no")


@check(f"""WITH {RATING_OCC}, {ctes(requests=NAME_BRAND_REQUESTS)}, {ranked('requests')},
    hits AS (SELECT r.*, i.title, i.rating FROM ranked r JOIN items i USING (id) JOIN requests q USING (request_id)
             WHERE i.author ILIKE '%' || q.author || '%'),
    placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank DESC, id) AS rank_no FROM hits)
    SELECT request_id, id, title, rating, rank, rank_no FROM placed WHERE rank_no <= 20""")
def search_ratings_text(spark, sf):
    ratings = view(spark, sf, RATINGS)
    index = stage(build_index(spread(ratings, "id"), RATING_FIELDS, "simple"))
    found = search_ratings_fts(ratings, index, view(spark, sf, NAME_BRAND_REQUESTS), "simple")
    return found.select("request_id", "id", "title", "rating", "rank", "rank_no")


GENRE_REQUESTS = """
    SELECT DISTINCT concat(p_type, '/', cast(p_size AS string)) AS request_id, lower(p_type) AS genre,
           cast(p_size AS string) AS year FROM {part}
    UNION SELECT DISTINCT p_brand, p_brand, cast(NULL AS string) FROM {part}"""


@check(f"""WITH {ctes(items=RATINGS, requests=GENRE_REQUESTS)},
    placed AS (SELECT q.request_id, i.id, i.title, i.rating,
      row_number() OVER (PARTITION BY q.request_id ORDER BY i.rating DESC NULLS LAST, i.id) AS rank_no
      FROM items i JOIN requests q ON i.genres ILIKE '%' || q.genre || '%' AND (q.year IS NULL OR i.year = q.year))
    SELECT request_id, id, title, rating, rank_no FROM placed WHERE rank_no <= 20""")
def search_ratings_best(spark, sf):
    ratings = view(spark, sf, RATINGS)
    index = build_index(spread(ratings, "id"), RATING_FIELDS, "simple")
    found = search_ratings_fts(ratings, index, view(spark, sf, GENRE_REQUESTS), "simple")
    return found.select("request_id", "id", "title", "rating", "rank_no")


MD5_KEYS = """
    SELECT DISTINCT md5(text) AS md5 FROM {documents} UNION SELECT DISTINCT md5(text) FROM {benchmark}"""
FIRST_DOC = f"""WITH {ctes(items=DOC_ITEMS, keys=MD5_KEYS)},
    first AS (SELECT md5, min(id) AS id FROM items GROUP BY md5),
    found AS (SELECT k.md5, i.* EXCLUDE (md5) FROM keys k LEFT JOIN first f USING (md5) LEFT JOIN items i ON i.id = f.id)"""


@check(f"""{FIRST_DOC} SELECT md5, id, title, language, length(description) AS n, id IS NOT NULL AS found FROM found""")
def lookup_checksum(spark, sf):
    rows = lookup_md5(view(spark, sf, MD5_KEYS), view(spark, sf, DOC_ITEMS))
    return rows.select("md5", "id", "title", "language", F.length("description").cast("long").alias("n"), "found")


@check(f"""{FIRST_DOC} SELECT md5, CASE WHEN id IS NULL THEN md5 || '.bin'
    ELSE substr(title || ' - ' || author, 1, 200) || '.' || extension END AS suggested_filename FROM found""")
def suggested_names(spark, sf):
    return suggest_filename(view(spark, sf, MD5_KEYS), view(spark, sf, DOC_ITEMS))


ISBN_KEYS = """
    SELECT concat('978', lpad(cast(p_partkey AS string), 10, '0')) AS isbn FROM {part}
    UNION SELECT concat('979', lpad(cast(s_suppkey AS string), 10, '0')) FROM {supplier}"""
# Every product comes in two formats under one isbn, and so do its ratings.
EDITIONS = " UNION ALL ".join(PRODUCTS.replace("p.p_partkey AS id", f"p.p_partkey * 2 + {f} AS id") for f in (0, 1))
EDITION_RATINGS = " UNION ALL ".join(RATINGS.replace("p_partkey AS id", f"p_partkey * 2 + {f} AS id") for f in (0, 1))


@check(f"""WITH {ctes(items=EDITIONS, ratings=EDITION_RATINGS, keys=ISBN_KEYS)},
    first_item AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY isbn ORDER BY id) = 1),
    first_rating AS (SELECT * FROM ratings QUALIFY row_number() OVER (PARTITION BY isbn ORDER BY id) = 1)
    SELECT k.isbn, i.id AS item_id, i.title AS item_title, r.id AS rating_id, r.rating FROM keys k
    LEFT JOIN first_item i USING (isbn) LEFT JOIN first_rating r USING (isbn)""")
def lookup_both(spark, sf):
    rows = lookup_isbn(view(spark, sf, ISBN_KEYS), view(spark, sf, EDITIONS), view(spark, sf, EDITION_RATINGS))
    return rows.select(
        "isbn", F.col("item.id").alias("item_id"), F.col("item.title").alias("item_title"),
        F.col("rating.id").alias("rating_id"), F.col("rating.rating").alias("rating"))


@check(f"""WITH {ctes(ratings=RATINGS, shelf=SHELF)} SELECT id, isbn, isbn <> '' AND isbn IN (SELECT isbn FROM shelf) AS available
    FROM ratings""")
def availability_flag(spark, sf):
    return with_availability(view(spark, sf, RATINGS).select("id", "isbn"), view(spark, sf, SHELF))


# A returned product's line marks it; most products are listed many times, some without a date.
RETURNS = """
    SELECT CASE WHEN l_returnflag = 'A' THEN md5(cast(l_partkey AS string)) ELSE 'none' END AS md5,
           CASE WHEN l_quantity >= 48 THEN l_shipdate END AS marked_at FROM {lineitem}"""


@check(f"""WITH {ctes(items=PRODUCTS, marks=RETURNS)} SELECT i.id, coalesce(m.marked_at, i.downloaded_at) AS downloaded_at
    FROM items i LEFT JOIN (SELECT md5, max(marked_at) AS marked_at FROM marks GROUP BY md5) m USING (md5)""")
def collected_marks(spark, sf):
    return mark_collected(view(spark, sf, PRODUCTS), view(spark, sf, RETURNS), F.col("marked_at")).select("id", "downloaded_at")


@check(f"""WITH {ctes(items=PRODUCTS, marks=RETURNS)} SELECT i.id, CASE WHEN m.md5 IS NULL THEN i.downloaded_at END AS downloaded_at
    FROM items i LEFT JOIN (SELECT DISTINCT md5 FROM marks) m USING (md5)""")
def collected_unmarks(spark, sf):
    return unmark_collected(view(spark, sf, PRODUCTS), view(spark, sf, RETURNS)).select("id", "downloaded_at")


# Whole names, single words, names with a word too many, and isbns written with hyphens.
TITLE_REQUESTS = """
    SELECT DISTINCT p_name AS request_id, p_name AS q FROM {part}
    UNION SELECT DISTINCT split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM {part}
    UNION SELECT DISTINCT concat(p_name, ' ', p_type), concat(p_name, ' ', p_type) FROM {part}
    UNION SELECT concat('978-', lpad(cast(p_partkey AS string), 10, '0')),
                 concat('978-', lpad(cast(p_partkey AS string), 10, '0')) FROM {part}"""


@check(f"""WITH {RATING_OCC}, {ctes(requests=TITLE_REQUESTS)},
    numbered AS (SELECT request_id, replace(q, '-', '') AS isbn FROM requests WHERE regexp_full_match(replace(q, '-', ''), '[0-9]{{10,13}}')),
    by_isbn AS (SELECT n.request_id, min(i.id) AS id FROM numbered n JOIN items i USING (isbn) GROUP BY n.request_id),
    texts AS (SELECT * FROM requests WHERE request_id NOT IN (SELECT request_id FROM by_isbn)),
    {ranked('texts')},
    named AS (SELECT b.request_id, b.id, row_number() OVER (PARTITION BY b.request_id ORDER BY b.rank DESC, b.id) AS rn
              FROM ranked b JOIN items i USING (id) JOIN texts t USING (request_id)
              WHERE list_has_all(string_split(lower(i.title), ' '), string_split(lower(t.q), ' '))
                AND len(string_split(t.q, ' ')) / len(string_split(i.title, ' ')) >= 0.6)
    SELECT request_id, id FROM by_isbn UNION ALL SELECT request_id, arg_min(id, rn) FROM named GROUP BY request_id""")
def title_resolution(spark, sf):
    ratings = view(spark, sf, RATINGS)
    index = stage(build_index(spread(ratings, "id"), RATING_FIELDS, "simple"))
    return resolve_source(view(spark, sf, TITLE_REQUESTS), ratings, index, "simple")
