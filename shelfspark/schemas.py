"""Table layouts and the column lists each public query returns."""

ITEM_COLUMNS = [
    "id", "source", "source_id", "title", "author", "publisher", "language", "year",
    "extension", "filesize", "pages", "md5", "isbn", "series",
]
COLLECTED_COLUMNS = ITEM_COLUMNS + ["downloaded_at"]
LOOKUP_COLUMNS = [
    "id", "source", "source_id", "title", "author", "publisher", "language", "year",
    "extension", "filesize", "pages", "description", "md5", "isbn", "series", "edition",
]
RATING_COLUMNS = [
    "id", "source_id", "title", "author", "rating", "ratings_count",
    "description", "genres", "isbn", "pages", "year",
]

ITEM_VALUES = [
    "title", "author", "publisher", "language", "year", "extension", "filesize", "pages",
    "description", "md5", "isbn", "series", "edition",
]
RATING_VALUES = [
    "title", "author", "rating", "ratings_count", "description", "genres", "isbn", "pages", "year",
]

# Text fields of each table with the weight label their words carry, in position order.
ITEM_FIELDS = [("title", "A"), ("author", "B"), ("publisher", "C"), ("description", "D"), ("isbn", "D")]
RATING_FIELDS = [("title", "A"), ("author", "B"), ("description", "C"), ("genres", "D"), ("isbn", "D")]

ITEMS = """
    id LONG, source STRING, source_id STRING, title STRING, author STRING, publisher STRING,
    language STRING, year STRING, extension STRING, filesize LONG, pages STRING, description STRING,
    md5 STRING, isbn STRING, series STRING, edition STRING, created_at TIMESTAMP,
    updated_at TIMESTAMP, downloaded_at TIMESTAMP
"""
RATINGS = """
    id LONG, source_id STRING, title STRING, author STRING, rating FLOAT, ratings_count INT,
    description STRING, genres STRING, isbn STRING, pages STRING, year STRING,
    created_at TIMESTAMP, updated_at TIMESTAMP
"""
VECTORS = "id LONG, embedding ARRAY<FLOAT>, model STRING"
DOC_PAGES = "doc_id STRING, page_number INT, content STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP"
OUTLINE = "doc_id STRING, seq INT, depth INT, parent_seq INT, title STRING, page INT"
RUN_META = "key STRING, value STRING, ts TIMESTAMP"
POSTINGS = "term STRING, id LONG, pos INT, weight DOUBLE, first BOOLEAN"
