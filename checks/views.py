"""Catalogue views over the given tables, as SELECTs both engines run."""

from checks.registry import plain

DOC_ITEMS = """
    SELECT doc_id AS id, source, cast(doc_id AS string) AS source_id,
           concat(source, ' ', lang, ' ', cast(doc_id AS string)) AS title, source AS author,
           lang AS publisher, lang AS language, cast(n_chars AS string) AS year,
           CASE WHEN n_chars < 500 THEN 'txt' WHEN n_chars < 2000 THEN 'epub' ELSE 'pdf' END AS extension,
           n_chars AS filesize, '' AS pages, text AS description, md5(text) AS md5, '' AS isbn,
           '' AS series, '' AS edition
    FROM {documents}"""

# A product counts as collected once a large order of it was returned; the last return dates it.
PRODUCTS = """
    SELECT p.p_partkey AS id, 'parts' AS source, cast(p.p_partkey AS string) AS source_id,
           p.p_name AS title, p.p_brand AS author, p.p_type AS publisher, lower(p.p_type) AS language,
           cast(p.p_size AS string) AS year,
           CASE WHEN p.p_size <= 15 THEN 'pdf' WHEN p.p_size <= 30 THEN 'epub' ELSE 'txt' END AS extension,
           cast(p.p_size AS bigint) AS filesize, '' AS pages, p.p_type AS description,
           md5(cast(p.p_partkey AS string)) AS md5,
           concat('978', lpad(cast(p.p_partkey AS string), 10, '0')) AS isbn, '' AS series, '' AS edition,
           c.at AS downloaded_at
    FROM {part} p LEFT JOIN (
        SELECT l_partkey, max(CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN l_shipdate END) AS at
        FROM {lineitem} GROUP BY l_partkey
    ) c ON c.l_partkey = p.p_partkey"""

RATINGS = """
    SELECT p_partkey AS id, cast(p_partkey AS string) AS source_id, p_name AS title, p_brand AS author,
           p_retailprice AS rating, p_size AS ratings_count, p_type AS description,
           concat(p_type, ',', p_brand) AS genres,
           CASE WHEN p_size > 5 THEN concat('978', lpad(cast(p_partkey AS string), 10, '0')) ELSE '' END AS isbn,
           '' AS pages, cast(p_size AS string) AS year
    FROM {part}"""

# Isbns on the shelf: one row per line, so frequent parts repeat; only returned lines of a fair size carry one.
SHELF = """
    SELECT CASE WHEN l_returnflag = 'R' AND l_discount >= 0.07 AND l_quantity >= 30
           THEN concat('978', lpad(cast(l_partkey AS string), 10, '0')) ELSE '' END AS isbn FROM {lineitem}"""

# Conversations as documents: a turn is a page.
DOC_PAGES = """
    SELECT cast(conv_id AS string) AS doc_id, cast(turn + 1 AS int) AS page_number, text AS content, role
    FROM {conversations}"""

CONV_ITEMS = """
    SELECT conv_id AS id, cast(conv_id AS string) AS md5, concat('conversation ', cast(conv_id AS string)) AS title,
           min(role) AS author, CASE WHEN count(*) >= 5 THEN 'pdf' ELSE 'txt' END AS extension,
           CASE WHEN count(*) <> 6 THEN timestamp '2024-01-01 00:00:00' END AS downloaded_at
    FROM {conversations} GROUP BY conv_id"""

VECTORS = "SELECT vec_id AS id, embedding, label FROM {embeddings}"

# Request tables, all drawn from the data.
BENCHMARK_REQUESTS = "SELECT item_id AS request_id, text AS q FROM {benchmark}"
LANG_REQUESTS = "SELECT DISTINCT lang AS request_id, lang AS q FROM {documents}"
SOURCE_REQUESTS = """
    SELECT DISTINCT concat(source, ' ', lang) AS request_id, concat(source, ' ', lang) AS q FROM {documents}"""
NAME_REQUESTS = "SELECT DISTINCT p_name AS request_id, p_name AS q FROM {part}"
NAME_BRAND_REQUESTS = """
    SELECT DISTINCT concat(p_name, '/', p_brand) AS request_id, p_name AS q, p_brand AS author FROM {part}"""


def ctes(**views: str) -> str:
    """WITH items of an oracle query."""
    return ", ".join(f"{name} AS ({plain(text)})" for name, text in views.items())


TOKEN = r"[\p{L}\p{N}]+"


def occurrences(rows: str, fields: list[tuple[str, float]]) -> str:
    """CTEs tok, occ: words of the fields of `rows` with running position and weight."""
    lists = ", ".join(
        f"regexp_extract_all(lower(coalesce({c}, '')), '{TOKEN}') AS t{i}" for i, (c, _) in enumerate(fields)
    )
    parts = []
    for i, (_, w) in enumerate(fields):
        base = " + ".join(["0", *[f"len(t{j})" for j in range(i)]])
        parts.append(
            f"SELECT id, unnest(t{i}) AS term, unnest(range(1, len(t{i}) + 1)) + {base} AS pos, {w}::double AS w FROM tok"
        )
    return f"tok AS (SELECT id, {lists} FROM {rows}), occ AS ({' UNION ALL '.join(parts)})"


def ranked(requests: str) -> str:
    """CTEs up to ranked(request_id, id, rank) for the request view and occ."""
    return f"""
    terms AS (SELECT DISTINCT request_id, unnest(regexp_extract_all(lower(q), '{TOKEN}')) AS term FROM {requests}),
    asked AS (SELECT request_id, count(*) AS n FROM terms GROUP BY request_id),
    hit AS (SELECT t.request_id, o.id, o.term, o.pos, o.w FROM occ o JOIN terms t USING (term)),
    matched AS (SELECT h.request_id, h.id, any_value(a.n) AS n FROM hit h JOIN asked a USING (request_id)
                GROUP BY h.request_id, h.id HAVING count(DISTINCT h.term) = any_value(a.n)),
    held AS (SELECT h.*, m.n, row_number() OVER (PARTITION BY h.request_id, h.id ORDER BY h.pos) AS j
             FROM hit h JOIN matched m USING (request_id, id)),
    peak AS (SELECT request_id, id, max(w) AS top, arg_min(j, -w * 1e9 + j) AS m,
             sum(w / (j * j)) AS series FROM held WHERE n = 1 GROUP BY request_id, id),
    pairs AS (SELECT request_id, id,
              sum(CASE WHEN c < 1e-4::double THEN -c * (1 + c / 2 + c * c / 3) ELSE ln(1 - c) END) AS miss FROM (
              SELECT a.request_id, a.id,
              sqrt(a.w * b.w / (1.005::double + 0.05::double * exp((a.pos - b.pos) / 1.5::double - 2))) AS c
              FROM held a JOIN held b ON a.request_id = b.request_id AND a.id = b.id AND a.term <> b.term
               AND a.pos - b.pos BETWEEN 1 AND 100 WHERE a.n > 1) GROUP BY request_id, id),
    ranked AS (
      SELECT request_id, id, ((top + series - top / (m * m)) / 1.64493406685::double)::float::double AS rank FROM peak
      UNION ALL
      SELECT request_id, id, (CASE WHEN x > -1e-4::double THEN -x * (1 + x / 2 + x * x / 6) ELSE 1 - exp(x) END)::float::double
      FROM (SELECT m.request_id, m.id, coalesce(p.miss, 0::double) AS x FROM matched m
            LEFT JOIN pairs p USING (request_id, id) WHERE m.n > 1))"""


DOC_FIELDS = [("title", "A"), ("author", "B"), ("publisher", "C"), ("description", "D"), ("isbn", "D")]
DOC_WEIGHTS = [("title", 1.0), ("author", 0.4), ("publisher", 0.2), ("description", 0.1), ("isbn", 0.1)]
RATING_WEIGHTS = [("title", 1.0), ("author", 0.4), ("description", 0.2), ("genres", 0.1), ("isbn", 0.1)]


def hashed(rows: str, key: str, text: str, name: str, dim: int = 64) -> str:
    """CTE `name`(key, embedding) with the hashing vectors of a text column."""
    digit = "instr('0123456789abcdef', substr(md5(word), {i}, 1)) - 1"
    number = " + ".join(f"({digit.format(i=i)})::bigint * {16 ** (8 - i)}" for i in range(1, 9))
    return f"""
    {name}_w AS (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '{TOKEN}')) AS word FROM {rows}),
    {name}_s AS (SELECT {key}, ({number}) % {dim} AS bucket,
                 sum(CASE WHEN ({digit.format(i=9)}) % 2 = 0 THEN 1 ELSE -1 END) AS total FROM {name}_w GROUP BY ALL),
    {name}_n AS (SELECT {key}, sqrt(sum(total * total)::double) AS length FROM {name}_s GROUP BY {key}),
    {name} AS (SELECT d.{key}, list(coalesce(CASE WHEN n.length > 0 THEN (s.total / n.length)::float END, 0::float) ORDER BY i) AS embedding
               FROM (SELECT {key}, unnest(range({dim})) AS i FROM {rows}) d
               LEFT JOIN {name}_s s ON s.{key} = d.{key} AND s.bucket = d.i
               LEFT JOIN {name}_n n ON n.{key} = d.{key} GROUP BY d.{key})"""
