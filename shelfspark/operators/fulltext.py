"""Weighted full-text postings, matching and ranking.

Rank is defined here as follows. With w the weight of an occurrence:

* one query term, occurrences in position order j = 1..n, m the first place of the largest weight:
  (w_m + sum(w_j / j^2) - w_m / m^2) / 1.64493406685
* several terms: 1 - prod(1 - c) over all pairs of occurrences of two different terms at most 100
  positions apart, c = sqrt(w1 * w2 / (1.005 + 0.05 * exp(d / 1.5 - 2)))

Ranks have the digits of a single-precision number, so that equal ones tie whatever the order of summation.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfspark.functions.analysis import WEIGHTS, positioned, to_term, to_terms, tokens
from shelfspark.operators.layout import spread
from shelfspark.operators.packing import LISTS, pack, pack_words, unpack
from shelfspark.operators.paging import top_rows
from shelfspark.sources.storage import delete_versions, snapshot_versions, stage

BUCKETS = 64
#: Parts by id that a bucket is written in.
SLICES = 8

# Fixed values of the rank formula.
MAX_DISTANCE = 100
SINGLE_TERM_SCALE = 1.64493406685
DECAY_BASE, DECAY_SCALE, DECAY_WIDTH, DECAY_SHIFT = 1.005, 0.05, 1.5, 2.0


def document_words(df: DataFrame, fields: list[tuple[str, str]], config: str, id_col: str = "id") -> DataFrame:
    """(id, words): all indexed words of a row as one array of (surface, pos, weight).

    Positions of a field continue after the last indexed word of the fields before it.
    """
    names, plain = [f"_f{i}" for i in range(len(fields))], config == "simple"
    arrays = df.select(
        F.col(id_col).alias("id"),
        *[(tokens(F.col(c)) if plain else positioned(F.col(c), config)).alias(n) for (c, _), n in zip(fields, names)],
    )

    def placed(name: str, weight: float, base: Column) -> Column:
        return F.transform(name, lambda w, i: F.struct(
            (w if plain else w["surface"]).alias("surface"), (base + (i + 1 if plain else w["pos"])).alias("pos"),
            F.lit(weight).alias("weight")))

    base, parts = F.lit(0), []
    for (_, label), name in zip(fields, names):
        parts.append(placed(name, WEIGHTS[label], base))
        base = base + (F.size(name) if plain else F.coalesce(F.try_element_at(F.col(name), F.lit(-1))["pos"], F.lit(0)))
    return arrays.select("id", F.concat(*parts).alias("words"))


def tokenize(df: DataFrame, fields: list[tuple[str, str]], config: str, id_col: str = "id") -> DataFrame:
    """One row (id, surface, pos, weight) per indexed word."""
    return document_words(df, fields, config, id_col).select("id", F.inline("words"))


def build_index(df: DataFrame, fields: list[tuple[str, str]], config: str, id_col: str = "id") -> DataFrame:
    """Postings: one row (term, id, pos, weight, first) per word occurrence.

    `first` marks the first occurrence of the term in its document. It is found where the words of the text are gathered
    by term, so a text stays in the task that read it; deal a table of few row groups out by `spread` before.
    """
    if config == "simple":
        names = [f"_f{i}" for i in range(len(fields))]
        words = df.select(F.col(id_col).alias("id"), *[tokens(F.col(c)).alias(n) for (c, _), n in zip(fields, names)])
        return unpack(pack_words(words, [WEIGHTS[label] for _, label in fields]))
    words = document_words(df, fields, config, id_col)
    terms = to_terms(F.transform("words", lambda w: w["surface"]), config)
    words = words.withColumn("terms", terms).select("id", F.zip_with("words", "terms", lambda w, term: F.struct(
        term.alias("surface"), w["pos"].alias("pos"), w["weight"].alias("weight"))).alias("words"))
    return unpack(pack_words(words, None))


def term_bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write_version(postings: DataFrame, path: str, version: int, base: int) -> None:
    """Postings and document frequencies of one version; the version counts once `state`, written last, names its base.

    Postings are packed to lists by term before they are dealt out, so that lists and not occurrences are sorted.
    """
    bucketed = pack(postings).withColumn("bucket", term_bucket(F.col("term")))
    # By hash, as cutting ranges would build the postings twice; a frequent word is in all slices of its bucket.
    start = F.get("id", F.lit(0))
    ordered = bucketed.repartition("bucket", F.pmod(F.xxhash64(start), F.lit(SLICES))).sortWithinPartitions("bucket", "term", start)
    ordered.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings/version={version}")
    spark = postings.sparkSession
    stored = spark.read.schema(f"{LISTS}, bucket INT").parquet(f"{path}/postings/version={version}")
    frequencies = stored.select("bucket", "term", "docs").repartition("bucket").groupBy("bucket", "term").agg(F.sum("docs").alias("doc_freq"))
    frequencies.filter("doc_freq > 0").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{path}/doc_freq/version={version}")
    spark.createDataFrame([(base,)], "base INT").coalesce(1).write.mode("overwrite").parquet(f"{path}/state/version={version}")


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """(base, newest) version of a stored index: readers take these and all between."""
    versions = snapshot_versions(spark, f"{path}/state")
    if not versions:
        raise FileNotFoundError(f"no complete index under {path}")
    return spark.read.schema("base INT").parquet(f"{path}/state/version={versions[-1]}").first()[0], versions[-1]


def write_index(postings: DataFrame, path: str) -> None:
    """Store postings by term bucket and in the order of terms: a search reads the buckets of its words only.

    Of an index that is there already, this is a new base: readers leave all versions before it aside.
    """
    version = max(snapshot_versions(postings.sparkSession, f"{path}/state"), default=-1) + 1
    _write_version(postings, path, version, version)


def update_index(path: str, changed: DataFrame, fields: list[tuple[str, str]], config: str, id_col: str = "id") -> None:
    """Bring a stored index up to date with new or `changed` rows without touching what it holds.

    The ids are noted as replaced in all earlier versions, and their postings are added as a new version. A row whose
    fields are all empty is thereby removed. Each version keeps one list of all ids replaced since the base, with the
    version that replaced them last.
    """
    spark = changed.sparkSession
    base, newest = _state(spark, path)
    version = newest + 1
    replaced = changed.select(F.col(id_col).cast("long").alias("id"), F.lit(version).alias("since")).union(_replaced(spark, path, base, newest))
    replaced.groupBy("id").agg(F.max("since").alias("since")).write.mode("overwrite").parquet(f"{path}/replaced/version={version}")
    _write_version(build_index(changed, fields, config, id_col), path, version, base)


def _replaced(spark: SparkSession, path: str, base: int, newest: int) -> DataFrame:
    """(id, since): postings of an id from versions before `since` are outdated."""
    if newest == base:
        return spark.createDataFrame([], "id LONG, since INT")
    return spark.read.schema("id LONG, since INT").parquet(f"{path}/replaced/version={newest}")


def _stored(spark: SparkSession, path: str, kind: str, schema: str, terms: DataFrame | None) -> DataFrame:
    """Rows of one kind of all versions in use, with their version; of the buckets and `terms` asked for where given.

    The terms meet the rows on (bucket, term), and where Spark broadcasts them, their buckets prune the folders.
    """
    base, newest = _state(spark, path)
    rows = spark.read.schema(f"{schema}, version INT, bucket INT").parquet(f"{path}/{kind}")
    rows = rows.filter((F.col("version") >= base) & (F.col("version") <= newest))
    if terms is None:
        return rows
    wanted = terms.filter(F.col("term").isNotNull() & (F.col("term") != "")).select(term_bucket(F.col("term")).alias("bucket"), "term")
    return rows.join(wanted.distinct(), ["bucket", "term"], "left_semi")


def read_index(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """Postings of a stored index as its updates left them, only those of `terms` where these are given."""
    lists = _stored(spark, path, "postings", LISTS, terms)
    base, newest = _state(spark, path)
    if newest == base:
        return unpack(lists.drop("version", "bucket"))
    rows = unpack(lists, "version")
    rows = rows.join(_replaced(spark, path, base, newest), "id", "left").filter(F.col("since").isNull() | (F.col("version") >= F.col("since")))
    return rows.select("term", "id", "pos", "weight", "first")


def read_doc_freq(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc_freq) kept with the index. After updates, replaced documents still count until `compact_index`."""
    rows = _stored(spark, path, "doc_freq", "term STRING, doc_freq LONG", terms)
    return rows.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"))


def compact_index(spark: SparkSession, path: str) -> None:
    """Fold all updates into a new base, without the postings they replaced; readers of the old base are not disturbed."""
    write_index(read_index(spark, path), path)


def expire_index(spark: SparkSession, path: str) -> None:
    """Delete versions before the base in use; for times when no reader uses them any more."""
    base, _ = _state(spark, path)
    for kind in ("state", "postings", "doc_freq", "replaced"):
        delete_versions(spark, f"{path}/{kind}", base)


def search_index(
    path: str, requests: DataFrame, config: str, depth: int | None = None, text: str = "q", key: str = "request_id"
) -> DataFrame:
    """search_fts over a stored index; only the buckets of the requests' words are read."""
    return search_fts(path, requests, config, depth, text, key)


def doc_freq(postings: DataFrame) -> DataFrame:
    """Documents per term; map tasks count before the shuffle."""
    return postings.filter("first").groupBy("term").agg(F.count("*").alias("doc_freq"))


def vocabulary(df: DataFrame, fields: list[tuple[str, str]], config: str, id_col: str = "id") -> DataFrame:
    """Distinct written forms with their term and number of occurrences."""
    words = tokenize(df, fields, config, id_col)
    forms = words.groupBy("surface").agg(F.count("*").alias("occurrences"))
    return forms.select("surface", to_term(F.col("surface"), config).alias("term"), "occurrences")


def plain_query(requests: DataFrame, config: str, text: str = "q", key: str = "request_id") -> DataFrame:
    """Distinct terms (request_id, term, n_terms) of every request; a stop-word text has none."""
    found = requests.select(
        F.col(key), F.explode(positioned(F.col(text), config)["surface"]).alias("surface")
    )
    terms = found.select(key, to_term(F.col("surface"), config).alias("term")).distinct()
    return terms.withColumn("n_terms", F.count("*").over(Window.partitionBy(key)))


def match_terms(
    postings: DataFrame, terms: DataFrame, key: str = "request_id",
    allowed: Callable[[DataFrame], DataFrame] | None = None, frequencies: DataFrame | None = None,
) -> DataFrame:
    """Occurrences (request_id, id, n_terms, term, pos, weight) in documents with every term of a request.

    Candidates come from the rarest term of each request only; its other terms are looked up for
    those candidates by (id, term). A frequent word is therefore never joined against all documents.
    `allowed` may drop candidate pairs (request_id, id) before their occurrences are fetched. `frequencies` (term,
    doc_freq), where kept, spare the count.
    """
    # Where the requests' words are few, Spark broadcasts them and map tasks keep only their postings.
    # They are kept, as counting, choosing and fetching would each read all postings.
    used = stage(postings.join(terms.select("term").distinct(), "term", "left_semi"))
    counted = terms.join(doc_freq(used) if frequencies is None else frequencies, "term")
    whole = Window.partitionBy(key)
    rarest = (
        counted.withColumn("_found", F.count("*").over(whole))
        .filter("_found = n_terms")
        .withColumn("_place", F.row_number().over(whole.orderBy("doc_freq", "term")))
        .filter("_place = 1")
        .select(key, "term", "n_terms")
        .join(terms.groupBy(key).agg(F.collect_set("term").alias("terms")), key)
    )
    firsts = used.filter("first").select("term", "id")
    candidates = spread(rarest, key, "term").join(firsts, "term").select(key, "n_terms", "terms", "id")
    if allowed is not None:
        candidates = allowed(candidates).select(key, "n_terms", "terms", "id")
    # By document as well as by request: one request may match a large part of all documents.
    candidates = spread(candidates, key, "id")
    # Each carries its request's terms, so that they need no join on the request.
    wanted = candidates.select(key, "n_terms", "id", F.explode("terms").alias("term"))
    hits = wanted.join(used, ["id", "term"])
    found = F.sum(F.col("first").cast("int")).over(Window.partitionBy(key, "id"))
    return hits.withColumn("_found", found).filter("_found = n_terms").drop("_found", "first")


def rank_matches(matches: DataFrame, key: str = "request_id") -> DataFrame:
    """Rank (request_id, id, rank) of every matched document.

    Occurrences are walked in position order with the at most 100 before them, so work grows with
    the text length and not with its square.
    """
    in_doc = Window.partitionBy(key, "id").orderBy("pos")
    near = in_doc.rangeBetween(-MAX_DISTANCE, -1)
    walked = matches.withColumn("j", F.row_number().over(in_doc)).withColumn(
        "near", F.when(F.col("n_terms") > 1, F.collect_list(F.struct("pos", "weight", "term")).over(near))
    )

    def log_miss(acc: Column, x: Column) -> Column:
        distance = (F.col("pos") - x["pos"]).cast("double")
        decay = F.lit(DECAY_BASE) + F.lit(DECAY_SCALE) * F.exp(distance / DECAY_WIDTH - DECAY_SHIFT)
        closeness = F.sqrt(F.col("weight") * x["weight"] / decay)
        return acc + F.when(x["term"] == F.col("term"), F.lit(0.0)).otherwise(F.log1p(-closeness))

    scored = walked.select(
        key, "id", "n_terms", "weight", "j",
        F.aggregate("near", F.lit(0.0), log_miss).alias("log_miss"),
    )
    grouped = scored.groupBy(key, "id").agg(
        F.first("n_terms").alias("n_terms"),
        F.sum("log_miss").alias("log_miss"),
        F.sum(F.col("weight") / (F.col("j") * F.col("j"))).alias("series"),
        F.min(F.struct((-F.col("weight")).alias("w"), F.col("j").alias("m"))).alias("best"),
    )
    top, m = -F.col("best.w"), F.col("best.m")
    single = (top + F.col("series") - top / (m * m)) / F.lit(SINGLE_TERM_SCALE)
    several = -F.expm1("log_miss")
    rank = F.when(F.col("n_terms") == 1, single).otherwise(several)
    return grouped.select(key, "id", rank.cast("float").cast("double").alias("rank"))


def search_fts(
    postings: DataFrame | str, requests: DataFrame, config: str, depth: int | None = None,
    text: str = "q", key: str = "request_id", allowed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ranked matches (request_id, id, rank); with `depth` only the best of each request.

    `postings` are rows, or the path of a stored index, of which only the words of the requests are read.
    """
    # The words of the requests are read by every step of the match: written once, of known size.
    terms, frequencies = stage(plain_query(requests, config, text, key)), None
    if isinstance(postings, str):
        spark, words = requests.sparkSession, terms.select("term").distinct()
        postings, frequencies = read_index(spark, postings, words), read_doc_freq(spark, postings, words)
    ranked = rank_matches(match_terms(postings, terms, key, allowed, frequencies), key)
    if depth is None:
        return ranked
    return top_rows(ranked, [key], [F.desc("rank"), F.col("id")], depth)
