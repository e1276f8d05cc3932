"""N-gram Jaccard join: components of documents whose sets of word shingles are alike.

Two documents link when 100 * |A and B| >= percent * |A or B|. Candidates must share prefix tokens under several
global orders of the tokens, as in any order the first |A| - needed + 1 tokens of two linked sets have one in common:

1. By code. Of each set a prefix longer by `extra` tokens is posted, and two linked sets then share `extra` + 1 of
   them. A set of which too few posted tokens occur elsewhere cannot link, which ends the matter for most documents.
2. By frequency among the sets left, rarest first, ties by another hash. Only tokens of this prefix that occur more
   than once are posted, and pairs are formed on them.
3. A pair's prefixes by code and by a third order must meet as well before the sets themselves are compared.

Equal sets are one node, so copies are never paired. Groups of near copies are not expanded either: in each round the
nodes posted under a token are compared with one of them, the hub, unless they are known to be connected. When
rounds find nothing new, all pairs left under a token that are not yet connected are compared, so no link that matters
to a component is lost. Each is made at its first common token, where both sets must have enough tokens left, and the
join drops pairs whose parity bitmaps differ in more bits than two linked sets can differ in tokens, as each differing
token flips one bit. Components are kept in tables, halving paths by joins; links are never gathered.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.words import MIX, WORD_CODES, claim, lists, shingles, slices, with_columns
from shelfspark.sources.storage import stage

SHINGLE = 5
PERCENT = 75
ROUNDS = 6
GAIN = 0.02
RECENT = 16
WORDS = 16
BITMAP = [f"bits{i}" for i in range(WORDS)]


def needed(n, percent: int):
    """Least overlap of a set of `n` with any linked one: the whole numbers from percent of n."""
    return -(-(n * percent) // 100)


def extra(n):
    """Tokens by which the prefix of a set of `n` is lengthened in the first order."""
    return n // 8


def prefix_length(n, percent: int):
    return n - needed(n, percent) + 1


def column_needed(n, percent: int):
    return F.ceil(n * percent / 100)


def set_key(tokens: np.ndarray) -> int:
    """64-bit identity of a set, as a signed number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)))))


def parity_bitmap(tokens: np.ndarray) -> list[int]:
    """WORDS signed numbers whose bits say of how many tokens, odd or even, each is the hash."""
    places = ((tokens * MIX) >> np.uint64(40)) % np.uint64(WORDS * 64)
    odd = (np.bincount(places.astype(np.int64), minlength=WORDS * 64) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _third_order(tokens: np.ndarray) -> np.ndarray:
    """Codes under which the third order sorts."""
    mixed = (tokens ^ (tokens >> np.uint64(31))) * MIX
    return mixed ^ (mixed >> np.uint64(33))


def _members(docs: DataFrame, identity: str, text: str, n: int) -> DataFrame:
    """(id, n_shingles, key) of every row; key is null for an empty set."""

    def compute(texts):
        claim(WORD_CODES)
        sets = [shingles(t, n) for t in texts]
        return {"n_shingles": [len(s) for s in sets], "key": [set_key(s) if len(s) else None for s in sets]}

    rows = docs.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    return with_columns(rows, "text", "n_shingles LONG, key LONG", compute)


def _first_prefixes(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """(key, n_shingles, tokens): the lengthened prefix by code; equal sets of an Arrow batch once."""

    def run(batches):
        claim(WORD_CODES)
        for whole in batches:
            for batch in slices(whole, "text"):
                keys, sizes, tokens = [], [], []
                for t in dict.fromkeys(batch.column(0).to_pylist()):
                    own = shingles(t, n)
                    if len(own):
                        keys.append(set_key(own))
                        sizes.append(len(own))
                        tokens.append(own[: prefix_length(len(own), percent) + extra(len(own))].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), lists(tokens, pa.int64())],
                    ["key", "n_shingles", "tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key LONG, n_shingles LONG, tokens ARRAY<LONG>")


def _plausible(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """Keys of sets that share enough of their first prefix with other sets."""
    posted = _first_prefixes(docs, text, n, percent).select("key", "n_shingles", F.explode("tokens").alias("token"))
    same = Window.partitionBy("token")
    common = (
        posted.withColumn("low", F.min("key").over(same)).withColumn("high", F.max("key").over(same))
        .filter("low <> high").select("key", "n_shingles", "token")
    )
    least = 1 + F.floor(column_needed(F.col("n_shingles"), percent) / 8)
    return (
        common.groupBy("key", "n_shingles", "token").count()
        .groupBy("key", "n_shingles").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least).select("key")
    )


def _texts_of(docs: DataFrame, members: DataFrame, keys: DataFrame, identity: str, text: str, n: int) -> DataFrame:
    """(key, text, parity bitmap), one row for each of `keys`."""
    firsts = members.join(keys, "key", "left_semi").groupBy("key").agg(F.min("id").alias("first"))
    rows = docs.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    found = rows.join(firsts, F.col("id").eqNullSafe(F.col("first"))).select("key", "text")

    def compute(texts):
        sets = [shingles(t, n) for t in texts]
        bitmaps = zip(*[parity_bitmap(s) for s in sets]) if sets else [()] * WORDS
        return {"own": [set_key(s) if len(s) else None for s in sets]} | dict(zip(BITMAP, map(list, bitmaps)))

    ddl = "own LONG, " + ", ".join(f"{b} LONG" for b in BITMAP)
    checked = with_columns(found, "text", ddl, compute, keep_text=True).filter("key = own")
    return checked.dropDuplicates(["key"]).select("key", "text", *BITMAP)


def _second_postings(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(token, key, n_shingles, place, rest): tokens of the prefix rarest first that more than one set has.

    `rest` counts the token and those of the set that come after it in this order and occur in other sets as well.
    """

    def compute(rows):
        sets = [shingles(t, n) for t in rows]
        return {"n_shingles": [len(s) for s in sets], "tokens": lists([s.view(np.int64) for s in sets], pa.int64())}

    all_tokens = with_columns(texts, "text", "n_shingles LONG, tokens ARRAY<LONG>", compute).select(
        "key", "n_shingles", F.explode("tokens").alias("token"))
    frequent = all_tokens.withColumn("df", F.count("*").over(Window.partitionBy("token"))).filter("df > 1")
    ordered = frequent.groupBy("key", "n_shingles").agg(
        F.array_sort(F.collect_list(F.struct("df", F.xxhash64("token").alias("tie"), "token"))).alias("tokens"))
    room = F.size("tokens") - column_needed(F.col("n_shingles"), percent) + 1
    prefix = F.slice("tokens", 1, F.greatest(room, F.lit(0)).cast("int"))
    placed = ordered.select("key", "n_shingles", F.size("tokens").alias("size"), F.posexplode(prefix).alias("place", "t"))
    return placed.select("t.token", "key", "n_shingles", "place", (F.col("size") - F.col("place")).alias("rest"))


def _linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Which of the `pairs` (a, b) link: prefixes by code and by the third order first, then the sets."""
    both = (
        pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    )

    def alike(left: np.ndarray, right: np.ndarray) -> bool:
        ends = [prefix_length(len(s), percent) for s in (left, right)]
        if not len(np.intersect1d(left[: ends[0]], right[: ends[1]], assume_unique=True)):
            return False
        others = [np.sort(_third_order(s))[:e] for s, e in zip((left, right), ends)]
        if not len(np.intersect1d(*others, assume_unique=True)):
            return False
        inner = len(np.intersect1d(left, right, assume_unique=True))
        return 100 * inner >= percent * (len(left) + len(right) - inner)

    def run(batches):
        last, last_set = None, None
        for whole in batches:
            for batch in slices(whole, "text_b"):
                found = []
                for ta, tb in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                    if tb != last:
                        last, last_set = tb, shingles(tb, n)
                    found.append(alike(shingles(ta, n), last_set))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(found, pa.bool_())], ["a", "b", "linked"])

    return both.mapInArrow(run, "a LONG, b LONG, linked BOOLEAN")


def components(edges: DataFrame) -> DataFrame:
    """(key, component) for every end of `edges` (a, b): the smallest key it is connected with.

    Each node takes the smallest label among its own, its neighbours' and its label's label, until nothing changes.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = stage(both.groupBy(F.col("a").alias("key")).agg(F.least(F.col("key"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(
            F.min("component").alias("near"))
        jump = labels.select(F.col("key").alias("component"), F.col("component").alias("jump"))
        moved = stage(labels.join(near, "key").join(jump, "component").select(
            "key", F.least("component", "near", "jump").alias("now"), F.col("component").alias("was")))
        changed = moved.filter("now <> was").limit(1).count()
        labels = moved.select("key", F.col("now").alias("component"))
        if not changed:
            return labels


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: the links are taken between components, which are then relabelled."""
    if labels is None:
        return components(links)

    def label(side):
        return labels.select(F.col("key").alias(side), F.col("component").alias(f"{side}_label"))

    between = (
        links.join(label("a"), "a", "left").join(label("b"), "b", "left")
        .select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    )
    above = components(between).select(F.col("key").alias("component"), F.col("component").alias("above"))
    known = labels.select("key", "component").union(links.select("a", "a")).union(links.select("b", "b"))
    known = known.groupBy("key").agg(F.min("component").alias("component"))
    return stage(known.join(above, "component", "left").select("key", F.coalesce("above", "component").alias("component")))


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("component", F.col("key"))
    return postings.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))


def _sizes_fit(one: str, other: str, percent: int):
    return 100 * F.least(one, other) >= percent * F.greatest(one, other)


def _hub_pairs(rows: DataFrame, seed: int, percent: int) -> DataFrame:
    """Each posted node with its token's hub, the node of smallest hash, where they are not yet connected."""
    hubs = rows.groupBy("token").agg(F.min(F.struct(
        F.xxhash64("key", F.lit(seed)).alias("place"), "key", "n_shingles", "component")).alias("hub"))
    met = rows.join(hubs, "token").filter(
        (F.col("component") != F.col("hub.component")) & _sizes_fit("n_shingles", "hub.n_shingles", percent))
    return met.select(F.col("key").alias("a"), F.col("hub.key").alias("b")).distinct()


def _rest_pairs(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """All pairs under a token that are not yet connected and may link by size, place and bitmap.

    One side is outside the token's largest component, so that component is never paired with itself. A pair is made at
    the first token that both prefixes have: rows carry the RECENT tokens before theirs, and where one of these is common
    too, the pair has been made there already. From the first common token on, both sets must have enough tokens left.
    """
    counts = rows.groupBy("token", "component").count()
    largest = counts.groupBy("token").agg(
        F.max(F.struct("count", "component")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = rows.join(largest.select("token", F.col("most.component").alias("main")), "token")
    before = Window.partitionBy("key").orderBy("place").rowsBetween(-RECENT, -1)
    mixed = mixed.withColumn("recent", F.collect_list("token").over(before))
    mixed = mixed.join(texts.select("key", *BITMAP), "key")
    outer = mixed.filter("component <> main").select(
        "token", F.col("key").alias("a"), F.col("n_shingles").alias("n_a"), F.col("component").alias("component_a"),
        F.col("rest").alias("rest_a"), F.col("recent").alias("recent_a"), *[F.col(b).alias(f"{b}_a") for b in BITMAP])
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_a"))) for b in BITMAP), F.lit(0))
    both = F.col("n_shingles") + F.col("n_a")
    met = outer.join(mixed, "token").filter(
        (F.col("component") != F.col("component_a")) & _sizes_fit("n_shingles", "n_a", percent)
        & (F.least("rest", "rest_a") * (100 + percent) >= both * percent)
        & (differ * (100 + percent) <= both * (100 - percent))
        & ~F.arrays_overlap("recent", "recent_a")
        & ((F.col("component") == F.col("main")) | (F.col("a") < F.col("key"))))
    return met.select("a", F.col("key").alias("b")).distinct()


def _untested(pairs: DataFrame, tested: list[DataFrame]) -> DataFrame:
    for known in tested:
        pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        pairs = pairs.join(known.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    return pairs


def key_components(docs: DataFrame, members: DataFrame, identity: str, text: str, n: int, percent: int) -> DataFrame | None:
    """(key, component) of the sets that link with another one, or None if no set can."""
    keys = stage(_plausible(docs, text, n, percent))
    texts = stage(_texts_of(docs, members, keys, identity, text, n))
    postings = stage(_second_postings(texts, n, percent))
    labels, tested, nodes = None, [], texts.count()
    for seed in range(ROUNDS + 1):
        rows = _labelled(postings, labels)
        last = seed == ROUNDS
        pairs = _untested(_rest_pairs(rows, texts, percent) if last else _hub_pairs(rows, seed, percent), tested)
        checked = stage(_linked(pairs, texts, n, percent))
        tested.append(checked)
        links = checked.filter("linked")
        found = links.count()
        if found:
            labels = _joined(labels, links)
        if not last and found < GAIN * nodes:
            rows = _labelled(postings, labels)
            links = stage(_linked(_untested(_rest_pairs(rows, texts, percent), tested), texts, n, percent)).filter("linked")
            return _joined(labels, links) if links.limit(1).count() else labels
    return labels


def jaccard_components(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(identity, n_shingles, component_id) of every row: the smallest identity among the rows it is connected with.

    This runs jobs at once and writes its steps to the shared folder. Texts without words, null or empty, link with
    nothing and are their own component. Rows with equal sets are one group, also when they repeat an id. A null id is
    never the smallest unless its whole group has none. An empty table gives no rows.
    """
    members = stage(_members(docs, identity, text, n))
    labels = key_components(docs, members, identity, text, n, percent)
    classes = members.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"))
    if labels is not None:
        classes = classes.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
        heads = classes.groupBy("component").agg(F.min("first").alias("head"))
        classes = classes.join(heads, "component").select("key", "head")
    else:
        classes = classes.withColumnRenamed("first", "head")
    return members.join(classes, "key", "left").select(
        F.col("id").alias(identity), "n_shingles",
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("head")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each component, with its columns: the smallest identity, of its rows any one.

    Rows without words stay, as they are alike to nothing. Components of which no row has an identity keep one row.
    """
    content = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    own = docs.select(F.col(text).alias("text"), F.struct(F.col(identity).isNull(), F.col(identity), content).alias("row"))
    found = jaccard_components(own.select("row", "text"), "row", "text")
    kept = found.filter((F.col("n_shingles") > 0) & (F.col("row") == F.col("component_id"))).select(F.col("row").alias("kept")).distinct()
    packed = docs.select(
        F.struct(*docs.columns).alias("doc"), F.struct(F.col(identity).isNull(), F.col(identity), content).alias("row"),
        F.coalesce(F.length(F.regexp_replace(F.col(text), r"[ \t\n\x0B\f\r]+", "")) > 0, F.lit(False)).alias("worded"))
    first = Window.partitionBy("row").orderBy(F.lit(0))
    worded = packed.filter("worded").join(kept, F.col("row").eqNullSafe(F.col("kept")), "left_semi")
    worded = worded.withColumn("copy", F.row_number().over(first)).filter("copy = 1")
    return worded.select("doc.*").unionByName(packed.filter("NOT worded").select("doc.*"))
