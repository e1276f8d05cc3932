"""Repeated passages: words inside a window of `n` words whose words also start earlier in the corpus.

Suffix automata of reference shards find them, and documents are streamed through for matching statistics: at each word,
the length of the longest run ending there that the shard has seen. Windows are where it is `n` or more. As the reference
is the corpus itself, its shards cannot all be broadcast; what can match is brought to one shard instead:

1. Of each window the gram of GRAM words with the smallest code is its anchor, so equal windows have equal anchors. The
   windows of one occurrence of an anchor follow one another, and the words they cover are a segment.
2. Only segments of anchors that occur more than once go on. Equal segments are one, kept at their earliest place; where
   an anchor has more than HOT occurrences, each window is a segment of its own, so a frequent anchor with very
   many surroundings is dealt out by window.
3. Segments whose anchor has other segments too go to a shard by anchor. A shard's segments come in corpus order; each is first streamed through the
   automaton of those before it, then added to it. A shard holds about SHARD_WORDS words, however large the corpus.
4. Windows found, and all windows of segments that are not at their earliest place, are laid over the texts.

Whole copies of a text are told by digest beforehand. Keys with more than a 1024th of all rows, 1024 at most, are joined
by broadcast and the others by shuffle, so no frequent passage lands in one task.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.joins import by_key
from shelfspark.llm.words import MIX, STEP, claim, lists, sha256, slices, windows, with_columns
from shelfspark.sources.storage import stage, unstage

WINDOW = 20
GRAM = 8
HOT = 4096
SHARD_WORDS = 100_000
SEGMENT = ("anchor", "run", "first", "windows")
LAID = "n_removed LONG, kept_sha256 STRING, kept STRING, spans ARRAY<STRUCT<start: INT, end: INT>>"
LONG_WORD = 4096
PIECE_BYTES = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_LETTER = np.array([not _GAP.match(bytes([b])) for b in range(256)])
# Codes of bytes and powers by place, both made from the mixing constants.
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_POWER = np.multiply.accumulate(np.full(LONG_WORD, STEP))
_ONE = np.ones(1, np.uint64)
_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


class SuffixAutomaton:
    """All runs of the words added so far. A state's run lengths end at `length`, its links lead to shorter ends."""

    def __init__(self):
        self.arcs: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _split(self, state: int, word, target: int) -> int:
        """A copy of `target` for runs no longer than those of `state` and a word; earlier arcs then lead to it."""
        arcs, link = self.arcs, self.link
        copy = len(arcs)
        arcs.append(arcs[target].copy())
        link.append(link[target])
        self.length.append(self.length[state] + 1)
        link[target] = copy
        while state >= 0 and arcs[state].get(word) == target:
            arcs[state][word] = copy
            state = link[state]
        return copy

    def add(self, words: list) -> None:
        """All runs of these words as well."""
        arcs, link, length, last = self.arcs, self.link, self.length, 0
        for word in words:
            target = arcs[last].get(word)
            if target is not None:
                last = target if length[target] == length[last] + 1 else self._split(last, word, target)
                continue
            made, state = len(arcs), last
            arcs.append({})
            link.append(0)
            length.append(length[last] + 1)
            while state >= 0 and word not in arcs[state]:
                arcs[state][word] = made
                state = link[state]
            if state >= 0:
                target = arcs[state][word]
                link[made] = target if length[target] == length[state] + 1 else self._split(state, word, target)
            last = made

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest run ending there that has been added."""
        arcs, link, length = self.arcs, self.link, self.length
        state = size = 0
        out = []
        for word in words:
            target = arcs[state].get(word)
            while target is None and state:
                state = link[state]
                size = length[state]
                target = arcs[state].get(word)
            if target is not None:
                state, size = target, size + 1
            out.append(size)
        return out


def matched(automaton: SuffixAutomaton, words: list, n: int) -> int:
    """Windows of the words that the automaton holds: bit i is for the window at word i."""
    return sum(1 << (i - n + 1) for i, size in enumerate(automaton.statistics(words)) if size >= n)


def _split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit code of each word: the sum of its bytes' codes times powers by place, over arrays of bytes.

    Words of over LONG_WORD bytes are hashed one by one, so that tables of places stay small.
    """
    data, out, start = (text or "").encode("utf-8", "surrogatepass"), [], 0
    while start < len(data):
        end = start + PIECE_BYTES
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        out.append(_piece_codes(data[start:end]))
        start = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _piece_codes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = _LETTER[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    out = np.empty(len(starts), np.uint64)
    short = sizes <= LONG_WORD
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
        inside[starts[i] : starts[i] + sizes[i]] = False
    if short.any():
        sizes = sizes[short]
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        code = np.add.reduceat(_BYTE[raw[inside]] * _POWER[place], first) + sizes.astype(np.uint64)
        code = (code ^ (code >> np.uint64(32))) * MIX
        out[short] = code ^ (code >> np.uint64(29))
    return out


def anchor_places(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each segment of a text's word codes."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = windows(words, GRAM)
    view = np.lib.stride_tricks.sliding_window_view(grams, n - GRAM + 1)
    at = np.arange(len(view)) + view.argmin(axis=1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return grams[at[first]], first, np.diff(first, append=len(view))


def run_codes(words: np.ndarray, first: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """A code of the words of each segment, by differences of prefix sums: equal wherever the words stand."""
    with np.errstate(over="ignore"):
        power, back = (np.multiply.accumulate(np.concatenate((_ONE, np.full(len(words), x)))) for x in (STEP, _BACK))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((words ^ (words >> np.uint64(29))) * power[:-1])))
        run = (total[first + count + n - 1] - total[first]) * back[first] + count.astype(np.uint64) * MIX
        return (run ^ (run >> np.uint64(32))) * MIX


def _place(*more: str) -> Column:
    """Where a segment stands in corpus order: reference rows first, null ids last."""
    return F.struct("own", F.col("id").isNull().alias("unnamed"), "id", "h", *more)


def _rows(docs: DataFrame, own: bool, identity: str, text: str) -> DataFrame:
    """Texts with two codes of their content, (h, g), and one of row and content, k; (k, h) tells documents apart."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.lit(own).alias("own"), F.col(identity).alias("id"), F.xxhash64(content).alias("h"),
        F.xxhash64(F.lit(1), content).alias("g"), content.alias("text"),
    ).withColumn("k", F.xxhash64("own", "id", "g"))


def _cut(rows: DataFrame, n: int) -> DataFrame:
    """Number and digest of the words of every text, and its anchors."""

    def compute(texts):
        claim()
        out, anchors = {"n_words": [], "whole": []}, []
        for text in texts:
            words = _split_words(text)
            out["n_words"].append(len(words))
            out["whole"].append(sha256(b" ".join(words)))
            anchors.append(anchor_places(word_codes(text), n)[0].view(np.int64))
        return out | {"anchors": lists(anchors, pa.int64())}

    return with_columns(rows, "text", "n_words LONG, whole STRING, anchors ARRAY<LONG>", compute)


def _word_lists(held: DataFrame, n: int) -> DataFrame:
    """Each segment that stands at its earliest place, with its word codes."""

    def run(batches):
        claim()
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, parts, rows = [], [], []
                for row, (text, found) in enumerate(zip(batch.column("text").to_pylist(), batch.column("found").to_pylist())):
                    words = word_codes(text).view(np.int64)
                    flat += [words[p["first"] : p["first"] + p["windows"] + n - 1] for p in found]
                    parts += found
                    rows += [row] * len(found)
                of_row = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("own", "id", "h")]
                own = [pa.array([p[c] for p in parts], t) for c, t in (("anchor", pa.int64()), ("run", pa.int64()), ("first", pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [*of_row, *own, lists(flat, pa.int64())], ["own", "id", "h", "anchor", "run", "first", "words"])

    kind = dict(held.dtypes)["id"]
    return held.select("own", "id", "h", "text", "found").mapInArrow(
        run, f"own BOOLEAN, id {kind}, h LONG, anchor LONG, run LONG, first INT, words ARRAY<LONG>")


def _streamed(words: DataFrame, shards: int, n: int) -> DataFrame:
    """(anchor, run, seen): the windows of each segment that earlier segments of its shard hold."""
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        words.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        .repartition(min(tasks, shards), "shard")
        .sortWithinPartitions("shard", "own", F.col("id").isNull(), "id", "h", "first")
        .select("shard", "anchor", "run", "words")
    )

    def run(batches):
        shard = automaton = None
        for batch in batches:
            seen = []
            for mine, part in zip(batch.column("shard").to_pylist(), batch.column("words").to_pylist()):
                if mine != shard:
                    shard, automaton = mine, SuffixAutomaton()
                seen.append(matched(automaton, part, n))
                automaton.add(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor"), batch.column("run"), pa.array(seen, pa.int64())], ["anchor", "run", "seen"])

    return dealt.mapInArrow(run, "anchor LONG, run LONG, seen LONG")


def _laid(found: DataFrame, n: int) -> DataFrame:
    """`found` rows (text, gone: first word and bits of its windows) with their removed spans and kept words."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                removed, kept, digests, spans = [], [], [], []
                for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                    words = _split_words(text)
                    step = np.zeros(len(words) + 1, np.int64)
                    for part in gone:
                        for low in range(part["bits"].bit_length()):
                            if part["bits"] >> low & 1:
                                step[part["first"] + low] += 1
                                step[part["first"] + low + n] -= 1
                    cover = np.cumsum(step[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], cover, [0]))))
                    rest = b" ".join([w for w, c in zip(words, cover.tolist()) if not c])
                    removed.append(int(cover.sum()))
                    digests.append(sha256(rest))
                    kept.append(rest.decode("utf-8", "replace"))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), batch.column("h"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                     pa.array(kept, pa.string()), pa.array(spans, kind)],
                    ["k", "h", "n_removed", "kept_sha256", "kept", "spans"])

    return found.select("k", "h", "text", "gone").mapInArrow(run, f"k LONG, h LONG, {LAID}")


def find_repeats(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", n: int = WINDOW, reference: DataFrame | None = None,
    hot: int = HOT, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept, spans) of every row of `docs`.

    A word goes when a window of `n` words over it starts earlier too: in a row of smaller id, at an earlier word of the
    same row, or anywhere in `reference`, a table with the same two columns. `spans` are maximal runs of removed words,
    end exclusive, and `kept` the words left, joined by one space; both are null where no word or every word of a copy goes.

    This runs jobs at once. Texts that are null or have fewer than `n` words keep all their words. Repeated rows of an id
    and text are one document and each give the same row. Rows with one id and different texts come in an order fixed by
    content. Null ids come last. An empty table gives no rows; other columns are not read.
    """
    if not GRAM <= n <= 62 + GRAM:
        raise ValueError(f"windows have {GRAM} to {62 + GRAM} words")
    rows = _rows(docs, True, identity, text)
    if reference is not None:
        rows = rows.unionByName(_rows(reference, False, identity, text))
    cut = stage(_cut(rows, n))
    facts = cut.select("own", "id", "k", "h", "g", "n_words", "whole", (F.size("anchors") > 0).alias("windowed"))
    copies = facts.groupBy("h", "g").agg(F.min(_place()).alias("origin"), F.count("*").alias("n"))
    known = stage(by_key(facts, copies, ["h", "g"], cut.count()).withColumn("copy", _place() != F.col("origin")).drop("origin", "n"))
    parts = cut.select("k", "h", F.explode("anchors").alias("anchor"))
    anchors = stage(parts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    total = anchors.agg(F.sum("n")).first()[0] or 0
    shared = by_key(parts, anchors, ["anchor"], total).select("k", "h", "anchor", (F.col("n") > hot).alias("fine"))
    held = stage(_with_texts(rows, shared, known.filter("copy"), n))
    unstage(cut)
    places = held.select("own", "id", "k", "h", F.explode("found").alias("s")).select("own", "id", "k", "h", "s.*")
    facts = places.groupBy("anchor", "run").agg(
        F.min(_place("first")).alias("origin"), F.count("*").alias("n"), F.max("windows").alias("windows"))
    # A window can only be met in another segment of its anchor, so an anchor with one kind of segment needs no shard.
    kinds = facts.groupBy("anchor").agg((F.count("*") > 1).alias("varied"))
    facts = stage(facts.join(kinds, "anchor"))
    size = facts.agg(F.sum("n").alias("places"), F.sum(F.when(F.col("varied"), F.col("windows") + (n - 1))).alias("words")).first()
    placed = stage(
        by_key(places, facts.drop("windows"), ["anchor", "run"], size["places"] or 0)
        .withColumn("here", _place("first") == F.col("origin")).drop("origin", "n"))
    earliest = placed.filter("here AND varied").groupBy("k", "h").agg(F.collect_list(F.struct(*SEGMENT)).alias("found"))
    shards = max(1, -(-(size["words"] or 0) // shard_words))
    texts = held.drop("found")
    seen = stage(_streamed(_word_lists(earliest.join(texts, ["k", "h"]), n), shards, n).filter("seen <> 0"))
    mine = placed.filter("own")
    gone = mine.filter("NOT here").select("k", "h", "first", F.expr("shiftleft(1L, windows) - 1").alias("bits")).unionByName(
        mine.filter("here").join(seen, ["anchor", "run"]).select("k", "h", "first", F.col("seen").alias("bits")))
    gone = gone.groupBy("k", "h").agg(F.collect_list(F.struct("first", "bits")).alias("gone"))
    laid = _laid(gone.join(texts, ["k", "h"]), n)
    whole = F.col("copy") & F.col("windowed")
    return known.filter("own").join(laid, ["k", "h"], "left").select(
        "id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(~whole, F.col("kept")).alias("kept"), F.when(~whole, F.col("spans")).alias("spans"),
    )


def _with_texts(rows: DataFrame, shared: DataFrame, copies: DataFrame, n: int) -> DataFrame:
    """Texts with a shared anchor, one row each and no copies, and their segments; those of hot anchors as single windows."""
    per_text = shared.groupBy("k", "h").agg(F.collect_set(F.struct("anchor", "fine")).alias("shared"))
    per_text = per_text.join(copies.select("k", "h"), ["k", "h"], "left_anti")
    both = per_text.join(rows, ["k", "h"]).select("own", "id", "k", "h", "text", "shared").dropDuplicates(["k", "h"])
    kinds = (("anchor", pa.int64()), ("run", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()))

    def found(text: str, anchors: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        words = word_codes(text)
        anchor, first, count = anchor_places(words, n)
        run = run_codes(words, first, count, n)
        plain, fine = (np.isin(anchor.view(np.int64), anchors[c]) for c in ("plain", "fine"))
        out = [x[plain] for x in (anchor, run, first, count)]
        if fine.any():
            each = windows(words, n)
            at = np.concatenate([np.arange(f, f + c) for f, c in zip(first[fine].tolist(), count[fine].tolist())])
            out = [np.concatenate(x) for x in zip(out, (each[at], each[at], at, np.ones(len(at), np.int64)))]
        return (out[0].view(np.int64), out[1].view(np.int64), *out[2:])

    def run(batches):
        claim()
        for whole in batches:
            for batch in slices(whole, "text"):
                shared, parts = batch.column("shared"), []
                edges, flat = shared.offsets.to_numpy() - shared.offsets[0].as_py(), shared.flatten()
                anchor, fine = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fine"))
                for text, a, b in zip(batch.column("text").to_pylist(), edges.tolist(), edges[1:].tolist()):
                    own, hot = anchor[a:b], fine[a:b]
                    parts.append(found(text, {"plain": own[~hot], "fine": own[hot]}))
                offsets = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts]))).astype(np.int32)
                columns = [pa.array(np.concatenate([p[i] for p in parts]), kind) for i, (_, kind) in enumerate(kinds)]
                segments = pa.StructArray.from_arrays(columns, [c for c, _ in kinds])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("own", "id", "k", "h", "text")], pa.ListArray.from_arrays(pa.array(offsets), segments)],
                    ["own", "id", "k", "h", "text", "found"])

    kind = dict(rows.dtypes)["id"]
    return both.mapInArrow(
        run, f"own BOOLEAN, id {kind}, k LONG, h LONG, text STRING, "
        "found ARRAY<STRUCT<anchor: LONG, run: LONG, first: INT, windows: INT>>")


def repeat_counts(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(identity, n_words, n_removed, kept_sha256) of every row."""
    return find_repeats(docs, identity, text).select(F.col("id").alias(identity), "n_words", "n_removed", "kept_sha256")
