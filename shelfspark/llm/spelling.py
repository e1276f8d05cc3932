"""Spelling variants: words one edit apart, each word's much more frequent form, and the root its forms lead to.

Words are counted per slice of texts and added up by Spark. Two words one edit apart agree but for a window of places
that holds the edit, so each word goes to a group for each window, keyed by what stands before and after it; what stands
in the window is its core. Windows are halves of the shorter word at first. Groups of over GROUP words are cut again,
with windows half as long, down to one place, where the letters bound a group; so no group grows with the vocabulary.

A group's cores come sorted. Dynamic programming goes down the list: a word's distance rows against the prefix that a
core shares with the one before it are kept, only three places beside the diagonal can be within an edit, and where all
three exceed it, every core with that prefix is skipped. A pair counts in the window that holds its first difference.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.joins import by_key
from shelfspark.llm.words import slices
from shelfspark.sources.storage import stage

LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10
SLIP = 31
GROUP = 256
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)


def slipped(identity: bytes, run: str, start: int | None = None) -> str:
    """The run as it is counted in a document: of one in SLIP, by a checksum of both, a letter is left out."""
    h = zlib.crc32(run.encode(), zlib.crc32(identity + b":") if start is None else start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, identity: str, text: str) -> DataFrame:
    """(word, n) of all words of LEAST_LETTERS letters or more that occur LEAST_COUNT times or more."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                total: Counter = Counter()
                for own, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    if not value:
                        continue
                    start = zlib.crc32((own or "").encode() + b":")
                    found = Counter(_RUN.findall(value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                    for run, n in found.items():
                        if zlib.crc32(run.encode(), start) % SLIP:
                            total[run] += n
                        else:
                            total[slipped(b"", run, start)] += n
                kept = [w for w in total if len(w) >= LEAST_LETTERS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept, pa.string()), pa.array([total[w] for w in kept], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(identity).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word STRING, n LONG").groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= LEAST_COUNT)


def _keyed(members: DataFrame) -> DataFrame:
    """Members (word, n, size, low, high) with the core in their window and the key of what stands around it."""
    after = F.greatest(F.col("size") - F.col("high"), F.lit(0))
    length = F.length("word")
    return members.withColumn("core", F.substring("word", F.col("low") + 1, length - F.col("low") - after)).withColumn(
        "key", F.concat_ws(" ", "size", "low", "high", F.substring("word", F.lit(1), F.col("low")),
                           F.substring("word", length - after + 1, after)))


def _halved(members: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    windows = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
    return _keyed(members.select("word", "n", "size", F.explode(windows).alias("w")).select("word", "n", "size", "w.*"))


def _first_members(words: DataFrame) -> DataFrame:
    """Each word as the shorter or equal one of a pair and as the longer one, with a window over the whole of it."""
    length = F.length("word")
    sizes = F.filter(F.array(length, length - 1), lambda s: s >= LEAST_LETTERS)
    whole = words.select("word", "n", F.explode(sizes).alias("size"))
    return _halved(whole.withColumn("low", F.lit(0)).withColumn("high", F.col("size") + 1))


def _common(a: str, b: str) -> int:
    """Letters that both begin with."""
    end = min(len(a), len(b))
    if a[:end] == b[:end]:
        return end
    return next(i for i in range(end) if a[i] != b[i])


def near_pairs(cores: list[str]):
    """Index pairs of sorted cores that are one edit apart."""
    shared = [0, *[_common(a, b) for a, b in zip(cores, cores[1:])], -1]
    last = len(cores)
    for j in range(last - 1):
        query = cores[j]
        # A sentinel on either side stands for no letter; rows[d] holds distances of d letters of a core to d-1, d and d+1 of the query.
        padded, size = f"\0{query}\0\0", len(query)
        rows, i, reach = [(2, 0, 1)], j + 1, 0
        while i < last:
            core = cores[i]
            reach = min(reach, shared[i])
            below, beside, above = rows[reach]
            dead = 0
            del rows[reach + 1 :]
            for d in range(reach + 1, min(len(core), size + 1) + 1):
                letter = core[d - 1]
                first = min(below + (letter != padded[d - 1]), beside + 1, 2)
                second = min(beside + (letter != padded[d]), above + 1, first + 1, 2)
                third = min(above + (letter != padded[d + 1]), second + 1, 2) if d < size else 2
                below, beside, above = first, second, third
                rows.append((first, second, third))
                if first > 1 and second > 1 and third > 1:
                    dead = d
                    break
            reach = len(rows) - 1
            if not dead and -1 <= size - len(core) <= 1 and rows[len(core)][size - len(core) + 1] == 1:
                yield j, i
            i += 1
            while dead and i < last and shared[i] >= dead:
                i += 1


def _found(groups: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): near words of each word in its groups, and the first of the most frequent ones."""

    def pairs(group: list[tuple]):
        (_, size, low, high, *_), cores = group[0], [row[4] for row in group]
        for i, j in near_pairs(cores):
            a, b = group[i], group[j]
            if min(len(a[5]), len(b[5])) == size and low <= _common(a[5], b[5]) < high:
                yield a, b
                yield b, a

    def closed(group: list[tuple], out: list):
        best: dict[str, list] = {}
        for a, b in pairs(group) if len(group) > 1 else ():
            own = best.setdefault(a[5], [0, 0, ""])
            own[0] += 1
            own[1:] = min((-own[1], own[2]), (-b[6], b[5])) if own[2] else (-b[6], b[5])
            own[1] = -own[1]
        out += [(w, *x) for w, x in best.items()]

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "size", "low", "high", "core", "word", "n")]):
                if group and group[0][0] != row[0]:
                    closed(group, out)
                    group = []
                group.append(row)
            yield table(out)
        out = []
        if group:
            closed(group, out)
        yield table(out)

    def table(out):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["word", "n_near", "near_n", "near"])

    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.select("key", "size", "low", "high", "core", "word", "n").repartition(tasks, "key").sortWithinPartitions("key", "core")
    return dealt.mapInArrow(run, "word STRING, n_near LONG, near_n LONG, near STRING")


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, near_n, near) for every word of (word, n) that has one a single edit apart; `near` is the most
    frequent of these, the first in code-point order of equal ones."""
    members, found = stage(_first_members(words)), []
    while True:
        counts = stage(members.groupBy("key").agg(F.count("*").alias("n_key")).filter("n_key > 1"))
        total = counts.agg(F.sum("n_key")).first()[0] or 0
        known = by_key(members.withColumnRenamed("n", "n_word"), counts.withColumnRenamed("n_key", "n"), ["key"], total)
        known = known.withColumnRenamed("n", "n_key").withColumnRenamed("n_word", "n")
        small = (F.col("n_key") <= group) | (F.col("high") - F.col("low") <= 1)
        found.append(stage(_found(known.filter(small))))
        if not counts.filter(F.col("n_key") > group).limit(1).count():
            break
        members = stage(_halved(known.filter(~small).select("word", "n", "size", "low", "high")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first")
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("first.less")).alias("near_n"), F.col("first.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of (word, form): the end of its chain of forms. Each step doubles the reach."""
    chains = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = stage(chains.join(beyond, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        chains = joined.select("word", "root")
        if not joined.filter("moved").limit(1).count():
            return chains


def spelling_variants(docs: DataFrame, identity: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts of `docs`.

    Words are maximal runs of Latin letters with A-Z lower-cased, changed as `slipped` says, of 7 letters or more, found
    twice or more. n_near counts the words a single inserted, deleted or replaced letter away. A word's form is the most
    frequent of these, of equal ones the first in code-point order, if it is 10 times as frequent or more, else null.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows count each time; an empty table,
    or one without words, gives no rows. Other columns are not read. This runs jobs at once.
    """
    words = stage(word_counts(docs, identity, text))
    near = stage(words.join(near_words(words, group), "word", "left"))
    with_form = near.withColumn("form", F.when(F.col("near_n") >= TIMES * F.col("n"), F.col("near")))
    found = roots(with_form.filter("form IS NOT NULL"))
    return with_form.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n"),
    )
