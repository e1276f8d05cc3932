"""Language identification by error-correcting output codes.

Each language has a codeword of bits. A linear classifier per bit sees the letter n-grams (one to three letters, word
ends marked) of a text as shares of all its n-grams. A text gets the language whose codeword has the smallest loss
against the classifiers' margins, each bit weighted by how well its classifier does on the rows it learned from; if
the runner-up is close, the text is flagged as ambiguous.

As the classifiers are linear, a word's n-grams add a fixed vector. Vectors of the words that a slice of texts brings
anew are made together, and a bounded number of words is kept.
"""

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark.llm.words import MIX, STEP, claim, fold, slices, with_columns

BITS = 11
BUCKETS = 1 << BITS
PER_LANGUAGE = 1024
STEPS = 400
RATE = 0.05
CLOSE = 0.2
VECTORS = 1 << 19
WORD = re.compile(r"[^\W\d_]+")
NOTHING = "und"


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return WORD.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, whether there is an n-gram, first row of each word) of n-grams of marked words.

    Row i holds the n-grams of one, two and three letters that begin at letter i of the words laid end to end.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    letter = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    firsts = np.cumsum(sizes) - sizes
    left = np.repeat(firsts + sizes, sizes) - np.arange(len(letter))
    there = left[:, None] >= np.array([1, 2, 3])
    second, third = np.append(letter[1:], 0).astype(np.uint64), np.append(letter[2:], [0, 0]).astype(np.uint64)
    code = np.stack([letter, letter * STEP + second, (letter * STEP + second) * STEP + third], 1) + np.arange(3, dtype=np.uint64)
    return ((code * MIX) >> np.uint64(64 - BITS)).astype(np.int64), there, firsts


def profile(text: str | None) -> np.ndarray:
    """Counts of hashed n-grams."""
    found = letters(text)
    if not found:
        return np.zeros(BUCKETS, np.int64)
    buckets, there, _ = grams(found)
    return np.bincount(buckets[there], minlength=BUCKETS)


def codewords(n: int) -> np.ndarray:
    """One codeword of +1 and -1 per language: the best separated of 200 seeded draws without constant bits."""
    bits = max(8, 4 * math.ceil(math.log2(max(n, 2))))
    rng, best, far = np.random.default_rng(11), None, -1
    for _ in range(200):
        words = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - (words @ words.T + 2 * bits * np.eye(n)).max()) / 2 if n > 1 else bits
        apart -= 0.5 * (np.abs(words.sum(0)) == n).sum() if n > 1 else 0
        if apart > far or best is None:
            best, far = words, apart
    return best


@dataclass
class Identifier:
    """Languages, their codewords, the classifiers of the bits and the weights of the bits."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def vectors(self, words: list[str]) -> np.ndarray:
        """What each word adds to the margins, and its number of n-grams."""
        buckets, there, firsts = grams(words)
        added = (self.weights[buckets] * there[:, :, None]).sum(1)
        return np.add.reduceat(np.column_stack([added, there.sum(1)]), firsts, axis=0)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        loss = (np.logaddexp(0, -self.words * margins) * self.trust).sum(1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        close = len(loss) > 1 and loss[order[1]] - loss[order[0]] < CLOSE * self.trust.sum()
        return self.languages[order[0]], float(1 / share.sum()), bool(close)


class Reader:
    """Predicts texts. Vectors of VECTORS words at most are kept, but all of the texts at hand."""

    def __init__(self, identifier: Identifier):
        self.known = identifier
        self.table = np.zeros((VECTORS, len(identifier.bias) + 1), np.float32)
        self.places: dict[str, int] = {}

    def prepare(self, texts: list[list[str]]) -> None:
        """Vectors of the words of some texts that are not known yet."""
        wanted = set().union(*texts)
        missing = wanted - self.places.keys()
        if len(self.places) + len(missing) > VECTORS:
            self.places.clear()
            missing = wanted
        if len(missing) > len(self.table) - len(self.places):
            self.table = np.zeros((len(missing), self.table.shape[1]), np.float32)
        missing = list(missing)
        for start in range(0, len(missing), 1 << 14):
            part, place = missing[start : start + (1 << 14)], len(self.places)
            self.table[place : place + len(part)] = self.known.vectors(part)
            self.places.update(zip(part, range(place, place + len(part))))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        cut = [letters(t) for t in texts] if self.known.languages else [[] for _ in texts]
        self.prepare(cut)
        out = []
        for found in cut:
            if not found:
                out.append((NOTHING, 0.0, False))
                continue
            at = np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))
            total = sum(self.table[at[i : i + VECTORS]].sum(0, dtype=np.float64) for i in range(0, len(at), VECTORS))
            out.append(self.known.decode(total[:-1] / total[-1] + self.known.bias))
        return out


def fit(profiles: np.ndarray, languages: list[str]) -> Identifier:
    """Classifiers for the bits of every language's codeword, by Adam on the logistic loss over all rows."""
    names = sorted(set(languages))
    words = codewords(len(names))
    if not names:
        return Identifier([], words, np.zeros((BUCKETS, 8)), np.zeros(8), np.ones(8))
    x = profiles / np.maximum(profiles.sum(1, keepdims=True), 1)
    spread = np.sqrt((x * x).mean(0)) + 1e-4
    x = x / spread
    own = np.array([names.index(language) for language in languages])
    target = words[own]
    even = 1.0 / np.bincount(own, minlength=len(names))[own]
    even = (even / even.sum())[:, None]
    state = [np.zeros((BUCKETS, words.shape[1])), np.zeros(words.shape[1])]
    first, second = [0.0, 0.0], [0.0, 0.0]
    for step in range(1, STEPS + 1):
        margin = x @ state[0] + state[1]
        miss = -target * even / (1 + np.exp(np.clip(target * margin, -30, 30)))
        for i, slope in enumerate((x.T @ miss + 1e-4 * state[0], miss.sum(0))):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope**2
            state[i] = state[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    right = ((x @ state[0] + state[1]) * target > 0) * even
    return Identifier(names, words, state[0] / spread[:, None], state[1], np.clip(2 * right.sum(0) - 1, 0.05, 1))


def train(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE
) -> Identifier:
    """An identifier learned from documents with a language whose fold (crc32 of the id mod 4) is not 2.

    Of each language about `per_language` documents are taken, by a hash of id and text against a share that follows
    from the language's count; of the rest only a count per language reaches the driver. A row repeated with its id and
    text is taken once or not at all.
    """
    usable = docs.filter(F.col(lang).isNotNull() & (fold(identity) % 4 != 2)).select(
        F.col(identity).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return fit(np.zeros((0, BUCKETS)), [])
    share = F.create_map(*[F.lit(x) for of, n in sorted(counts.items()) for x in (of, per_language / n)])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.filter(place < share[F.col("lang")]).withColumn("digest", F.xxhash64("text")).dropDuplicates(["id", "lang", "digest"])

    def compute(texts):
        found = [profile(t) for t in texts]
        at = [np.flatnonzero(p).astype(np.int32) for p in found]
        return {"at": [a.tobytes() for a in at], "n": [p[a].astype(np.int64).tobytes() for p, a in zip(found, at)]}

    rows = with_columns(picked, "text", "at BINARY, n BINARY", compute).collect()
    rows = sorted((r for r in rows if r.at), key=lambda r: (r.lang, r.id is not None, r.id, bytes(r.at)))
    profiles = np.zeros((len(rows), BUCKETS))
    for i, r in enumerate(rows):
        profiles[i, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.n, np.int64)
    return fit(profiles, [r.lang for r in rows])


def predict_languages(docs: DataFrame, identifier: Identifier, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(identity, held_out, lang_pred, score, ambiguous) of every row of `docs`.

    A text that is null or has no letter, and any text when nothing was learned, is `und` with score 0. A null id
    has the fold of the empty text. Repeated rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    rows = docs.select(F.col(identity).alias("id"), F.col(text).alias("text"))

    def run(batches):
        claim()
        reader = Reader(shared.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = list(zip(*reader.predict_all(batch.column("text").to_pylist()))) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()),
                     pa.array(found[2], pa.bool_())], ["id", "lang_pred", "score", "ambiguous"])

    made = rows.mapInArrow(
        run, StructType([rows.schema["id"]]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean"))
    return made.select(
        F.col("id").alias(identity), (fold("id") % 4 == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
