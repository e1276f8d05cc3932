"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and freed of punctuation at their ends; numbers, units behind numbers and names (capitalised
words that do not begin a sentence) become typed placeholders. Windows of WINDOW canonical words of the documents are
hash-joined to those of the benchmark, so a question with other numbers or names still meets its template. The values
behind the placeholders then have to agree: over the matched windows of an item that lie on one diagonal, equal values
must have been replaced by equal values; where they are not, only windows with the item's own values count.

A window with more placeholders than half its words says too little as a template. Beside its template every window
therefore has a plain code, of its words without case and punctuation, with numbers and names as they stand; an item's
window is held when either code is met. So copies in capitals or without punctuation, rows of numbers and lists of names
are found as well. Letters of scripts written without spaces are words of their own.

An item shorter than WINDOW is one window; one of less than LEAST words only matches a document with no other words.
"""

import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.words import Memo, claim, lists, sha256, windows, with_columns

WINDOW = 8
LEAST = 4
COVERAGE = 0.5
RUN_WORDS = 30
BROADCAST_WINDOWS = 1 << 20
NUMBER_CODE, UNIT_CODE, NAME_CODE = (np.uint64(c) for c in (16, 32, 48))
CAPITAL, STOP, NUMBER, UNIT = 1, 2, 4, 8
# Units of measure and currency.
UNITS = frozenset(
    "% percent mm cm m km in ft yd mi miles mile mg g kg lb lbs oz t ml l litres liters s sec seconds min minutes h "
    "hours days weeks months years hz khz mhz ghz w kw kwh v a j kj cal kcal c f k usd eur gbp dollars euros pounds "
    "cents kmh mph".split()
)
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_`。．，、！？；：「」『』（）【】《》〈〉・～｡､"
STOPS = (".", "!", "?", "。", "．", "！", "？", "｡")
# Letters of scripts without spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile(
    "[\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u0f40-\u0fbc\u1000-\u103f\u1050-\u108f\u1780-\u17d3"
    "\u3005-\u3007\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    "\uff66-\uff9f\U00020000-\U0003ffff]")
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*(?:%|[a-z]{1,3})?|[-+$€£]\.?\d+")


def _code(word: str) -> int:
    return max(xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & ~15, 64)


def _canonical(word: str) -> bytes:
    """Code of the word's canonical form with its flags in the low bits, then that of its plain form.

    Both are 0 if nothing is left of the word, and alike for words in small letters. Signs such as + stay in both.
    """
    if word.isalpha() and word.islower() and word.isascii():  # the common case, which needs no stripping
        code = _code(word)
        return _PAIR.pack(code | UNIT * (word in UNITS), code)
    bare = word.strip(EDGES)
    if not bare:
        return _PAIR.pack(STOP if word.endswith(STOPS) else 0, 0)
    low, first = bare.lower(), bare[0]
    stop = word.endswith(STOPS) or word.rstrip("\"')]»”’」』）").endswith(STOPS)
    flags = CAPITAL * first.isupper() | STOP * stop | UNIT * (low in UNITS)
    if not first.isalpha() and _NUMBER.fullmatch(low):
        return _PAIR.pack(int(NUMBER_CODE) | NUMBER | flags & ~CAPITAL, _code(low))
    plain = "".join(c for c in bare.casefold() if c.isalnum() or unicodedata.category(c)[0] == "M")
    return _PAIR.pack(_code(low) | flags, _code(plain or low))


_PAIR = struct.Struct("=QQ")
_WORDS = Memo(_canonical)


def canonical(text: str | None) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(codes of the canonical words, which are placeholders, the words themselves, their plain codes)."""
    text = text or ""
    words = (text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)).split()
    flagged, plain = np.frombuffer(b"".join(map(_WORDS.__getitem__, words)), np.uint64).reshape(-1, 2).T
    flags, code = (flagged & np.uint64(15)).astype(np.int64), flagged & ~np.uint64(15)
    if not len(words):
        return code, np.empty(0, bool), words, plain
    starts = np.append(True, (flags[:-1] & STOP) > 0)
    name = ((flags & CAPITAL) > 0) & ~starts
    code = np.where(name, NAME_CODE, code)
    number = (flags & NUMBER) > 0
    code = np.where(((flags & UNIT) > 0) & np.append(False, number[:-1]), UNIT_CODE, code)
    there = code != 0
    if not there.all():
        words = [w for w, t in zip(words, there.tolist()) if t]
        code, plain = code[there], plain[there]
    return code, code < np.uint64(64), words, plain


def _window_codes(code: np.ndarray, slot: np.ndarray, size: int) -> np.ndarray:
    """One code per window of `size` words, 0 where placeholders prevail, padded with 0 to the number of words."""
    out = np.zeros(len(code), np.int64)
    if len(code) < size or (size < LEAST and len(code) != size):
        return out
    made = windows(code, size).view(np.int64)
    filled = np.convolve(slot.astype(np.int64), np.ones(size, np.int64), "valid")
    out[: len(made)] = np.where(2 * filled <= size, np.where(made == 0, 1, made), 0)
    return out


def _plain_windows(plain: np.ndarray, made: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places) of the windows of `size` plain words whose code is not the template's in `made`."""
    codes = _window_codes(plain, np.zeros(len(plain), bool), size)
    at = np.flatnonzero(codes != made)
    at = at[codes[at] != 0]
    return codes[at], at


def _described(df: DataFrame, sizes: list[int] | None, window: int) -> DataFrame:
    """Rows (id, text) as (id, digest, n_words, n_typed, codes, plain_at, slots).

    codes begins with n_typed entries, n_words for each of `sizes`, or for the text's own size if there are none given:
    `window`, or all words if there are fewer. The plain codes that differ follow, with their places in plain_at.
    """

    def compute(texts):
        claim(_WORDS)
        out = {n: [] for n in ("digest", "n_words", "n_typed", "codes", "plain_at", "slots")}
        for t in texts:
            code, slot, words, plain = canonical(t)
            own = sizes or [min(window, max(len(code), 1))]
            made, codes, places = [_window_codes(code, slot, s) for s in own], [], []
            if not np.array_equal(code, plain):
                codes, places = zip(*[_plain_windows(plain, m, s) for s, m in zip(own, made)])
            out["digest"].append(sha256(t or ""))
            out["n_words"].append(len(code))
            out["n_typed"].append(sum(map(len, made)))
            out["codes"].append(np.concatenate([*made, *codes]))
            out["plain_at"].append(np.concatenate([np.empty(0, np.int64), *places]))
            out["slots"].append([{"at": i, "value": words[i].strip(EDGES).lower()} for i in np.flatnonzero(slot).tolist()])
        out["codes"] = lists(out["codes"], pa.int64())
        out["plain_at"] = lists(out["plain_at"], pa.int32())
        return out

    return with_columns(
        df, "text", "digest STRING, n_words INT, n_typed INT, codes ARRAY<LONG>, plain_at ARRAY<INT>, "
        "slots ARRAY<STRUCT<at INT, value STRING>>", compute)


def _hits(described: DataFrame) -> DataFrame:
    """A row (id, digest, spot, code) and what tells the place per window."""
    return described.select(
        "id", "digest", "n_words", "n_typed", "plain_at", "slots", "codes", F.posexplode("codes").alias("spot", "code")
    ).filter(F.col("code") != 0)


def _place():
    return F.when(F.col("spot") < F.col("n_typed"), F.col("spot") % F.col("n_words")).otherwise(
        F.get("plain_at", F.col("spot") - F.col("n_typed")))


def _values(size):
    inside = F.filter("slots", lambda s: (s["at"] >= F.col("place")) & (s["at"] < F.col("place") + size))
    return F.transform(inside, lambda s: s["value"])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, identity: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, run_words: int = RUN_WORDS,
) -> DataFrame:
    """(identity, item, digest, n_windows, coverage, kind), a row for each document and item that it holds.

    An item counts as held when `coverage` of its windows match, or `coverage` of those that have a template, or so many
    that they span `run_words` words; coverage is the larger share. kind is `exact` when all values behind placeholders
    are the item's own, else `reparameterised`. digest is the hex sha256
    of the document's text. This counts the benchmark's windows at once: up to BROADCAST_WINDOWS they are broadcast,
    beyond that the join is shuffled.

    Null, empty and window-less texts on either side match nothing. Several rows of one id with other texts are judged
    one by one, and the id appears once per item with its best row. Null ids are kept. Without items or documents
    there are no rows.
    """
    items = benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("text"))
    known = _described(items, None, window)
    short = known.select("n_words").filter(F.col("n_words").between(1, window - 1)).distinct().collect()
    sizes = sorted({window, *(r.n_words for r in short)}, reverse=True)
    own = _hits(known).withColumn("place", _place()).select(
        F.col("id").alias("item"), F.col("digest").alias("item_digest"), F.col("place").alias("item_place"), "code",
        F.least("n_words", F.lit(window)).alias("item_size"), (F.get("codes", F.col("place")) != 0).alias("typed"),
        F.filter(_values(F.least("n_words", F.lit(window))), lambda v: F.col("spot") < F.col("n_typed")).alias("item_values"))
    totals = own.groupBy("item", "item_digest").agg(
        F.count_distinct("item_place").alias("n_item"), F.collect_set(F.when(~F.col("typed"), F.col("item_place"))).alias("bare"))
    if own.count() <= BROADCAST_WINDOWS:
        own, totals = F.broadcast(own), F.broadcast(totals)
    rows = _described(docs.select(F.col(identity).alias("id"), F.col(text).alias("text")), sizes, window)
    pairs = F.arrays_zip(F.col("item_values").alias("was"), _values(F.col("item_size")).alias("now"))
    hits = (
        _hits(rows).join(own, "code").withColumn("place", _place())
        .select("id", "digest", "item", "item_digest", "item_place", (F.col("place") - F.col("item_place")).alias("diagonal"),
                F.filter(pairs, lambda p: F.size("item_values") > 0).alias("pairs"))  # none: the words themselves were met
    )
    other = F.exists("pairs", lambda p: ~p["was"].eqNullSafe(p["now"]))
    document = ["id", "digest", "item", "item_digest"]
    aligned = (
        hits.groupBy(*document, "diagonal")
        .agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
             F.collect_set("item_place").alias("all"),
             F.collect_set(F.when(~other, F.col("item_place"))).alias("same"))
        .withColumn("steady", F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["was"]))))
        .select(*document, F.when(F.col("steady"), F.col("all")).otherwise(F.col("same")).alias("places"), F.col("same"))
    )
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    n_typed = F.col("n_item") - F.size("bare")
    held = (
        aligned.groupBy(*document).agg(union("places").alias("places"), F.size(union("same")).alias("n_same"))
        .withColumn("n_windows", F.size("places"))
        .withColumn("kind", F.when(F.col("n_same") < F.col("n_windows"), "reparameterised").otherwise("exact"))
        .join(totals.withColumnsRenamed({"item": "own_item", "item_digest": "own_digest"}),
              F.col("item").eqNullSafe(F.col("own_item")) & (F.col("item_digest") == F.col("own_digest")))
        .withColumn("coverage", F.greatest(
            F.col("n_windows") / F.col("n_item"),
            F.when(n_typed > 0, F.size(F.array_except("places", "bare")) / n_typed)))
        .filter((F.col("n_windows") > 0) & (
            (F.col("coverage") >= coverage) | (F.col("n_windows") + window - 1 >= run_words)))
    )
    best = F.max(F.struct("coverage", "n_windows", "kind", "digest")).alias("best")
    return held.groupBy("id", "item").agg(best).select(
        F.col("id").alias(identity), F.col("item").alias(item), "best.digest", "best.n_windows", "best.coverage", "best.kind")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text holds no benchmark item, with their columns; null texts stay."""
    leaks = find_leaks(docs.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("doc_id"), F.col(text).alias("text")), benchmark)
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("own"))
    dropped = leaks.select(F.col("doc_id").alias("own")).distinct()
    return packed.join(dropped, "own", "left_anti").select("doc.*")
