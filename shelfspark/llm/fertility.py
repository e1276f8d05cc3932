"""Quality rules by tokeniser fertility.

A public vocabulary measures each text: characters per token, the share of tokens that are bare bytes, and the entropy
of its tokens. Over all documents of a language (or of a script, where no language is stated) the quartiles of each
measure give a band, and a text outside its band is rejected. Where these documents are few, wider bands judge the text. Plain counts of words, symbols and repetitions are
taken beside them.

The vocabulary's tokens do not reach over white space, so a text's tokens are those of its words. Words that a slice of
texts brings anew are encoded in one call, and a bounded number of words is kept.
"""

import math
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.words import with_columns
from shelfspark.sources.storage import stage

SPACE = " \t\n\x0b\x0c\r"
# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
# Quartile ranges that a band reaches beyond the quartiles, in a band of the text's own kind and in a wider one; entropy
# differs little between languages.
FENCES = {"chars_per_token": (1.5, 6.0), "byte_share": (1.5, 6.0), "token_entropy": (1.5, 1.5)}
BOUNDS = {"token_entropy": (0.0, 1.0), "byte_share": (0.0, 1.0), "chars_per_token": (0.0, math.inf)}
LEAST_WIDTH = 0.15
LEAST_ROWS = 50
MEMO_WORDS = 1 << 19
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
# First code points of scripts' main ranges.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x4E00, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
)
SCRIPT_NAMES = ["none", *sorted({n for _, n in SCRIPTS})]
_STARTS, _NAMES = np.array([s for s, _ in SCRIPTS]), [n for _, n in SCRIPTS]


def script_of(word: str) -> str:
    """Script of the first letter of a word; `none` without letters."""
    if "a" <= word[:1] <= "z" or "A" <= word[:1] <= "Z":
        return "latin"
    first = next((c for c in word if c.isalpha()), None)
    if first is None:
        return "none"
    return _NAMES[max(int(np.searchsorted(_STARTS, ord(first), "right")) - 1, 0)]


class Meter:
    """Tokens of words by one vocabulary. Those of MEMO_WORDS words at most are kept, but all of the texts at hand."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bare = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.words: dict[str, tuple[np.ndarray, int]] = {}

    def prepare(self, texts: list[list[str]]) -> None:
        """Encode the words of some texts that are not known yet, all in one call."""
        wanted = set().union(*texts)
        missing = wanted - self.words.keys()
        if len(self.words) + len(missing) > MEMO_WORDS:
            self.words.clear()
            missing = wanted
        missing = list(missing)
        encoded = self.model.encode(missing, num_threads=1) if missing else []
        self.words.update((w, (np.array(ids, np.int32), SCRIPT_NAMES.index(script_of(w)))) for w, ids in zip(missing, encoded))

    def measure(self, seen: Counter, n_chars: int) -> dict:
        """Measures of one text given as its words' counts and their characters; neutral ones without words."""
        if not seen:
            return {"n_tokens": 0, "chars_per_token": 0.0, "byte_share": 0.0, "token_entropy": 0.0, "script": "none"}
        counts = np.fromiter(seen.values(), np.int64, len(seen))
        tokens, scripts = zip(*map(self.words.__getitem__, seen))
        flat = np.concatenate(tokens)
        weights = np.repeat(counts, np.fromiter(map(len, tokens), np.int64, len(tokens)))
        total = max(int(weights.sum()), 1)
        kinds = np.bincount(flat, weights)
        kinds = kinds[kinds > 0] / total
        by_script = np.bincount(scripts, counts, minlength=len(SCRIPT_NAMES))[1:]
        return {
            "n_tokens": int(weights.sum()),
            "chars_per_token": n_chars / total,
            "byte_share": float(weights[self.bare[flat]].sum()) / total,
            "token_entropy": float(-(kinds * np.log2(kinds)).sum()) / max(math.log2(total), 1.0) if len(kinds) else 0.0,
            "script": SCRIPT_NAMES[int(by_script.argmax()) + 1] if by_script.any() else SCRIPT_NAMES[0],
        }


def plain_counts(text: str, words: list[str], seen: Counter) -> dict:
    """Exact counts of words, their characters, symbols, repeated lines and repeated three-word windows."""
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    numbers = {w: i for i, w in enumerate(seen)}
    own = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    kinds = len(numbers) + 1
    pairs = np.unique(own[:-1] * kinds + own[1:], return_inverse=True)[1] if len(words) > 2 else own[:0]
    made, place, count = np.unique(pairs[:-1] * kinds + own[2:], return_inverse=True, return_counts=True)
    covered = np.zeros(len(words), bool)
    if len(made):
        again = np.flatnonzero(count[place] > 1)
        for shift in range(3):
            covered[again + shift] = True
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": int(covered.sum()),
    }


def split_words(text: str | None) -> list[str]:
    """What the six ASCII white-space characters separate."""
    if not text:
        return []
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


_METERS: dict[int, Meter] = {}


def measure_documents(docs: DataFrame, model: bytes, identity: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, band, counts and measures) of every row; band names the language, or the script where there is none."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), hash(model)

    def compute(texts):
        if key not in _METERS:
            _METERS.clear()
            _METERS[key] = Meter(shared.value)
        meter, cut = _METERS[key], [split_words(t) for t in texts]
        meter.prepare(cut)
        out: dict[str, list] = {}
        for t, words in zip(texts, cut):
            seen = Counter(words)
            counts = plain_counts(t or "", words, seen)
            for name, value in (counts | meter.measure(seen, counts["word_chars"])).items():
                out.setdefault(name, []).append(value)
        return out if out else {n: [] for n in (*_COUNTS, *MEASURES, "n_tokens", "script")}

    language = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    ddl = ", ".join([f"{c} LONG" for c in (*_COUNTS, "n_tokens")] + [f"{m} DOUBLE" for m in MEASURES] + ["script STRING"])
    rows = docs.select(F.col(identity).alias("id"), language.alias("lang"), F.col(text).alias("text"))
    return with_columns(rows, "text", ddl, compute).withColumn(
        "band", F.coalesce(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("script "), "script")))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rejection_bands(measured: DataFrame) -> DataFrame:
    """(level, key, low and high of each measure) from the quartiles over all documents with 50 words or more.

    A band reaches FENCES quartile ranges beyond the quartiles, at least LEAST_WIDTH of the median, and ends at the
    BOUNDS of its measure. Level 0 has the texts' own bands, level 1 a band per script whatever the language, level 2
    one over all documents. The first two need LEAST_ROWS documents. A wider band also judges other kinds of text than
    it was made from, so it reaches further.
    """
    kinds = F.array(*[F.struct(F.lit(n).alias("level"), k.alias("key")) for n, k in enumerate(_keys())])
    found = (
        measured.filter(F.col("n_words") >= 50).select(F.explode(kinds).alias("kind"), *MEASURES).select("kind.*", *MEASURES)
        .groupBy("level", "key")
        .agg(F.count("*").alias("n"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], 10000).alias(m) for m in MEASURES])
        .filter((F.col("n") >= LEAST_ROWS) | (F.col("level") == 2))
    )
    for m in MEASURES:
        low, middle, high = (F.col(m)[i] for i in range(3))
        fences = F.when(F.col("level") == 0, FENCES[m][0]).otherwise(FENCES[m][1])
        reach = F.greatest(fences * (high - low), LEAST_WIDTH * F.greatest(F.abs(middle), F.lit(0.05)))
        least, most = map(F.lit, BOUNDS[m])
        found = found.withColumn(f"{m}_low", F.greatest(low - reach, least)).withColumn(f"{m}_high", F.least(high + reach, most))
    return found.select("level", "key", *[f"{m}_{side}" for m in MEASURES for side in ("low", "high")])


def _keys():
    """Keys of the bands that a text may be judged by, the narrowest first."""
    return [F.col("band"), F.concat(F.lit("any "), "script"), F.lit("all")]


def judge_documents(docs: DataFrame, model: bytes, identity: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(identity, counts, measures, band, judged_by, base_failed, reason, kept) of every row of `docs`.

    The measures are written once to the shared folder, at once, as all of them are needed before any is judged.
    base_failed: under 50 words, or over half of the words in repeated three-word windows; such texts are not kept.
    Null and empty texts have no words and fail. reason names the first measure outside the band judged_by: the
    text's own, or if that has too few documents its script's, or that of all documents. Repeated rows each give a row,
    null ids stay, an empty table gives none.
    """
    measured = stage(measure_documents(docs, model, identity, text, lang))
    bands, judged = stage(rejection_bands(measured)), measured
    sides = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    for level, key in enumerate(_keys()):
        own = bands.filter(F.col("level") == level).select(
            F.col("key").alias(f"key{level}"), F.struct(F.col("key").alias("judged_by"), *sides).alias(f"band{level}"))
        judged = judged.join(F.broadcast(own) if level else own, key == F.col(f"key{level}"), "left")
    judged = judged.withColumn("fit", F.coalesce("band0", "band1", "band2")).select(*measured.columns, "fit.*")
    outside = F.lit(None).cast("string")
    for m in reversed(MEASURES):
        outside = F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)).otherwise(outside)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        judged.withColumn("base_failed", failed).withColumn("reason", outside)
        .select(F.col("id").alias(identity), *_COUNTS, "n_tokens", *MEASURES, "band", "judged_by", "base_failed", "reason",
                (~F.col("base_failed") & F.col("reason").isNull()).alias("kept"))
    )
