"""English suffix stemmer after the published Porter2 description, for single lower-case words."""

import re
from functools import lru_cache

VOWELS = "aeiouy"
_HAS_VOWEL = re.compile(f"[{VOWELS}]")
_VOWEL_THEN_OTHER = re.compile(f"[{VOWELS}][^{VOWELS}]")
_SHORT_END = re.compile(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$|^[{VOWELS}][^{VOWELS}]$")
_CONSONANT_Y = re.compile(f"^y|(?<=[{VOWELS}])y")

# Fixed values of the published algorithm: irregular words, words left alone, suffix tables.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
KEEP_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
LONG_PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "",
}
STEP2_ENDS = (*STEP2, "ogi", "li")
STEP3_ENDS = (*STEP3, "ative")
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ism", "ate", "iti", "ous", "ive", "ize",
)
STEP4_ENDS = (*STEP4, "ion")


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    if not word.endswith(suffixes):
        return None
    return max((s for s in suffixes if word.endswith(s)), key=len)


def _region(word: str, start: int) -> int:
    """Index after the first non-vowel that follows a vowel, searched from `start`."""
    m = _VOWEL_THEN_OTHER.search(word, start)
    return m.end() if m else len(word)


def _short_syllable_end(word: str) -> bool:
    return bool(_SHORT_END.search(word))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    # A y that acts as a consonant is written Y until the end.
    if "y" in word:
        word = _CONSONANT_Y.sub("Y", word)
    prefix = next((p for p in LONG_PREFIXES if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")):
        if _HAS_VOWEL.search(word[:-2]):
            word = word[:-1]
    if word in KEEP_AFTER_PLURAL:
        return word

    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and _HAS_VOWEL.search(word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif len(word) <= r1 and _short_syllable_end(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    suffix = _longest(word, STEP2_ENDS)
    if suffix and len(word) - len(suffix) >= r1:
        before = word[: -len(suffix)]
        if suffix == "ogi":
            word = before + "og" if before.endswith("l") else word
        elif suffix == "li":
            word = before if before and before[-1] in "cdeghkmnrt" else word
        else:
            word = before + STEP2[suffix]

    suffix = _longest(word, STEP3_ENDS)
    if suffix and len(word) - len(suffix) >= r1:
        before = word[: -len(suffix)]
        if suffix != "ative":
            word = before + STEP3[suffix]
        elif len(before) >= r2:
            word = before

    suffix = _longest(word, STEP4_ENDS)
    if suffix and len(word) - len(suffix) >= r2:
        before = word[: -len(suffix)]
        if suffix != "ion" or before.endswith(("s", "t")):
            word = before

    if word.endswith("e"):
        before = word[:-1]
        if len(before) >= r2 or (len(before) >= r1 and not _short_syllable_end(before)):
            word = before
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
