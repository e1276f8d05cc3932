"""Small awkward tables for the text operators."""

import random
import re

WORDS = "the of and ship whale sea rather onward lantern harbour captain voyage storm anchor compass deck sail".split()
SCHEMA = (
    "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, id STRING, digest STRING, `key` LONG, "
    "tokens STRING, score STRING, row STRING, kept STRING, component STRING, label INT, size INT"
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) * (rng.random() < 0.4) for _ in range(n))


def texts() -> list:
    """Nulls, empty and blank texts, one letter, other scripts, a very long text and repeated ones."""
    return [
        None, "", " \n\t ", "a", "Zürich 東京 Москва naïve Ǆ ﬁ İ ſ K", "x" * 20000, prose(1, 4000), prose(2, 60),
        prose(2, 60), "A\u0300 cafe\u0301 \u00a0 \u2003 \x1c\x85 end", "<|endoftext|> and <|startoftext|>",
        "it's we'll they're 've'd ''s 'll", "line\nline\nline\n\n \nother", prose(3, 7) + "\r\n" + prose(3, 7),
    ]


def messy(spark, extra=()):
    """Documents with null ids, repeated ids and rows, null columns, and columns named like the operators' own."""
    rows = [(i, t) for i, t in enumerate([*texts(), *extra])]
    rows += [(7, prose(9, 30)), (None, prose(2, 60)), (None, None), rows[6], rows[6]]
    return spark.createDataFrame(
        [(i, t, None if k % 3 else "en", "s", None if k % 2 else 5, "x", "x", 1, "x", "x", "x", "x", "x", 1, 1)
         for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
