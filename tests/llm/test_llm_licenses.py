import re

from llm_samples import empty, messy, rows_of

from shelfspark.llm.license_scan import PHRASES, TEMPLATES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
TEXTS = [
    "MIT License", "mit license MIT-LICENSE mit.license", "the gnu General Public License, a general public\nlicense",
    "general public", "license mit general license", "ÀMIT License mit licensé", "İmit license", "apache apache license license",
    " ".join(["mit license"] * 300), "Apache\x00License \x7f mit license",
]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    own, places = words(text), []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(own) - len(parts) + 1) if own[i : i + len(parts)] == parts]
    starts = [i for i, _ in places]
    return (len(own), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def test_base_places(spark):
    docs = messy(spark, TEXTS)
    expected = sorted([(r.doc_id, *brute(r.text)) for r in docs.collect()], key=repr)
    found = scan_licenses(docs)
    assert rows_of(found, *COLUMNS) == expected
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
               for r in found.collect())
    assert rows_of(scan_licenses(empty(spark)), *COLUMNS) == []


def test_templates_whole_changed_and_partial(spark):
    rows = []
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        own = text.split()
        rows += [(i * 10, name, "Before it " + text + " and after"), (i * 10 + 1, name, text.upper().replace(" ", "\n# "))]
        if len(own) > 12:
            rows.append((i * 10 + 2, name, " ".join([*own[:6], "put", "in", *own[6:]])))
    docs = spark.createDataFrame(rows, "doc_id LONG, name STRING, text STRING")
    found = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for i, name, _ in rows:
        assert name in found[i].labels.split(",") and found[i].score > 0.8
    spans = {s.template: s for s in found[0].spans}
    first = sorted(TEMPLATES)[0]
    assert (spans[f"text {first}"].start, spans[f"text {first}"].end) == (2, 2 + len(words(TEMPLATES[first])))


def test_plain_prose_has_no_label(spark):
    docs = spark.createDataFrame([(1, "this is free and the software you use may be of any kind for the following")], "doc_id LONG, text STRING")
    row = scan_licenses(docs).first()
    assert row.labels == "" and row.n_base == 0 and row.score < 0.6
