import hashlib
import random
import re

from llm_samples import empty, messy, rows_of

from shelfspark.llm import secret_scan

EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password") + "|" + "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def random_texts(n):
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "=", ":", " ", '"', "'", "\n", "é",
             "abcdefabcdef", "0123456789", "A1B2C3", "日", "\u212a", "ſ", "x", "0f", ".", "ghp_"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_base_spans_as_plain_expressions():
    for text in random_texts(5000):
        assert [s for s in secret_scan.spans(text) if s[2] in secret_scan.BASE] == brute(text)


def test_hex_runs_at_every_place():
    for n in range(30):
        for shift in range(18):
            text = "z" * shift + "a" * n + "g" + "1" * 16 + "h" + "2" * 15
            assert secret_scan.spans(text) == brute(text)


def test_checksums():
    body = b"0aZ" * 10
    good = "ghp_" + body.decode() + secret_scan.checksum62(body).decode()
    assert secret_scan.spans("é " + good) == [(2, 42, "github")]
    assert secret_scan.spans(good[:-1] + ("A" if good[-1] != "A" else "B")) == []
    assert secret_scan.checksum62(b"") == b"000000"


def test_table_and_edges(spark):
    docs = messy(spark, random_texts(40))
    expected = []
    for r in docs.collect():
        found = brute(r.text or "")
        kinds = [k for _, _, k in found]
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in found)
        expected.append((r.doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                         hashlib.sha256(text.encode()).hexdigest()))
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert rows_of(secret_scan.scan_secrets(docs), *columns) == sorted(expected, key=repr)
    assert rows_of(secret_scan.scan_secrets(empty(spark)), *columns) == []


def test_redaction(spark):
    assert secret_scan.redacted("é password=abcdefabcdefabcdef0 y") == "é [assign] y"
    assert secret_scan.redacted(None) is None and secret_scan.redacted("plain") == "plain"
    docs = messy(spark, random_texts(40))
    found = secret_scan.redact(docs)
    assert found.schema == docs.schema
    assert rows_of(found.drop("text"), *[c for c in docs.columns if c != "text"]) == rows_of(docs, *[c for c in docs.columns if c != "text"])
    assert rows_of(found, "text") == sorted(((secret_scan.redacted(r.text),) for r in docs.collect()), key=repr)
