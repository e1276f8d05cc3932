"""Secret scan: keyword automaton first, anchored expressions only at its hits, checksums last.

One Aho-Corasick automaton finds all keywords in the A-Z-lower-cased bytes of a text. At each hit the expression of
the keyword's kind is matched from that place on. Runs of hexadecimal digits have no keyword; they are found by
probing every eighth byte, as a run of sixteen covers two neighbouring probes, and the run is then read around the
probe. Kinds with an embedded checksum are kept only when it agrees.

Positions are code points, ends exclusive. Within a kind spans are leftmost and do not overlap.
"""

import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.words import sha256, with_columns

# Kinds, their expressions and least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{2,}")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github",
    "ghr_": "github", "npm_": "npm",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_DIGITS = frozenset(b"0123456789abcdef")
STRIDE = LEAST_HEX // 2


def checksum62(body: bytes) -> bytes:
    """crc32 in six digits of base 62, as tokens with an embedded checksum end."""
    value, digits = zlib.crc32(body), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits.encode()


def _automaton():
    made = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


_FOUND = {}


def _hits(raw: bytes) -> list[tuple[int, str]]:
    """(start, kind) of every keyword; bytes are read as Latin-1, so places are bytes."""
    if "made" not in _FOUND:
        _FOUND["made"] = _automaton()
    return sorted((end - size + 1, kind) for end, (kind, size) in _FOUND["made"].iter(raw.lower().decode("latin-1")))


def _hex_runs(raw: bytes) -> list[tuple[int, int]]:
    found, done = [], 0
    for probe in HEX.finditer(raw[::STRIDE]):
        start, end = probe.start() * STRIDE, (probe.end() - 1) * STRIDE + 1
        if start < done:
            continue
        while start > 0 and raw[start - 1] in HEX_DIGITS:
            start -= 1
        place = start
        while place < end + STRIDE:
            stop = place
            while stop < len(raw) and raw[stop] in HEX_DIGITS:
                stop += 1
            if stop - place >= LEAST_HEX:
                found.append((place, stop))
            done = place = stop + 1
    return found


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets of one text, by start and then kind in the order of KINDS."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, str]] = [(a, b, "hex") for a, b in _hex_runs(raw)]
    ends = dict.fromkeys(KINDS, 0)
    expressions = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}
    for start, kind in _hits(raw):
        if start < ends[kind]:
            continue
        match = expressions[kind].match(raw, start)
        if not match:
            continue
        if kind in ("github", "npm"):
            good = checksum62(match[1]) == match[2]
            if not good:
                continue
        else:
            good = len(match[2]) >= LEAST_VALUE if kind == "assign" else len(match[0]) >= LEAST_ACCESS
        ends[kind] = match.end()
        if good:
            found.append((start, match.end(), kind))
    if found and not raw.isascii():
        places, last, count = {}, 0, 0
        for edge in sorted({x for a, b, _ in found for x in (a, b)}):
            count += len(raw[last:edge].decode("utf-8", "surrogatepass"))
            places[edge], last = count, edge
        found = [(places[a], places[b], kind) for a, b, kind in found]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan_secrets(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(identity, n_assign, n_access, n_hex, n_checked, base_sha256, spans) of every row.

    n_checked counts the spans with a right checksum. Null and empty texts have none; rows, repeated or not, and null
    ids stay; an empty table gives no rows. Other columns are not read.
    """

    def compute(texts):
        out = {"n_assign": [], "n_access": [], "n_hex": [], "n_checked": [], "base_sha256": [], "spans": []}
        for found in map(spans, texts):
            kinds = [kind for _, _, kind in found]
            for kind in BASE:
                out[f"n_{kind}"].append(kinds.count(kind))
            out["n_checked"].append(sum(kind not in BASE for kind in kinds))
            out["base_sha256"].append(sha256(joined([s for s in found if s[2] in BASE])))
            out["spans"].append(joined(found))
        return out

    ddl = "n_assign LONG, n_access LONG, n_hex LONG, n_checked LONG, base_sha256 STRING, spans STRING"
    rows = docs.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    return with_columns(rows, "text", ddl, compute).withColumnRenamed("id", identity)


def redacted(text: str | None) -> str | None:
    """The text with each secret, overlapping ones as one, replaced by the kind that begins first; null stays."""
    found, out, place = spans(text), [], 0
    if not found:
        return text
    end, kind = -1, ""
    merged: list[list] = []
    for a, b, kind in found:
        if merged and a < end:
            merged[-1][1] = end = max(end, b)
        else:
            merged.append([a, b, kind])
            end = b
    for a, b, kind in merged:
        out += [text[place:a], f"[{kind}]"]
        place = b
    return "".join([*out, text[place:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with its secrets replaced in the text; all other columns and all rows stay as they are."""
    import pyarrow as pa

    from shelfspark.llm.words import claim, slices

    def run(batches):
        claim()
        for whole in batches:
            for batch in slices(whole, text):
                column = batch.schema.get_field_index(text)
                made = pa.array([redacted(t) for t in batch.column(column).to_pylist()], batch.column(column).type)
                yield pa.RecordBatch.from_arrays(
                    [made if i == column else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
