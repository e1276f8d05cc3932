"""Byte-level BPE: text to ids by a rank table, and ids back to bytes.

Pre-tokenisation is done on whole arrays of code points. A table gives each code point its class; looking one or
two places ahead turns classes into symbols of a small automaton. What a symbol does to the automaton is a function
from state to state, and functions compose associatively, so states are found by a scan: blocks of the array are
composed side by side, then the blocks' totals, then every position reads its state and whether a piece begins there.
A piece's ids come from pair merging, memoised by piece. Offsets of pieces in the text come with the ids.

The classes are those of the pattern in `public_tokenizers.PATTERN`; which code points count as letters, numbers and
white space is asked of the library whose results are to be met, once, when the table is made.
"""

from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.words import Memo, claim, sha256, with_columns

# symbols
LETTER, NUMBER, OTHER, SHORT, LONG, GLUE, LONE, INNER, BREAK = range(9)
# states: what the piece so far is
FRESH, LETTERS, NUMBERS, OTHERS, GLUED, SPACES, ONE_MORE, TWO_MORE = range(8)
BLOCK = 512
CHUNK_CHARS = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file if line.strip())}


@cache
def class_table() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 white space, 4 space, 5 apostrophe."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    for value, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        probe = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(probe.encode_ordinary(points)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    table[ord(" ")], table[ord("'")] = 4, 5
    return table


def _next(state: int, symbol: int) -> tuple[int, bool]:
    """State after a symbol, and whether the symbol begins a piece."""
    if symbol == BREAK:
        return FRESH, True
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    if symbol == GLUE:
        return GLUED, True
    if symbol == LONE:
        return FRESH, True
    if symbol == INNER:
        return SPACES, state != SPACES
    if symbol == LETTER:
        return LETTERS, state not in (LETTERS, GLUED)
    if symbol == NUMBER:
        return NUMBERS, state not in (NUMBERS, GLUED)
    if state in (OTHERS, GLUED) or symbol == OTHER:
        return OTHERS, state not in (OTHERS, GLUED)
    return (ONE_MORE if symbol == SHORT else TWO_MORE), True


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, product of two elements, state that an element leads to from FRESH, begins)."""
    symbols = [tuple(_next(s, x)[0] for s in range(8)) for x in range(9)]
    elements = {tuple(range(8)): 0}
    order = [tuple(range(8))]
    for first in order:
        for then in symbols:
            both = tuple(then[s] for s in first)
            if both not in elements:
                elements[both] = len(order)
                order.append(both)
    product = np.array([[elements[tuple(b[s] for s in a)] for b in order] for a in order], np.uint16)
    begins = np.array([[_next(s, x)[1] for x in range(9)] for s in range(8)])
    return np.array([elements[x] for x in symbols], np.uint16), product, np.array(order, np.uint8)[:, FRESH], begins


def _scan(elements: np.ndarray) -> np.ndarray:
    """The product of all elements up to each place, by blocks side by side."""
    _, product, _, _ = _monoid()
    size = len(product)
    flat = product.ravel()
    if len(elements) <= BLOCK:
        out, total = np.empty_like(elements), 0
        for i, x in enumerate(elements.tolist()):
            total = int(flat[total * size + x])
            out[i] = total
        return out
    rows = -(-len(elements) // BLOCK)
    table = np.zeros(rows * BLOCK, np.uint16)
    table[: len(elements)] = elements
    table = np.ascontiguousarray(table.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        table[j] = flat[table[j - 1].astype(np.intp) * size + table[j]]
    before = np.zeros(rows, np.uint16)
    before[1:] = _scan(table[-1])[:-1]
    return flat[before.astype(np.intp) * size + table].T.reshape(-1)[: len(elements)]


def symbols_of(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; 0x110000 stands between texts."""
    table = class_table()
    stop = points == 0x110000
    kind = table[np.where(stop, 0, points)]
    after = np.append(points[1:], 0x110000)
    after2 = np.append(after[1:], 0x110000)
    space = ((kind == 3) | (kind == 4)) & ~stop
    last = space & ~np.append(space[1:], False) & (after != 0x110000)
    out = np.full(len(points), OTHER, np.uint8)
    out[kind == 1], out[kind == 2] = LETTER, NUMBER
    out[space] = INNER
    out[last] = np.where(kind[last] == 4, GLUE, LONE)
    mark = np.flatnonzero(kind == 5)
    a, b = after[mark], after2[mark]
    short = np.isin(a, [ord(c) for c in "stmd"])
    long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    out[mark[short]], out[mark[long]] = SHORT, LONG
    out[stop] = BREAK
    return out


def piece_starts(texts: list[str]) -> list[np.ndarray]:
    """Where pieces begin in each text, as code-point offsets."""
    points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[ends[:-1]] = 0x110000
    symbols = symbols_of(points)
    of_symbol, _, leads, begins = _monoid()
    state = np.empty(len(points), np.uint8)
    if len(points):
        state[0] = FRESH
        state[1:] = leads[_scan(of_symbol[symbols])[:-1]]
    starts = np.flatnonzero(begins[state, symbols] & (symbols != BREAK))
    firsts = np.append(0, ends[:-1] + 1)
    edges = np.searchsorted(starts, firsts).tolist() + [len(starts)]
    return [starts[a:b] - f for a, b, f in zip(edges, edges[1:], firsts.tolist())]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the neighbouring pair of lowest rank is joined, leftmost first, while there is one."""
    known = ranks.get(piece)
    if known is not None:
        return [known]
    if len(piece) > 256:
        return _merge_long(piece, ranks)
    get, none = ranks.get, 1 << 62
    edges = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) != none:
        at = pairs.index(best)
        del edges[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = get(piece[edges[at] : edges[at + 2]], none)
        if at:
            pairs[at - 1] = get(piece[edges[at - 1] : edges[at + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(edges, edges[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs over a linked list, for pieces of any length."""
    import heapq

    n = len(piece)
    parts: list = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[parts[i] + parts[i + 1]], i, 2) for i in range(n - 1) if parts[i] + parts[i + 1] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else n
        if j >= n or len(parts[i]) + len(parts[j]) != length:
            continue
        parts[i], parts[j], right[i] = parts[i] + parts[j], None, right[j]
        if right[j] < n:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (rank := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (rank, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p is not None]


class Codec:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {str(i).encode(): word for word, i in ranks.items()}
        self.memo = Memo(lambda piece: b" ".join(b"%d" % i for i in merge(piece.encode("utf-8"), ranks)), 1 << 19)

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """Each text cut into its pieces."""
        out, group, size = [], [], 0
        for text in [*texts, None]:
            if group and (text is None or size + len(text) > CHUNK_CHARS):
                for t, starts in zip(group, piece_starts(group)):
                    edges = starts.tolist()
                    out.append([t[a:b] for a, b in zip(edges, [*edges[1:], len(t)])])
                group, size = [], 0
            if text is not None:
                group.append(text)
                size += len(text)
        return out

    def encode(self, pieces: list[str]) -> bytes:
        """Decimal ids joined by one space."""
        return b" ".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, ids.split(b" "))) if ids else b""


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec for a broadcast table; one table at a time is kept."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(shared.value)
    return _CODECS[shared.id]


class _Table:
    """A rank table and class table sent to the workers once."""

    def __init__(self, spark, ranks: dict[bytes, int]):
        self.ranks = spark.sparkContext.broadcast(ranks)
        self.id = sha256(b"".join(b"%d:%d:%b" % (i, len(word), word) for word, i in sorted(ranks.items())))

    @property
    def value(self):
        return self.ranks.value


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", with_ids: bool = True) -> DataFrame:
    """`docs` without its text, with ids (list of int), starts and the digests of ids and of the decoded bytes.

    starts are the code-point offsets of the pieces and piece_ids the number of ids of each, so that any id can be
    traced to its place. `with_ids=False` leaves the lists out. Null is encoded as the empty text: no ids.
    Rows, repeated or not, stay as they are; an empty table gives no rows. The other columns must not be named as
    the new ones are.
    """
    table = _Table(docs.sparkSession, ranks)

    def compute(texts):
        codec = _codec(table)
        claim(codec.memo)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "starts": [], "piece_ids": []}
        for pieces in codec.pieces([t or "" for t in texts]):
            ids = codec.encode(pieces)
            out["n_tokens"].append(ids.count(b" ") + 1 if ids else 0)
            out["ids_sha256"].append(sha256(ids))
            out["decoded_sha256"].append(sha256(codec.decode(ids)))
            if with_ids:
                out["ids"].append([int(i) for i in ids.split()])
                out["starts"].append([0, *np.cumsum([len(p) for p in pieces]).tolist()[:-1]] if pieces else [])
                out["piece_ids"].append([codec.memo[p].count(b" ") + 1 for p in pieces])
        return out

    ddl = "n_tokens LONG, ids_sha256 STRING, decoded_sha256 STRING"
    if with_ids:
        ddl += ", ids ARRAY<INT>, starts ARRAY<INT>, piece_ids ARRAY<INT>"
    return with_columns(docs, text, ddl, compute)


def decode_ids(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """`rows` with `decoded`, the bytes of a list of ids; null gives null, an id without an entry is an error."""
    table = _Table(rows.sparkSession, ranks)

    def run(batches):
        codec = _codec(table)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            made = [None if x is None else b"".join(codec.words[b"%d" % i] for i in x) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("decoded", BinaryType()))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(identity, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return encode_texts(docs.select(F.col(identity), F.col(text)), ranks, text, with_ids=False)
