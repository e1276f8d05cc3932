"""Helpers that run inside tasks: memoised functions, word codes, window codes, Arrow batches by text."""

import hashlib
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MEMO_ENTRIES = 1 << 18
SLICE_BYTES = 8 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)


_MEMOS: list[weakref.ref] = []


def claim(*kept: dict) -> None:
    """Empty all memos of this process but the `kept` ones: a worker serves one operator after the other."""
    for known in list(_MEMOS):
        memo = known()
        if memo is None:
            _MEMOS.remove(known)
        elif memo and not any(memo is k for k in kept):
            memo.clear()


class Memo(dict):
    """Results of `fn` by argument. It starts anew at `limit` entries, so its memory is bounded."""

    def __init__(self, fn: Callable, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.fn, self.limit = fn, limit
        _MEMOS.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


WORD_CODES = Memo(xxhash.xxh3_64_intdigest)


def codes(words: list[bytes], memo: Memo = WORD_CODES) -> np.ndarray:
    """A 64-bit code for each word."""
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code for each run of `n` words; none when there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for j in range(n):
        out = out * STEP + words[j : j + count]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return out ^ (out >> np.uint64(29))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct codes of the `n`-word runs of a text whose A-Z are lower-cased; a shorter one is a single run.

    Words are what the six ASCII white-space characters separate.
    """
    words = codes((text or "").encode("utf-8", "surrogatepass").lower().split())
    return np.unique(windows(words, min(n, len(words)))) if len(words) else np.empty(0, np.uint64)


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    parts = np.cumsum(sizes + 64) // size
    edges = np.flatnonzero(np.diff(parts, prepend=-1)).tolist() + [batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        yield batch.slice(start, end - start)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _as(values, kind: pa.DataType) -> pa.Array:
    if not isinstance(values, pa.Array):
        return pa.array(values, kind)
    return values if values.type == kind else values.cast(kind)


def with_columns(
    df: DataFrame, text: str, ddl: str, compute: Callable[[list], dict], keep_text: bool = False
) -> DataFrame:
    """`df` with the columns `ddl`, which `compute` makes from a list of texts as lists or Arrow arrays by name.

    The text column itself goes unless `keep_text`. Names of `df` must differ from those in `ddl`.
    """
    added = StructType.fromDDL(ddl)
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = StructType(kept + added.fields)
    names = [f.name for f in kept]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for whole in batches:
            for batch in slices(whole, text):
                made = compute(batch.column(text).to_pylist())
                columns = [batch.column(n) for n in names] + [made[f.name] for f in added.fields]
                yield pa.RecordBatch.from_arrays(
                    [_as(c, t.type) for c, t in zip(columns, target)],
                    schema=target,
                )

    return df.mapInArrow(run, schema)


def fold(identity: str):
    """crc32 of a column's value as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(identity).cast("string"), F.lit("")).cast("binary"))
