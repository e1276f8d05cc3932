"""Occurrences of a term as one row of lists, gathered in the task that has them."""

import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

PLACES = ["id", "pos", "weight", "first"]
LISTS = "term STRING, docs LONG, id ARRAY<LONG>, pos ARRAY<INT>, weight ARRAY<DOUBLE>, first ARRAY<BOOLEAN>"
#: Occurrences and bytes that a task holds at once, and places in one list.
BLOCK_ROWS = 1 << 20
BLOCK_BYTES = 48 << 20
LIST_PLACES = 1 << 12

#: Lists that postings were made from, while those are in use.
_MADE_FROM: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _lists(coded: pa.DictionaryArray, order: np.ndarray, places: dict[str, pa.Array]) -> pa.RecordBatch:
    """A row per term, or several of at most LIST_PLACES occurrences; `order` has those of a term together, `places` are in it."""
    codes, at = coded.indices.to_numpy()[order], np.arange(len(order))
    begins = np.diff(codes, prepend=-1) != 0
    own = at - np.maximum.accumulate(np.where(begins, at, 0))
    starts = np.flatnonzero(own % LIST_PLACES == 0)
    offsets = pa.array(np.append(starts, len(order)), pa.int32())
    first = pc.fill_null(places["first"], False).to_numpy(zero_copy_only=False)
    columns = [coded.dictionary.take(pa.array(codes[starts])), pa.array(np.add.reduceat(first.astype(np.int64), starts))]
    columns += [pa.ListArray.from_arrays(offsets, places[c]) for c in PLACES]
    return pa.RecordBatch.from_arrays(columns, ["term", "docs", *PLACES])


def _encoded(terms: pa.Array) -> pa.DictionaryArray:
    return pc.dictionary_encode(terms, null_encoding="encode")


def _postings_block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(batches).combine_chunks()
    coded = _encoded(whole["term"].combine_chunks())
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    taken = pa.array(order)
    return _lists(coded, order, {c: whole[c].combine_chunks().take(taken) for c in PLACES})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
            yield _postings_block(held)
            held, rows, size = [], 0, 0
    if held:
        yield _postings_block(held)


def _words_block(batches: list[pa.RecordBatch], weights: list[float] | None) -> pa.RecordBatch | None:
    """Lists of the words of documents: fields as lists of words, or one list of (surface, pos, weight)."""
    whole = pa.Table.from_batches(batches).combine_chunks()
    ids, *fields = [whole[c].combine_chunks() for c in whole.column_names]
    base, parts = np.zeros(len(ids), np.int64), []
    for i, lists in enumerate(fields):
        sizes, words = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), lists.flatten()
        doc = np.repeat(np.arange(len(ids)), sizes)
        if weights is None:
            parts.append((words.field("surface"), doc, words.field("pos").to_numpy(), words.field("weight").to_numpy()))
            continue
        before = np.cumsum(sizes) - sizes
        parts.append((words, doc, base[doc] + np.arange(len(doc)) - before[doc] + 1, np.full(len(doc), weights[i])))
        base += sizes
    terms = pa.chunked_array([p[0] for p in parts]).combine_chunks()
    doc, pos, weight = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    if not len(doc):
        return None
    coded = _encoded(terms)
    order = np.argsort(doc, kind="stable")
    order = order[np.argsort(coded.indices.to_numpy()[order], kind="stable")]
    doc, codes = doc[order], coded.indices.to_numpy()[order]
    first = (np.diff(codes, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)
    return _lists(coded, order, {
        "id": ids.take(pa.array(doc)), "pos": pa.array(pos[order], pa.int32()), "weight": pa.array(weight[order], pa.float64()),
        "first": pa.array(first)})


def pack_words(words: DataFrame, weights: list[float] | None) -> DataFrame:
    """Lists of documents given as (id, words of each field), or as (id, list of surface, pos, weight) without `weights`."""
    def run(batches):
        held, count = [], 0
        for whole in batches:
            sizes = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy().astype(np.int64) for c in whole.columns[1:])
            parts = np.cumsum(sizes) // BLOCK_ROWS
            edges = np.flatnonzero(np.diff(parts, prepend=-1)).tolist() + [whole.num_rows]
            for start, end in zip(edges, edges[1:]):
                held.append(whole.slice(start, end - start))
                count += int(sizes[start:end].sum())
                if count >= BLOCK_ROWS // 2:
                    made, held, count = _words_block(held, weights), [], 0
                    if made is not None:
                        yield made
        if held and (made := _words_block(held, weights)) is not None:
            yield made

    schema = StructType.fromDDL(LISTS)
    schema["id"].dataType = ArrayType(words.schema["id"].dataType)
    return words.mapInArrow(run, schema)


def pack(postings: DataFrame) -> DataFrame:
    """Postings as LISTS: what a task has of a term within about a million rows is one row, without a shuffle.

    Postings that `unpack` has just made of lists are those lists.
    """
    schema = StructType.fromDDL(LISTS)
    if (made := _MADE_FROM.get(postings)) is not None:
        return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    kinds = {"term": schema["term"].dataType} | {c: schema[c].dataType.elementType for c in PLACES}
    return postings.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]).mapInArrow(_pack, schema)


def unpack(lists: DataFrame, *kept: str) -> DataFrame:
    """The postings of LISTS, one row (term, id, pos, weight, first) each, with the `kept` columns before."""
    each = lists.select(*kept, "term", F.posexplode("id").alias("_at", "_id"), *PLACES[1:])
    postings = each.select(*kept, "term", F.col("_id").alias("id"), *[F.get(c, F.col("_at")).alias(c) for c in PLACES[1:]])
    if not kept:
        _MADE_FROM[postings] = lists
    return postings
