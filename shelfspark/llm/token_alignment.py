"""Alignment of two tokenizers' tokens over the bytes of each text.

A is a byte-level BPE vocabulary, B a piece vocabulary with byte fallback. Both cut a text where a character that is no
white space is followed by a space, so a text is a row of chunks that each tokenise by themselves. A task works on
slices of texts, all in Arrow:

1. Texts are split to lists of chunks, flattened with parent indices and dictionary-encoded; a slice's distinct chunks
   have their ids of A and of B as lists.
2. Cumulative sums of token lengths, less the sum before the chunk, give each token's end. (chunk, end) is one key, and
   a full outer hash join of A's and B's keys has a row for each stretch of bytes between neighbouring ends. Sorted and
   filled backward, a row holds the only A and B token over its stretch: the links are these rows. Keys that both
   sides have close a group.
3. Table.group_by adds up links by id pair, weighted by the chunk's occurrences, and chunk figures by document.

A slice's chunks and links are stored as one compressed value, of which a task of the second pass holds a few: batches,
pages and row groups are kept small, as a slice is a row of some hundred kilobytes.

Spark merges the partial pair counts. Counts of the pairs that are most frequent, HEAD at most, are broadcast; rarer
ones are met by a shuffle, in which no pair has more than its share of all links, 1 in HEAD.
"""

import base64
import json
import re
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from shelfspark.llm.words import claim, sha256, slices
from shelfspark.sources.storage import few_rows_at_once, stage, unstage

HEAD = 1 << 19
MEMO_CHUNKS = 1 << 17
SLICE_BYTES = 1 << 20
SHIFT = 32
LOW = (1 << SHIFT) - 1
# White space, in the widest reading of the libraries, and then a space; or a space at either end.
_SPACES = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_AWKWARD = f"[{_SPACES}] |^ | $"
_CHUNK = re.compile("(?:^| )(?:[^ ]|(?<=[\\s\u180e]) |^ )*")
_SIDES = ("a", "b")
NO_LISTS = pa.array([], pa.large_list(pa.int32()))
_FACTS = ("n_a", "n_b", "n_groups", "n_links")
_PLACES = ("n_chunks", "chunks", "chunk_links", "links")


def load_byte_bpe(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, letters = model["vocab"], byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocabulary["".join(m)] for m in merges]
    if order != sorted(order):
        raise ValueError("ids do not follow the order of merges")
    wanted = {"".join(m) for m in merges} | set(letters)
    return {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word in wanted}


@cache
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 itself, others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers of a worker, ids of the chunks it has met lately, and bytes by id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known: dict[str, int] = {}
        self.ids = {side: NO_LISTS for side in _SIDES}
        by_id = {i: word for word, i in ranks.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes = {
            "a": pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.large_binary()),
            "b": pa.array([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                           for i, p in enumerate(pieces)], pa.large_binary()),
        }
        self.lengths = {side: pc.binary_length(x).cast(pa.int64()) for side, x in self.bytes.items()}
        self.digits = pa.array([str(i) for i in range(max(map(len, self.bytes.values())))], pa.large_string())

    def _encode_a(self, chunks: list[str]) -> pa.LargeListArray:
        """Ids of ` chunk` for chunks that end in no white space: of all in one text, then dealt out by their bytes."""
        joined = [f" {c}" for c in chunks]
        ids = np.array(self.a.encode_ordinary("".join(joined)), np.int32)
        ends = np.cumsum(pc.binary_length(pa.array(joined, pa.large_string())).to_numpy(), dtype=np.int64)
        cuts = np.searchsorted(self.lengths["a"].to_numpy()[ids].cumsum(), ends) + 1
        return pa.LargeListArray.from_arrays(np.concatenate(([0], cuts)), pa.array(ids))

    def encode(self, chunks: list[str]) -> dict[str, pa.LargeListArray]:
        """Ids of A and of B of each distinct chunk."""
        missing = [c for c in chunks if c not in self.known]
        if len(self.known) + len(missing) > MEMO_CHUNKS:
            self.known.clear()
            self.ids = {side: NO_LISTS for side in _SIDES}
            missing = chunks
        if missing:
            open_ended = [c for c in missing if not c or c[-1].isspace() or c[-1] == "\u180e"]
            apart = set(open_ended)
            closed = [c for c in missing if c not in apart]
            missing = closed + open_ended
            new = {
                "a": [self._encode_a(closed), pa.array([self.a.encode_ordinary(f" {c}") for c in open_ended], NO_LISTS.type)],
                "b": [pa.array(self.b.encode(missing, num_threads=1), NO_LISTS.type)],
            }
            self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing))))
            self.ids = {side: pa.concat_arrays([self.ids[side], *new[side]]) for side in _SIDES}
        at = pa.array(np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks)))
        return {side: self.ids[side].take(at) for side in _SIDES}


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _of_counts(counts, values: pa.Array) -> pa.LargeListArray:
    """Lists of so many values each."""
    offsets = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def _without(values: pa.Array, gone: pa.Array) -> pa.Array:
    """A copy of the values with nulls where `gone` is true."""
    return values.take(pa.array(np.arange(len(values)), mask=gone.to_numpy(zero_copy_only=False)))


def chunk_lists(texts: pa.Array) -> pa.LargeListArray:
    """Chunks of each text, without the space that begins each one; null for null and empty texts."""
    texts = _without(texts, pc.fill_null(pc.equal(pc.binary_length(texts), 0), False)).cast(pa.large_string())
    awkward = pc.fill_null(pc.match_substring_regex(texts, _AWKWARD), False)
    plain = pc.split_pattern(_without(texts, awkward), " ").cast(pa.large_list(pa.large_string()))
    if not pc.any(awkward).as_py():
        return plain
    cut = []
    for text in texts.filter(awkward).to_pylist():
        parts = [p[1:] for p in _CHUNK.findall(f" {text}")]
        if len(parts) > 1 and not parts[-1].strip(" "):
            parts[-2:] = [f"{parts[-2]} {parts[-1]}"]
        cut.append(parts)
    place = np.arange(len(texts))
    place[awkward.to_numpy(zero_copy_only=False)] = len(texts) + np.arange(len(cut))
    return pa.concat_arrays([plain, pa.array(cut, plain.type)]).take(pa.array(place))


def _ends(ids: pa.LargeListArray, lengths: pa.Array) -> pa.Array:
    """(list, end of the token in it) of every id as one key."""
    parent = pc.list_parent_indices(ids)
    total = pc.cumulative_sum(lengths.take(ids.flatten()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(ids.offsets)
    return pc.add(pc.shift_left(parent, SHIFT), pc.subtract(total, before.take(parent)))


def aligned(a: pa.LargeListArray, b: pa.LargeListArray, tokens: Tokenizers) -> dict:
    """Links and groups of the chunks whose ids are the lists `a` and `b`, all with the same bytes and not empty."""
    ends = [pa.table({"key": _ends(ids, tokens.lengths[side]), side: ids.flatten()}) for side, ids in zip(_SIDES, (a, b))]
    rows = ends[0].join(ends[1], "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    key, *own = [rows[c].combine_chunks() for c in ("key", *_SIDES)]
    chunk = pc.shift_right(key, SHIFT)
    common = pc.and_(own[0].is_valid(), own[1].is_valid()).cast(pa.int64())
    group = pc.subtract(pc.cumulative_sum(common), common)
    links = [pc.fill_null_backward(x) for x in own]
    n_groups = pc.sum(common).as_py() or 0
    sides = []
    for ids in own:
        held = ids.is_valid()
        counts = np.bincount(group.filter(held).to_numpy(), minlength=n_groups)
        sides.append(pc.binary_join(_of_counts(counts, tokens.digits.take(ids.filter(held))), _text(",")))
    per_chunk = pa.table({"chunk": chunk, "common": common}).group_by("chunk", use_threads=False).aggregate(
        [("common", "sum"), ("common", "count")]).sort_by("chunk")
    groups = per_chunk["common_sum"].to_numpy()
    return {
        "chunk": chunk, "pair": pc.add(pc.shift_left(links[0].cast(pa.int64()), SHIFT), links[1].cast(pa.int64())),
        "n_groups": groups, "n_links": per_chunk["common_count"].to_numpy(),
        "text": pc.binary_join(_of_counts(groups, pc.binary_join_element_wise(*sides, _text("|"))), _text(";")),
    }


def _whole(chunks: pa.Array, ids: dict, tokens: Tokenizers) -> pa.Array:
    """Whether A's and B's bytes are those of the chunk with its space."""
    wanted = pc.binary_join_element_wise(_text(" "), chunks, _text("")).cast(pa.large_binary())
    same = [pc.equal(pc.binary_join(pa.LargeListArray.from_arrays(x.offsets, tokens.bytes[side].take(x.flatten())), pa.scalar(b"", pa.large_binary())), wanted)
            for side, x in ids.items()]
    return pc.and_(*same)


def align_slice(texts: pa.Array, tokens: Tokenizers) -> dict:
    """Figures of each text, its chunks as numbers, each chunk's links, and links by id pair."""
    lists = chunk_lists(texts)
    while True:
        coded = lists.flatten().dictionary_encode()
        chunks, codes, parent = coded.dictionary, coded.indices.cast(pa.int64()), pc.list_parent_indices(lists)
        ids = tokens.encode(chunks.to_pylist())
        broken = pc.invert(_whole(chunks, ids, tokens))
        if not pc.any(broken).as_py():
            break
        bad = parent.filter(broken.take(codes))
        lists = _without(lists, pc.is_in(pa.array(np.arange(len(lists))), bad))
    found = aligned(ids["a"], ids["b"], tokens)
    facts = {"n_a": pc.list_value_length(ids["a"]).cast(pa.int64()), "n_b": pc.list_value_length(ids["b"]).cast(pa.int64()),
             "n_groups": pa.array(found["n_groups"], pa.int64()), "n_links": pa.array(found["n_links"], pa.int64())}
    by_text = pa.table({"text": parent} | {c: x.take(codes) for c, x in facts.items()}).group_by("text", use_threads=False).aggregate(
        [(c, "sum") for c in _FACTS])
    out = {c: np.zeros(len(texts), np.int64) for c in _FACTS}
    for c in _FACTS:
        out[c][by_text["text"].to_numpy()] = by_text[f"{c}_sum"].to_numpy()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    joined = pc.binary_join(_of_counts(sizes, found["text"].take(codes)), _text(";")).to_pylist()
    weight = pa.array(np.bincount(codes.to_numpy(), minlength=len(chunks)), pa.int64())
    coded = found["pair"].dictionary_encode()
    pairs = pa.table({"pair": coded.indices, "n": weight.take(found["chunk"])}).group_by("pair", use_threads=False).aggregate(
        [("n", "sum")]).sort_by("pair")
    return out | {
        "groups_sha256": [sha256(x) if x else "" for x in joined], "n_chunks": sizes, "chunks": codes.to_numpy(),
        "chunk_links": found["n_links"], "links": coded.indices.to_numpy(),
        "pairs": coded.dictionary.to_numpy(), "pair_counts": pairs["n_sum"].to_numpy(),
    }


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 32-bit numbers as one compressed value, after their sizes."""
    sizes = np.array([len(x) for x in arrays], np.int64)
    plain = b"".join(np.asarray(x, np.int32).tobytes() for x in arrays)
    return sizes.tobytes() + pa.Codec("zstd", 1).compress(plain, asbytes=True)


def unpack(packed: pa.Buffer, count: int) -> list[np.ndarray]:
    """The `count` arrays that `pack` was given."""
    sizes = np.frombuffer(packed, np.int64, count)
    plain = pa.Codec("zstd").decompress(packed.slice(sizes.nbytes), int(sizes.sum()) * 4)
    return np.split(np.frombuffer(plain, np.int32), np.cumsum(sizes)[:-1])


_TOKENIZERS: dict[str, Tokenizers] = {}


def _slices(docs: DataFrame, ranks: dict[bytes, int], pattern: str, model: bytes) -> DataFrame:
    """A row per slice of texts, holding what `align_slice` says of them."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, model))
    digest = sha256(base64.b64encode(model) + pattern.encode() + b"".join(b"%d=%b;" % (i, w) for w, i in sorted(ranks.items())))
    kinds = {c: "LONG" for c in ("n_a", "n_b", "n_groups", "n_links", "pairs", "pair_counts")} | {"groups_sha256": "STRING"}
    arrow = {"LONG": pa.int64(), "STRING": pa.string()}
    identity = docs.schema["id"].dataType
    schema = StructType([StructField("slice", StructType.fromDDL("s STRING")["s"].dataType), StructField("ids", ArrayType(identity))]
                        + StructType.fromDDL(", ".join(f"{c} ARRAY<{k}>" for c, k in kinds.items()) + ", places BINARY").fields)

    def run(batches):
        if digest not in _TOKENIZERS:
            _TOKENIZERS.clear()
            _TOKENIZERS[digest] = Tokenizers(*shared.value)
        claim()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                made = align_slice(batch.column("text"), _TOKENIZERS[digest])
                ids = batch.column("id")
                columns = [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
                columns += [
                    pa.ListArray.from_arrays(pa.array([0, len(made[c])], pa.int32()), pa.array(made[c], arrow[k])) for c, k in kinds.items()]
                columns.append(pa.array([pack([made[c] for c in _PLACES])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["slice", "ids", *kinds, "places"])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair, and whether no other pair of its B id has more."""
    counts = parts.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_counts").alias("n")).withColumn("b", F.col("pair").bitwiseAND(LOW))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(parts: DataFrame, head: pa.Table) -> DataFrame:
    """A row per text with its sums over links of frequent pairs, and its links of other pairs."""
    order = np.argsort(head["pair"].to_numpy(), kind="stable")
    shared = parts.sparkSession.sparkContext.broadcast((
        head["pair"].to_numpy()[order], head["n"].to_numpy()[order], head["best"].to_numpy(zero_copy_only=False)[order]))
    figures = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")

    def run(batches):
        # The worker has no more use for what the first pass kept.
        _TOKENIZERS.clear()
        pa.default_memory_pool().release_unused()
        known, n, best = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in batch.schema.names if c not in ("slice", "places")}
                n_chunks, chunks, chunk_links, links = unpack(batch.column("places")[i].as_buffer(), len(_PLACES))
                # Pairs are looked up once for the slice; links name them by place.
                pairs = row["pairs"].to_numpy()
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                if len(known):
                    hit = known[at] == pairs
                    met, value, top = hit[links], np.where(hit, n[at], 0)[links], (hit & best[at])[links]
                else:
                    met, value, top = np.zeros(len(links), bool), np.zeros(len(links), np.int64), np.zeros(len(links), bool)
                first = np.concatenate(([0], np.cumsum(chunk_links, dtype=np.int64))).astype(np.int64)
                edge = np.concatenate(([0], np.cumsum(n_chunks, dtype=np.int64))).astype(np.int64)

                def by_text(x):
                    of_chunk = np.diff(np.concatenate(([0], np.cumsum(x.astype(np.int64))))[first])
                    return np.diff(np.concatenate(([0], np.cumsum(of_chunk[chunks])))[edge])

                rare = [[] for _ in range(len(edge) - 1)]
                left = by_text(~met)
                for text in np.flatnonzero(left).tolist():
                    for c in chunks[edge[text] : edge[text + 1]].tolist():
                        own = slice(first[c], first[c + 1])
                        rare[text] += pairs[links[own][~met[own]]].tolist()
                size = len(rare)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("slice")[i].as_py()] * size, pa.string()), pa.array(range(size), pa.int32()), row["ids"],
                     *[row[c] for c in figures], pa.array(by_text(top), pa.int64()), pa.array(by_text(value), pa.int64()),
                     pa.array(rare, pa.list_(pa.int64()))],
                    ["slice", "place", "id", *figures, "n_best", "count_sum", "rare"])

    identity = parts.schema["ids"].dataType.elementType
    schema = StructType([*StructType.fromDDL("slice STRING, place INT").fields, StructField("id", identity), *StructType.fromDDL(
        "n_a LONG, n_b LONG, n_groups LONG, n_links LONG, groups_sha256 STRING, n_best LONG, count_sum LONG, rare ARRAY<LONG>").fields])
    return parts.select("slice", "ids", *figures, "pairs", "places").mapInArrow(run, schema)


def align_tokens(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, model: bytes, identity: str = "doc_id", text: str = "text",
    head: int = HEAD,
) -> DataFrame:
    """(identity, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`.

    A encodes a space and the text by `ranks`, each match of `pattern` by itself; B encodes the text by the piece model
    `model`, which adds a space and whose pieces have spaces at their beginning only. n_best counts links whose id pair
    is as frequent as any of its B id, count_sum adds up the corpus counts of the pairs of all links.

    Texts that are null or empty, or whose bytes one of the tokenizers does not give back, have zeros and no digest, and
    their tokens count nowhere. Repeated rows and ids each count and each give a row, null ids too. An empty table gives
    no rows; other columns are not read. This runs jobs at once and writes its steps to the shared folder.
    """
    rows = docs.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    with few_rows_at_once(spark):
        parts = stage(_slices(rows, ranks, pattern, model), wide=True)
        counts = stage(pair_counts(parts))
    most = counts.orderBy(F.desc("n")).limit(head + 1).agg(F.count("*").alias("rows"), F.min("n").alias("least")).first()
    floor = most["least"] if most["rows"] > head else 0
    head_rows = counts.filter(F.col("n") > floor).toArrow()
    with few_rows_at_once(spark):
        scored = stage(_scored(parts, head_rows))
    unstage(parts)
    figures = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    if not floor:
        return scored.select(F.col("id").alias(identity), *figures)
    rare = (
        scored.select("slice", "place", F.explode("rare").alias("pair"))
        .join(counts.filter(F.col("n") <= floor), "pair")
        .groupBy("slice", "place").agg(F.sum("n").alias("more"), F.sum(F.col("best").cast("long")).alias("more_best"))
    )
    return scored.join(rare, ["slice", "place"], "left").withColumn(
        "n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn(
        "count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0))).select(F.col("id").alias(identity), *figures)
