"""Seekable zstd feeds for checks and tests, written by Spark tasks or held in memory."""

import struct

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shelfspark.sources.seekable import CHECKSUM_FLAG, FOOTER, SEEKABLE_MAGIC
from shelfspark.sources.storage import as_uri

# Fixed value: magic number of a zstd frame that decoders skip.
SKIPPABLE_MAGIC = 0x184D2A5E
FRAME_BYTES = 50_000


def seek_table(sizes: list[tuple[int, int]], checksum: bool = False) -> bytes:
    entries = b"".join(struct.pack("<II", a, b) + (b"\0" * 4 if checksum else b"") for a, b in sizes)
    table = entries + FOOTER.pack(len(sizes), CHECKSUM_FLAG if checksum else 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def pack_seekable(pieces: list[bytes], checksum: bool = False) -> bytes:
    """A small seekable file in memory, one frame per piece of text."""
    packed = [pa.Codec("zstd").compress(p, asbytes=True) for p in pieces]
    return b"".join(packed) + seek_table([(len(a), len(b)) for a, b in zip(packed, pieces)], checksum)


def write_seekable(lines: DataFrame, folder: str, prefix: str = "part") -> int:
    """Write one seekable file per partition of `lines` (value); returns the number of files.

    Frames are cut by size wherever that falls, so lines straddle them.
    """
    uri = as_uri(folder)

    def write(batches):
        filesystem, root = fs.FileSystem.from_uri(uri)
        filesystem.create_dir(root)
        name = f"{root}/{prefix}-{TaskContext.get().partitionId():05d}.jsonl.zst"
        codec, sizes, held = pa.Codec("zstd"), [], b""
        with filesystem.open_output_stream(name, compression=None) as out:
            def frame(text: bytes) -> None:
                packed = codec.compress(text, asbytes=True)
                sizes.append((len(packed), len(text)))
                out.write(packed)

            for batch in batches:
                for value in batch.column(0).to_pylist():
                    held += value.encode() + b"\n"
                    while len(held) >= FRAME_BYTES:
                        frame(held[:FRAME_BYTES])
                        held = held[FRAME_BYTES:]
            if held:
                frame(held)
            out.write(seek_table(sizes))
        yield pa.RecordBatch.from_pydict({"name": [name]})

    return lines.select("value").mapInArrow(write, "name STRING").count()
