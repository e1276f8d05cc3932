"""Splittable reader for line files stored as seekable zstd: independent frames plus a seek table."""

import struct
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from shelfspark.sources.storage import as_uri

# Fixed values of the seekable format.
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
CHECKSUM_FLAG = 0x80

SPLIT_BYTES = 64 * 1024 * 1024
BATCH_LINES = 4_096
#: Frames that one task of a stream reads.
TASK_FRAMES = 8


@dataclass(frozen=True)
class Frame:
    offset: int
    size: int
    text_offset: int
    text_size: int


@dataclass
class FrameRange(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class StampedRange(FrameRange):
    modified: int


def read_footer(handle, size: int) -> tuple[int, int]:
    """Number of frames and descriptor of the seek table, from the last bytes of a file."""
    if size < FOOTER.size:
        raise ValueError("not a seekable zstd file (too short)")
    handle.seek(size - FOOTER.size)
    count, descriptor, magic = FOOTER.unpack(handle.read(FOOTER.size))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable zstd file (bad footer magic)")
    return count, descriptor


def read_frames(handle, size: int) -> list[Frame]:
    """Frames listed by the seek table at the end of a file."""
    count, descriptor = read_footer(handle, size)
    entry = struct.Struct("<III" if descriptor & CHECKSUM_FLAG else "<II")
    handle.seek(size - FOOTER.size - count * entry.size)
    frames, offset, text_offset = [], 0, 0
    for fields in entry.iter_unpack(handle.read(count * entry.size)):
        frames.append(Frame(offset, fields[0], text_offset, fields[1]))
        offset += fields[0]
        text_offset += fields[1]
    return frames


def split_frames(path: str, frames: list[Frame], split_bytes: int) -> list[FrameRange]:
    """Runs of frames of about `split_bytes` of text each."""
    ranges, first, held = [], 0, 0
    for i, frame in enumerate(frames):
        held += frame.text_size
        if held >= split_bytes:
            ranges.append(FrameRange(path, first, i + 1))
            first, held = i + 1, 0
    if first < len(frames):
        ranges.append(FrameRange(path, first, len(frames)))
    return ranges


def lines_of_range(read_text, frames: list[Frame], first: int, last: int):
    """(position, line) of every line that belongs to frames first … last-1.

    A line belongs to the range in which it starts. A line that starts exactly on the border goes to
    the earlier range: the later one always drops what precedes its first newline.
    """
    pos = frames[first].text_offset
    end = frames[last - 1].text_offset + frames[last - 1].text_size
    skipping = first > 0
    rest = b""
    for i in range(first, len(frames)):
        rest += read_text(frames[i])
        start = 0
        while (cut := rest.find(b"\n", start)) >= 0:
            if skipping:
                skipping = False
            elif pos + start > end:
                return
            else:
                yield pos + start, rest[start:cut]
            start = cut + 1
        rest, pos = rest[start:], pos + start
        # What is left starts in this range only if it starts no later than its end.
        if i + 1 >= last and (skipping or pos > end):
            return
    if rest and not skipping and pos <= end:
        yield pos, rest


class SeekableLinesReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        filesystem, path = fs.FileSystem.from_uri(self.path)
        if filesystem.get_file_info(path).type != fs.FileType.Directory:
            return filesystem, [path]
        inside = filesystem.get_file_info(fs.FileSelector(path))
        return filesystem, sorted(f.path for f in inside if f.path.endswith(".zst"))

    def partitions(self):
        filesystem, paths = self._files()
        ranges = []
        for path in paths:
            with filesystem.open_input_file(path) as handle:
                ranges += split_frames(path, read_frames(handle, handle.size()), self.split_bytes)
        return ranges

    def read(self, partition: FrameRange):
        codec = pa.Codec("zstd")
        schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("value", pa.string())])
        filesystem, _ = fs.FileSystem.from_uri(self.path)
        with filesystem.open_input_file(partition.path) as handle:
            frames = read_frames(handle, handle.size())

            def read_text(frame: Frame) -> bytes:
                handle.seek(frame.offset)
                return codec.decompress(handle.read(frame.size), frame.text_size, asbytes=True)

            positions, values = [], []

            def batch():
                files = pa.array([partition.path] * len(values), pa.string())
                return pa.RecordBatch.from_arrays([files, pa.array(positions), pa.array(values)], schema=schema)

            for pos, line in lines_of_range(read_text, frames, partition.first, partition.last):
                positions.append(pos)
                values.append(line.decode("utf-8", "replace"))
                if len(values) == BATCH_LINES:
                    yield batch()
                    positions, values = [], []
            if values:
                yield batch()


class SeekableLines(DataSource):
    """`spark.read.format("seekable_lines").load(uri)`: rows (file, pos, value), ordered by (file, pos)."""

    @classmethod
    def name(cls):
        return "seekable_lines"

    def schema(self):
        return "file STRING, pos LONG, value STRING"

    def reader(self, schema):
        return SeekableLinesReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


class FrameStreamReader(DataSourceStreamReader):
    """Offsets are (modified, file, frame): all frames before that place, in this order, have been read.

    The driver reads the last bytes of files that are new, for their number of frames; seek tables and text are read
    by tasks. Spark gives the offset it goes on from to `partitions` first, also after a restart.
    """

    def __init__(self, path: str, max_frames: int | None):
        self.path, self.max_frames, self.at = path, max_frames, None

    def _ahead(self, at: dict):
        """(modified, file, first frame not read, number of frames) of the files from an offset on."""
        filesystem, path = fs.FileSystem.from_uri(self.path)
        inside = filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True))
        place = (at["modified"], at["file"])
        for modified, file in sorted((f.mtime_ns or 0, f.path) for f in inside if f.path.endswith(".zst")):
            if (modified, file) >= place:
                with filesystem.open_input_file(file) as handle:
                    count, _ = read_footer(handle, handle.size())
                yield modified, file, at["frame"] if (modified, file) == place else 0, count

    def initialOffset(self):
        return {"modified": -1, "file": "", "frame": 0}

    def latestOffset(self):
        at = self.at or self.initialOffset()
        left = self.max_frames
        for modified, file, first, count in self._ahead(at):
            last = count if left is None else min(count, first + left)
            at = {"modified": modified, "file": file, "frame": last}
            if left is not None:
                left -= last - first
                if left == 0:
                    break
        return at

    def partitions(self, start: dict, end: dict):
        self.at, ranges, stop = end, [], (end["modified"], end["file"])
        for modified, file, first, count in self._ahead(start) if start != end else ():
            if (modified, file) > stop:
                break
            last = end["frame"] if (modified, file) == stop else count
            ranges += [
                StampedRange(file, i, min(i + TASK_FRAMES, last), modified) for i in range(first, last, TASK_FRAMES)]
        return ranges

    def read(self, partition: StampedRange):
        for batch in SeekableLinesReader(self.path, SPLIT_BYTES).read(partition):
            yield batch.add_column(0, "modified", pa.array([partition.modified] * batch.num_rows, pa.int64()))


class SeekableFrames(DataSource):
    """`spark.readStream.format("seekable_frames").load(uri)`: rows (modified, file, pos, value) in that order."""

    @classmethod
    def name(cls):
        return "seekable_frames"

    def schema(self):
        return "modified LONG, file STRING, pos LONG, value STRING"

    def streamReader(self, schema):
        limit = self.options.get("max_frames")
        return FrameStreamReader(self.options["path"], None if limit is None else int(limit))


def read_frame_stream(spark: SparkSession, folder: str, max_frames: int | None = None) -> DataFrame:
    """Lines of the seekable zstd files that appear in a folder, with columns (modified, file, block) for their order.

    A batch holds at most `max_frames` frames and may end inside a file; a restarted query goes on at the next frame.
    A file has to be complete when it appears, and must not be older than those already read.
    """
    spark.dataSource.register(SeekableFrames)
    reader = spark.readStream.format("seekable_frames")
    if max_frames is not None:
        reader = reader.option("max_frames", str(max_frames))
    return reader.load(as_uri(folder)).withColumnRenamed("pos", "block")


def read_seekable_jsonl(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of a seekable zstd file, or of all in a folder, one task per run of frames.

    `pos` is the offset of the line in its file's text.
    """
    spark.dataSource.register(SeekableLines)
    return spark.read.format("seekable_lines").option("split_bytes", str(split_bytes)).load(as_uri(path))
