import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfspark.sources.discovery import discover_input, extract_hosts, latest_release, newest_input
from shelfspark.sources.lines import slice_in_order, window_lines
from shelfspark.sources.meta import meta_current, meta_delete, meta_get, meta_put, meta_read
from checks.feeds import pack_seekable
from shelfspark.sources.seekable import (
    lines_of_range, read_frames, read_seekable_jsonl, split_frames,
)
from shelfspark.sources.storage import read_snapshot, snapshot_versions, write_snapshot


class Held:
    """A file in memory with the calls the reader uses."""

    def __init__(self, data):
        import io

        self.file = io.BytesIO(data)

    def __getattr__(self, name):
        return getattr(self.file, name)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.text("abé\n", max_size=12), min_size=1, max_size=8), st.integers(1, 30), st.booleans()
)
def test_any_split_reads_the_same_lines(texts, split_bytes, checksum):
    whole = "".join(texts).encode()
    # Frames cut anywhere, also inside a character.
    pieces = [whole[i : i + 5] for i in range(0, len(whole), 5)] or [b""]
    data = pack_seekable(pieces, checksum)
    frames = read_frames(Held(data), len(data))
    assert sum(f.text_size for f in frames) == len(whole)

    def read_text(frame):
        return whole[frame.text_offset : frame.text_offset + frame.text_size]

    got = [
        line for r in split_frames("f", frames, split_bytes)
        for line in lines_of_range(read_text, frames, r.first, r.last)
    ]
    expected, at = [], 0
    for line in whole.split(b"\n"):
        expected.append((at, line))
        at += len(line) + 1
    if expected[-1][1] == b"":
        expected.pop()
    assert got == expected


def write_lines(folder, name, frames):
    path = folder / name
    path.write_bytes(pack_seekable(frames))
    return str(path)


def test_read_seekable(spark, tmp_path):
    text = "".join(f'{{"n": {i}, "t": "é{i}"}}\n' for i in range(500)).encode()
    path = write_lines(tmp_path, "a.jsonl.zst", [text[i : i + 333] for i in range(0, len(text), 333)])
    for split in (1, 1000, 10**9):
        got = read_seekable_jsonl(spark, path, split).orderBy("pos").collect()
        assert [r.value for r in got] == text.decode().splitlines()
    assert read_seekable_jsonl(spark, path, 1000).rdd.getNumPartitions() > 5


def test_not_seekable(spark, tmp_path):
    path = tmp_path / "a.zst"
    path.write_bytes(b"x" * 50)
    with pytest.raises(Exception, match="not a seekable zstd file"):
        read_seekable_jsonl(spark, str(path)).collect()


@pytest.mark.parametrize("skip,limit", [(0, None), (0, 0), (0, 7), (3, 4), (95, 10), (17, None), (200, 5), (10, 20)])
def test_slice_in_order(spark, skip, limit):
    rows = [(f"f{i % 3}", i * 10) for i in range(100)]
    df = spark.createDataFrame(rows, "file STRING, pos LONG")
    got = sorted((r.file, r.pos) for r in slice_in_order(df, ["file"], "pos", skip, limit, span=50).collect())
    end = None if limit is None else skip + limit
    assert got == sorted(rows)[skip:end]


def test_window_lines_skips_blank(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(["a", " ", "b", " ", "c", "d"])],
                               "file STRING, pos LONG, value STRING")
    assert [r.value for r in window_lines(df, 1, 2).orderBy("pos").collect()] == ["b", "c"]


def test_discovery(spark, tmp_path):
    for name in ["x_records_1.zst", "x_records_2.zst", "x_records_2.zst.aria2", "y_records.txt"]:
        (tmp_path / name).write_bytes(b"1")
    assert discover_input(spark, str(tmp_path), "x_records").endswith("x_records_1.zst")
    assert newest_input(spark, str(tmp_path)) is not None
    (tmp_path / "x_records_3.zst").write_bytes(b"1")
    with pytest.raises(FileNotFoundError, match="several"):
        discover_input(spark, str(tmp_path), "x_records")
    with pytest.raises(FileNotFoundError, match="none"):
        discover_input(spark, str(tmp_path), "y_records")


def test_latest_release(spark):
    df = spark.createDataFrame(
        [("a_records_1", 2 * 1024**3, False), ("a_records_2", 3 * 1024**3 // 2, False), ("a_records_3", 1, True),
         ("b_records_1", 1024**3, False)], "display_name STRING, data_size LONG, obsolete BOOLEAN")
    got = latest_release(df, ["a_records", "b_records", "c_records"]).orderBy("source").collect()
    assert [tuple(r) for r in got] == [("a_records", "a_records_2", 1.5), ("b_records", "b_records_1", 1.0)]


def test_extract_hosts(spark):
    df = spark.createDataFrame([(1, "http://m.aa http://m.bb http://m.aa"), (2, "none")], "page_id LONG, html STRING")
    got = extract_hosts(df, r"https?://m\.(\w+)").orderBy("page_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "http://m.aa"), (1, 1, "http://m.bb")]


def test_meta(spark, tmp_path):
    path = f"{tmp_path}/notes"
    assert meta_get(meta_read(spark, path), "a") is None
    meta_put(spark, path, {"a": "1", "b": "2"})
    meta_put(spark, path, {"a": "3"})
    meta_delete(spark, path, ["b"])
    notes = meta_read(spark, path)
    assert [tuple(r) for r in meta_current(notes).collect()] == [("a", "3")]
    assert meta_get(notes, "a") == "3"


def test_snapshots(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert read_snapshot(spark, root, "id LONG").count() == 0
    assert write_snapshot(spark.range(3), root) == 0
    assert write_snapshot(spark.range(5), root) == 1
    (tmp_path / "t" / "version=000000000002").mkdir()
    assert snapshot_versions(spark, root) == [0, 1]
    assert read_snapshot(spark, root).count() == 5
    assert read_snapshot(spark, root, before=1).count() == 3
    write_snapshot(spark.range(7), root, 1)
    assert read_snapshot(spark, root).agg(F.max("id")).first()[0] == 6


def test_discover_a_feed_in_parts(spark, tmp_path):
    parts = tmp_path / "a__x_records__1"
    parts.mkdir()
    for n in (0, 1):
        (parts / f"part-{n}.jsonl.zst").write_bytes(pack_seekable([f"line {n}\n".encode()]))
        os.utime(parts / f"part-{n}.jsonl.zst", (1000 + n, 1000 + n))
    (tmp_path / "y_records.zst").write_bytes(b"")
    os.utime(tmp_path / "y_records.zst", (10, 10))
    found = discover_input(spark, str(tmp_path), "x_records")
    assert sorted(r.value for r in read_seekable_jsonl(spark, found).collect()) == ["line 0", "line 1"]
    assert newest_input(spark, str(tmp_path)).timestamp() == 1001
    (parts / "part-1.jsonl.zst.aria2").write_bytes(b"")
    with pytest.raises(FileNotFoundError, match="none"):
        discover_input(spark, str(tmp_path), "x_records")
