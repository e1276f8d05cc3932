import json
import os

import pytest
from pyspark.sql import functions as F

from shelfspark.operators.embedding import HashingEmbedder
from shelfspark.operators.fulltext import build_index, read_index
from shelfspark.operators.parse import parse_items
from shelfspark.plans.ingest import run_ingest
from shelfspark.schemas import ITEM_FIELDS, ITEM_VALUES, ITEMS, VECTORS
from shelfspark.sources.meta import meta_current, meta_read
from checks.feeds import pack_seekable
from shelfspark.sources.storage import read_snapshot
from shelfspark.streaming.ingest import ingest_frames, stream_ingest


def item_line(n, title=None):
    return json.dumps({"metadata": {"zlibrary_id": n, "title": title or f"Title {n}"}})


def rating_line(n, title=None):
    xml = f"<book><title>{title or f'Work {n}'}</title><average_rating>3.5</average_rating></book>"
    return json.dumps({"metadata": {"id": n, "record": xml}})


def feed(folder, name, lines, at=None):
    text = "".join(line + "\n" for line in lines).encode()
    path = folder / name
    path.write_bytes(pack_seekable([text[i : i + 700] for i in range(0, len(text), 700)]))
    if at:
        os.utime(path, (at, at))


def test_run_ingest(spark, tmp_path):
    inputs, root = tmp_path / "in", f"{tmp_path}/out"
    inputs.mkdir()
    feed(inputs, "a__zlib3_records__1.jsonl.zst", [item_line(n) for n in range(1, 41)] + [item_line(3, "Newer 3"), item_line("")], 1000)
    feed(inputs, "a__goodreads_records__1.jsonl.zst", [rating_line(n) for n in range(1, 11)], 1000)
    embedder = HashingEmbedder(8)
    def index_is_fresh():
        fresh = build_index(read_snapshot(spark, f"{root}/items", ITEMS), ITEM_FIELDS, "simple")
        return sorted(read_index(spark, f"{root}/index/items").collect()) == sorted(fresh.collect())

    status = run_ingest(spark, str(inputs), root, embedder, text_config="simple").first()
    assert (status.items_count, status.ratings_count, status.embedded, status.error) == (40, 10, 10, None)
    assert index_is_fresh()
    assert (status.rejected, status.restored) == (1, 0)
    refused = spark.read.parquet(f"{root}/rejected/items").collect()
    assert [r.reason for r in refused] == ["no source_id"]
    items = read_snapshot(spark, f"{root}/items", ITEMS)
    assert sorted(r.id for r in items.collect()) == list(range(1, 41))
    assert items.filter("source_id = '3'").first().title == "Newer 3"

    again = run_ingest(spark, str(inputs), root, embedder).first()
    assert (again.items_count, again.ratings_count, again.embedded) == (None, None, 0)

    feed(inputs, "a__zlib3_records__1.jsonl.zst", [item_line(1), item_line(2, "Changed"), item_line(99)], 2000)
    feed(inputs, "a__goodreads_records__1.jsonl.zst", [rating_line(1), rating_line(2, "Changed")], 2000)
    status = run_ingest(spark, str(inputs), root, embedder, text_config="simple", vector_cache=f"{tmp_path}/cache").first()
    assert (status.items_count, status.ratings_count, status.embedded) == (41, 10, 1)
    assert index_is_fresh() and spark.read.json(f"{tmp_path}/cache").count() == 10
    after = {r.source_id: r for r in read_snapshot(spark, f"{root}/items", ITEMS).collect()}
    before = {r.source_id: r for r in items.collect()}
    assert after["99"].id == 41 and after["2"].title == "Changed" and after["2"].id == before["2"].id
    assert after["1"].updated_at == before["1"].updated_at < after["2"].updated_at
    assert read_snapshot(spark, f"{root}/vectors", VECTORS).filter("embedding IS NOT NULL").count() == 10
    notes = {r.key: r.value for r in meta_current(meta_read(spark, f"{root}/notes")).collect()}
    assert (notes["items_count"], notes["items_done"], notes["run_error"]) == ("41", "true", "")


def test_failed_run_leaves_the_tables_and_a_note(spark, tmp_path):
    inputs, root = tmp_path / "in", f"{tmp_path}/out"
    inputs.mkdir()
    feed(inputs, "zlib3_records.zst", [item_line(1), "x" * 2000])
    feed(inputs, "goodreads_records.zst", [rating_line(1)])
    with pytest.raises(Exception, match="invalid JSON"):
        run_ingest(spark, str(inputs), root)
    notes = {r.key: r.value for r in meta_current(meta_read(spark, f"{root}/notes")).collect()}
    assert 0 < len(notes["run_error"]) <= 501 and notes.get("items_done") is None
    assert read_snapshot(spark, f"{root}/items", ITEMS).count() == 0
    status = run_ingest(spark, str(inputs), root, mode="quarantine", limit=5).first()
    assert (status.items_count, status.ratings_count, status.rejected) == (1, 1, 1)
    assert spark.read.parquet(f"{root}/rejected/items").first().value == "x" * 2000


def test_vectors_are_restored_once(spark, tmp_path):
    from shelfspark.operators.embedding import export_vectors
    from shelfspark.plans.ingest import embed_table
    from shelfspark.sources.storage import write_snapshot

    root, cache, embedder = f"{tmp_path}/out", f"{tmp_path}/cache", HashingEmbedder(4)
    rows = spark.range(1, 5).selectExpr("id", "concat('Work ', id) AS title")
    for c in ["source_id", "author", "description", "genres", "isbn", "pages", "year"]:
        rows = rows.withColumn(c, F.lit(""))
    write_snapshot(rows, f"{root}/ratings")
    export_vectors(spark.createDataFrame([(1, [1.0] * 4), (2, [2.0] * 4), (9, [3.0] * 4)], "id LONG, embedding ARRAY<FLOAT>"), cache)
    assert embed_table(spark, root, embedder, cache, limit=1) == (1, 2)
    assert embed_table(spark, root, embedder, cache) == (1, 0)
    assert read_snapshot(spark, f"{root}/vectors", VECTORS).filter("id = 1").first().embedding == [1.0] * 4


def test_stream_ingest(spark, tmp_path):
    folder, table, check = tmp_path / "in", f"{tmp_path}/items", f"{tmp_path}/check"
    folder.mkdir()

    def add(name, lines, at):
        (folder / name).write_text("\n".join(lines) + "\n")
        os.utime(folder / name, (at, at))

    def run():
        query = stream_ingest(spark, str(folder), table, ITEMS, check, parse_items, ITEM_VALUES, max_files=1, rejected=f"{tmp_path}/no")
        query.awaitTermination()
        return {r.source_id: (r.id, r.title) for r in read_snapshot(spark, table, ITEMS).collect()}

    add("b.jsonl", [item_line(1, "first"), item_line(2), item_line(1, "second")], 1000)
    add("a.jsonl", [item_line(2, "later"), "broken", item_line(3)], 2000)
    got = run()
    assert {k: t for k, (_, t) in got.items()} == {"1": "second", "2": "later", "3": "Title 3"}
    assert sorted(i for i, _ in got.values()) == [1, 2, 3]
    assert run() == got
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/no").collect()] == ["broken"]
    add("c.jsonl", [item_line(4)], 3000)
    assert run()["4"] == (4, "Title 4")


def test_stream_into_a_table_that_has_versions(spark, tmp_path):
    from shelfspark.sources.storage import snapshot_versions, write_snapshot

    folder, table, check = tmp_path / "in", f"{tmp_path}/items", f"{tmp_path}/check"
    folder.mkdir()
    old = parse_items(spark.createDataFrame([(item_line(7, "old"),), (item_line(8),)], "value STRING")).selectExpr("*", "cast(source_id AS LONG) AS id")
    rows = spark.createDataFrame([], ITEMS).unionByName(old, allowMissingColumns=True)
    write_snapshot(rows.limit(1), table)
    write_snapshot(rows, table)

    def run():
        stream_ingest(spark, str(folder), table, ITEMS, check, parse_items, ITEM_VALUES, max_files=1).awaitTermination()
        return {r.source_id: r.title for r in read_snapshot(spark, table, ITEMS).collect()}

    (folder / "a.jsonl").write_text(item_line(7, "new") + "\n" + item_line(9) + "\n")
    assert run() == {"7": "new", "8": "Title 8", "9": "Title 9"}
    assert snapshot_versions(spark, table) == [0, 1, 2] and spark.read.parquet(f"{table}/version={0:012d}").count() == 1
    (folder / "b.jsonl").write_text(item_line(10) + "\n")
    assert "10" in run() and snapshot_versions(spark, table) == [0, 1, 2, 3]
    write_snapshot(rows, table)
    (folder / "c.jsonl").write_text(item_line(11) + "\n")
    with pytest.raises(Exception, match="written by somebody else"):
        run()
    assert read_snapshot(spark, table, ITEMS).count() == 2


def test_frames_restart_inside_a_file(spark, tmp_path):
    folder, table, check = tmp_path / "in", f"{tmp_path}/items", f"{tmp_path}/check"
    folder.mkdir()

    def add(name, lines, at):
        text = ("\n".join(lines) + "\n").encode()
        # Frames end anywhere inside lines.
        (folder / name).write_bytes(pack_seekable([text[i:i + 70] for i in range(0, len(text), 70)]))
        os.utime(folder / name, (at, at))
        return -(-len(text) // 70)

    def titles():
        return {r.source_id: r.title for r in read_snapshot(spark, table, ITEMS).collect()}

    def failing(lines, mode):
        if lines.filter(F.col("value").contains('"stop"')).limit(1).count():
            raise RuntimeError("stopped")
        return parse_items(lines, mode)

    n = add("b.zst", [item_line(1, "first"), item_line(2), item_line(1, "second")], 1000)
    n += add("a.zst", [item_line(2, "later"), "broken", item_line(3), item_line(4, "stop"), item_line(5)], 2000)
    with pytest.raises(Exception, match="stopped"):
        ingest_frames(spark, str(folder), table, ITEMS, check, failing, ITEM_VALUES, max_frames=2)
    before = titles()
    assert before["1"] == "second" and "5" not in before
    args = (spark, str(folder), table, ITEMS, check, parse_items, ITEM_VALUES, "quarantine", 2, f"{tmp_path}/no")
    again = ingest_frames(*args)
    assert 0 < again < -(-n // 2)
    assert titles() == {"1": "second", "2": "later", "3": "Title 3", "4": "stop", "5": "Title 5"}
    assert ingest_frames(*args) == 0
    add("0.zst", [item_line(6)], 3000)
    assert ingest_frames(*args) > 0 and titles()["6"] == "Title 6"


def test_frames_are_merged_as_they_fill(spark, tmp_path, monkeypatch):
    from shelfspark.sources.storage import snapshot_versions, write_snapshot
    from shelfspark.streaming import ingest

    folder, table, check = tmp_path / "in", f"{tmp_path}/items", f"{tmp_path}/check"
    folder.mkdir()
    text = "".join(item_line(i % 3, f"{i}-of-it") + "\n" for i in range(24)).encode()
    size = -(-len(text) // 12)
    (folder / "a.zst").write_bytes(pack_seekable([text[i:i + size] for i in range(0, len(text), size)]))
    args = (spark, str(folder), table, ITEMS, check, parse_items, ITEM_VALUES, "quarantine", 1)

    def rows():
        return sorted((r.source_id, r.id, r.title) for r in read_snapshot(spark, table, ITEMS).collect())

    # A run that is killed leaves its batches pending; the next one takes them up and reads none again.
    with monkeypatch.context() as killed:
        killed.setattr(ingest, "_fold", lambda *_: None)
        killed.setattr(ingest, "folder_bytes", lambda *_: 0)
        assert ingest_frames(*args) == 12
    assert not snapshot_versions(spark, table) and len(snapshot_versions(spark, f"{check}-pending")) == 12
    assert ingest_frames(*args) == 0
    last = [("0", 1, "21-of-it"), ("1", 2, "22-of-it"), ("2", 3, "23-of-it")]
    assert rows() == last and snapshot_versions(spark, f"{check}-pending") == []
    # Batches are merged once they take as much room as the table, not one by one.
    table, check = f"{tmp_path}/more", f"{tmp_path}/check-more"
    assert ingest_frames(spark, str(folder), table, ITEMS, check, parse_items, ITEM_VALUES, max_frames=1) == 12
    assert rows() == last and len(snapshot_versions(spark, table)) < 12
    write_snapshot(spark.createDataFrame([], ITEMS), table)
    (folder / "b.zst").write_bytes(pack_seekable([(item_line(9) + "\n").encode()]))
    with pytest.raises(Exception, match="written by somebody else"):
        ingest_frames(spark, str(folder), table, ITEMS, check, parse_items, ITEM_VALUES, max_frames=1)


@pytest.fixture
def own_work_folder(tmp_path, monkeypatch):
    from shelfspark.sources import storage

    (tmp_path / "work").mkdir()
    monkeypatch.setattr(storage, "work_dir", lambda spark: f"{tmp_path}/work")


def test_a_step_leaves_no_staged_tables(spark, tmp_path, own_work_folder):
    from shelfspark.sources.storage import CLEANUP, folder_names, read_snapshot, stage, step, work_dir, write_snapshot

    def staged():
        return {n for n in folder_names(spark, work_dir(spark)) if n.startswith("stage-")}

    kept, before = stage(spark.range(5)), spark.conf.get(CLEANUP)
    there = staged()
    with step(spark):
        inside = stage(spark.range(7))
        with step(spark):
            assert stage(spark.range(3)).count() == 3 and len(staged()) == len(there) + 2
        assert inside.count() == 7 and spark.conf.get(CLEANUP) == "true"
        write_snapshot(inside.union(kept), f"{tmp_path}/table")
    assert staged() == there and kept.count() == 5 and spark.conf.get(CLEANUP) == before
    assert read_snapshot(spark, f"{tmp_path}/table").count() == 12
    with pytest.raises(ValueError), step(spark):
        stage(spark.range(1))
        raise ValueError
    assert staged() == there


def test_an_ingest_run_leaves_no_staged_tables(spark, tmp_path, own_work_folder):
    from shelfspark.sources.storage import folder_names, work_dir

    lines = [json.dumps({"metadata": {"zlibrary_id": f"n{i}", "title": f"Salt {i}"}}) for i in range(4)]
    records = [json.dumps({"metadata": {"id": f"r{i}", "record": f"<book><title>Oar {i}</title></book>"}}) for i in range(3)]
    (tmp_path / "in").mkdir()
    for name, feed in (("a__zlib3_records__1", lines), ("a__goodreads_records__1", records)):
        (tmp_path / "in" / f"{name}.jsonl.seekable.zst").write_bytes(pack_seekable([("\n".join(feed) + "\n").encode()]))
    there = set(folder_names(spark, work_dir(spark)))
    status = run_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/tables", HashingEmbedder(4), text_config="simple").first()
    assert (status.items_count, status.ratings_count, status.embedded) == (4, 3, 3)
    assert set(folder_names(spark, work_dir(spark))) == there
