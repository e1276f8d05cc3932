import pytest
from llm_samples import empty, messy, prose, rows_of

from shelfspark.llm import decontaminate
from shelfspark.llm.decontaminate import drop_contaminated, find_leaks

QUESTION = (
    "If Alice has 12 apples and buys 7 kg of pears at the market on her way home, then how many pieces of fruit "
    "does Alice carry when she gives 12 apples to Bruno and keeps the rest of them for herself?"
)
OTHER = prose(77, 35)
ITEMS = [(1, QUESTION), (2, OTHER), (3, "whale lantern harbour rather often"), (4, None), (5, ""), (6, "two words"), (7, "3 4 5 6 7 8 9 1 2 3")]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id LONG, text STRING")


def leaks(spark, benchmark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    return {(r.doc_id, r.item_id): r for r in find_leaks(docs, benchmark).collect()}


def test_verbatim_and_reparameterised(spark, benchmark):
    changed = QUESTION.replace("12", "31").replace("Alice", "Zoe").replace("7 kg", "900 lb").replace("Bruno", "Carl")
    mixed = QUESTION.replace("12 apples and", "31 apples and").replace("Alice carry", "Zoe carry")
    found = leaks(spark, benchmark, [
        "Some words before. " + QUESTION + " And after.", "Begin here. " + changed, prose(5, 300),
        prose(6, 200) + " " + OTHER + " " + prose(8, 200), OTHER.upper(), QUESTION.replace(",", "").replace(" ", "\n")])
    assert set(found) == {(0, 1), (1, 1), (3, 2), (4, 2), (5, 1)} or set(found) == {(0, 1), (1, 1), (3, 2), (5, 1)}
    assert found[0, 1].kind == "exact" and found[1, 1].kind == "reparameterised"
    consistent, broken = (leaks(spark, benchmark, ["Now. " + t])[0, 1] for t in (changed, mixed))
    assert consistent.n_windows > broken.n_windows and broken.kind == "exact"
    assert leaks(spark, benchmark, ["Now. " + mixed + " Then. " + QUESTION])[0, 1].kind == "exact"
    two = leaks(spark, benchmark, ["Now. " + changed + " Then. " + changed.replace("31", "56")])
    assert two[0, 1].kind == "reparameterised"


def test_inconsistent_slots_do_not_count(spark):
    item = "Start with 5 red balls then add 5 blue balls then take 5 green balls then give 5 pink balls away"
    benchmark = spark.createDataFrame([(1, item)], "item_id LONG, text STRING")
    steady = item.replace("5", "8")
    other = item
    for n in (8, 3, 9, 4):
        other = other.replace(" 5 ", f" {n} ", 1)
    assert set(leaks(spark, benchmark, [steady])) == {(0, 1)}
    assert leaks(spark, benchmark, [other]) == {}


def test_half_an_item_and_less(spark, benchmark):
    own = OTHER.split()
    found = leaks(spark, benchmark, [" ".join(own[:24]), " ".join(own[:12]), " ".join(own[10:34]) + " tail"])
    assert set(found) == {(0, 2), (2, 2)}


def test_short_items(spark, benchmark):
    found = leaks(spark, benchmark, [
        "before Whale lantern, harbour rather often after", "two words", "the two words here", "whale lantern harbour"])
    assert (1, 6) in found and (2, 6) not in found and (3, 3) not in found


def test_broadcast_and_shuffled_joins_agree(spark, benchmark, monkeypatch):
    docs = messy(spark, [QUESTION, "So. " + QUESTION, OTHER])
    columns = ("doc_id", "item_id", "n_windows", "coverage", "kind")
    broadcast = rows_of(find_leaks(docs, benchmark), *columns)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert rows_of(find_leaks(docs, benchmark), *columns) == broadcast and broadcast


def test_edges(spark, benchmark):
    docs = messy(spark, [QUESTION])
    rows = [*docs.select("doc_id", "text").collect()]
    again = docs.unionByName(docs)
    assert rows_of(find_leaks(docs, benchmark), "doc_id", "item_id") == rows_of(find_leaks(again, benchmark), "doc_id", "item_id")
    named = spark.createDataFrame([(None, QUESTION), (None, QUESTION), (9, OTHER), (9, "x")], "doc_id LONG, text STRING")
    twice = benchmark.unionByName(benchmark)
    assert rows_of(find_leaks(named, twice), "doc_id", "item_id") == [(9, 2), (None, 1)]
    assert rows_of(find_leaks(empty(spark), benchmark), "doc_id") == []
    assert rows_of(find_leaks(docs, benchmark.limit(0)), "doc_id") == []
    kept = drop_contaminated(docs, benchmark)
    assert kept.schema == docs.schema
    assert rows_of(kept, "doc_id", "text") == sorted(((r.doc_id, r.text) for r in rows if r.text != QUESTION), key=repr)


def test_planted_items_of_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    texts, wanted = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}, set()
    for r in items.collect():
        wanted |= {(i, r.item_id) for i, t in texts.items() if " ".join(r.text.split()) in t}
    assert wanted <= found and wanted
    halves = {(i, r.item_id) for r in items.collect() for i, t in texts.items()
              if any(" ".join(r.text.split()[k : k + 8]) in t for k in range(1, 40, 4) if len(r.text.split()) >= k + 8)}
    assert found <= halves


def test_copies_in_other_case_or_without_punctuation(spark, benchmark):
    bare = "".join(c for c in QUESTION if c.isalnum() or c == " ")
    found = leaks(spark, benchmark, [
        OTHER.upper(), OTHER.title(), QUESTION.upper(), QUESTION.title(), bare.title(), "Heading " + bare.lower(), prose(5, 300).upper()])
    assert set(found) == {(0, 2), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1)}


def test_every_item_is_found_where_it_stands_verbatim(spark):
    items = [
        "3 4 5 6 7 8 9 1 2 3", "Anna Berg, Carl Dahl, Eva Falk, Gustav Holm, Ida Jansson", "whale lantern harbour rather often",
        "What is the capital of Norway", "北京是中华人民共和国的首都，位于华北平原。", "กรุงเทพมหานครเป็นเมืองหลวง", "春夏秋冬",
        "東京は日本の首都です", "12 + 30 = 42", "see – 3 kg of it",
    ]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id LONG, text STRING")
    texts = [f"{a}{t}{b}" for t in items for a, b in (("Question: ", " after"), ("before\n", "\nafter"))]
    texts += [f"他说{t}了" for t in items[4:8]]
    found = leaks(spark, benchmark, texts)
    assert set(found) == {(i, i // 2) for i in range(20)} | {(20 + i, 4 + i) for i in range(4)}
    assert leaks(spark, benchmark, ["9 4 1 5 7 2 8 1 2 6", "Olle Ek, Per Gran, Rut Hed, Sven Is, Tor Jord", "我们在上海住了很多年，冬天很冷。"]) == {}


def test_templates_that_cover_part_of_an_item_still_count(spark):
    item = "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 then count how many whales sail past the old harbour"
    benchmark = spark.createDataFrame([(1, item)], "item_id LONG, text STRING")
    found = leaks(spark, benchmark, ["7 7 " + item[item.index("then") :]])
    assert found[0, 1].coverage >= 0.5 and found[0, 1].kind == "reparameterised"
