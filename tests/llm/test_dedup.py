"""Substring, suffix and near-duplicate removal against brute force, with hot groups, nulls, ties and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runscope.llm import blocks, neardup, repeats, suffixes
from tests.llm import brute

VOCABULARY = [f"w{i}" for i in range(30)] + ["É", "漢字", "A,", "the"]


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    make = lambda k: " ".join(rng.choice(VOCABULARY) for _ in range(k))
    passage, base = make(40), make(80)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = base
        elif kind == 1:
            found = base.split(" ")
            for _ in range(rng.randint(1, 5)):
                found[rng.randrange(len(found))] = f"x{rng.randrange(999)}"
            text = " ".join(found)
        elif kind == 2:
            text = make(10) + "\n" + passage + " " + make(15)
        elif kind == 3:
            text = "ab " * rng.randint(1, 120)
        else:
            text = make(rng.randint(0, 60))
        rows.append((1000 - 7 * i, text))
    return rows + [(5, None), (6, ""), (7, " \t"), (8, "one"), (9, "ONE"), (10, "漢" * 400), (11, "é" + "漢" * 300)]


@pytest.mark.parametrize("width", [13, 20])
def test_substring_dedup(spark, docs, width):
    rows = corpus()
    found = repeats.substring_dedup(docs(rows), width).withColumn("kept", F.sha2("kept", 256))
    assert sorted(map(tuple, found.collect())) == sorted(brute.later_windows(rows, width))


def test_substring_dedup_of_repeated_rows(spark, docs):
    text = " ".join(map(str, range(30)))
    found = repeats.substring_dedup(docs([(None, text), (1, text), (1, text), (2, "a b")])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in found) == [("1", 30), ("1", 30), ("2", 0), ("None", 0)]


def test_without_repeats_keeps_columns(spark, docs):
    text = " ".join(map(str, range(30)))
    table = docs([(1, text), (2, text), (3, "so  it\tis " + text), (4, None), (5, "")])
    found = {r["doc_id"]: r for r in repeats.without_repeats(table).collect()}
    assert set(found) == {1, 3, 4, 5} and found[3]["text"] == "so it is" and found[1]["text"] == text
    assert found[4]["text"] is None and found[5]["text"] == "" and found[3].asDict().keys() == set(table.columns)
    assert found[3]["answer"] == 2 and found[3]["block"] == "b2"


def test_a_cover_meets_every_offset():
    for a in range(repeats.PERIOD):
        for b in range(repeats.PERIOD):
            assert any({(a + d) % repeats.PERIOD, (b + d) % repeats.PERIOD} <= set(repeats.COVER) for d in range(repeats.PERIOD))


@pytest.mark.parametrize("crowd", [20_000, 2])
@pytest.mark.parametrize("stretch", [1, 1 << 17])
def test_suffix_dedup(spark, docs, crowd, stretch):
    rows = corpus(1)
    found = suffixes.suffix_dedup(docs(rows), 60, stretch, crowd).withColumn("kept", F.sha2("kept", 256)).drop("spans")
    assert sorted(map(tuple, found.collect())) == sorted(brute.repeated_strings(rows, 60))


@pytest.mark.parametrize("width", [20, 60])
def test_pieces_do_not_depend_on_stretches(width):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 10, 300, 5000]))) + "ab" * 90 for _ in range(30)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    block = blocks.Block(0, None, np.cumsum([0, *map(len, texts)]), data, np.zeros(len(texts), bool))
    whole = suffixes.Pieces(block, width, 2**20)
    for stretch in (1, 777, 4096):
        cut = suffixes.Pieces(block, width, stretch)
        for name in ("low", "high", "anchor", "which", "asked"):
            assert (getattr(whole, name) == getattr(cut, name)).all()


def test_suffix_dedup_of_a_text_beyond_the_bits_of_a_place(spark, docs):
    rng = np.random.default_rng(4)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    shared = "AB" * 100
    long = letters(2**24 - 100) + shared + letters(3_000_000)
    found = {r["doc_id"]: r for r in suffixes.suffix_dedup(docs([(1, long), (2, letters(500) + shared + letters(300))])).collect()}
    assert found[1]["n_removed"] == found[2]["n_removed"] == 200
    assert found[1]["spans"] == [2**24 - 100, 2**24 + 100] and found[2]["spans"] == [500, 700]


def test_suffix_spans(spark, docs):
    text = "x" * 10 + "".join(map(chr, range(0x4E00, 0x4E00 + 80)))
    found = {r["doc_id"]: r for r in suffixes.suffix_dedup(docs([(1, text), (2, "y" * 7 + text[5:])])).collect()}
    assert found[1]["spans"] == [5, 250] and found[2]["spans"] == [7, 252] and bytes(found[1]["kept"]) == b"x" * 5


@pytest.mark.parametrize("common", [100, 3])
@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, docs, own_area, common, size, monkeypatch):
    monkeypatch.setattr(neardup, "COMMON", common)
    rows = corpus(2, 90)
    found, _ = neardup.near_duplicates(docs(rows), own_area, size, 80)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect())
    assert got == sorted(brute.components(rows, size, 80))


def test_sets_and_lists_meet_answers_without_a_copy(spark, docs, own_area, monkeypatch):
    """Before, every join on ``block`` wrote all sets, lists or blocks once more, as shuffle files."""
    monkeypatch.setitem(own_area.__dict__, "drop", lambda table: None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = neardup.NearDuplicates(docs(corpus(2, 90)), own_area, 4, 80, again=True)
        found.components()
        for table in (found.blocks, found.sets, found.lists):
            answers = spark.range(9).selectExpr("id % 3 AS block", "id").groupBy("block").agg(F.collect_list("id").alias("answer"))
            plan = blocks.beside(table, answers, "left")._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_of_each_group(spark, docs):
    text = " ".join(map(str, range(60)))
    table = docs([(4, text), (2, text), (2, text), (None, None), (9, ""), (7, "other"), (8, text.replace("31", "x"))])
    found = neardup.one_of_each_group(table).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["2", "7", "9", "None"]
    assert found[0].asDict().keys() == set(table.columns)


def test_possible_never_loses_close_pairs():
    rng = np.random.default_rng(0)
    for n in (5, 30, 400):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], rng.integers(0, 2**63, len(a) // 10).astype(np.uint64)]))
        both = neardup.Sets(0, np.arange(2), np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b])).sketches()
        assert neardup.possible(both[:1], both[1:])[0]


def test_leader_runs_cover_sizes():
    keys = np.array([1, 1, 1, 2, 3, 3], np.uint64)
    pairs = {(int(i), int(j)) for x, y in neardup.list_pairs(keys) for i, j in zip(x, y)}
    assert pairs == {(0, 1), (0, 2), (1, 2), (4, 5)}


def test_empty_tables(spark, docs, own_area):
    empty = docs([(1, "x")]).where("doc_id < 0")
    assert repeats.substring_dedup(empty).count() == 0 and repeats.without_repeats(empty).count() == 0
    assert suffixes.suffix_dedup(empty).count() == 0
    assert neardup.near_duplicates(empty, own_area)[0].count() == 0 and neardup.one_of_each_group(empty).count() == 0


def test_blocks_give_back_rows(spark, docs, own_area, monkeypatch):
    rows = corpus(3)
    table = docs(rows)
    packed = blocks.pack(table, own_area)
    names = table.columns

    def back(batches):
        for block, _ in blocks.unpack(batches):
            yield block.rows(names, [block.text(i) for i in range(len(block))])

    assert sorted(packed.mapInArrow(back, table.schema).collect(), key=str) == sorted(table.collect(), key=str)
