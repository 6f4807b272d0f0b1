"""Learned scores, fingerprints, mixing and decontamination: held-out accuracy, invariants and brute force."""

import math
import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from runscope.llm import blocks, decontaminate, fingerprints, language, lmscore, mixing, quality, queries, splits, toxicity
from runscope.llm.text import buffers
from runscope.plans.stage import ARROW_ROWS
from tests.llm import brute

ODD = [None, "", "  ", "!", "漢字", "a" * 30_000]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(4)
    english = "the of and to in that with for this from have not you are".split()
    german = "der die und in den von zu das mit sich auf für ist im".split()
    return [(i, prose(rng, german if i % 2 else english, rng.randint(5, 60))) for i in range(120)]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_remainder_is_crc32_of_the_id_as_text(spark):
    found = spark.createDataFrame([(7,), (123,), (None,)], "doc_id long").select("doc_id", splits.remainder(5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 for r in found)


def test_toxicity(spark, docs):
    rng, words = random.Random(1), [f"w{i}" for i in range(60)]
    rows = [(i, prose(rng, words + ["Idiot!", "scum"] * (3 * (i % 4 == 0)), 40)) for i in range(200)]
    table = docs(rows + [(900 + i, t) for i, t in enumerate(ODD)])
    known = [(i, None, int("Idiot" in t or "scum" in t)) for i, t in rows if i % 3] + [(1, None, None), (None, None, 1), (77777, None, 1)]
    model = toxicity.fit(table, labels_of(spark, known))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    truth = {i: "Idiot" in t or "scum" in t for i, t in rows}
    assert len(found) == 206 and all(0 <= s <= 1 for s in found.values())
    assert np.mean([(found[i] >= 0.5) == truth[i] for i in truth if i % 3 == 0]) > 0.95
    kept = toxicity.keep_ordinary(table, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in found.items() if s < 0.5} and kept.columns == table.columns


@pytest.mark.parametrize("known, score", [([], 0.0), ([(1, 0, 1)], 1.0), ([(1, 0, 0)], 0.0)])
def test_toxicity_of_one_class(spark, docs, known, score):
    table = docs([(1, "a b"), (2, None)])
    found = toxicity.score(table, toxicity.fit(table, labels_of(spark, known))).collect()
    assert [round(r["score"], 9) for r in found] == [score, score]


def test_discounted_chances_equal_brute_force(spark, docs):
    rng = random.Random(8)
    rows = [(i, prose(rng, [f"w{k}" for k in range(12 + i % 2 * 6)], rng.randint(0, 25))) for i in range(30)]
    pairs = [(i % 2, a, b) for i, t in rows for a, b in zip(["<s>", *t.split()], t.split())]
    cut = lambda counts: (sum(c == 1 for c in counts) + 0.5) / (sum(c == 1 for c in counts) + 2 * sum(c == 2 for c in counts) + 1)
    known = {w for _, a, b in pairs for w in (a, b)}
    follows = {(a, b) for _, a, b in pairs}

    def chances(label, before, word):
        own = {}
        for one, a, b in pairs:
            if one == label:
                own[a, b] = own.get((a, b), 0) + 1
        kinds = {w: sum(b == w for _, b in own) for w in known}
        # Every known word, the start among them, and one place for all unknown ones.
        shared = (sum(b == word for _, b in follows) + 0.5) / (len(follows) + 0.5 * (len(known) + 1))
        d, total = cut(list(kinds.values())), sum(kinds.values())
        lower = max(kinds.get(word, 0) - d, 0) / total + d * sum(k > 0 for k in kinds.values()) / total * shared
        after = {b: n for (a, b), n in own.items() if a == before}
        d, total = cut(list(own.values())), sum(after.values())
        return lower, (max(after.get(word, 0) - d, 0) + d * len(after) * lower) / total if total else lower

    table = docs(rows).withColumn("label", splits.F.expr("cast(doc_id % 2 as int)")).select("label", "text")
    counts = table.mapInArrow(toxicity._count, "label int, before long, word long, n long")
    model = toxicity._estimate(counts.groupBy("label", "before", "word").agg(splits.F.sum("n").alias("n")).toArrow()).open()
    texts = ["w1 w2 w17 w17", "W3", "new w1 new", "w13 w2", "w16 w15", "", None]
    found = model.evidence(pa.array(texts, pa.string()))
    for text, row in zip(texts, found):
        words = (text or "").lower().split()
        for order in range(2):
            ratios = [math.log(chances(1, a, b)[order] / chances(0, a, b)[order]) for a, b in zip(["<s>", *words], words)]
            expected = [sum(ratios) / len(ratios), max(ratios), max(sum(ratios[i : i + 8]) / 8 for i in range(len(ratios)))] if ratios else [0, 0, 0]
            assert np.allclose(row[3 * order : 3 * order + 3], expected)


def test_toxicity_of_repeated_rows_and_no_rows(spark, docs):
    table = docs([(1, "you scum"), (1, "you scum"), (2, "good day"), (None, "scum")])
    model = toxicity.fit(table, labels_of(spark, [(1, 0, 1), (2, 0, 0)]))
    found = sorted((r["doc_id"] or 0, r["score"]) for r in toxicity.score(table, model).collect())
    assert len(found) == 4 and found[1] == found[2]
    nothing = table.limit(0)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels_of(spark, [(1, 0, 1)]))).count() == 0


def test_quality(spark, docs):
    rng, words = random.Random(2), "some plain words that make a fair sentence".split()
    rows = [(i, prose(rng, words, 50) if i % 3 else prose(rng, words, 50).upper() + "!!") for i in range(150)]
    table = docs(rows + [(900 + i, t) for i, t in enumerate(ODD)])
    found = quality.score_quality(table, labels_of(spark, [(i, int(i % 3 > 0), None) for i, _ in rows if i % 4]))
    found = {r["doc_id"]: r["score"] for r in found.collect()}
    assert len(found) == 156 and all(0 <= s <= 1 for s in found.values())
    assert all((found[i] >= 0.7) == (i % 3 > 0) for i, _ in rows)
    assert {r["score"] for r in quality.score_quality(table, labels_of(spark, [])).collect()} == {0.0}


def test_isotonic_means_rise():
    found = quality.isotonic(np.array([1.0, 0, 3, 1, 4]), np.array([2.0, 2, 4, 2, 4]))
    assert np.allclose(found, [0.25, 0.25, 2 / 3, 2 / 3, 1])


def test_language(spark, docs, spoken):
    table = docs(spoken).withColumn("lang", splits.F.when(splits.F.col("doc_id") % 2 == 1, "de").otherwise("en"))
    odd = docs([(900 + i, t) for i, t in enumerate(ODD)]).withColumn("lang", splits.F.lit(None).cast("string"))
    model = language.fit(table.where("doc_id % 3 != 1").unionByName(odd), epochs=6)
    found = {r["doc_id"]: r for r in language.identify(table.unionByName(odd), model).collect()}
    assert np.mean([found[i]["lang_pred"] == ("de" if i % 2 else "en") for i, _ in spoken if i % 3 == 1]) > 0.9
    assert [found[900 + i]["lang_pred"] == "und" for i in range(6)] == [True, True, True, True, False, False]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}


def test_language_of_a_small_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not there")
    docs = spark.read.parquet(path)
    found = language.identify(docs, language.fit(docs.where(splits.remainder(3) != 1)))
    pairs = docs.where(splits.remainder(3) == 1).select("doc_id", "lang").join(found, "doc_id").where("lang_pred <> 'und' and lang is not null").collect()
    assert len(pairs) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in pairs]) > 0.9


def test_recurrent_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    layer = language.Direction(rng.normal(0, 0.5, (256, 9)), rng.normal(0, 0.5, (3, 9)))
    layer.inputs, layer.hidden = layer.inputs.astype(np.float64), layer.hidden.astype(np.float64)
    codes, pull = rng.integers(0, 5, (6, 4)), rng.normal(size=(6, 4, 3))
    keep = []
    layer.states(codes, keep)
    d_inputs, d_hidden = layer.gradients(codes, keep, pull)
    for array, gradient, place in ((layer.inputs, d_inputs, (2, 4)), (layer.inputs, d_inputs, (1, 7)), (layer.hidden, d_hidden, (1, 5))):
        losses = []
        for step in (1e-2, -2e-2):
            array[place] += step
            losses.append(float((layer.states(codes) * pull).sum()))
        array[place] += 1e-2
        assert math.isclose((losses[0] - losses[1]) / 2e-2, gradient[place], rel_tol=0.02, abs_tol=2e-3)


def test_fingerprints(spark, docs):
    rng = random.Random(3)
    rows = [(3 * i, prose(rng, [f"w{k}é" for k in range(300)], rng.randint(1, 300))) for i in range(40)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, rows[0][1])]
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs(rows)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    gram = lambda t: {t[i : i + 8] for i in range(max(1, len(t) - 7))} if t else set()
    errors = []
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert found[i]["edited_sha256"] == brute.sha(edited) and found[i]["n_chars"] == len(t)
        a, b = gram(t), gram(edited)
        errors.append(abs(found[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(errors) < 0.04 and max(errors) < 0.25
    assert found[0]["fingerprint"] == found[2000]["fingerprint"] and found[1000]["fingerprint"] == ""


def test_fingerprints_of_ties_and_nothing(spark, docs):
    found = fingerprints.fingerprint_documents(docs([(1, "abcdefgh" * 4), (1, "zyxwvuts" * 4), (None, "only")]))
    assert found.count() == 3
    assert fingerprints.fingerprint_documents(docs([(1, "x")]).where("doc_id < 0")).count() == 0
    alone = fingerprints.fingerprint_documents(docs([(1, "x" * 40)])).first()
    assert alone["near_next"] == 1.0


def test_mixing(spark, docs, own_area):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 60))) for i in range(300)] + [(900, None), (901, "")]
    source = splits.F.expr("CASE WHEN doc_id % 10 < 4 THEN 'hot' WHEN doc_id % 10 < 9 THEN concat('s', doc_id % 10) END")
    table = docs(rows).withColumn("source", source)
    first, again = (sorted(mixing.mix_sources(t, own_area).collect(), key=lambda r: r["doc_id"]) for t in (table, table.repartition(5)))
    assert first == again and len(first) == 302
    size = {i: len((t or "").split()) for i, t in rows}
    by = {}
    for r in first:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["copies"] <= 2
        by.setdefault(r["source"], []).append(r)
    names = sorted((n for n in by if n is not None)) + [None]
    sizes = {n: sum(r["size"] for r in by[n]) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        level = (total - sum(2 * sizes[n] for n in full)) / sum(weight[n] for n in names if n not in full)
        more = {n for n in names if n not in full and level * weight[n] > 2 * sizes[n]}
        if not more:
            break
        full |= more
    for n in names:
        target[n] = 2 * sizes[n] if n in full else level * weight[n]
        assert {r["source_size"] for r in by[n]} == {sizes[n]} and math.isclose(by[n][0]["target"], target[n], rel_tol=1e-9)
        assert abs(sum(r["size"] * r["copies"] for r in by[n]) - target[n]) <= 0.02 * target[n] + 3


def test_flight_keeps_totals_until_few_are_left():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 1000, 500), rng.random(500)
    found = mixing.flight(p, size, rng)
    assert ((found > 0) & (found < 1)).sum() <= 2
    assert math.isclose(found @ size, p @ size, rel_tol=1e-9) and math.isclose(found.sum(), p.sum(), rel_tol=1e-9)


def test_mixing_in_several_groups(spark, docs, own_area, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 20)
    table = docs([(i, "w " * (1 + i % 37)) for i in range(200)]).withColumn("source", splits.F.when(splits.F.col("doc_id") < 150, "a"))
    found = mixing.mix_sources(table, own_area).collect()
    for name in ("a", None):
        mine = [r for r in found if r["source"] == name]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) < 0.02 * mine[0]["target"] + 3
    assert mixing.mix_sources(table.where("doc_id < 0"), own_area).count() == 0


def test_mixing_of_long_documents_beside_and_in_larger_sources(spark, docs, own_area, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 40)
    sizes = [6000, 5900, 5800, *(2**k for k in range(13)), *range(3, 60, 3)]
    rows = [("small", n) for n in sizes] + [("tall", n) for n in sizes * 3] + [("hot", 1 + i % 50) for i in range(600)]
    table = docs([(i, "w " * n) for i, (_, n) in enumerate(rows)])
    names = splits.F.array(*(splits.F.lit(name) for name, _ in rows))
    table = table.withColumn("source", splits.F.element_at(names, (splits.F.col("doc_id") + 1).cast("int")))
    found = mixing.mix_sources(table, own_area).collect()
    assert len(found) == len(rows)
    for name in ("small", "tall", "hot"):
        mine = [r for r in found if r["source"] == name]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 5


def test_edit_distance_and_pieces():
    rng = random.Random(6)
    for _ in range(150):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        assert decontaminate.distance(masks, len(item), text) == brute.edit_distance_in(item, text)
        assert "".join(p for _, p in decontaminate.cut(item)) == item


def test_leaks(spark, docs):
    rng = random.Random(7)
    letters = "abcdefghijklmnop "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(40, 200)))) for i in range(12)] + [(99, None), (98, "  "), (5, "tiny one")]
    rows = []
    for i in range(60):
        noise = "".join(rng.choice(letters) for _ in range(300))
        item = decontaminate.normalised(items[i % 12][1])
        for _ in range(rng.randint(0, len(item) // 12)):
            at = rng.randrange(len(item))
            item = item[:at] + rng.choice(["", "z", "zz"]) + item[at + 1 :]
        rows.append((i, noise[:150] + item.upper() + noise[150:] if i % 2 else noise))
    rows += [(900 + i, t) for i, t in enumerate(ODD)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = {}
    for doc, text in rows:
        for item, words in items:
            words = decontaminate.normalised(words)
            budget = len(decontaminate.cut(words)) - 1
            if words and text:
                edits = brute.edit_distance_in(words, decontaminate.normalised(text)[:2000])
                if edits <= budget:
                    wanted[doc, item] = min(edits, wanted.get((doc, item), edits))
    table = docs(rows)
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_leaks(table, benchmark).collect()}
    assert found == wanted and len(found) > 10
    clean = decontaminate.keep_clean(table, benchmark)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in wanted} and clean.columns == table.columns
    assert decontaminate.find_leaks(table, benchmark.where("item_id < 0")).count() == 0


def test_leaks_within_a_tenth_of_the_characters(spark, docs):
    rng = random.Random(8)
    item = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n - 2)).join("xy")
    items = [(n, item(n)) for n in (9, 10, 19, 20, 31, 47, 95, 233, 394)]
    rows = []
    for n, text in items:
        for more in (0, 1):
            # One edit in the middle of each of so many equal stretches.
            edits = n // 10 + more
            at = {n * (2 * k + 1) // (2 * edits) for k in range(edits)}
            rows.append((2 * n + more, "# " * 30 + "".join("%" if i in at else c for i, c in enumerate(text)) + " #" * 30))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = {}
    for doc, text in rows:
        for number, words in items:
            words = decontaminate.normalised(words)
            edits = brute.edit_distance_in(words, decontaminate.normalised(text))
            if edits <= len(words) // 10:
                wanted[doc, number] = edits
    assert {(2 * n, n) for n, _ in items if n != 9} <= set(wanted) and (18, 9) in wanted
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_leaks(docs(rows), benchmark).collect()}
    assert found == wanted
    clean = decontaminate.keep_clean(docs(rows), benchmark)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in wanted}


def test_leaks_in_several_passes(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 60)
    items = [(i, f"a passage of the benchmark with the number {i * 37} in it") for i in range(9)]
    table = docs([(i, "before " + t + " after") for i, t in items])
    found = decontaminate.find_leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["edits"] == 0} == {(i, i) for i in range(9)}


def test_language_model_scores(spark, docs, spoken):
    rows = spoken + [(900 + i, t) for i, t in enumerate(ODD)]
    table = docs(rows).withColumn("trains", splits.F.col("doc_id") % 5 != 1)
    found = {r["doc_id"]: r for r in lmscore.score_documents(table, "trains").collect()}
    counts, total = {}, 0
    tokens = {i: [*brute.words(brute.lower(t)), None] for i, t in rows}
    for i, found_tokens in tokens.items():
        if i % 5 != 1:
            for token in found_tokens:
                counts[token], total = counts.get(token, 0) + 1, total + 1
    for i, mine in tokens.items():
        r = found[i]
        base = sum(math.log10((counts.get(t, 0) + 0.5) / (total + 0.5 * (len(counts) + 1))) for t in mine)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(t in counts for t in mine), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    known = np.mean([found[i]["bits_per_byte"] for i, _ in spoken if i % 5 == 1])
    assert known < 3 < found[905]["bits_per_byte"] or known < 2


def test_codes_are_prefix_free_and_ways_hold_all_counts():
    code = lmscore.Code(np.arange(256) ** 2)
    assert math.isclose(sum(2.0 ** -code.length), 1.0)
    assert len({tuple(code.bits[r, : code.length[r]].tolist()) for r in range(256)}) == 256
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 6, 300, np.uint64) << np.uint64(8) | rng.integers(0, 256, 300, np.uint64))
    totals = rng.integers(0, 9, len(keys))
    ways = code.levels(keys, totals)
    for key, way in zip(keys.tolist(), ways):
        for j in range(code.length[key & 255] + 1):
            prefix = code.bits[key & 255, :j]
            same = [k >> 8 == key >> 8 and code.length[k & 255] >= j and (code.bits[k & 255, :j] == prefix).all() for k in keys.tolist()]
            assert way[j] == totals[same].sum()


@pytest.mark.parametrize("low", [0, 8])
def test_distinct_values(low):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, 5000, np.uint64) << np.uint64(9) | rng.integers(0, 9, 5000, np.uint64)
    for some in (values, values << np.uint64(40), values[:1], values[:0]):
        keys, place, which = lmscore.distinct(some, low)
        assert np.array_equal(keys, np.unique(some)) and np.array_equal(some[place], keys) and np.array_equal(keys[which], some)


def test_numbers_are_sent_in_the_bytes_they_need():
    rng = np.random.default_rng(6)
    for top in (1, 2**8, 2**16 - 1, 2**33, 2**63):
        values = rng.integers(0, top, 5000, np.uint64, endpoint=True)
        values[7] = top
        body = lmscore.spread(values)
        assert np.array_equal(lmscore.joined(body), values) and body[0] == (top.bit_length() + 7) // 8
    assert len(lmscore.joined(lmscore.spread(values[:0]))) == 0


def peak_bytes(function):
    tracemalloc.start()
    found = function()
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return found, peak


def test_memory_of_a_block_and_of_a_part():
    """A worker holds a bounded number of bytes for each byte of a block's text, and for each count of a part."""
    rng = random.Random(7)
    texts = [prose(rng, [f"word{rng.randrange(20_000)}" for _ in range(500)], 200) for _ in range(400)]
    data, ends = buffers(pa.array(texts))
    trains = np.ones(len(texts), bool)
    block = blocks.Block(0, None, ends, data, ~trains)
    code = lmscore.Code(np.bincount(data, minlength=256))
    tokens, peak = peak_bytes(lambda: lmscore.Tokens(block, code, trains))
    assert peak < 40 * len(data), peak / len(data)
    keys, counts = tokens.asked_contexts()
    ways, peak = peak_bytes(lambda: code.levels(keys, counts))
    assert peak < 8 * ways.size, peak / ways.size
    steps = ways.astype(np.uint64)
    steps[:, 1:] = ways[:, :-1] - ways[:, 1:]
    names, often = tokens.asked_names()
    # One part holds all keys; contexts are numbered after it.
    answer = [{"part": 0, "body": lmscore.spread(often)}, {"part": 1, "body": lmscore.spread(steps.T[code.reach[:, keys & lmscore.BYTE]])}]
    (words, pairs, told, begins), peak = peak_bytes(lambda: tokens.told(answer, 1))
    assert peak < 20 * ways.size, peak / ways.size
    assert np.array_equal(words, tokens.often) and pairs.sum() == len(tokens.which)
    length = code.length[(keys & lmscore.BYTE).astype(int)]
    assert all(np.array_equal(told[b : b + n + 1], way[: n + 1]) for b, n, way in zip(begins, length, ways))


def test_rows_are_handed_over_one_at_a_time(spark, docs, monkeypatch):
    """While weights are learned and while the query scores; the session's own setting comes back."""
    handed = lmscore.unpack

    def unpack(batches):
        return handed(batch for batch in batches if not (any(n.startswith("answer") for n in batch.schema.names) and batch.num_rows > 1 and 1 / 0))

    monkeypatch.setattr(lmscore, "unpack", unpack)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 40)
    table = docs([(i, f"word{i} " * 9) for i in range(60)])
    monkeypatch.setattr(queries, "table", lambda *_: table)
    before = spark.conf.get(ARROW_ROWS)
    seen = queries.op5_lm_score(spark, "").collect()
    assert len(seen) == 60 and spark.conf.get(ARROW_ROWS) == before


def test_language_model_equals_brute_force(spark, docs, spoken, monkeypatch):
    """Counts by dictionaries, bit by bit, under given weights."""
    rng = np.random.default_rng(5)
    mixer = lmscore.Mixer.new()
    mixer.weights = rng.uniform(0, 0.6, mixer.weights.shape)
    mixer.ones = mixer.seen * rng.uniform(0.1, 0.9, len(mixer.seen))
    mixer.pairs = rng.uniform(0.1, 0.9, lmscore.SEEN)
    monkeypatch.setattr(lmscore, "SPARE_BITS", 40)
    monkeypatch.setattr(lmscore, "_mixer", lambda *_: mixer)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 900)
    rows = spoken + [(900 + i, t) for i, t in enumerate(["ab ab ab", "", None, "Der der \u00fcber", "abab" * 20])]
    table = docs(rows).withColumn("trains", splits.F.col("doc_id") % 5 != 1)
    found = {r["doc_id"]: r["score"] for r in lmscore.score_documents(table, "trains").collect()}

    tokens = {i: [*(w.encode() for w in brute.words(brute.lower(t))), b""] for i, t in rows}
    histogram, contexts, words, pairs = np.zeros(256, np.int64), {}, {}, {}
    for i, t in rows:
        if i % 5 != 1:
            for byte in brute.lower(t or "").encode():
                histogram[32 if chr(byte).isspace() and byte < 128 else byte] += 1
    code = lmscore.Code(histogram)

    def ways(word):
        spelled = word + b" "
        for k, byte in enumerate(spelled):
            yield byte, [(kind, spelled[max(0, k - size) : k], k < size) for kind, size in ((0, 2), (1, 3), (2, 4), (3, 10**6))]

    for i, mine in tokens.items():
        if i % 5 != 1:
            for before, word in zip([b"", *mine], mine):
                words[word] = words.get(word, 0) + 1
                pairs[before, word] = pairs.get((before, word), 0) + 1
                for byte, seen in ways(word):
                    for context in seen:
                        inner = contexts.setdefault(context, {})
                        rank = int(code.rank[byte])
                        inner[rank] = inner.get(rank, 0) + 1

    def spelled(word):
        chance = 1.0
        for byte, seen in ways(word):
            rank = int(code.rank[byte])
            for j in range(code.length[rank]):
                bit, mixed, counts = code.bits[rank, j], 0.0, []
                for context in seen:
                    below = [(r, n) for r, n in contexts.get(context, {}).items() if code.low[rank, j] <= r <= code.high[rank, j]]
                    ones = sum(n for r, n in below if code.bits[r, j])
                    counts.append((ones, sum(n for _, n in below)))
                gate = 0
                for _, n in counts[1:]:
                    gate = 4 * gate + (n >= 1) + (n >= 4) + (n >= 32)
                for k, (ones, n) in enumerate(counts):
                    mixed += mixer.weights[k][gate] * math.log((ones + 0.4) / (n - ones + 0.4))
                mixed = min(12.0, max(-12.0, mixed))
                cell = gate * 49 + round((mixed + 12) * 2)
                one = 0.5 / (1 + math.exp(-mixed)) + 0.5 * mixer.ones[cell] / mixer.seen[cell]
                chance *= one if bit else 1 - one
        return chance

    kept = {}
    for i, mine in tokens.items():
        score = 0.0
        for before, word in zip([b"", *mine], mine):
            if word not in kept:
                kept[word] = spelled(word)
            n = words.get(before, 0)
            share = mixer.pairs[int(math.log2(n))] if n else 0.0
            follows = pairs.get((before, word), 0) / n if n else 0.0
            score += math.log10((1 - share) * kept[word] + share * follows)
        assert math.isclose(found[i], score, rel_tol=2e-3), i


def test_blocks_meet_their_counts_without_a_copy(spark, docs):
    """Before, learning and scoring each wrote all blocks once more, as shuffle files."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        table = docs([(i, f"a{i} b c") for i in range(9)]).withColumn("trains", splits.F.col("doc_id") % 5 != 1)
        found = lmscore.score_documents(table, "trains")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and found.count() == 9, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_without_training_documents(spark, docs):
    table = docs([(1, "a b"), (2, None)]).withColumn("trains", splits.F.lit(False))
    found = lmscore.score_documents(table, "trains").collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in found) and len(found) == 2
    assert lmscore.score_documents(table.where("doc_id < 0"), "trains").count() == 0


def test_likeness_of_texts():
    a, b = "x" * 5, "abcdefghijklmnop" * 9
    found = fingerprints.fingerprint_pairs([a, b, ""], [a, "q" * 80, ""])
    assert found["near_next"][0] == 1.0 and found["near_next"][1] < 0.1 and found["near_next"][2] == 1.0
    assert pa.array(found["fingerprint"]).to_pylist()[2] == ""
