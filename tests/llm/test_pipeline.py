"""The pipeline on a small folder, each stage against brute force on what the stage before kept."""

import random

import corpus_pipeline
from tests.llm import brute


def test_stages(spark, docs, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    texts = [prose(80) for _ in range(30)]
    texts += [t + " more" for t in texts[:4]]
    passage, item = prose(35), prose(40)
    texts += [f"{prose(50)} {passage} {prose(40)}" for _ in range(3)]
    edited = list(item)
    for at in range(5, len(item), 13):
        edited[at] = "%"
    texts += [f"{prose(30)} {''.join(edited)} {prose(30)}"]
    texts += [prose(60) + " idiot scum" * 15 for _ in range(10)]
    docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, None, int("idiot" in t)) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    table, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(enumerate(texts))
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path)).localCheckpoint()
        before = kept
        if name == "toxicity":
            kept = {i: t for i, t in before.items() if "idiot" not in t}
        elif name == "minhash_near_dedup":
            kept = {i: before[i] for i in {first for _, _, first in brute.components(list(before.items()), 5, 80)}}
        elif name == "substring_dedup":
            digest = {i: d for i, _, _, d in brute.later_windows(list(before.items()), 30)}
            kept = {r["doc_id"]: r["text"] for r in table.collect()}
            assert set(kept) == set(before) and all(brute.sha(" ".join(brute.words(t))) == digest[i] for i, t in kept.items())
            assert all(r["n_chars"] == len(r["text"]) for r in table.collect())
        elif name == "benchmark_decontamination":
            kept = {i: t for i, t in before.items() if brute.edit_distance_in(item, t) > len(item) // 10}
        if name != "source_mixing":
            assert {r["doc_id"]: r["text"] for r in table.collect()} == kept, name
            assert kept != before, name
    found = table.collect()
    assert {r["doc_id"]: r["size"] for r in found} == {i: len(brute.words(t)) for i, t in kept.items()}
    assert all(r["taken"] == r["size"] * r["copies"] for r in found)
    assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 0.02 * found[0]["target"]
