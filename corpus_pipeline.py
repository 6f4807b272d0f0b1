"""Corpus cleaning as five stages, each of which works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.llm import decontaminate, mixing, neardup, repeats, toxicity
from runscope.plans.stage import StageArea

#: Words of a passage that a second occurrence loses in the pipeline.
PASSAGE_WORDS = 30


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from all labels, puts below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 0.8 of their five-word shingles."""
    return neardup.one_of_each_group(docs, shingle=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of passages that an earlier place holds; n_chars follows the text."""
    cleaned = repeats.without_repeats(docs, width=PASSAGE_WORDS)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its budget of edits."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document that is left: (doc_id, source, size, source_size, target, copies, taken)."""
    mixed = mixing.mix_sources(docs, StageArea(spark, "mixing"))
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_to_targets),
]

#: The toxicity model and edit distances within budgets have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    area = StageArea(spark, "pipeline")
    for name, stage in STAGES:
        docs = area.put(stage(spark, docs, sf_dir), name)
    return docs
