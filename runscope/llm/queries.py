"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.llm import audit, decontaminate, extract, fingerprints, infill, language, lmscore, mixing, neardup, quality, repeats, suffixes, toxicity
from runscope.llm.oracles import ORACLES
from runscope.llm.splits import remainder
from runscope.plans.stage import StageArea, row_by_row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(remainder(4) != 2)
    scored = quality.score_quality(table(spark, sf_dir, "documents"), labels)
    return scored.select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), StageArea(spark, "mixing"))
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents that hold an item have rows."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("trains", remainder(5) != 1)
    found = lmscore.score_documents(docs, "trains").withColumn("held_out", remainder(5) == 1)
    with row_by_row(spark):
        return StageArea(spark, "scores").put(found)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = neardup.near_duplicates(docs, StageArea(spark, "neardup"), shingle=4, percent=80)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs.where(remainder(3) != 1)))
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract_text(table(spark, sf_dir, "pages"), StageArea(spark, "extract"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.restore(infill.fill_in_middle(table(spark, sf_dir, "documents")))
    digests = [F.sha2(name, 256).alias(f"{name}_sha256") for name in ("output", "restored")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_sources(table(spark, sf_dir, "documents"), StageArea(spark, "audit"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_lm_score": op5_lm_score,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op11_html_extraction": op11_html_extraction,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_audit": op13_source_audit,
}

__all__ = ["ORACLES", "QUERIES"]
