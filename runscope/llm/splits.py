"""Held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo *modulus*; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row per labelled document of *docs*; of several labels the largest counts."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).alias("label"))
    )
    return known.join(docs.select("doc_id"), "doc_id", "left_semi")


def sample(rows: DataFrame, n: int) -> DataFrame:
    """At most *n* rows of (doc_id, ...), those with the smallest hash of the id: the same ones in each run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
