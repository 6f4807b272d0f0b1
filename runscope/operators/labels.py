"""Joining cluster and outlier labels, counting them, exporting tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.functions import cluster_label, distance, outlier_label
from runscope.operators.clean import COORDINATES, ID
from runscope.sources.columns import quoted


def names_table(df: DataFrame, names: Mapping[int, str] | DataFrame | None) -> DataFrame | None:
    """Custom cluster names as a (cluster_id, custom_name) table."""
    if names is None or isinstance(names, DataFrame):
        return names
    if not names:
        return None
    return df.sparkSession.createDataFrame(
        [(int(k), str(v)) for k, v in names.items()], "cluster_id long, custom_name string"
    )


def apply_cluster_labels(
    df: DataFrame, labels: DataFrame, names: Mapping[int, str] | DataFrame | None = None
) -> DataFrame:
    """Rows with a label, plus their cluster name; unlabelled rows are dropped."""
    joined = df.join(labels.select(ID, "cluster_id"), ID)
    custom = names_table(df, names)
    if custom is None:
        return joined.withColumn("cluster", cluster_label(F.col("cluster_id"))).drop("cluster_id")
    named = joined.join(custom, "cluster_id", "left")
    return named.withColumn("cluster", cluster_label(F.col("cluster_id"), F.col("custom_name"))).drop(
        "cluster_id", "custom_name"
    )


def apply_outlier_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    joined = df.join(labels.select(ID, "is_outlier"), ID)
    return joined.withColumn("Outlier", outlier_label(F.col("is_outlier"))).drop("is_outlier")


def export_table(
    df: DataFrame, labels: DataFrame | None = None, names: Mapping[int, str] | DataFrame | None = None
) -> DataFrame:
    """The whole table without coordinates, with cluster_id and cluster_name once clustering ran."""
    shown = df.drop(*COORDINATES)
    if labels is None:
        return shown
    joined = shown.join(labels.select(ID, F.col("cluster_id").cast("long").alias("cluster_id")), ID, "left")
    custom = names_table(df, names)
    if custom is None:
        label = cluster_label(F.col("cluster_id"))
    else:
        joined = joined.join(custom, "cluster_id", "left")
        label = cluster_label(F.col("cluster_id"), F.col("custom_name"))
    named = F.when(F.col("cluster_id").isNull(), F.lit("")).otherwise(label)
    return joined.withColumn("cluster_name", named).select(*shown.columns, "cluster_id", "cluster_name")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV part files with headers; an empty string stays apart from a missing value."""
    df.write.mode("overwrite").option("header", True).csv(path)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster_id").agg(F.count("*").alias("n"))


def cluster_summary(labels: DataFrame) -> DataFrame:
    """Number of clusters, labelled runs and noise runs."""
    return (
        cluster_sizes(labels)
        .agg(
            F.count_if(F.col("cluster_id") >= 0).alias("clusters"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("runs"),
            F.coalesce(F.sum(F.when(F.col("cluster_id") < 0, F.col("n"))), F.lit(0)).alias("noise"),
        )
    )


def outlier_summary(labels: DataFrame) -> DataFrame:
    """Number and percentage of outliers."""
    n_out = F.coalesce(F.sum("is_outlier"), F.lit(0))
    return labels.agg(
        n_out.cast("long").alias("outliers"),
        F.count("*").alias("runs"),
        F.try_divide(100.0 * n_out, F.count("*")).alias("percent"),
    )


def barycentres(frame: DataFrame, labels: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of every feature per cluster, noise left out."""
    joined = frame.join(labels.where(F.col("cluster_id") >= 0).select(ID, "cluster_id"), ID)
    return joined.groupBy("cluster_id").agg(*[F.avg(quoted(f)).alias(f) for f in features])


def representatives(
    frame: DataFrame, labels: DataFrame, features: Sequence[str], centres: DataFrame | None = None
) -> DataFrame:
    """The real run nearest to each centre, as (cluster_id, shot_id); ties go to the smaller ID.

    *centres* (cluster_id and the features) defaults to the barycentres.
    """
    centres = barycentres(frame, labels, features) if centres is None else centres
    centres = centres.select("cluster_id", *[F.col(quoted(f)).alias(f"_c{i}") for i, f in enumerate(features)])
    members = frame.join(labels.where(F.col("cluster_id") >= 0).select(ID, "cluster_id"), ID).join(centres, "cluster_id")
    apart = F.round(distance([F.col(quoted(f)) for f in features], [F.col(f"_c{i}") for i in range(len(features))]), 9)
    return members.groupBy("cluster_id").agg(F.min_by(ID, F.struct(apart, F.col(ID))).alias(ID))
