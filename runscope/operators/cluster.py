"""Clustering of runs on standardised features or on projection coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runscope.operators.clean import COORDINATES, ID, FeatureSpace, feature_space
from runscope.operators.dbscan import dbscan
from runscope.operators.labels import representatives
from runscope.operators.ward import agglomerate
from runscope.plans.stage import StageArea

ALGORITHMS = ("kmeans", "dbscan", "agglomerative")
# Defaults of the clustering operators.
N_CLUSTERS = 5
EPS = 0.5
MIN_SAMPLES = 5
SEED = 42


@dataclass(frozen=True)
class Clustering:
    """Labels (shot_id, cluster_id; -1 is noise) and one real run per cluster (cluster_id, shot_id)."""

    labels: DataFrame
    representatives: DataFrame
    space: FeatureSpace


def cluster_runs(
    df: DataFrame,
    algorithm: str = "kmeans",
    features: Sequence[str] | None = None,
    n_clusters: int = N_CLUSTERS,
    eps: float = EPS,
    min_samples: int = MIN_SAMPLES,
    on_projection: bool = False,
    area: StageArea | None = None,
) -> Clustering:
    """Cluster the whole table. Unknown algorithm, no valid feature or no rows give empty results."""
    if eps <= 0:
        raise ValueError("eps must be greater than 0")
    wanted = COORDINATES if on_projection else features
    space = feature_space(df, wanted)
    if algorithm not in ALGORITHMS or not space.features:
        labels = df.select(ID, F.lit(0).cast("long").alias("cluster_id")).limit(0)
        return Clustering(labels, labels.select("cluster_id", ID), space)
    area = area or StageArea(df.sparkSession, "cluster")
    centres = None
    if algorithm == "kmeans":
        labels, centres = kmeans(space, n_clusters, area)
    elif algorithm == "dbscan":
        labels = area.put(dbscan(space, eps, min_samples, area), "labels")
    else:
        labels = area.put(agglomerate(space, n_clusters, area), "labels")
    return Clustering(labels, representatives(space.frame, labels, space.features, centres), space)


def kmeans(space: FeatureSpace, n_clusters: int, area: StageArea) -> tuple[DataFrame, DataFrame]:
    """Labels and centres of k-means; clusters are numbered by their smallest run."""
    vectors = area.put(space.vectors(), "vectors")
    model = KMeans(k=n_clusters, seed=SEED, maxIter=300, tol=1e-4, featuresCol="features", predictionCol="raw")
    fitted = model.fit(vectors.select(array_to_vector("vec").alias("features")))
    raw = area.put(
        fitted.transform(vectors.select(ID, array_to_vector("vec").alias("features"))).select(ID, "raw"), "raw"
    )
    # One row per cluster, at most n_clusters of them.
    order = raw.groupBy("raw").agg(F.min(ID).alias("first"))
    numbers = order.select("raw", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("cluster_id"))
    labels = raw.join(F.broadcast(numbers), "raw").select(ID, "cluster_id")
    rows = [(i, *map(float, centre)) for i, centre in enumerate(fitted.clusterCenters())]
    fields = ", ".join(f"`c{i}` double" for i in range(len(space.features)))
    centres = df_of(vectors, rows, f"raw int, {fields}").toDF("raw", *space.features)
    return labels, centres.join(numbers, "raw").drop("raw")


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)
