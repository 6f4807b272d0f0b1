"""Two-dimensional projections: fit once, place new runs without moving the old ones."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from runscope.config import PROJECTION_METHODS
from runscope.operators.clean import ID, ColumnStats, FeatureSpace, as_feature, column_stats, feature_columns
from runscope.operators.layout import N_NEIGHBORS, ROUNDS, neighbour_layout, principal_axes
from runscope.plans.blocks import nearest_between
from runscope.plans.stage import StageArea
from runscope.sources.columns import quoted

AXIS_LABELS = ("Dim 1", "Dim 2")
_MODEL_SCHEMA = "position int, method string, feature string, n_rows long, valid long, mean double, squares double, w1 double, w2 double"


@dataclass(frozen=True)
class ProjectionModel:
    """Column statistics at fit time plus either two axes (pca) or the placed points (umap)."""

    method: str
    stats: list[ColumnStats]  # every imputed feature; those without spread do not enter the projection
    axes: np.ndarray | None = None
    placed: DataFrame | None = None

    @property
    def scaled(self) -> list[ColumnStats]:
        return [s for s in self.stats if s.usable_variance]

    def _values(self, df: DataFrame) -> list[Column]:
        """Standardised inputs; a column the table lacks counts as missing, hence as the fit-time mean."""
        return [
            s.standardised(as_feature(df, s.name)) if s.name in df.columns else F.lit(0.0) for s in self.scaled
        ]

    def vectors(self, df: DataFrame) -> DataFrame:
        return df.select(ID, F.array(*[v + F.lit(0.0) for v in self._values(df)]).alias("vec"))

    def transform(self, df: DataFrame, area: StageArea | None = None) -> DataFrame:
        """(shot_id, umap_x, umap_y) of any rows, never refitting."""
        if self.axes is not None:
            values = self._values(df)
            coordinates = [
                sum((v * F.lit(float(w)) for v, w in zip(values, axis)), F.lit(0.0)) for axis in self.axes
            ]
            return df.select(ID, coordinates[0].alias("umap_x"), coordinates[1].alias("umap_y"))
        return self._place(df, area or StageArea(df.sparkSession, "place"))

    def _place(self, df: DataFrame, area: StageArea) -> DataFrame:
        """A vector seen at fit time keeps its place (a join); others take the distance-weighted
        mean of the nearest placed points."""
        vectors = self.vectors(df)
        seats = self.placed.select("vec", "umap_x", "umap_y")
        queries = vectors.groupBy("vec").agg(F.min(ID).alias("id"))
        fresh = area.put(queries.join(seats.select("vec"), "vec", "left_anti"), "new")
        if fresh.isEmpty():
            return vectors.join(seats, "vec").select(ID, "umap_x", "umap_y")
        targets = self.placed.select("id", "vec", F.lit(1.0).alias("weight"))
        near = nearest_between(fresh.withColumn("weight", F.lit(1.0)), targets, N_NEIGHBORS - 1, area)
        partners = self.placed.select(F.col("id").alias("partner"), "umap_x", "umap_y")
        # Distances are rounded for ties, so a very near point may show distance 0.
        weight = 1 / F.greatest("score", F.lit(1e-9))
        means = [(F.sum(weight * F.col(c)) / F.sum(weight)).alias(c) for c in ("umap_x", "umap_y")]
        placed = fresh.join(near.join(partners, "partner").groupBy("id").agg(*means), "id")
        return vectors.join(seats.unionByName(placed.drop("id")), "vec").select(ID, "umap_x", "umap_y")

    def save(self, spark: SparkSession, path: str) -> None:
        scaled = [s.name for s in self.scaled]
        rows = []
        for i, s in enumerate(self.stats):
            weights = [None, None]
            if self.axes is not None and s.name in scaled:
                weights = [float(axis[scaled.index(s.name)]) for axis in self.axes]
            rows.append((i, self.method, s.name, s.rows, s.valid, s.mean, s.squares, *weights))
        if self.placed is not None:
            self.placed.write.mode("overwrite").parquet(f"{path}/placed")
        spark.createDataFrame(rows, _MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ProjectionModel:
        rows = spark.read.parquet(f"{path}/columns").orderBy("position").collect()
        stats = [ColumnStats(r["feature"], r["n_rows"], r["valid"], r["mean"], r["squares"]) for r in rows]
        method = rows[0]["method"]
        if method == "umap":
            return ProjectionModel(method, stats, placed=spark.read.parquet(f"{path}/placed"))
        used = [r for r, s in zip(rows, stats) if s.usable_variance]
        return ProjectionModel(method, stats, axes=np.array([[r["w1"] for r in used], [r["w2"] for r in used]]))


def fit_projection(
    df: DataFrame,
    method: str = "umap",
    features: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    area: StageArea | None = None,
    rounds: int = ROUNDS,
) -> ProjectionModel:
    """Fit on the chosen numeric columns: drop empty ones, impute means, drop those without spread,
    standardise, project to two dimensions. *rounds* belongs to the neighbour graph alone."""
    if method not in PROJECTION_METHODS:
        raise ValueError(f"method must be one of {PROJECTION_METHODS}, got {method!r}")
    chosen = feature_columns(df, features, exclude)
    if not chosen:
        raise ValueError("no usable feature columns: check the feature list, or that the table has numeric columns")
    stats = [s for s in column_stats(df, chosen) if not s.all_missing]
    if not stats:
        raise ValueError("all feature columns are entirely missing: choose columns that hold data")
    model = ProjectionModel(method, stats)
    if not model.scaled:
        raise ValueError("no feature column with finite, non-zero variance remains")
    if len(model.scaled) < 2 and method == "pca":
        raise ValueError("a two-dimensional projection needs at least 2 features with spread")
    if method == "pca":
        return ProjectionModel(method, stats, axes=principal_axes(model.vectors(df), 2))
    area = area or StageArea(df.sparkSession, "umap")
    space = FeatureSpace(
        df.select(ID, *[s.standardised(as_feature(df, s.name)).alias(s.name) for s in model.scaled]),
        [s.name for s in model.scaled],
        model.scaled,
        [],
    )
    return ProjectionModel(method, stats, placed=area.put(neighbour_layout(space, area, rounds=rounds), "placed"))


def project(df: DataFrame, model: ProjectionModel, area: StageArea | None = None) -> DataFrame:
    """The table with its coordinates (inner join on the ID)."""
    if model.axes is not None:
        x, y = (
            sum((v * F.lit(float(w)) for v, w in zip(model._values(df), axis)), F.lit(0.0)) for axis in model.axes
        )
        return df.select("*", x.alias("umap_x"), y.alias("umap_y"))
    return attach_embedding(df, model.transform(df, area))


def attach_embedding(df: DataFrame, embedding: DataFrame) -> DataFrame:
    """Inner join with coordinates: runs without a place vanish."""
    return df.join(embedding.select(ID, "umap_x", "umap_y"), ID)


def unseen(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose ID is not in *known*."""
    return df.join(known.select(ID), ID, "left_anti")


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Union by column name; columns missing on one side become null."""
    return table.unionByName(rows, allowMissingColumns=True)


def config_key(
    method: str,
    features: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    variable: str | None = None,
) -> str:
    """Key of a stored projection: settings only, so added rows never force a refit."""
    text = "|".join(
        [method, ",".join(sorted(features)) if features else "*", ",".join(sorted(exclude or ())), variable or "*"]
    )
    return hashlib.md5(text.encode()).hexdigest()


class ProjectionStore:
    """Fitted models and their embeddings in a folder, one subfolder per configuration and variable."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def folder(self, key: str, variable: str | None = None) -> str:
        safe = "".join(c if c.isalnum() or c in "-_" else "_" for c in variable or "all")
        return f"{self.root}/config={key}/variable={safe}"

    def load(self, folder: str) -> tuple[ProjectionModel, DataFrame] | None:
        try:
            embedding = self.spark.read.parquet(f"{folder}/embedding")
            return ProjectionModel.load(self.spark, f"{folder}/model"), embedding
        except AnalysisException:
            return None

    def get(
        self,
        df: DataFrame,
        method: str = "umap",
        features: Sequence[str] | None = None,
        exclude: Sequence[str] | None = None,
        variable: str | None = None,
    ) -> tuple[ProjectionModel, DataFrame]:
        """(model, embedding of every run): reuse what is stored and place only unseen runs.

        The embedding is written after the model, so a job that died in between starts over; placed
        runs are appended and found again by ID, so a repeated call adds nothing twice.
        """
        folder = self.folder(config_key(method, features, exclude, variable), variable)
        stored = self.load(folder)
        if stored is None:
            model = fit_projection(df, method, features, exclude)
            model.save(self.spark, f"{folder}/model")
            model = ProjectionModel.load(self.spark, f"{folder}/model")
            model.transform(df).write.mode("overwrite").parquet(f"{folder}/embedding")
            return model, self.spark.read.parquet(f"{folder}/embedding")
        model, embedding = stored
        new_rows = unseen(df, embedding)
        if not new_rows.select(F.lit(1)).limit(1).isEmpty():
            model.transform(new_rows).write.mode("append").parquet(f"{folder}/embedding")
        return model, self.spark.read.parquet(f"{folder}/embedding")
