"""One data set put together from its settings: runs with coordinates, the fitted model, references, refresh."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from runscope.config import ScopeConfig
from runscope.operators.clean import ID
from runscope.operators.graph import reference_edges
from runscope.operators.project import ProjectionModel, append_rows, attach_embedding, fit_projection, project
from runscope.plans.stage import StageArea
from runscope.sources import registry
from runscope.sources.embeddings import read_embedding
from runscope.sources.stats import newer_than
from runscope.streaming.live import LiveTable, refresh_stream

AXES = ("Dim 1", "Dim 2")
COORDINATES = ("umap_x", "umap_y")


@dataclass(frozen=True)
class Dataset:
    """A snapshot: ``runs`` is written in the area, so files that arrive later show up by ``refresh`` only."""

    path: str
    config: ScopeConfig
    variable: str | None
    area: StageArea
    runs: DataFrame
    model: ProjectionModel | None
    axes: tuple[str, str] = AXES

    def edges(self) -> DataFrame | None:
        """(shot_id, ref_id) among the runs, or None without a reference column."""
        if self.config.reference_column is None:
            return None
        return reference_edges(self.runs, self.config.reference_column)

    def refresh(self) -> Dataset | None:
        """The data set with all rows above its highest ID, placed by the model it has; None if there are none.

        The ID predicate reaches the scan, of one variable too. The model is never fitted again, and a
        data set with given coordinates has none, so it cannot grow. Without rows there is no highest ID.
        """
        highest = self.runs.agg(F.max(ID)).first()[0]
        if self.model is None or highest is None:
            return None
        rows = newer_than(_read(self.area.spark, self.path, self.config, self.variable), highest)
        fresh = self.area.put(project(rows, self.model, self.area), "fresh")
        if fresh.isEmpty():
            return None
        return replace(self, runs=append_rows(self.runs, fresh))

    def follow(
        self, source: str, schema: T.StructType | str, table: LiveTable, checkpoint: str, mode: str = "strict"
    ) -> StreamingQuery:
        """Keep *table* up to date from a folder of arriving files, as often as the settings say."""
        if self.model is None:
            raise ValueError("given coordinates cannot be extended: there is no fitted model")
        if not table.exists():
            table.create(self.runs.drop(*COORDINATES), self.model)
        interval = self.config.refresh_interval_seconds
        return refresh_stream(self.area.spark, source, schema, table, self.model, checkpoint, mode, interval)


def open_dataset(
    spark: SparkSession,
    path: str,
    config: ScopeConfig | None = None,
    variable: str | None = None,
    area: StageArea | None = None,
) -> Dataset | None:
    """Read the runs, fit the projection of the settings (or join the given coordinates) and attach it.

    Long-format tables need a variable; without one there is no data set yet.
    """
    config = config or ScopeConfig()
    if config.variable_column is not None and variable is None:
        return None
    area = area or StageArea(spark, "dataset")
    runs = _read(spark, path, config, variable)
    if config.projection_path is not None:
        embedding, *axes = read_embedding(spark, config.projection_path)
        placed = area.put(attach_embedding(runs, embedding), "runs")
        return Dataset(path, config, variable, area, placed, None, tuple(axes))
    # One reading decides both what is fitted and what is shown.
    runs = area.put(runs, "read")
    model = fit_projection(runs, config.projection_method, config.features, config.exclude_features, area)
    return Dataset(path, config, variable, area, area.put(project(runs, model, area), "runs"), model)


def _read(spark: SparkSession, path: str, config: ScopeConfig, variable: str | None) -> DataFrame:
    if config.variable_column is None:
        return registry.open_stats(spark, path, config)
    return registry.open_variable(spark, path, variable, config)
