"""Pre-computed coordinates and attribution values."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.operators.clean import ID
from runscope.plans.ordering import number_rows
from runscope.plans.stage import StageArea
from runscope.sources.columns import quoted, with_shot_id


def as_embedding(df: DataFrame) -> tuple[DataFrame, str, str]:
    """(shot_id, umap_x, umap_y) and the axis labels: the first two columns beside the ID."""
    renamed = with_shot_id(df)
    axes = [c for c in renamed.columns if c != ID]
    if len(axes) < 2:
        raise ValueError(f"an embedding needs at least 2 coordinate columns, found {axes}")
    x, y = axes[:2]
    return renamed.select(ID, F.col(quoted(x)).alias("umap_x"), F.col(quoted(y)).alias("umap_y")), x, y


def read_embedding(spark: SparkSession, path: str) -> tuple[DataFrame, str, str]:
    suffix = PurePath(path).suffix.lower()
    if suffix == ".csv":
        return as_embedding(spark.read.option("header", True).option("inferSchema", True).csv(path))
    if suffix in (".parquet", ".pq"):
        return as_embedding(spark.read.parquet(path))
    raise ValueError(f"unsupported embedding format {suffix!r}: expected .csv or .parquet")


def attach_by_position(
    df: DataFrame, coordinates: DataFrame, df_order: str, coordinates_order: str, area: StageArea | None = None
) -> DataFrame:
    """Coordinates for a table by row order.

    Two value columns (besides the order column) are matched by position and the row counts must
    agree; with three or more the first one is the ID itself.
    """
    values = [c for c in coordinates.columns if c != coordinates_order]
    if len(values) < 2:
        raise ValueError(f"coordinates need 2 or 3 value columns, found {values}")
    if len(values) >= 3:
        return coordinates.select(
            F.col(quoted(values[0])).cast("long").alias(ID),
            F.col(quoted(values[1])).alias("umap_x"),
            F.col(quoted(values[2])).alias("umap_y"),
        )
    runs, rows = df.count(), coordinates.count()
    if runs != rows:
        raise ValueError(f"the embedding has {rows} rows but the table has {runs}")
    area = area or StageArea(df.sparkSession, "positions")
    order = F.col(quoted(df_order)).alias("_order")
    left = number_rows(df.select(ID, order), ["_order"], "_position", area).drop("_order")
    right = number_rows(coordinates, [coordinates_order], "_position", area)
    return left.join(right, "_position").select(
        ID, F.col(quoted(values[0])).alias("umap_x"), F.col(quoted(values[1])).alias("umap_y")
    )


def read_attribution(spark: SparkSession, path: str, cls: bool | None = True) -> DataFrame:
    """(shot_id, feature, class, value) rows of one class (all classes with None)."""
    rows = spark.read.parquet(path)
    return rows if cls is None else rows.where(F.col("class") == F.lit(cls))
