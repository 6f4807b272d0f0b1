"""Attribution values: how features add up to a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runscope.operators.clean import ID


def decision_path(values: DataFrame, base: float = 0.0, top: int | None = None) -> DataFrame:
    """(shot_id, feature, value, importance, cumulative) for every run.

    Features add up from the least to the most important (absolute value, then name). With
    *top* only the most important steps are listed, but the sum contains all of them. A window holds the
    features of one run.
    """
    rising = Window.partitionBy(ID).orderBy(F.abs("value"), F.desc("feature"))
    falling = Window.partitionBy(ID).orderBy(F.abs("value").desc(), "feature")
    path = values.select(
        ID,
        "feature",
        "value",
        F.row_number().over(falling).alias("importance"),
        (F.lit(base) + F.sum("value").over(rising.rowsBetween(Window.unboundedPreceding, 0))).alias("cumulative"),
    )
    return path if top is None else path.where(F.col("importance") <= top)
