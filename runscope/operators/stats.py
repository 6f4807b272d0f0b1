"""Counts and correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.functions import finite
from runscope.operators.clean import ID, column_stats
from runscope.sources.columns import quoted

def run_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def filtered_count(df: DataFrame, condition: Column | None) -> DataFrame:
    passing = F.count("*") if condition is None else F.count_if(condition)
    return df.agg(passing.alias("shown"), F.count("*").alias("total"))


def latest_run(df: DataFrame) -> DataFrame:
    return df.agg(F.max(ID).alias("latest"))


def correlation_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [
        f for f in features if f in df.columns and isinstance(df.schema[f].dataType, (T.NumericType, T.BooleanType))
    ]


def correlate(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson r of all pairs over the rows where both are present, as (x, y, r); undefined is 0."""
    chosen = correlation_features(df, features)
    if len(chosen) < 2:
        raise ValueError("at least 2 numeric features are needed")
    upper = _upper_triangle(df, chosen)
    both = F.array(F.struct("x", "y", "r"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    return upper.select(F.inline(F.slice(both, 1, F.when(F.col("x") == F.col("y"), 1).otherwise(2))))


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same as a square table, one row per feature."""
    chosen = correlation_features(df, features)
    return correlate(df, features).groupBy("x").pivot("y", chosen).agg(F.first("r"))


def _pair_moments(raw: np.ndarray) -> np.ndarray:
    """(8, d, d) for a block of rows: n, both means, both squared spreads, the cross spread, and whether each side varies.

    Everything is over the rows where both features of a pair are present, centred on the means of
    just these rows; a feature that is constant over them has a spread of exactly 0.
    """
    size = raw.shape[1]
    present = ~np.isnan(raw)
    out = np.zeros((8, size, size))
    out[6], out[7] = np.inf, -np.inf
    for i in range(size):
        rows, mask = raw[present[:, i]], present[present[:, i]]
        n = mask.sum(0)
        value = np.where(mask, rows, 0.0)
        mine = np.where(mask, rows[:, i : i + 1], 0.0)
        means = mine.sum(0) / np.maximum(n, 1), value.sum(0) / np.maximum(n, 1)
        x = np.where(mask, rows[:, i : i + 1] - means[0], 0.0)
        y = np.where(mask, rows - means[1], 0.0)
        out[:6, i] = n, *means, (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
        if len(rows):
            out[6, i] = np.where(mask, rows[:, i : i + 1], np.inf).min(0)
            out[7, i] = np.where(mask, rows[:, i : i + 1], -np.inf).max(0)
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together (the pairwise update of Chan, Golub and LeVeque)."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy = b[1] - a[1], b[2] - a[2]
    both = a[0] * share
    return np.stack(
        [
            n,
            a[1] + dx * share,
            a[2] + dy * share,
            a[3] + b[3] + dx * dx * both,
            a[4] + b[4] + dy * dy * both,
            a[5] + b[5] + dx * dy * both,
            np.minimum(a[6], b[6]),
            np.maximum(a[7], b[7]),
        ]
    )


def _upper_triangle(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x, y, r) with x not after y. Each task merges its rows' moments; one row per task and pair is left to sum."""
    names = list(features)
    centre = [s.mean if s.mean is not None else 0.0 for s in column_stats(df, names)]
    # Values near their overall mean keep the sums over tasks from cancelling; a constant stays one.
    clean = df.select(*[(finite(F.col(quoted(f))) - F.lit(c)).alias(f"f{i}") for i, (f, c) in enumerate(zip(names, centre))])
    size = len(names)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = _pair_moments(np.zeros((0, size)))
        for batch in batches:
            total = _merged(total, _pair_moments(batch.to_numpy(dtype=float)))
        rows, cols = np.triu_indices(size)
        found = {f"m{k}": total[k][rows, cols] for k in range(6)}
        # The range of the second feature of a pair is that of the first one of the mirrored pair.
        ranges = {"x0": total[6][rows, cols], "x1": total[7][rows, cols], "y0": total[6][cols, rows], "y1": total[7][cols, rows]}
        yield pd.DataFrame({"i": rows, "j": cols, **found, **ranges})

    columns = [*(f"m{k}" for k in range(6)), "x0", "x1", "y0", "y1"]
    parts = clean.mapInPandas(moments, "i int, j int, " + ", ".join(f"{c} double" for c in columns))
    n, mx, my = F.col("m0"), F.col("m1"), F.col("m2")
    sums = parts.where("m0 > 0").groupBy("i", "j").agg(
        F.sum(n).alias("n"),
        F.sum(n * mx).alias("sx"),
        F.sum(n * my).alias("sy"),
        F.sum(F.col("m3") + n * mx * mx).alias("xx"),
        F.sum(F.col("m4") + n * my * my).alias("yy"),
        F.sum(F.col("m5") + n * mx * my).alias("xy"),
        ((F.min("x0") < F.max("x1")) & (F.min("y0") < F.max("y1"))).alias("varies"),
    )
    spread = lambda square, a, b: F.greatest(F.col(square) - F.col(a) * F.col(b) / F.col("n"), F.lit(0.0))
    norm = F.sqrt(spread("xx", "sx", "sx")) * F.sqrt(spread("yy", "sy", "sy"))
    cross = F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")
    r = F.when(F.col("varies") & (norm > 0), cross / norm)
    pairs = df.sparkSession.createDataFrame(
        [(i, j, names[i], names[j]) for i in range(size) for j in range(i, size)], "i int, j int, x string, y string"
    )
    return pairs.join(sums.select("i", "j", r.alias("r")), ["i", "j"], "left").select("x", "y", F.coalesce("r", F.lit(0.0)).alias("r"))
