"""Neighbour-graph embedding: points that are close in feature space end up close in the plane.

Same purpose as a UMAP projection, built from joins: the exact neighbour table gives fuzzy edge
weights, principal components the first layout, and a given number of rounds then pulls neighbours
together and pushes random pairs apart. Not bit-equal to any single-machine implementation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.operators.clean import FeatureSpace
from runscope.operators.neighbors import distinct_neighbors
from runscope.plans.ordering import number_rows
from runscope.plans.stage import StageArea

N_NEIGHBORS = 15  # the point itself included
ROUNDS = 15
NEGATIVES = 15  # random partners per point and round; fewer make the rounds noisy
SEED = 42
# Curve of the low-dimensional similarity for min_dist 0.1 and spread 1.
CURVE_A = 1.577
CURVE_B = 0.8951
START_SPAN = 10.0  # the first layout lies within this distance of the centre on both axes
CLIP = 4.0


def principal_axes(vectors: DataFrame, k: int) -> np.ndarray:
    """Leading principal directions of a (vec) table as rows; only a d*d matrix is gathered.

    Sign rule: of the loadings within 1e-9 of the largest size the first one is positive.
    """
    model = PCA(k=k, inputCol="features", outputCol="out").fit(vectors.select(array_to_vector("vec").alias("features")))
    axes = np.array(model.pc.toArray()).T
    for axis in axes:
        size = np.abs(axis)
        lead = int(np.argmax(size >= size.max() - 1e-9))
        if axis[lead] < 0:
            axis *= -1
    return axes


def dot(vec: Column, weights: np.ndarray) -> Column:
    products = F.zip_with(vec, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def _bandwidth(scores: pd.Series) -> pd.DataFrame:
    """Distance of the nearest distinct neighbour and the scale at which the weights sum to log2(k)."""
    width = int(scores.map(len).max())
    table = np.full((len(scores), width), np.inf)
    for i, row in enumerate(scores):
        table[i, : len(row)] = row
    nearest = np.where(table > 0, table, np.inf).min(axis=1)
    nearest[~np.isfinite(nearest)] = 0.0
    target = np.log2(np.maximum(scores.map(len).to_numpy() + 1, 2))
    excess = np.maximum(table - nearest[:, None], 0.0)
    low, high = np.zeros(len(table)), np.full(len(table), np.inf)
    sigma = np.ones(len(table))
    for _ in range(64):
        total = np.exp(-excess / sigma[:, None]).sum(axis=1)
        above = total > target
        high, low = np.where(above, sigma, high), np.where(above, low, sigma)
        sigma = np.where(np.isfinite(high), (low + high) / 2, sigma * 2)
        sigma = np.clip(sigma, 1e-12, 1e12)
    return pd.DataFrame({"rho": nearest, "sigma": sigma})


def fuzzy_edges(pairs: DataFrame) -> DataFrame:
    """Symmetric weights (low, high, w) of a neighbour table (id, partner, score)."""
    scale = F.pandas_udf(_bandwidth, "rho double, sigma double")
    lists = pairs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("score", "partner"))).alias("near"))
    scaled = lists.select("id", "near", scale(F.col("near.score")).alias("s"))
    one_way = scaled.select("id", "s", F.inline("near")).select(
        "id",
        "partner",
        F.exp(-F.greatest(F.col("score") - F.col("s.rho"), F.lit(0.0)) / F.col("s.sigma")).alias("w"),
    )
    merged = one_way.groupBy(F.least("id", "partner").alias("low"), F.greatest("id", "partner").alias("high"))
    both = merged.agg(F.sum("w").alias("sum"), (F.min("w") * F.max("w")).alias("product"), F.count("*").alias("n"))
    return both.select("low", "high", F.when(F.col("n") > 1, F.col("sum") - F.col("product")).otherwise(F.col("sum")).alias("w"))


def neighbour_layout(
    space: FeatureSpace, area: StageArea, n_neighbors: int = N_NEIGHBORS, rounds: int = ROUNDS
) -> DataFrame:
    """(id, vec, umap_x, umap_y), one row per distinct vector. All edges pull in all *rounds*; with no round
    the first layout is returned."""
    points, pairs = distinct_neighbors(space, n_neighbors - 1, area)
    nodes = area.put(number_rows(points.select("id", "vec"), ["id"], "node", area), "nodes")
    total = nodes.count()
    keys = nodes.select("id", "node")
    edges = fuzzy_edges(pairs)
    edges = edges.join(keys.select(F.col("id").alias("low"), F.col("node").alias("i")), "low")
    edges = edges.join(keys.select(F.col("id").alias("high"), F.col("node").alias("j")), "high").select("i", "j", "w")
    directed = area.put(edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), "edges")
    edges = directed.withColumn("pull", F.lit(True))

    axes = principal_axes(nodes, 2)
    start = nodes.select("node", dot(F.col("vec"), axes[0]).alias("x"), dot(F.col("vec"), axes[1]).alias("y"))
    spread = start.agg(F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y")).first()
    placed = [_start_position(c, spread[c]).alias(c) for c in ("x", "y")]
    layout = area.put(start.select("node", *placed), "layout")
    for done in range(rounds):
        following = area.put(_round(layout, edges, total, done, rounds), "layout")
        area.drop(layout)
        layout = following
    placed = layout.select("node", F.col("x").alias("umap_x"), F.col("y").alias("umap_y"))
    return nodes.join(placed, "node").drop("node")


def _start_position(axis: str, deviation: float | None) -> Column:
    """Three deviations fill the span; points further out are held at its edge."""
    scaled = F.col(axis) / F.lit((deviation or 1.0) * 3 / START_SPAN)
    return F.least(F.greatest(scaled, F.lit(-START_SPAN)), F.lit(START_SPAN))


def _round(layout: DataFrame, edges: DataFrame, total: int, done: int, rounds: int) -> DataFrame:
    """One round. Random partners are computed from the node number, so they join by key as edges do."""
    random_node = F.pmod(F.xxhash64("i", F.lit(done + SEED), "draw"), F.lit(total))
    own = layout.select(F.col("node").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    other = layout.select(F.col("node").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    pushes = own.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(NEGATIVES)))).select(
        "i", "xi", "yi", random_node.alias("j"), F.lit(1.0).alias("w"), F.lit(False).alias("pull")
    )
    pulls = edges.join(own, "i").select("i", "xi", "yi", "j", "w", "pull")
    moved = pulls.unionByName(pushes).join(other, "j")
    dx, dy = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    squared = dx * dx + dy * dy
    powered = F.pow(squared, F.lit(CURVE_B))
    pull = F.when(squared > 0, F.lit(-2 * CURVE_A * CURVE_B) * powered / squared / (1 + F.lit(CURVE_A) * powered)).otherwise(0.0)
    push = F.lit(2 * CURVE_B) / ((squared + 0.001) * (1 + F.lit(CURVE_A) * powered))
    slope = F.when(F.col("pull"), pull).otherwise(push)

    def force(delta: Column) -> Column:
        step = F.least(F.greatest(slope * delta, F.lit(-CLIP)), F.lit(CLIP)) * F.col("w")
        drawn = F.sum(F.when(F.col("pull"), step)) / F.sum(F.when(F.col("pull"), F.col("w")))
        driven = F.sum(F.when(~F.col("pull"), step)) / F.lit(NEGATIVES)
        return F.coalesce(drawn, F.lit(0.0)) + F.coalesce(driven, F.lit(0.0))

    rate = F.lit(1.0 - done / rounds)
    # Every point has push rows, so none is lost, and its own position comes with each row.
    return moved.groupBy(F.col("i").alias("node")).agg(
        (F.min("xi") + rate * force(dx)).alias("x"), (F.min("yi") + rate * force(dy)).alias("y")
    )
