"""Outlier detection: isolation forest and local outlier factor."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.operators.clean import COORDINATES, ID, FeatureSpace, feature_space
from runscope.operators.neighbors import distinct_neighbors, member_pool
from runscope.plans.blocks import BLOCK_ROWS, LEAF_ROWS
from runscope.plans.ordering import exact_quantile
from runscope.plans.stage import StageArea

ALGORITHMS = ("isoforest", "lof")
# Defaults of the outlier operators.
CONTAMINATION = 0.1
N_NEIGHBORS = 20
TREES = 100
TREE_ROWS = 256
SEED = 42
DENSITY_FLOOR = 1e-10
EULER_GAMMA = 0.5772156649015329


def detect_outliers(
    df: DataFrame,
    algorithm: str = "isoforest",
    features: Sequence[str] | None = None,
    contamination: float = CONTAMINATION,
    n_neighbors: int = N_NEIGHBORS,
    on_projection: bool = False,
    area: StageArea | None = None,
) -> DataFrame:
    """(shot_id, is_outlier, score) of the whole table; lower scores are stranger.

    Unknown algorithm, no valid feature or no rows give an empty result.
    """
    space = feature_space(df, COORDINATES if on_projection else features)
    if algorithm not in ALGORITHMS or not space.features:
        return df.select(ID, F.lit(0).alias("is_outlier"), F.lit(0.0).alias("score")).limit(0)
    area = area or StageArea(df.sparkSession, "outliers")
    if algorithm == "lof":
        scored = local_outlier_factor(space, n_neighbors, area)
    else:
        scored = isolation_forest(space, area)
    scored = area.put(scored, "scores")
    threshold = exact_quantile(scored, "score", contamination)
    return scored.select(ID, (F.col("score") < F.lit(threshold)).cast("int").alias("is_outlier"), "score")


def local_outlier_factor(
    space: FeatureSpace, n_neighbors: int, area: StageArea, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(shot_id, score) with score = -LOF.

    All copies of a vector have the same distances, hence the same score: everything is computed
    once per distinct vector, and a neighbour shared by many copies is joined once.
    """
    total = space.frame.count()
    k = min(n_neighbors, total - 1)
    if k < 1:
        return space.frame.select(ID, F.lit(-1.0).alias("score"))
    points, pairs = distinct_neighbors(space, k, area, leaf_rows, block_rows)
    # The pool holds k+1 runs; leaving out the leading run of the vector itself leaves k neighbours.
    pools = area.put(
        member_pool(points, pairs, k).select(
            "id", F.slice(F.filter("pool", lambda e: e["run"] != F.col("id")), 1, k).alias("near")
        ),
        "pools",
    )
    owner = points.select("id", F.explode("members").alias("run"))
    reach = pools.select("id", F.element_at("near", -1)["score"].alias("k_distance"))
    links = area.put(
        pools.select("id", F.inline("near")).join(owner.withColumnRenamed("id", "partner"), "run").select("id", "partner", "score"),
        "links",
    )
    reached = links.join(reach.withColumnRenamed("id", "partner"), "partner")
    density = area.put(
        reached.groupBy("id").agg(
            (1.0 / (F.avg(F.greatest("score", "k_distance")) + F.lit(DENSITY_FLOOR))).alias("density")
        ),
        "density",
    )
    around = links.join(density.withColumnRenamed("id", "partner"), "partner").groupBy("id").agg(F.avg("density").alias("mean"))
    factor = density.join(around, "id").select("id", (-F.col("mean") / F.col("density")).alias("score"))
    scored = points.select("id", "vec").join(factor, "id").select("vec", "score")
    return space.vectors().join(scored, "vec").select(ID, "score")


def isolation_forest(
    space: FeatureSpace, area: StageArea, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED
) -> DataFrame:
    """(shot_id, score) with score = -2^(-mean path / expected path).

    Every tree grows from its own random draw of at most *tree_rows* rows, as the method defines, out of
    one pool drawn by a hash per row; all rows are scored. The forest has at most trees * (2 * tree_rows - 1) nodes.
    """
    vectors = area.put(space.vectors(), "vectors")
    total = vectors.count()
    per_tree = min(tree_rows, total)
    grown = _draws(vectors, total, trees, per_tree, seed).groupBy("tree").applyInPandas(
        _grower(per_tree, seed), "tree int, node int, feature int, split double, left int, right int, depth double"
    )
    nodes = grown.toPandas().sort_values(["tree", "node"])
    forest = [
        tuple(part[c].to_numpy() for c in ("feature", "split", "left", "right", "depth"))
        for _, part in nodes.groupby("tree")
    ]
    shared = space.frame.sparkSession.sparkContext.broadcast(forest)
    expected = _average_path(per_tree)

    @F.pandas_udf("double")
    def score(vec: pd.Series) -> pd.Series:
        x = np.stack(vec.to_numpy()).astype(float)
        rows = np.arange(len(x))
        path = np.zeros(len(x))
        for feature, split, left, right, depth in shared.value:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = left[at] >= 0
                if not inner.any():
                    break
                goes_left = x[rows, np.maximum(feature[at], 0)] <= split[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            path += depth[at]
        return pd.Series(-np.exp2(-path / len(shared.value) / max(expected, 1e-12)))

    return vectors.select(ID, score("vec").alias("score"))


def _draws(vectors: DataFrame, total: int, trees: int, per_tree: int, seed: int) -> DataFrame:
    """(tree, draw, vec): a few more than *per_tree* random rows for every tree.

    One hash per row draws the pool, about as many rows as all trees need; only rows of the pool are
    dealt, and a row is copied only to the trees that take it.
    """
    wanted = per_tree + 8 * per_tree**0.5 + 32
    pool = min(1.0, trees * wanted / total)
    # Of the rows of the pool each tree takes this share.
    share = min(1.0, wanted / (pool * total))
    drawn = vectors.select(ID, "vec", F.xxhash64(ID, F.lit(seed)).alias("ticket")).where(_below("ticket", pool))
    takers = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: _below(F.xxhash64("ticket", tree, F.lit(seed)), share)
    )
    dealt = drawn.select(ID, "vec", "ticket", F.explode(takers).alias("tree"))
    return dealt.select("tree", F.xxhash64("ticket", "tree", F.lit(seed)).alias("draw"), "vec")


def _below(number: Column | str, share: float) -> Column:
    """True for this share of all 64-bit numbers."""
    number = F.col(number) if isinstance(number, str) else number
    return F.shiftright(number, 1).cast("double") + F.lit(2.0**62) <= F.lit(share * 2.0**63)


def _average_path(rows: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of *rows* leaves."""
    if rows <= 1:
        return 0.0
    if rows <= 2:
        return 1.0
    return 2.0 * (np.log(rows - 1.0) + EULER_GAMMA) - 2.0 * (rows - 1.0) / rows


def _grower(per_tree: int, seed: int):
    limit = int(np.ceil(np.log2(max(per_tree, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw").head(per_tree)
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        random = np.random.default_rng([seed, tree])
        out: list[list] = []
        waiting = [(np.arange(len(x)), 0, -1, 0)]
        while waiting:
            rows, depth, parent, side = waiting.pop()
            node = len(out)
            out.append([tree, node, -1, 0.0, -1, -1, depth + _average_path(len(rows))])
            if parent >= 0:
                out[parent][4 + side] = node
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or len(usable) == 0:
                continue
            feature = int(random.choice(usable))
            split = float(random.uniform(low[feature], high[feature]))
            goes_left = x[rows, feature] <= split
            out[node][2], out[node][3] = feature, split
            waiting.append((rows[goes_left], depth + 1, node, 0))
            waiting.append((rows[~goes_left], depth + 1, node, 1))
        return pd.DataFrame(out, columns=["tree", "node", "feature", "split", "left", "right", "depth"])

    return grow
