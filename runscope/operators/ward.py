"""Agglomerative clustering with Ward linkage, exact.

Merging every pair of clusters that are each other's nearest builds the same tree as merging the
closest pair one at a time, because Ward distances never shrink by a merge. That has two uses here.

*Inside a leaf.* Each round deals the clusters to the leaves of a tree over randomly turned axes. A task merges
the pairs of its leaf, one after the other, as long as the boxes of the other leaves prove that no cluster
there can be nearer: merges elsewhere keep centres inside their boxes and only add weight, so the proof outlasts them.
A last leaf that holds all clusters merges them to one.

*Across leaves.* Where boxes prove too little, as in many axes, the nearest partner of each cluster is searched with
the blocked join. Partners are kept in a table from then on: a merge never brings a third cluster closer than its
partner was, so only merged clusters and those whose partner has merged are searched again.

The tree is cut by leaving out its highest merges.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.operators.clean import ID, FeatureSpace
from runscope.plans.blocks import BLOCK_ROWS, Boxes, nearest, rank_split, sample_tree
from runscope.plans.ordering import number_rows
from runscope.plans.stage import StageArea

#: Clusters that a task holds in one leaf; larger leaves are halved, as their own leaves, where they are.
LEAF_ROWS = 2048
#: A round in leaves that joins less than this share of all clusters is followed by one across leaves.
WORTHWHILE = 0.1
_STATE = "id long, vec array<double>, weight double"
_LOCAL = f"{_STATE}, a long, b long, height double, step long"


def agglomerate(
    space: FeatureSpace,
    n_clusters: int,
    area: StageArea,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
    worthwhile: float = WORTHWHILE,
) -> DataFrame:
    """(shot_id, cluster_id), clusters numbered by their smallest run.

    Equal vectors always share a cluster, so there are never more clusters than distinct vectors.
    """
    vectors = space.vectors()
    points = area.put(vectors.groupBy("vec").agg(F.min(ID).alias("id"), F.count("*").alias("weight")), "points")
    # A cluster is named by its smallest run; its vector is the centre of all its members.
    state = points.select("id", "vec", F.col("weight").cast("double").alias("weight"))
    merges: list[DataFrame] = []
    partners = None
    rows, local = state.count(), True
    for step in count():
        if rows <= 1:
            break
        if local:
            state, pairs, left = _merge_in_leaves(state, rows, len(space.features), step, leaf_rows, area)
            local = rows - left >= worthwhile * rows
        else:
            local = True
            partners = _kept_partners(state, partners, rows, area, leaf_rows, block_rows)
            pairs = area.put(_mutual(partners, step), "merges")
            state = area.put(_merged(state, pairs), "state")
            left = state.count()
            if left == rows:
                raise RuntimeError("no two clusters are each other's nearest")
        if partners is not None:
            gone = pairs.select(F.explode(F.array("a", "b")).alias("id"))
            partners = partners.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "partner"), "partner", "left_anti")
            partners = area.put(partners.select("id", "partner", "score"), "partners")
        merges.append(pairs)
        rows = left

    tree = reduce(DataFrame.unionByName, merges) if merges else points.selectExpr("id AS a", "id AS b", "0D AS height", "0L AS step").limit(0)
    highest = tree.orderBy(F.desc("height"), F.desc("step"), "a", "b").limit(max(n_clusters - 1, 0))
    kept = tree.join(highest.select("a", "b"), ["a", "b"], "left_anti")
    found = _roots(area.put(kept.select(F.col("b").alias("id"), F.col("a").alias("first")), "absorbed"), area)
    groups = area.put(points.select("id", "vec").join(found, "id", "left").select("vec", F.coalesce("first", "id").alias("first")), "groups")
    numbers = number_rows(groups.select("first").distinct(), ["first"], "cluster_id", area)
    labels = groups.join(numbers, "first").select("vec", F.col("cluster_id").cast("long").alias("cluster_id"))
    return vectors.join(labels, "vec").select(ID, "cluster_id")


def _roots(absorbed: DataFrame, area: StageArea) -> DataFrame:
    """(id, first): the cluster each one ends in. A cluster is absorbed once, by one of a smaller name, so pointers are doubled."""
    while True:
        onward = absorbed.select(F.col("id").alias("first"), F.col("first").alias("next"))
        found = area.put(absorbed.select("id", "first").join(onward, "first", "left").select("id", F.coalesce("next", "first").alias("first"), "next"), "absorbed")
        area.drop(absorbed)
        absorbed = found
        if found.where(F.col("next").isNotNull()).isEmpty():
            return found.drop("next")


def _kept_partners(
    state: DataFrame, known: DataFrame | None, rows: int, area: StageArea, leaf_rows: int, block_rows: int
) -> DataFrame:
    """(id, partner, score) of every cluster; only those without a kept partner are searched."""
    asking = state
    if known is not None:
        asking = state.join(known.select("id", F.lit(False).alias("asks")), "id", "left").fillna(True, ["asks"])
        asking = area.put(asking, "asking")
    found = nearest(asking, 1, area, ward=True, leaf_rows=4 * leaf_rows, block_rows=block_rows, rows=rows)
    found = found.select("id", "partner", "score")
    found = area.put(found if known is None else found.unionByName(known), "partners")
    if known is not None and _mutual(found, 0).isEmpty():
        # Ties between old and new partners can leave no pair; fresh ones, with ties broken alike, cannot.
        return _kept_partners(state, None, rows, area, leaf_rows, block_rows)
    return found


def _mutual(partners: DataFrame, step: int) -> DataFrame:
    back = partners.select(F.col("id").alias("partner"), F.col("partner").alias("id"))
    mutual = partners.where(F.col("id") < F.col("partner")).join(back, ["id", "partner"])
    return mutual.select(
        F.col("id").alias("a"), F.col("partner").alias("b"), F.col("score").alias("height"), F.lit(step << 32).cast("long").alias("step")
    )


def _merged(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters after the merges of one round."""
    target = F.coalesce("a", "id").alias("id")
    moved = state.join(pairs.select(F.col("b").alias("id"), "a"), "id", "left").select(target, "vec", "weight")
    # At most two rows share a name, so the lists below have one or two entries.
    both = moved.groupBy("id").agg(F.collect_list(F.struct("vec", "weight")).alias("parts"))
    first, second = F.col("parts")[0], F.get("parts", F.lit(1))
    total = first["weight"] + second["weight"]
    centre = F.zip_with(
        first["vec"], second["vec"], lambda x, y: (x * first["weight"] + y * second["weight"]) / total
    )
    return both.select(
        "id",
        F.coalesce(centre, first["vec"]).alias("vec"),
        F.coalesce(total, first["weight"]).alias("weight"),
    )


def _merge_in_leaves(
    state: DataFrame, rows: int, dims: int, step: int, leaf_rows: int, area: StageArea
) -> tuple[DataFrame, DataFrame, int]:
    """The clusters left, the merges made, and how many are left, after the merges that leaves can prove."""
    turn = np.linalg.qr(np.random.default_rng(step).normal(size=(dims, dims)))[0] if step else np.eye(dims)
    tree = sample_tree(state, rows, leaf_rows, turn)
    others = Boxes(np.zeros(0, np.int64), *(np.zeros((0, dims)) for _ in "lh"), np.zeros(0))
    placed = state.withColumn("leaf", F.lit(0))
    if tree:
        @F.pandas_udf("struct<leaf: int, turned: array<double>>")
        def place(vec: pd.Series) -> pd.DataFrame:
            turned = np.stack(vec.to_numpy()).astype(float) @ turn
            return pd.DataFrame({"leaf": tree.assign(turned).astype("int32"), "turned": list(turned)})

        placed = state.withColumn("place", place("vec")).select("id", "vec", "weight", "place.leaf", "place.turned")
        others = _boxes(placed, dims)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, pdf = int(pdf["leaf"].iloc[0]), pdf.sort_values("id")
        away = others.names != leaf
        away = Boxes(*(part[away] for part in (others.names, others.lows, others.highs, others.weights)))
        ids, points = pdf["id"].to_numpy(), np.stack(pdf["vec"].to_numpy()).astype(float)
        weights = pdf["weight"].to_numpy(float)
        parts = [np.sort(part) for part in rank_split(points @ turn, 2 * leaf_rows)]
        out = []
        for i, part in enumerate(parts):
            beside = [_box_of(points[other] @ turn, weights[other]) for j, other in enumerate(parts) if j != i]
            boxes = Boxes(*(np.concatenate([a, *b]) for a, b in zip((away.names, away.lows, away.highs, away.weights), zip(*beside, strict=True), strict=True))) if beside else away
            out += merge_while_proven(ids[part], points[part], weights[part], boxes, turn, step << 32)
        return pd.DataFrame(out, columns=["id", "vec", "weight", "a", "b", "height", "step"]).astype({c: "Int64" for c in ("id", "a", "b", "step")})

    done = area.put(placed.groupBy("leaf").applyInPandas(run, _LOCAL), "local")
    state = done.where(F.col("id").isNotNull()).select("id", "vec", "weight")
    return state, done.where(F.col("id").isNull()).select("a", "b", "height", "step"), state.count()


def _boxes(placed: DataFrame, dims: int) -> Boxes:
    """True boxes of all leaves, in turned axes; there are at most MOST_LEAVES of them."""
    box = [F.min(F.col("turned")[i]).alias(f"lo{i}") for i in range(dims)] + [F.max(F.col("turned")[i]).alias(f"hi{i}") for i in range(dims)]
    found = placed.groupBy("leaf").agg(F.min("weight").alias("w"), *box).collect()
    bounds = (np.array([[r[f"{end}{i}"] for i in range(dims)] for r in found], dtype=float) for end in ("lo", "hi"))
    return Boxes(np.array([r["leaf"] for r in found], dtype=np.int64), *bounds, np.array([r["w"] for r in found], dtype=float))


def _box_of(points: np.ndarray, weights: np.ndarray) -> tuple:
    return np.array([-1]), points.min(axis=0)[None], points.max(axis=0)[None], np.array([weights.min()])


def merge_while_proven(
    ids: np.ndarray, centre: np.ndarray, weight: np.ndarray, others: Boxes, turn: np.ndarray, step: int
) -> list[tuple]:
    """Clusters left, as (id, vec, weight, ...), and merges, as (..., a, b, height, step), of one leaf.

    Pairs that are each other's nearest in the leaf merge if they are no farther apart than any cluster in the
    boxes of *others* can be.
    """
    n = len(ids)
    centre, weight, alive = centre.copy(), weight.copy(), np.ones(n, bool)

    def costs(rows: np.ndarray) -> np.ndarray:
        """Ward costs of some rows with all, summed one dimension at a time."""
        total = np.zeros((len(rows), n))
        for i in range(centre.shape[1]):
            gap = centre[rows, i, None] - centre[None, :, i]
            total += gap * gap
        total *= weight[rows, None] * weight[None] / (weight[rows, None] + weight[None])
        total[np.arange(len(rows)), rows] = np.inf
        total[:, ~alive] = np.inf
        return total

    def outside(rows: np.ndarray) -> np.ndarray:
        if not len(others.names):
            return np.full(len(rows), np.inf)
        return others.least_scores(centre[rows] @ turn, weight[rows], True).min(axis=1) * (1 - 1e-9)

    everyone = np.arange(n)
    best, near, limit = np.full(n, np.inf), np.zeros(n, np.int64), np.empty(n)

    def search(rows: np.ndarray) -> None:
        for low in range(0, len(rows), 512):
            part = rows[low : low + 512]
            table = costs(part)
            near[part] = table.argmin(axis=1)
            best[part] = table[np.arange(len(part)), near[part]]
            limit[part] = outside(part)

    search(everyone)
    merges: list[tuple] = []
    while alive.sum() > 1:
        rows = np.flatnonzero(alive & (near > everyone) & (near[near] == everyone))
        rows = rows[best[rows] <= np.minimum(limit[rows], limit[near[rows]])]
        if not len(rows):
            # With ties no two may name each other; the least of all costs is mutual in any case.
            open_ = np.where(alive, best, np.inf)
            one = int(open_.argmin())
            if open_[one] > min(limit[one], limit[near[one]]):
                break
            rows = np.array([min(one, near[one])])
            near[rows[0]], best[rows[0]] = max(one, near[one]), open_[one]
        gone = near[rows]
        merges += [(ids[a], ids[b], best[a], step + len(merges) + i) for i, (a, b) in enumerate(zip(rows, gone, strict=True))]
        total = weight[rows] + weight[gone]
        centre[rows] = (centre[rows] * weight[rows, None] + centre[gone] * weight[gone, None]) / total[:, None]
        weight[rows] = total
        alive[gone] = False
        touched = np.zeros(n, bool)
        touched[rows] = touched[gone] = True
        search(np.flatnonzero(alive & (touched | touched[near])))
    out = [(ids[i], centre[i], weight[i], None, None, None, None) for i in np.flatnonzero(alive)]
    return out + [(None, None, None, *merge) for merge in merges]
