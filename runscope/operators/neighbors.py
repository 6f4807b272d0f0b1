"""Similar-run search and the batch nearest-neighbour join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runscope.functions import distance, rank_opacity
from runscope.operators.clean import (
    ID,
    FeatureSpace,
    as_feature,
    default_features,
    feature_space,
    space_from_stats,
    stats_columns,
    stats_from_row,
)
from runscope.plans.blocks import BLOCK_ROWS, LEAF_ROWS, TIE_DIGITS, distinct_points, nearest
from runscope.plans.stage import StageArea
from runscope.sources.columns import quoted

DEFAULT_K = 10


def find_similar(df: DataFrame, query_id: int, k: int = DEFAULT_K, features: Sequence[str] | None = None) -> DataFrame:
    """The *k* runs closest to *query_id*, as (shot_id, rank, score).

    One pass collects the column statistics and the query's own values; the second computes
    distances and keeps k rows per task. An unknown ID gives no rows; if none of the wanted features
    exists, the default ones are used.
    """
    chosen = [f for f in features or () if f in df.columns] or default_features(df)
    empty = df.select(ID, F.lit(0).alias("rank"), F.lit(0.0).alias("score")).limit(0)
    if not chosen:
        return empty
    own = F.struct(*[as_feature(df, c).alias(f"q{i}") for i, c in enumerate(chosen)])
    is_query = F.col(ID) == F.lit(query_id)
    row = df.agg(*stats_columns(df, chosen), F.first(F.when(is_query, own), ignorenulls=True).alias("query")).first()
    if row["query"] is None:
        return empty
    stats = stats_from_row(row, chosen)
    space = space_from_stats(df, stats)
    target = [s.standardised(F.lit(row["query"][f"q{i}"]).cast("double")) for i, s in enumerate(stats) if not s.all_missing]
    if not target:
        return empty
    scored = space.frame.where(~is_query).select(
        ID, F.round(distance([F.col(quoted(f)) for f in space.features], target), TIE_DIGITS).alias("score")
    )
    best = scored.orderBy("score", ID).limit(k)
    return best.select(ID, F.row_number().over(Window.orderBy("score", ID)).alias("rank"), "score")


def highlight(hits: DataFrame, points: DataFrame, total: int) -> DataFrame:
    """Search hits with their coordinates and a weight that fades with the rank."""
    faded = hits.select(ID, "rank", rank_opacity(F.col("rank") - 1, F.lit(total)).alias("opacity"))
    return points.join(faded, ID)


def knn_join(
    df: DataFrame,
    k: int = DEFAULT_K,
    features: Sequence[str] | None = None,
    area: StageArea | None = None,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The *k* nearest runs of every run, as (shot_id, neighbor_id, rank, score). Exact."""
    area = area or StageArea(df.sparkSession, "knn")
    space = feature_space(df, features)
    if not space.features:
        return df.select(ID, F.col(ID).alias("neighbor_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("score")).limit(0)
    return expand_neighbors(space, k, area, leaf_rows, block_rows)


def distinct_neighbors(
    space: FeatureSpace, k: int, area: StageArea, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Distinct points with their members, and for each the *k* nearest distinct points."""
    points = area.put(distinct_points(space.vectors(), k + 1), "points")
    pairs = nearest(
        points.select("id", "vec", F.lit(1.0).alias("weight")), k, area, leaf_rows=leaf_rows, block_rows=block_rows
    )
    return points, pairs


def member_pool(points: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(id, pool): for each distinct point, k+1 candidate (score, run) structs in order, own copies included.

    k+1 suffice: a run leaves out itself and needs k more. Every distinct partner brings at most
    k+1 runs, so a pool is assembled from a bounded number of candidates.
    """
    others = pairs.join(points.select(F.col("id").alias("partner"), "members"), "partner").select("id", "score", "members")
    own = points.select("id", F.lit(0.0).alias("score"), "members")
    runs = own.unionByName(others).select("id", "score", F.explode("members").alias("run"))
    order = Window.partitionBy("id").orderBy("score", "run")
    kept = runs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1)
    return kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("score", "run"))).alias("pool"))


def expand_neighbors(
    space: FeatureSpace, k: int, area: StageArea, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    points, pairs = distinct_neighbors(space, k, area, leaf_rows, block_rows)
    pools = points.select("id", "vec").join(member_pool(points, pairs, k), "id").select("vec", "pool")
    runs = space.vectors().join(pools, "vec").select(ID, F.filter("pool", lambda e: e["run"] != F.col(ID)).alias("pool"))
    return runs.select(ID, F.posexplode(F.slice("pool", 1, k)).alias("rank", "hit")).select(
        ID, F.col("hit.run").alias("neighbor_id"), (F.col("rank") + 1).alias("rank"), F.col("hit.score").alias("score")
    )
