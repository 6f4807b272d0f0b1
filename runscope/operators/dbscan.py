"""Density clustering on a grid of cells whose diagonal is eps.

Points of one cell are always neighbours, so crowded cells need no pairs at all: their points are
core points and belong together. Distances are computed only for points of thinly filled cells
(fewer than ``min_samples`` each), and two cells are linked by halving their boxes until one pair
of points within eps is found or none can exist.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.functions import array_distance
from runscope.operators.clean import ID, FeatureSpace
from runscope.operators.graph import connected_components
from runscope.plans.blocks import within
from runscope.plans.ordering import number_rows
from runscope.plans.stage import StageArea

BINNED_AXES = 3  # with more, nearby cells are searched in a tree instead of in neighbouring bins
SALT_ROWS = 200_000  # rows of one cell that a task compares at a time
DIRECT_PAIRS = 1024  # box pairs with at most this many point pairs are compared point by point
LAST_LEVEL = 60  # halvings after which boxes are as small as numbers can tell; what is open then is compared point by point


def dbscan(space: FeatureSpace, eps: float, min_samples: int, area: StageArea) -> DataFrame:
    """(shot_id, cluster_id). Noise is -1; clusters are numbered by their smallest core run, and a
    border run joins the lowest-numbered cluster within reach."""
    if eps <= 0:
        raise ValueError("eps must be greater than 0")
    dims = len(space.features)
    vectors = space.vectors()
    side = eps / math.sqrt(dims) * (1 - 1e-12)
    # "n" counts the copies of a vector: they are all neighbours of each other.
    points = area.put(
        vectors.groupBy("vec")
        .agg(F.min(ID).alias("id"), F.count("*").alias("n"))
        .withColumn("cell", F.transform("vec", lambda x: F.floor(x / F.lit(side)))),
        "points",
    )
    cells = area.put(
        points.groupBy("cell").agg(
            F.min("id").alias("cid"), F.sum("n").alias("cell_n"), F.count("*").alias("cell_rows")
        ),
        "cells",
    )
    located = area.put(
        points.join(cells, "cell").select("id", "vec", "n", "cid", "cell_n", "cell_rows"),
        "located",
    )
    near = area.put(_near_cells(cells, dims, area), "near")
    hits = area.put(_thin_neighbours(located, near, eps, min_samples), "hits")

    thin_core = hits.groupBy("id").agg(F.sum("n").alias("reach")).where(F.col("reach") >= min_samples).select("id")
    crowded = located.where(F.col("cell_n") >= min_samples)
    core = area.put(
        crowded.unionByName(located.where(F.col("cell_n") < min_samples).join(thin_core, "id", "left_semi")).select(
            "id", "vec", "cid"
        ),
        "core",
    )
    links = _linked_cells(core, near, eps, side, dims, area)
    core_cells = core.groupBy("cid").agg(F.min("id").alias("first"))
    found = connected_components(links, area).withColumnRenamed("node", "cid")
    group = F.coalesce("component", "cid")
    grouped = core_cells.join(found, "cid", "left").select("cid", "first", group.alias("group"))
    numbers = number_rows(grouped.groupBy("group").agg(F.min("first").alias("first")), ["first"], "cluster_id", area)
    cell_cluster = area.put(
        grouped.join(numbers.select("group", "cluster_id"), "group").select("cid", "cluster_id"), "clusters"
    )

    core_label = core.join(cell_cluster, "cid").select("id", "cluster_id")
    border = (
        hits.join(thin_core, "id", "left_anti")
        .join(core.select(F.col("id").alias("thin_id"), F.lit(True).alias("thin_core")), "thin_id", "left")
        .where(F.col("thin_id").isNull() | F.col("thin_core"))
        .join(cell_cluster, "cid")
        .groupBy("id")
        .agg(F.min("cluster_id").alias("cluster_id"))
    )
    labels = core_label.unionByName(border)
    labelled = points.select("id", "vec").join(labels, "id", "left")
    return vectors.join(labelled, "vec").select(
        ID, F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id")
    )


def _near_cells(cells: DataFrame, dims: int, area: StageArea) -> DataFrame:
    """(a, b, rows_b): ordered pairs of filled cells that may hold points within eps, own cell included.

    With few axes cells are joined on coarse bins of all of them, one side copied to the neighbouring bins. With more,
    copies would be too many: as two such cells have their corners less than twice the diagonal apart, a
    search within that distance finds them. The gap between the cells decides in both cases.
    """
    left = cells.select(F.col("cid").alias("a"), F.col("cell").alias("cell_a"))
    right = cells.select(F.col("cid").alias("b"), F.col("cell").alias("cell_b"), F.col("cell_rows").alias("rows_b"))

    def gap(x: Column, y: Column) -> Column:
        apart = F.greatest(F.abs(x - y) - 1, F.lit(0))
        return apart * apart

    distance = F.aggregate(F.zip_with("cell_a", "cell_b", gap), F.lit(0).cast("long"), lambda s, x: s + x)
    if dims <= BINNED_AXES:
        reach = 1 + math.isqrt(dims)
        bins = [f"bin{i}" for i in range(dims)]
        for i, name in enumerate(bins):
            own = F.floor(F.col("cell_a")[i] / reach)
            left = left.withColumn(name, F.explode(F.array(*[own + step for step in (-1, 0, 1)])))
            right = right.withColumn(name, F.floor(F.col("cell_b")[i] / reach))
        return left.join(right, bins).where(distance <= dims).select("a", "b", "rows_b")
    corner = F.transform("cell", lambda x: x.cast("double")).alias("vec")
    corners = area.put(cells.select(F.col("cid").alias("id"), corner, F.lit(1.0).alias("weight")), "corners")
    pairs = within(corners, 2 * math.sqrt(dims) + 1e-6, area).select(F.col("id").alias("a"), F.col("partner").alias("b"))
    own = cells.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.col("cell_rows").alias("rows_b"))
    return pairs.join(left, "a").join(right, "b").where(distance <= dims).select("a", "b", "rows_b").unionByName(own)


def _thin_neighbours(located: DataFrame, near: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Neighbours of the points in thin cells: (id, cid, thin_id, n).

    Neighbours in a crowded cell are summed per cell (thin_id null), those in thin cells listed one
    by one. A crowded cell meets at most ``min_samples - 1`` points of each cell around it; its own
    rows are spread over several tasks by a salt that depends on their number.
    """
    salts = F.ceil(F.col("rows_b") / F.lit(SALT_ROWS)).cast("int")
    seekers = (
        located.where(F.col("cell_n") < min_samples)
        .select("id", F.col("vec").alias("own"), F.col("cid").alias("a"))
        .join(near, "a")
        .select("id", "own", F.col("b").alias("cid"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    )
    pieces = F.ceil(F.col("cell_rows") / F.lit(SALT_ROWS))
    targets = located.select(
        F.col("id").alias("other"),
        "vec",
        "n",
        "cid",
        "cell_n",
        F.pmod(F.xxhash64("id"), pieces).cast("int").alias("salt"),
    )
    within = seekers.join(targets, ["cid", "salt"]).where(array_distance(F.col("own"), F.col("vec")) <= F.lit(eps))
    thin = F.when(F.col("cell_n") < min_samples, F.col("other"))
    return within.groupBy("id", "cid", thin.alias("thin_id")).agg(F.sum("n").alias("n"))


def _linked_cells(
    core: DataFrame, near: DataFrame, eps: float, side: float, dims: int, area: StageArea
) -> DataFrame:
    """(a, b) for cells with core points at most eps apart."""
    pairs = near.where(F.col("a") < F.col("b")).select("a", "b")
    queue, links = None, []
    for level in count():
        width = side / (1 << level)
        inside = core if queue is None else core.join(_open_cells(queue), "cid", "left_semi")
        boxes = inside.withColumn("box", F.transform("vec", lambda x: F.floor(x / F.lit(width))))
        summary = area.put(_box_summary(boxes, dims), "boxes")
        if queue is None:
            queue = pairs.join(summary.select(F.col("cid").alias("a"), F.col("box").alias("box_a")), "a").join(
                summary.select(F.col("cid").alias("b"), F.col("box").alias("box_b")), "b"
            )
        else:
            children = summary.withColumn("parent", F.transform("box", lambda x: F.shiftright(x, 1)))
            for end in "ab":
                child = children.select(
                    F.col("cid").alias(end), F.col("parent").alias(f"box_{end}"), F.col("box").alias(f"child_{end}")
                )
                queue = queue.join(child, [end, f"box_{end}"]).drop(f"box_{end}")
                queue = queue.withColumnRenamed(f"child_{end}", f"box_{end}")
        for end in "ab":
            info = summary.select(*[F.col(c).alias(f"{c}_{end}") for c in ("box", "rows", "lows", "highs", "sample")], F.col("cid").alias(end))
            queue = queue.join(info, [end, f"box_{end}"])
        possible = queue.where(_box_gap() <= F.lit(eps)).withColumn(
            "linked", array_distance(F.col("sample_a"), F.col("sample_b")) <= F.lit(eps)
        )
        state = area.put(possible.select("a", "b", "box_a", "box_b", "rows_a", "rows_b", "linked"), "queue")
        sure = state.where("linked").select("a", "b").distinct()
        open_pairs = state.where("not linked and rows_a * rows_b > 1").join(sure, ["a", "b"], "left_anti")
        small = (F.col("rows_a") * F.col("rows_b") <= DIRECT_PAIRS) | F.lit(level >= LAST_LEVEL)
        few = open_pairs.where(small)
        points = boxes.select("cid", "box", "vec")
        for end in "ab":
            side_points = points.select(F.col("cid").alias(end), F.col("box").alias(f"box_{end}"), F.col("vec").alias(f"vec_{end}"))
            few = few.join(side_points, [end, f"box_{end}"])
        direct = few.where(array_distance(F.col("vec_a"), F.col("vec_b")) <= F.lit(eps)).select("a", "b").distinct()
        links.append(area.put(sure.unionByName(direct).distinct(), "links"))
        queue = area.put(
            open_pairs.where(~small)
            .join(links[-1], ["a", "b"], "left_anti")
            .select("a", "b", "box_a", "box_b"),
            "open",
        )
        if queue.isEmpty():
            return reduce(DataFrame.unionByName, links)


def _open_cells(queue: DataFrame) -> DataFrame:
    """Cells of which a pair is still open; the points of others are not looked at again."""
    return queue.select(F.explode(F.array("a", "b")).alias("cid")).distinct()


def _box_summary(boxes: DataFrame, size: int) -> DataFrame:
    """Row count, bounding box and one point of each box, all from partial aggregates."""
    return boxes.groupBy("cid", "box").agg(
        F.count("*").alias("rows"),
        F.array(*[F.min(F.col("vec")[i]) for i in range(size)]).alias("lows"),
        F.array(*[F.max(F.col("vec")[i]) for i in range(size)]).alias("highs"),
        # One number at a time keeps this a hash aggregate; IDs are unique, so it is one point.
        F.array(*[F.min_by(F.col("vec")[i], "id") for i in range(size)]).alias("sample"),
    )


def _box_gap() -> Column:
    """Distance between the bounding boxes of both ends."""
    left = F.zip_with("lows_a", "highs_b", lambda low, high: F.greatest(low - high, F.lit(0.0)))
    right = F.zip_with("lows_b", "highs_a", lambda low, high: F.greatest(low - high, F.lit(0.0)))
    squares = F.zip_with(left, right, lambda x, y: x * x + y * y)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
