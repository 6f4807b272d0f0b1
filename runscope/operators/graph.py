"""Reference graph between runs: edges, connected components, the visible part of a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.functions import finite, parse_number, scale_position
from runscope.operators.clean import ID
from runscope.plans.stage import StageArea
from runscope.sources.columns import quoted


def reference_edges(df: DataFrame, column: str) -> DataFrame:
    """(shot_id, ref_id): the distinct edges from runs to other runs of the table.

    Non-numeric references are ignored and fractions cut off. An ID in several rows keeps all its
    references.
    """
    value = F.col(quoted(column))
    if isinstance(df.schema[column].dataType, T.StringType):
        value = parse_number(value)
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        value = finite(value)
    pairs = df.select(F.col(ID).cast("long").alias(ID), value.cast("long").alias("ref_id"))
    wanted = pairs.where(F.col("ref_id").isNotNull() & (F.col("ref_id") != F.col(ID)))
    known = df.select(F.col(ID).cast("long").alias("ref_id"))
    return wanted.join(known, "ref_id", "left_semi").distinct()


def reference_parents(edges: DataFrame) -> DataFrame:
    """(shot_id, ref_id): the one reference of each run that stands for its parent, the smallest."""
    return edges.groupBy(ID).agg(F.min("ref_id").alias("ref_id"))


def connected_components(edges: DataFrame, area: StageArea) -> DataFrame:
    """(node, component) for every node of an undirected (a, b) edge table; the label is the smallest node.

    Alternates two rewrites until nothing changes: every node hands its larger neighbours to its
    smallest neighbour, then its smaller ones. Each keeps the components and ends in stars around
    the smallest nodes after a logarithmic number of rounds. Minima are aggregated before the
    exchange, and the join that hands them out has one row per node on one side, so a hub's edges
    can be split freely by the adaptive skew join.
    """
    current = area.put(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    signature = _signature(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = (
            both.join(smallest, "a")
            .where((F.col("b") > F.col("a")) & (F.col("b") != F.col("low")))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a")
        moved = small.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        kept = lowest.select("a", F.col("low").alias("b"))
        following = area.put(moved.unionByName(kept).distinct(), "edges")
        area.drop(current)
        current = following
        found = _signature(current)
        if found == signature:
            break
        signature = found
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge table; equal for two rounds means nothing moved."""
    spread = F.xxhash64("a", "b")
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(spread).alias("x"), F.sum(F.shiftright(spread, 20)).alias("s")
    ).first()
    return tuple(row)


#: Runs of one search round that are named in a predicate; more are joined.
FEW_RUNS = 1000


def reference_components(edges: DataFrame, area: StageArea | None = None) -> DataFrame:
    """(shot_id, component) for every run with at least one reference edge."""
    area = area or StageArea(edges.sparkSession, "graph")
    found = connected_components(edges.select(F.col(ID).alias("a"), F.col("ref_id").alias("b")), area)
    return found.select(F.col("node").alias(ID), "component")


def component_of(edges: DataFrame, components: DataFrame, shot_id: int) -> DataFrame:
    """Runs connected with *shot_id*; a run without edges is alone, an empty graph has no runs."""
    own = components.where(F.col(ID) == F.lit(shot_id)).select("component")
    members = components.join(F.broadcast(own), "component", "left_semi").select(ID)
    # limit(1) makes this at most one row: the graph exists, so the run itself belongs to it.
    itself = edges.limit(1).select(F.lit(shot_id).cast("long").alias(ID))
    return members.unionByName(itself).distinct()


def search_component(edges: DataFrame, shot_id: int, area: StageArea | None = None) -> DataFrame:
    """Like :func:`component_of`, by a search from the run: components of other runs are never built.

    Neighbours are laid out by range of run once; a round reads those of the runs that the round before reached, and the
    search ends with a round that reaches none. Rounds follow the distance from the run, so for very long
    chains :func:`component_of` is the better choice.
    """
    area = area or StageArea(edges.sparkSession, "search")
    both = edges.select(F.col(ID).alias("a"), F.col("ref_id").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = area.put(both.repartitionByRange("a").sortWithinPartitions("a"), "links")
    reached = area.put(edges.limit(1).select(F.lit(shot_id).cast("long").alias(ID)), "reached")
    fresh = reached
    while True:
        named = [row[ID] for row in fresh.limit(FEW_RUNS + 1).collect()]
        if not named:
            return reached
        # Predicates reach the scan, so files of runs outside of their range are not read.
        if len(named) <= FEW_RUNS:
            near = links.where(F.col("a").isin(named))
        else:
            low, high = fresh.agg(F.min(ID), F.max(ID)).first()
            near = links.where(F.col("a").between(F.lit(low), F.lit(high)))
            near = near.join(fresh.withColumnRenamed(ID, "a"), "a", "left_semi")
        found = near.select(F.col("b").alias(ID)).distinct().join(reached, ID, "left_anti")
        fresh = area.put(found, "fresh")
        reached = reached.unionByName(fresh)


def visible_nodes(components: DataFrame, points: DataFrame, shot_id: int) -> DataFrame:
    """Plotted runs of the component of *shot_id*: (shot_id, x, y, shade, selected)."""
    own = components.where(F.col(ID) == F.lit(shot_id)).select("component")
    members = components.join(F.broadcast(own), "component", "left_semi")
    shown = points.select(ID, "x", "y").join(members, ID)
    span = shown.groupBy("component").agg(F.min(ID).alias("low"), F.max(ID).alias("high"))
    shade = scale_position(F.col(ID), F.col("low"), F.col("high"))
    # The span of the one component is a single row.
    return shown.join(F.broadcast(span), "component").select(
        ID, "x", "y", shade.alias("shade"), (F.col(ID) == F.lit(shot_id)).alias("selected")
    )


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in *nodes*, once per pair, shaded like their older end."""
    pairs = edges.select(F.least(ID, "ref_id").alias("low_id"), F.greatest(ID, "ref_id").alias("high_id")).distinct()
    low = nodes.select(F.col(ID).alias("low_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), "shade")
    high = nodes.select(F.col(ID).alias("high_id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return pairs.join(low, "low_id").join(high, "high_id")


def component_shade(components: DataFrame) -> DataFrame:
    """Position of every run between the smallest and the largest ID of its component.

    An aggregate and a join instead of a window: a giant component never sits in one task.
    """
    span = components.groupBy("component").agg(F.min(ID).alias("low"), F.max(ID).alias("high"))
    shade = scale_position(F.col(ID), F.col("low"), F.col("high"))
    return components.join(span, "component").select(ID, "component", shade.alias("shade"))
