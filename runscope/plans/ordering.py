"""Global order without a single-task window: row numbers, quantiles, cuts of hot keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runscope.plans.stage import StageArea

# Rows that one task may comfortably sort or aggregate exactly.
EXACT_ROWS = 1_000_000
# A key with more rows than this is cut, each time into this many pieces, until its pieces have fewer.
HOT_ROWS = 1_000_000
HOT_PIECES = 128


def number_rows(df: DataFrame, order: list[str], name: str, area: StageArea) -> DataFrame:
    """Add a 0-based position in the order of *order* (which must be unique).

    A range exchange splits the rows evenly; the row number inside a partition is then shifted by
    the sizes of the partitions before it (one small row per partition). The partition number is
    written out first, so a recomputed partition cannot disagree with the offsets.
    """
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    staged = area.put(spread, "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        staged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop("_part", "_offset")
    )


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Linear-interpolation quantile. Brackets the wanted ranks with a sketch until few rows remain.

    The built-in exact percentile keeps every distinct value in one buffer, so it only ever sees
    the rows between the two brackets.
    """
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    total = values.count()
    if total == 0:
        return None
    rank = q * (total - 1)
    ranks = (math.floor(rank), math.ceil(rank))
    below, inside, rows = 0, values, total
    while rows > EXACT_ROWS:
        error = max(1e-4, 1000 / rows)
        wanted = [max(0.0, (ranks[0] - below) / rows - 2 * error), min(1.0, (ranks[1] - below) / rows + 2 * error)]
        low, high = inside.approxQuantile("v", wanted, error)
        if low == high:
            break
        counts = values.agg(
            F.count_if(F.col("v") < low).alias("below"),
            F.count_if(F.col("v").between(low, high)).alias("inside"),
        ).first()
        if not (counts["below"] <= ranks[0] and ranks[1] < counts["below"] + counts["inside"]):
            break
        if counts["inside"] >= rows:
            break
        below, rows = counts["below"], counts["inside"]
        inside = values.where(F.col("v").between(low, high))
    if rows > EXACT_ROWS:
        # Few distinct values: their counts are small enough to rank.
        inside = inside.groupBy("v").agg(F.count("*").alias("n"))
        picks = [_value_at(inside, r - below) for r in ranks]
    else:
        picks = [_element(inside, r - below, rows) for r in ranks]
    return picks[0] + (picks[1] - picks[0]) * (rank - ranks[0])


def _element(values: DataFrame, rank: int, rows: int) -> float:
    """The value at a 0-based rank, taken as it is (an interpolated one could miss it by an ulp)."""
    return values.agg(F.expr(f"percentile_disc({(rank + 0.5) / rows!r}) WITHIN GROUP (ORDER BY v)").alias("p")).first()["p"]


def _value_at(counts: DataFrame, rank: int) -> float:
    """Value at a 0-based rank of a (v, n) table, found by halving the value range."""
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    while low < high:
        middle = low + (high - low) / 2
        row = counts.agg(
            F.sum(F.when(F.col("v") <= middle, F.col("n"))).alias("at_most"),
            F.max(F.when(F.col("v") <= middle, F.col("v"))).alias("left"),
            F.min(F.when(F.col("v") > middle, F.col("v"))).alias("right"),
        ).first()
        if (row["at_most"] or 0) > rank:
            high = row["left"]
        else:
            low = row["right"]
    return low


def hot_cuts(
    df: DataFrame, key: str, order: str, area: StageArea, limit: int = HOT_ROWS, pieces: int = HOT_PIECES
) -> DataFrame | None:
    """Cut points of *order* for every key with more than *limit* rows, as a staged (key, cuts); None if there are none.

    Pieces that are still too large are cut again, unless all their rows have one place in the order. Every round is
    an aggregate, so the size of a key or of the table does not matter, and later stages see the same
    cuts whatever is recomputed.
    """
    steps = F.array(*[F.lit((i + 1) / pieces) for i in range(pieces - 1)])
    cuts = None
    while True:
        placed = with_chunk(df, key, order, cuts)
        sizes = placed.groupBy(key, "_chunk").agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"))
        large = area.put(sizes.where((F.col("n") > limit) & (F.col("low") < F.col("high"))).select(key, "_chunk"), "large")
        if large.isEmpty():
            return cuts
        inside = placed.join(large, [key, "_chunk"], "left_semi").groupBy(key, "_chunk")
        # The largest value cuts nothing off; leaving it out keeps every round a true division.
        found = inside.agg(F.percentile_approx(order, steps, F.lit(10_000)).alias("cuts"), F.min(order).alias("low"), F.max(order).alias("high"))
        low, high = F.col("low"), F.col("high")
        within = F.filter("cuts", lambda c: c < high)
        found = found.select(key, F.when(F.size(within) > 0, within).otherwise(F.array(low)).alias("cuts"))
        if cuts is not None:
            found = found.unionByName(cuts)
        merged = found.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("cuts"))
        cuts = area.put(merged, "cuts")


def with_chunk(df: DataFrame, key: str, order: str, cuts: DataFrame | None) -> DataFrame:
    """Add ``_chunk``: the piece of its key a row belongs to (always 0 for keys that are not hot)."""
    if cuts is None:
        return df.withColumn("_chunk", F.lit(0))
    joined = df.join(cuts, key, "left")
    passed = F.size(F.filter("cuts", lambda c: c < F.col(order)))
    return joined.withColumn("_chunk", F.when(F.col("cuts").isNull(), 0).otherwise(passed)).drop("cuts")
