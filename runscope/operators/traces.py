"""Resampling, aligning and selecting time traces; all runs at once, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runscope.functions import not_nan
from runscope.operators.clean import ID
from runscope.plans.ordering import HOT_ROWS, hot_cuts, with_chunk
from runscope.plans.stage import StageArea

KEYS = [ID, "signal"]


def _samples(traces: DataFrame) -> DataFrame:
    return traces.select(ID, "signal", F.col("time").cast("double").alias("time"), not_nan(F.col("value")).alias("value"))


def _sample(time: str, value: str) -> Column:
    return F.struct(F.col(time).alias("time"), F.col(value).alias("value"))


def _between(left: Column, right: Column, time: Column) -> Column:
    """Value on the straight line between two (time, value) samples; a sample at *time* itself wins.

    Outside the range of the samples one side is missing, and so is the value.
    """
    slope = (right["value"] - left["value"]) / (right["time"] - left["time"])
    return (
        F.when(right["time"] == time, right["value"])
        .when(left["time"] == time, left["value"])
        .otherwise(left["value"] + slope * (time - left["time"]))
    )


def resample(traces: DataFrame, rate_hz: float, min_time: float = 0.0, max_time: float = 1.0) -> DataFrame:
    """(shot_id, signal, step, time, value) on round((max - min) * rate) evenly spaced times, ends included.

    Samples are first reduced to the first and the last one between two grid times, which happens
    before the exchange: however long a trace is, at most one row per grid time leaves a task. A
    window over these rows then knows both neighbours of every grid time. Sample times of a signal
    are taken to be unique.
    """
    n = round((max_time - min_time) * rate_hz)
    if n < 1:
        return traces.select(ID, "signal", F.lit(0).alias("step"), "time", "value").limit(0)
    width = (max_time - min_time) / (n - 1) if n > 1 else 0.0

    def at(step: Column) -> Column:
        inner = step * F.lit(width) + F.lit(min_time)
        return F.when(step == n - 1, F.lit(max_time)).otherwise(inner) if n > 1 else F.lit(min_time)

    time = F.col("time")
    if n > 1:
        # The quotient may be off by a rounding error, so it is checked against the grid times.
        guess = F.floor((time - F.lit(min_time)) / F.lit(width))
        guess = F.greatest(F.lit(-1), F.least(guess, F.lit(n - 1))).cast("int")
        step = F.when(time < at(guess), guess - 1).when((guess < n - 1) & (time >= at(guess + 1)), guess + 1)
        step = F.greatest(step.otherwise(guess), F.lit(-1))
        step = F.when(time < F.lit(min_time), -1).otherwise(step)
    else:
        step = F.when(time < F.lit(min_time), -1).otherwise(0)
    # Plain numbers as buffers keep this a hash aggregate; structs would sort all samples first.
    pieces = (
        _samples(traces)
        .where(time.isNotNull())
        .groupBy(*KEYS, step.alias("piece"))
        .agg(
            F.min("time").alias("t0"),
            F.min_by("value", "time").alias("v0"),
            F.max("time").alias("t1"),
            F.max_by("value", "time").alias("v1"),
        )
        .select(*KEYS, "piece", _sample("t0", "v0").alias("first"), _sample("t1", "v1").alias("last"))
    )
    order = Window.partitionBy(*KEYS).orderBy("piece")
    linked = pieces.select(
        *KEYS,
        "piece",
        "first",
        F.col("last").alias("left"),
        F.lead("first").over(order).alias("right"),
        F.lead("piece").over(order).alias("next"),
        F.lag("piece").over(order).alias("previous"),
    )
    # A row answers for the grid times after its piece up to the next one; the first row also for
    # those before it, where only an exact hit has a value.
    spans = F.array(
        F.struct(
            (F.col("piece") + 1).alias("from"),
            F.coalesce("next", F.lit(n - 1)).alias("to"),
            F.col("left").alias("left"),
            F.col("right").alias("right"),
        ),
        F.struct(
            F.lit(0).alias("from"),
            F.when(F.col("previous").isNull(), F.col("piece")).otherwise(-1).alias("to"),
            F.lit(None).cast("struct<time:double,value:double>").alias("left"),
            F.col("first").alias("right"),
        ),
    )
    filled = linked.select(*KEYS, F.inline(spans)).where(F.col("from") <= F.col("to"))
    grid = filled.select(*KEYS, "left", "right", F.explode(F.sequence("from", "to")).alias("step"))
    grid = grid.select(*KEYS, "step", at(F.col("step")).alias("time"), "left", "right")
    return grid.select(*KEYS, "step", "time", _between(F.col("left"), F.col("right"), F.col("time")).alias("value"))


def align_to_first(
    traces: DataFrame, signals: Sequence[str], hot_rows: int = HOT_ROWS, area: StageArea | None = None
) -> DataFrame:
    """(shot_id, signal, time, value) of all signals at the sample times of a run's first available one.

    "First" is the order of *signals*. Runs with more than *hot_rows* samples are cut into pieces of time with fewer; the
    samples next to a piece are handed over from a small table of piece ends.
    """
    ranked = F.create_map(*[F.lit(x) for i, s in enumerate(dict.fromkeys(signals)) for x in (s, i)])
    samples = _samples(traces).where(F.col("signal").isin(list(signals)) & F.col("time").isNotNull())
    leads = samples.groupBy(ID).agg(
        F.min(ranked[F.col("signal")]).alias("lead"), F.collect_set("signal").alias("present")
    )
    axis = samples.join(leads, ID).where(ranked[F.col("signal")] == F.col("lead"))
    axis = axis.groupBy(ID, "time").agg(F.first("present").alias("present"))
    wanted = axis.select(ID, F.explode("present").alias("signal"), "time", F.lit(True).alias("on_axis"))
    measured = samples.groupBy(*KEYS, "time").agg(F.max("value").alias("value"))
    measured = measured.select(*KEYS, "time", F.struct("time", "value").alias("sample"))
    # One row per time: the sample, the request, or both.
    rows = measured.join(wanted, [*KEYS, "time"], "full_outer")

    cuts = hot_cuts(samples, ID, "time", area or StageArea(traces.sparkSession, "align"), hot_rows)
    rows = with_chunk(rows, ID, "time", cuts)
    inside = Window.partitionBy(*KEYS, "_chunk").orderBy("time")
    left = F.last("sample", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("sample", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    found = rows.select(*KEYS, "_chunk", "time", "on_axis", left.alias("left"), right.alias("right"))
    found = found.where("on_axis")
    if cuts is not None:
        # At most one row per piece of a run and signal.
        ends = rows.groupBy(*KEYS, "_chunk").agg(F.min("sample").alias("head"), F.max("sample").alias("tail"))
        order = Window.partitionBy(*KEYS).orderBy("_chunk")
        before = F.last("tail", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first("head", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
        ends = ends.select(*KEYS, "_chunk", before.alias("before"), after.alias("after"))
        found = found.join(ends, [*KEYS, "_chunk"]).withColumns(
            {"left": F.coalesce("left", "before"), "right": F.coalesce("right", "after")}
        )
    return found.select(*KEYS, "time", _between(F.col("left"), F.col("right"), F.col("time")).alias("value"))


def to_wide(traces: DataFrame, signals: Sequence[str]) -> DataFrame:
    """One row per run and time with a column per signal; of several samples at one time the largest counts."""
    return traces.groupBy(ID, "time").pivot("signal", list(signals)).agg(F.max("value"))


def traces_of(traces: DataFrame, ids: DataFrame) -> DataFrame:
    """Samples of a set of runs; runs without a trace are simply absent."""
    return traces.join(ids.select(ID), ID, "left_semi")


def representative_traces(traces: DataFrame, representatives: DataFrame, signals: Sequence[str]) -> DataFrame:
    """(cluster_id, shot_id, signal, time, value): missing samples are 0, signals without any value left out."""
    chosen = representatives.select("cluster_id", ID)
    samples = _samples(traces).where(F.col("signal").isin(list(signals))).join(chosen, ID)
    present = samples.groupBy(*KEYS).agg(F.count("value").alias("n")).where(F.col("n") > 0).select(*KEYS)
    filled = samples.join(present, KEYS, "left_semi")
    return filled.select("cluster_id", ID, "signal", "time", F.coalesce("value", F.lit(0.0)).alias("value"))


def sample_traces(traces: DataFrame, ids: DataFrame, order: str, n: int, signals: Sequence[str]) -> DataFrame:
    """Samples of the first *n* runs of a list, missing values kept."""
    first = ids.orderBy(order).limit(n).select(ID)
    return traces_of(traces.where(F.col("signal").isin(list(signals))), first)


OUTLIER_TRACES = 5
NEIGHBOR_TRACES = 10


def outlier_traces(traces: DataFrame, labels: DataFrame, signals: Sequence[str], n: int = OUTLIER_TRACES) -> DataFrame:
    return sample_traces(traces, labels.where(F.col("is_outlier") == 1), ID, n, signals)


def neighbor_traces(traces: DataFrame, hits: DataFrame, signals: Sequence[str], n: int = NEIGHBOR_TRACES) -> DataFrame:
    return sample_traces(traces, hits, "rank", n, signals)


def mean_traces(
    traces: DataFrame, labels: DataFrame, rate_hz: float, min_time: float = 0.0, max_time: float = 1.0
) -> DataFrame:
    """(cluster_id, signal, step, time, value, runs): mean over the members on a common grid, noise left out."""
    members = labels.where(F.col("cluster_id") >= 0).select(ID, "cluster_id")
    grid = resample(traces_of(traces, members), rate_hz, min_time, max_time)
    joined = grid.where(F.col("value").isNotNull()).join(members, ID)
    return joined.groupBy("cluster_id", "signal", "step", "time").agg(
        F.avg("value").alias("value"), F.count("*").alias("runs")
    )
