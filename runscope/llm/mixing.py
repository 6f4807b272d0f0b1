"""Mixing sources to target weights by cube-method balanced sampling.

Every document is wanted target / source size times. The whole part is taken for certain; the
fractional part is an inclusion probability, and the cube method draws it: probabilities move
through the null-space of two constraints (the words and the number of documents taken) until they
are 0 or 1, so both totals stay what they were. Groups of one source flow apart from each other and
hand the few undecided documents up to larger groups, each source for as many rounds as its own size
takes. A dozen documents of graded sizes of each source are kept aside before its first flight; they
and what is left of it, at most two documents, are the landing problem, settled by the choice nearest
to the totals.

Defined results: a null or empty text has size 0; null is a source of its own, sorted last; a
source without words has target 0. Repeated rows are drawn one by one; equal ids are told apart by
the order in which their rows sort. Draws depend on ids alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runscope.llm.text import Words, buffers, slices
from runscope.plans.ordering import number_rows
from runscope.plans.stage import StageArea

SLICE = 2 << 20
WEIGHTS = (3, 1, 2)
VOLUME = 1.5
MOST_COPIES = 2.0
#: Documents that flow together in one task.
GROUP = 5000
#: Documents of a source that are settled together with the last undecided ones.
LANDING = 12
#: Documents of which one task chooses those for the landing.
GRADED = 64 * LANDING
EPSILON = 1e-9
UNITS = "source string, unit long, size long, p double, n long, kept boolean"


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            size = Words(*buffers(batch.column("text"))).counts.astype(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array(size)], names=names)

    names = ["doc_id", "source", "size"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, source string, size long")


def source_targets(sizes: DataFrame, area: StageArea) -> DataFrame:
    """(source, source_size, n, largest, target): weights by rank, stopped at twice the source's size.

    Each round shares what is left among the sources below their stop; it ends when none passes it.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n"), F.max("size").alias("largest")
    )
    # Null last: it gets no rank from the order of the texts but the number after the last.
    named = number_rows(area.put(sources.where("source IS NOT NULL"), "named"), ["source"], "rank", area)
    last = sources.where("source IS NULL").withColumn("rank", F.lit(named.count()).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = area.put(named.unionByName(last).withColumn("weight", weight.cast("double")), "sources")
    stop = F.col("source_size") * MOST_COPIES
    volume = (ranked.agg(F.sum("source_size")).first()[0] or 0) * VOLUME
    level, stopped = 0.0, -1
    while True:
        # A source stays stopped once it is: the level only rises.
        full = F.col("weight") * level >= stop
        row = ranked.agg(
            F.sum(F.when(full, stop)).alias("given"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count_if(full).alias("stopped"),
        ).first()
        if row["stopped"] == stopped or not row["open"]:
            break
        stopped = row["stopped"]
        level = max(0.0, volume - (row["given"] or 0.0)) / row["open"]
    return ranked.select("source", "source_size", "n", "largest", F.least(F.col("weight") * level, stop).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities along null-space directions of (size, 1) until at most two are undecided."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if EPSILON < p[i] < 1 - EPSILON]
    p[p <= EPSILON], p[p >= 1 - EPSILON] = 0.0, 1.0
    held: list[int] = []
    coins = rng.random(len(open_) + 1)
    for step, i in enumerate(open_):
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (float(size[j]) for j in held)
        # Orthogonal to (1, 1, 1) and (a, b, c); any zero-sum direction if the sizes are equal.
        move = (1.0, -1.0, 0.0) if a == b == c else (b - c, c - a, a - b)
        up = down = np.inf
        for j, m in zip(held, move, strict=True):
            if m > 0:
                up, down = min(up, (1 - p[j]) / m), min(down, p[j] / m)
            elif m < 0:
                up, down = min(up, -p[j] / m), min(down, (p[j] - 1) / m)
        by = up if coins[step] * (up + down) < down else -down
        for j, m in zip(held, move, strict=True):
            p[j] += by * m
            if p[j] <= EPSILON or p[j] >= 1 - EPSILON:
                p[j] = round(p[j])
        held = [j for j in held if 0.0 < p[j] < 1.0]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the undecided units: of all choices the one nearest to the expected words and documents."""
    left = np.flatnonzero((p > 0) & (p < 1))
    choices = np.arange(2 ** len(left))[:, None] >> np.arange(len(left)) & 1
    words, number = choices @ size[left] - p[left] @ size[left], choices.sum(1) - p[left].sum()
    out = p.copy()
    out[left] = choices[np.argmin(np.abs(words) + np.abs(number))]
    return out


def landing_units(size: np.ndarray, largest: float) -> list[int]:
    """Units of about a half, a quarter, an eighth, ... of the largest size: they make the landing fine-grained."""
    left = list(np.argsort(size, kind="stable"))
    out: list[int] = []
    wanted = float(largest)
    while left and len(out) < LANDING:
        wanted /= 2
        at = int(np.searchsorted(size[left], wanted))
        nearest = min((i for i in (at - 1, at) if 0 <= i < len(left)), key=lambda i: abs(size[left[i]] - wanted))
        out.append(left.pop(nearest))
    return out


def _graded(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("unit", ignore_index=True)
    chosen = landing_units(group["size"].to_numpy(), group["largest"].iloc[0])
    return group.loc[chosen, ["source", "unit", "size", "n", "largest"]]


def keep_aside(open_: DataFrame, area: StageArea) -> DataFrame:
    """*open_* with the column kept: true for the landing units of each source."""
    parts = F.ceil(F.col("n") / GRADED)
    chosen, most = open_.select("source", "unit", "size", "n", "largest"), None
    while most is None or most > LANDING:
        # The best of each part first, then the best of those.
        dealt = chosen.withColumn("_part", F.pmod(F.col("unit"), parts))
        found = dealt.groupBy("source", "_part").applyInPandas(_graded, "source string, unit long, size long, n long, largest long")
        chosen = area.put(found.withColumn("n", parts * LANDING), "graded")
        most = chosen.agg(F.max("n")).first()[0] or 0
    marks = chosen.select("unit", F.lit(True).alias("kept"))
    return open_.join(marks, "unit", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def _flow(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("unit", ignore_index=True)
    seed = [abs(int(group["unit"].sum())), len(group)]
    rng = np.random.default_rng(seed)
    # Large documents first, equal ones in random order: what stays undecided is small.
    size = group["size"].to_numpy()
    order = np.lexsort((rng.random(len(group)), -size))
    order = order[~group["kept"].to_numpy()[order]]
    p = group["p"].to_numpy().copy()
    p[order] = flight(p[order], size[order], rng)
    group["p"] = land(p, size) if group["last"].iloc[0] else p
    return group[["source", "unit", "size", "p", "n", "kept"]]


def mix_sources(docs: DataFrame, area: StageArea) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies): how often the mix takes each row."""
    ranked = Window.partitionBy("key").orderBy("source", "size")
    key = F.xxhash64(F.col("doc_id").cast("string"))
    sizes = area.put(document_sizes(docs).withColumn("key", key), "sizes")
    # Rows of one id get units of their own; an id is not expected to repeat often.
    sizes = area.put(
        sizes.withColumn("unit", F.xxhash64("key", F.row_number().over(ranked))).drop("key"), "units"
    )
    targets = area.put(source_targets(sizes, area), "targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "size", sizes["source"], "source_size", "n", "largest", "target", "unit", copies.alias("copies")
    )
    whole = F.floor(F.col("copies") + EPSILON)
    rows = wanted.withColumn("whole", whole).withColumn("p", F.greatest(F.col("copies") - whole, F.lit(0.0)))
    rows = area.put(rows, "wanted")
    open_ = rows.where(F.col("p") > EPSILON).select("source", "unit", "size", "p", "n", "largest")
    open_ = area.put(keep_aside(open_, area).drop("largest"), "open")
    drawn: list[DataFrame] = []
    groups, last = F.ceil(F.col("n") / GROUP), F.col("n") <= GROUP
    most = open_.agg(F.max("n")).first()[0]
    while most is not None:
        # What a source keeps aside meets the rest of it in the source's own last round.
        dealt = open_.where(last | ~F.col("kept")).withColumn("_group", F.pmod(F.col("unit"), groups)).withColumn("last", last)
        found = area.put(dealt.groupBy("source", "_group").applyInPandas(_flow, UNITS), "flight")
        drawn.append(found.where(F.col("p") >= 1 - EPSILON).select("unit"))
        if most <= GROUP:
            break
        left = found.where((F.col("p") > EPSILON) & (F.col("p") < 1 - EPSILON))
        waiting = open_.where(~last & F.col("kept")).select(*left.columns)
        # A group leaves two units at most.
        open_ = area.put(left.unionByName(waiting).withColumn("n", groups * 2), "open")
        most = open_.agg(F.max("n")).first()[0]
    if not drawn:
        taken = rows.withColumn("taken", F.lit(0))
    else:
        units = drawn[0]
        for more in drawn[1:]:
            units = units.unionByName(more)
        taken = rows.join(units.withColumn("taken", F.lit(1)), "unit", "left")
    return taken.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("whole") + F.coalesce("taken", F.lit(0))).alias("copies")
    )
