"""Exact nearest-partner joins over a two-level tree of blocks.

A sample picks the split planes of a coarse k-d tree. Each coarse leaf is cut further where its rows are, by
rank, into blocks of at most ``BLOCK_ROWS`` rows, however many rows crowd in one place; true
bounding boxes come from all rows. A row first meets its own block, which bounds the distance of its partners. The
boxes of coarse leaves, a fixed number, tell which leaves may hold closer ones, the boxes of their blocks, found by a
join, tell which blocks. So the work of a row depends on its neighbourhood, not on the size of the
table. Sample and planes decide how much is pruned, never what is found.

Blocks that very many rows ask for are dealt to several tasks. Equal vectors are one row here (see
``distinct_points``), so piles of copies cannot fill a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runscope.plans.stage import StageArea

BLOCK_ROWS = 512
#: Rows of a coarse leaf, as long as there are fewer than MOST_LEAVES; beyond, leaves get more blocks.
LEAF_ROWS = 8192
#: Coarse leaves, whose boxes every task holds.
MOST_LEAVES = 16_384
SAMPLE_ROWS = 100_000
TIE_DIGITS = 9  # distances that agree to this many decimals are ties, broken by the smaller ID
#: Groups of rows that ask for one block in one task; a block asked for more often, and by more than this share of all, is dealt out.
GROUPS_AT_ONCE = 256
HOT_SHARES = 4096


@dataclass(frozen=True)
class SplitTree:
    """Split planes in heap order: node i has the children 2i+1 and 2i+2."""

    dims: np.ndarray
    values: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def assign(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            right = points[rows, self.dims[node]] > self.values[node]
            node = 2 * node + 1 + right
        return node - (self.leaves - 1)


def fit_tree(sample: np.ndarray, depth: int) -> SplitTree:
    inner = (1 << depth) - 1
    dims, values = np.zeros(inner, dtype=np.int64), np.zeros(inner)
    members = {0: np.arange(len(sample))}
    for node in range(inner):
        rows = members.pop(node)
        if len(rows):
            spread = sample[rows].max(axis=0) - sample[rows].min(axis=0)
            dims[node] = int(spread.argmax())
            values[node] = float(np.median(sample[rows, dims[node]]))
        right = sample[rows, dims[node]] > values[node]
        members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return SplitTree(dims, values, depth)


def rank_split(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in groups of at most *most*, halved by rank along the widest axis."""
    waiting, done = [np.arange(len(points))], []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        part = points[rows]
        axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
        order = np.argpartition(part[:, axis], len(rows) // 2)
        waiting += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def distinct_points(points: DataFrame, copies: int) -> DataFrame:
    """(id, vec, members): one row per distinct vector, led by its smallest ID.

    ``members`` holds its *copies* smallest IDs. The rank filter is applied before the exchange, so
    a vector shared by very many rows sends only that many per task.
    """
    smallest = Window.partitionBy("vec").orderBy("shot_id")
    kept = points.withColumn("_rank", F.row_number().over(smallest)).where(F.col("_rank") <= copies)
    members = kept.groupBy("vec").agg(F.sort_array(F.collect_list("shot_id")).alias("members"))
    return members.select(F.element_at("members", 1).alias("id"), "vec", "members")


@dataclass(frozen=True)
class Boxes:
    """Bounding box and smallest weight of each member of a list of leaves or blocks."""

    names: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    weights: np.ndarray

    def squares(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points to the boxes, one dimension at a time to keep the arrays small."""
        total = np.zeros((len(points), len(self.names)))
        for i in range(points.shape[1]):
            x = points[:, i, None]
            gap = np.maximum(np.maximum(self.lows[None, :, i] - x, x - self.highs[None, :, i]), 0.0)
            total += gap * gap
        return total

    def least_scores(self, points: np.ndarray, weights: np.ndarray, ward: bool) -> np.ndarray:
        """What the score of a point with any row of each box is at least."""
        lower = self.squares(points)
        if ward:
            return lower * (weights[:, None] * self.weights[None] / (weights[:, None] + self.weights[None]))
        return np.sqrt(lower)

    def within(self, points: np.ndarray, weights: np.ndarray, bounds: np.ndarray, ward: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(box, rows): for every box the points that may find a score within their bound in it."""
        step = max(1, 2_000_000 // max(len(self.names), 1))
        found = []
        for low in range(0, len(points), step):
            part = slice(low, low + step)
            # A hair of slack keeps rounding from excluding a box that holds a tie.
            limit = bounds[part, None] * (1 + 1e-9) + 10.0**-TIE_DIGITS
            found.append(self.least_scores(points[part], weights[part], ward) <= limit)
        near = np.concatenate(found)
        for box in np.flatnonzero(near.any(axis=0)):
            yield int(box), np.flatnonzero(near[:, box])


@dataclass(frozen=True)
class Index:
    """Blocks (leaf, block, ids, vecs, weights, asks, low, high, least), the boxes of coarse leaves, and the number of tasks."""

    blocks: DataFrame
    coarse: Boxes
    dims: int
    tasks: int

    def fine(self) -> DataFrame:
        """(leaf, boxes): the boxes of the blocks of each coarse leaf."""
        box = F.struct("block", "low", "high", "least")
        return self.blocks.groupBy("leaf").agg(F.collect_list(box).alias("boxes"))


_BLOCK = (
    "leaf int, block string, ids array<long>, vecs array<double>, weights array<double>, asks array<boolean>, "
    "low array<double>, high array<double>, least double"
)


def sample_tree(points: DataFrame, rows: int, leaf_rows: int, turn: np.ndarray | None = None) -> SplitTree | None:
    """Coarse tree of a table with ``vec``, fitted in the coordinates *turn* rotates it to; None for one leaf."""
    depth = 0
    while (rows >> depth) > leaf_rows and (1 << depth) < MOST_LEAVES:
        depth += 1
    if not depth:
        return None
    fraction = min(1.0, SAMPLE_ROWS / rows)
    picked = points.select("vec") if fraction == 1.0 else points.select("vec").sample(fraction, seed=42)
    sample = np.array([row["vec"] for row in picked.limit(2 * SAMPLE_ROWS).collect()], dtype=float)
    return fit_tree(sample if turn is None else sample @ turn, depth)


def build_index(
    points: DataFrame, area: StageArea, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, rows: int | None = None
) -> Index:
    """*points* has (id, vec, weight) and, if only some rows ask for partners, ``asks``; it should be a staged table."""
    rows = points.count() if rows is None else rows
    if "asks" not in points.columns:
        points = points.withColumn("asks", F.lit(True))
    tree = sample_tree(points, rows, leaf_rows)

    @F.pandas_udf("int")
    def leaf_of(vec: pd.Series) -> pd.Series:
        return pd.Series(tree.assign(np.stack(vec.to_numpy())).astype("int32"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, points = int(pdf["leaf"].iloc[0]), np.stack(pdf["vec"].to_numpy()).astype(float)
        columns = {name: pdf[name].to_numpy() for name in ("id", "weight", "asks")}
        out = []
        for number, part in enumerate(rank_split(points, block_rows)):
            part = part[np.argsort(columns["id"][part])]
            inside = points[part]
            values = [columns[name][part] for name in ("id", "weight", "asks")]
            box = (inside.min(axis=0), inside.max(axis=0), float(values[1].min()))
            out.append((leaf, f"{leaf}/{number}", values[0], inside.ravel(), values[1], values[2], *box))
        return pd.DataFrame(out, columns=["leaf", "block", "ids", "vecs", "weights", "asks", "low", "high", "least"])

    spark = points.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = points.withColumn("leaf", leaf_of("vec") if tree else F.lit(0))
    blocks = placed.select("leaf", "id", "vec", "weight", "asks").groupBy("leaf").applyInPandas(cut, _BLOCK)
    # Few bytes but much work per row: a given partition count keeps small partitions from being merged.
    blocks = area.put(blocks.repartition(tasks, "block"), "blocks")
    return Index(blocks, *leaf_boxes(blocks), tasks)


def leaf_boxes(blocks: DataFrame) -> tuple[Boxes, int]:
    """The boxes of coarse leaves, at most MOST_LEAVES of them, and the number of dimensions."""
    first = blocks.select(F.size("low").alias("d")).first()
    dims = first["d"] if first else 0
    box = [F.min(F.col("low")[i]).alias(f"lo{i}") for i in range(dims)] + [F.max(F.col("high")[i]).alias(f"hi{i}") for i in range(dims)]
    stats = sorted(blocks.groupBy("leaf").agg(F.min("least").alias("w"), *box).collect(), key=lambda r: r["leaf"])
    bounds = (np.array([[r[f"{end}{i}"] for i in range(dims)] for r in stats], dtype=float) for end in ("lo", "hi"))
    return Boxes(np.array([r["leaf"] for r in stats], dtype=np.int64), *bounds, np.array([r["w"] for r in stats], dtype=float)), dims


def _pair_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed one dimension at a time as a SQL engine would."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        diff = a[:, i, None] - b[None, :, i]
        total += diff * diff
    return total


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest scores of every row, ties by ID."""
    if scores.shape[1] > 4 * k:
        cut = np.partition(scores, k - 1, axis=1)[:, k - 1]
        width = int((scores <= cut[:, None]).sum(axis=1).max())
        if width < scores.shape[1] // 2:
            near = np.argpartition(scores, width - 1, axis=1)[:, :width]
            scores, ids = np.take_along_axis(scores, near, axis=1), np.take_along_axis(ids, near, axis=1)
    order = np.lexsort((ids, scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


@dataclass(frozen=True)
class Matcher:
    """Scores between rows and blocks. With *same* both sides are one table and a row is no partner of itself."""

    k: int
    ward: bool
    same: bool

    def match(self, ids, points, weights, bounds, block_ids, block_points, block_weights) -> tuple[list, list, np.ndarray]:
        """Partners and scores of each row within its bound, and the bound that results from this block."""
        squares = _pair_squares(points, block_points)
        if self.ward:
            scores = squares * (weights[:, None] * block_weights[None, :] / (weights[:, None] + block_weights[None, :]))
        else:
            scores = np.round(np.sqrt(squares), TIE_DIGITS)
        if self.same:
            scores[ids[:, None] == block_ids[None, :]] = np.inf
        scores, partners = _best(scores, np.broadcast_to(block_ids, scores.shape), self.k)
        known = np.isfinite(scores) & (scores <= bounds[:, None])
        new = scores[:, -1] if scores.shape[1] == self.k else np.full(len(ids), np.inf)
        return [p[f] for p, f in zip(partners, known, strict=True)], [s[f] for s, f in zip(scores, known, strict=True)], new


# A row with partners is a result; any other asks for a visit to its coarse leaf.
_FOUND = (
    "leaf int, seen string, ids array<long>, vecs array<double>, weights array<double>, bounds array<double>, "
    "partners array<array<long>>, scores array<array<double>>"
)
_FOUND_NAMES = ["leaf", "seen", "ids", "vecs", "weights", "bounds", "partners", "scores"]
_VISIT = "block string, ids array<long>, vecs array<double>, weights array<double>, bounds array<double>"
_RESULT = -1


def _grid(values, rows: int) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(rows, -1)


def _first_match(matcher: Matcher, coarse: Boxes, alone: bool):
    """Task body: rows next to a first block in, partners and visits to coarse leaves out.

    *alone*: that block holds all there is, so no visits are needed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                block_ids = np.asarray(row.ids, dtype=np.int64)
                block_points, block_weights = _grid(row.vecs, len(block_ids)), np.asarray(row.weights, dtype=float)
                if matcher.same:
                    asks = np.asarray(row.asks, dtype=bool)
                    ids, points, weights = block_ids[asks], block_points[asks], block_weights[asks]
                else:
                    ids = np.asarray(row.q_ids, dtype=np.int64)
                    points, weights = _grid(row.q_vecs, len(ids)), np.asarray(row.q_weights, dtype=float)
                if not len(ids):
                    continue
                open_ = np.full(len(ids), np.inf)
                partners, scores, bounds = matcher.match(ids, points, weights, open_, block_ids, block_points, block_weights)
                out = [(_RESULT, None, ids, None, None, None, partners, scores)]
                if not alone:
                    for leaf, near in coarse.within(points, weights, bounds, matcher.ward):
                        name = int(coarse.names[leaf])
                        out.append((name, row.block, ids[near], points[near].ravel(), weights[near], bounds[near], None, None))
                yield pd.DataFrame(out, columns=_FOUND_NAMES)

    return run


def _block_visits(matcher: Matcher):
    """Task body: visits to a coarse leaf, joined with the boxes of its blocks, in; visits to blocks out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                ids, boxes = np.asarray(row.ids, dtype=np.int64), block_boxes(row.boxes)
                points = _grid(row.vecs, len(ids))
                weights, bounds = np.asarray(row.weights, dtype=float), np.asarray(row.bounds, dtype=float)
                for box, near in boxes.within(points, weights, bounds, matcher.ward):
                    if boxes.names[box] != row.seen:
                        out.append((boxes.names[box], ids[near], points[near].ravel(), weights[near], bounds[near]))
            yield pd.DataFrame(out, columns=["block", "ids", "vecs", "weights", "bounds"])

    return run


def block_boxes(rows) -> Boxes:
    names = np.array([r["block"] for r in rows], dtype=object)
    lows, highs = (np.array([list(r[end]) for r in rows], dtype=float) for end in ("low", "high"))
    return Boxes(names, lows, highs, np.array([r["least"] for r in rows], dtype=float))


def _later_match(matcher: Matcher):
    """Task body: visits joined with their block in, partners out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                ids, block_ids = np.asarray(row.q_ids, dtype=np.int64), np.asarray(row.ids, dtype=np.int64)
                rows = (ids, _grid(row.q_vecs, len(ids)), np.asarray(row.q_weights, dtype=float), np.asarray(row.q_bounds, dtype=float))
                partners, scores, _ = matcher.match(*rows, block_ids, _grid(row.vecs, len(block_ids)), np.asarray(row.weights, dtype=float))
                out.append((_RESULT, None, ids, None, None, None, partners, scores))
            yield pd.DataFrame(out, columns=_FOUND_NAMES)

    return run


def _meet(visits: DataFrame, index: Index) -> DataFrame:
    """Visits next to the block they ask for. *visits* is a staged table.

    Blocks with more visits than others are copied to several tasks, among which their visits are
    dealt out; there are at most HOT_SHARES of them.
    """
    asked = visits.groupBy("block").count()
    total = asked.agg(F.sum("count")).first()[0] or 0
    limit = max(GROUPS_AT_ONCE, total // HOT_SHARES)
    hot = {row["block"]: -(-row["count"] // limit) for row in asked.where(F.col("count") > limit).collect()}
    salt, salts = F.lit(0), F.lit(1)
    if hot:
        table = visits.sparkSession.createDataFrame(sorted(hot.items()), "block string, salts long")
        visits = visits.join(F.broadcast(table), "block", "left")
        salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int")
    queries = visits.withColumn("salt", salt).select("block", "salt", *[F.col(c).alias(f"q_{c}") for c in ("ids", "vecs", "weights", "bounds")])
    blocks = index.blocks.select("block", "ids", "vecs", "weights")
    if hot:
        blocks = blocks.join(F.broadcast(table), "block", "left")
        salts = F.coalesce("salts", F.lit(1))
    blocks = blocks.select("block", "ids", "vecs", "weights", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("salt"))
    left, right = (side.repartition(index.tasks, "block", "salt") for side in (queries, blocks))
    return left.join(right.hint("merge"), ["block", "salt"])


def _search(first: DataFrame, index: Index, matcher: Matcher, area: StageArea) -> DataFrame:
    """Partners from the first match and from the visits it asked for. *first* is a staged table."""
    visits = first.where(F.col("leaf") != _RESULT).select("leaf", "seen", "ids", "vecs", "weights", "bounds")
    asked = visits.repartition(index.tasks).join(index.fine(), "leaf").mapInPandas(_block_visits(matcher), _VISIT)
    asked = area.put(asked, "visits")
    second = _meet(asked, index).mapInPandas(_later_match(matcher), _FOUND)
    return _top(first.where(F.col("leaf") == _RESULT).unionByName(second), matcher.k)


def nearest(
    points: DataFrame,
    k: int,
    area: StageArea,
    ward: bool = False,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """The *k* nearest other rows of each row of (id, vec, weight[, asks]) that asks, as (id, partner, score).

    The score is the Euclidean distance or, with *ward*, the rise in within-cluster squares (times
    two) when two clusters of the given weights merge. Exact; ties, to TIE_DIGITS decimals of a
    distance, go to the smaller ID.
    """
    index, matcher = build_index(points, area, leaf_rows, block_rows, rows), Matcher(k, ward, True)
    alone = index.blocks.limit(2).count() < 2
    first = index.blocks.mapInPandas(_first_match(matcher, index.coarse, alone), _FOUND)
    if alone:
        return _top(first, k)
    return _search(area.put(first, "first"), index, matcher, area)


def within(points: DataFrame, radius: float, area: StageArea, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, partner): ordered pairs of different rows of (id, vec, weight) at most *radius* apart."""
    index = build_index(points, area, leaf_rows, block_rows)
    matcher, coarse = Matcher(1, False, True), index.coarse

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                ids = np.asarray(row.ids, dtype=np.int64)
                rows, weights, bounds = _grid(row.vecs, len(ids)), np.asarray(row.weights, dtype=float), np.full(len(ids), radius)
                for leaf, near in coarse.within(rows, weights, bounds, False):
                    out.append((int(coarse.names[leaf]), None, ids[near], rows[near].ravel(), weights[near], bounds[near], None, None))
            yield pd.DataFrame(out, columns=_FOUND_NAMES)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, block_ids = np.asarray(row.q_ids, dtype=np.int64), np.asarray(row.ids, dtype=np.int64)
                squares = _pair_squares(_grid(row.q_vecs, len(ids)), _grid(row.vecs, len(block_ids)))
                a, b = np.nonzero((np.sqrt(squares) <= radius) & (ids[:, None] != block_ids[None, :]))
                yield pd.DataFrame({"id": ids[a], "partner": block_ids[b]})

    visits = index.blocks.mapInPandas(ask, _FOUND).select("leaf", "seen", "ids", "vecs", "weights", "bounds")
    asked = area.put(visits.join(index.fine(), "leaf").mapInPandas(_block_visits(matcher), _VISIT), "visits")
    return _meet(asked, index).mapInPandas(pairs, "id long, partner long")


def nearest_between(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    area: StageArea,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The *k* nearest rows of *points* for each row of *queries*, both (id, vec, weight)."""
    index, matcher = build_index(points, area, leaf_rows, block_rows), Matcher(k, False, False)
    if not len(index.coarse.names):
        return queries.select("id", F.col("id").alias("partner"), F.lit(0.0).alias("score")).limit(0)
    coarse = index.coarse

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in groups of one closest coarse leaf."""
        step = max(1, 2_000_000 // len(coarse.names))
        for batch in batches:
            for low in range(0, len(batch), step):
                part = batch.iloc[low : low + step]
                points = np.stack(part["vec"].to_numpy()).astype(float)
                closest = coarse.squares(points).argmin(axis=1)
                ids, weights = part["id"].to_numpy(), part["weight"].to_numpy(float)
                out = [(int(coarse.names[c]), ids[r], points[r].ravel(), weights[r]) for c, r in _groups(closest, block_rows)]
                yield pd.DataFrame(out, columns=["leaf", "ids", "vecs", "weights"])

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The same by closest block, next to the boxes of their coarse leaf."""
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                boxes, ids = block_boxes(row.boxes), np.asarray(row.ids, dtype=np.int64)
                points, weights = _grid(row.vecs, len(ids)), np.asarray(row.weights, dtype=float)
                for box, r in _groups(boxes.squares(points).argmin(axis=1), block_rows):
                    out.append((boxes.names[box], ids[r], points[r].ravel(), weights[r], np.full(len(r), np.inf)))
            yield pd.DataFrame(out, columns=["block", "ids", "vecs", "weights", "bounds"])

    schema = "leaf int, ids array<long>, vecs array<double>, weights array<double>"
    placed = queries.select("id", "vec", "weight").mapInPandas(packed, schema)
    grouped = area.put(placed.join(index.fine(), "leaf").mapInPandas(seeds, _VISIT), "queries")
    first = _meet(grouped, index).mapInPandas(_first_match(matcher, coarse, False), _FOUND)
    return _search(area.put(first, "first"), index, matcher, area)


def _groups(keys: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key, rows) with at most *most* rows at once."""
    for key in np.unique(keys):
        rows = np.flatnonzero(keys == key)
        for low in range(0, len(rows), most):
            yield int(key), rows[low : low + most]


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k partners of each row; every block gave at most k, and each task keeps at most k before the exchange."""
    pairs = F.zip_with("scores", "partners", lambda s, p: F.arrays_zip(s.alias("score"), p.alias("partner")))
    rows = found.select("ids", pairs.alias("pairs"))
    lists = rows.select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("pairs").alias("pairs"))))
    each = lists.select("id", F.inline("pairs"))
    order = Window.partitionBy("id").orderBy("score", "partner")
    ranked = each.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return ranked.select("id", "partner", "score")
