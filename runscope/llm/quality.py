"""Quality score: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of whole texts (lengths, character classes, repetition) are standardised and mapped by
random Fourier features to a space in which a linear model equals a Gaussian-kernel one. Partitions
sum their share of the normal equations; their number of cells depends only on the number of
features, so the driver solves a system of fixed size. The raw ridge score is then made a
probability by isotonic regression on bins of the training scores.

Defined results: a null or empty text has all statistics zero and is scored like any other; without
labels every score is 0; with labels of one class every score is that class. Of several labels of
one document the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.splits import labelled
from runscope.llm.text import STEP, Words, buffers, mix, slices, window_starts, windows
from runscope.plans.stage import StageArea

SLICE = 2 << 20
KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "bracket", "symbol", "wide")
STATISTICS = [
    "log_words",
    "word_length",
    "word_spread",
    "longest_word",
    *KINDS,
    "distinct_words",
    "distinct_triples",
    "doubled_words",
    "short_words",
    "words_per_line",
]
BINS = 2000


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("symbol"), np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind[b] = KINDS.index("wide")
        elif c.islower():
            kind[b] = KINDS.index("lower")
        elif c.isupper():
            kind[b] = KINDS.index("upper")
        elif c.isdigit():
            kind[b] = KINDS.index("digit")
        elif c == "\n":
            kind[b] = KINDS.index("newline")
        elif b < 33:
            kind[b] = KINDS.index("space")
        elif c in ".,;:?'\"-":
            kind[b] = KINDS.index("stop")
        elif c in "()[]{}<>":
            kind[b] = KINDS.index("bracket")
    return kind


BYTE_KINDS = _byte_kinds()


def statistics(text: pa.Array) -> np.ndarray:
    """(rows, statistics) of a batch of texts."""
    data, offsets = buffers(text)
    rows, sizes = len(text), np.diff(offsets)
    cells = BYTE_KINDS[data]
    cells += np.repeat(np.arange(rows) * len(KINDS), sizes)
    kinds = np.bincount(cells, minlength=rows * len(KINDS)).reshape(rows, -1) / np.maximum(sizes, 1)[:, None]
    words = Words(data, offsets)
    document, counts = words.document(), words.counts
    share = lambda found: np.bincount(document, found, rows) / np.maximum(counts, 1)
    mean = share(words.length)
    hashes = words.hashes(lower=True)
    longest = np.zeros(rows)
    if len(words):
        longest[counts > 0] = np.maximum.reduceat(words.length, words.first[:-1][counts > 0])
    doubled = np.zeros(len(words))
    doubled[1:] = (hashes[1:] == hashes[:-1]) & (document[1:] == document[:-1])
    triples = windows(hashes, 3)
    starts = window_starts(words.first, 3)
    lines = np.rint(kinds[:, KINDS.index("newline")] * sizes) + 1
    return np.column_stack(
        [
            np.log1p(counts),
            mean,
            np.sqrt(np.maximum(share(words.length.astype(float) ** 2) - mean**2, 0)),
            np.log1p(longest),
            kinds,
            _distinct(hashes, document, rows),
            _distinct(triples[starts], document[starts], rows),
            share(doubled),
            share(words.length <= 3),
            np.log1p(counts / lines),
        ]
    )


def _distinct(values: np.ndarray, document: np.ndarray, rows: int) -> np.ndarray:
    """Share of different values per document; 0 without any."""
    keys = mix(values + document.astype(np.uint64) * STEP)
    _, first = np.unique(keys, return_index=True)
    return np.bincount(document[first], minlength=rows) / np.maximum(np.bincount(document, minlength=rows), 1)


@dataclass
class QualityModel:
    middle: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.scale, -6, 6)
        wave = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([np.ones(len(x)), wave])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            x = statistics(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), _lists(x)], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-2) -> QualityModel:
    """Fit on every labelled row of *stats* (doc_id, x)."""
    known = labelled(stats, labels, "quality")
    rows = stats.join(known, "doc_id").select("x", (F.col("label") > 0).cast("double").alias("y"))
    d = len(STATISTICS)
    sums = [f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(d) for f in (F.avg, F.stddev_pop)]
    moments = rows.agg(F.count("*").alias("n"), F.avg("y").alias("share"), *sums).first()
    rng = np.random.default_rng(7)
    model = QualityModel(
        np.zeros(d),
        np.ones(d),
        rng.normal(0, 1 / width, (d, features)),
        rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1),
        np.array([0.0, 1.0]),
        np.full(2, moments["share"] or 0.0),
    )
    if not moments["n"] or moments["share"] in (0.0, 1.0):
        return model
    model.middle = np.array([moments[f"avg{i}"] for i in range(d)])
    model.scale = np.maximum([moments[f"stddev_pop{i}"] for i in range(d)], 1e-9)
    cells = rows.mapInArrow(_normal_equations(model), "cell int, value double")
    found = cells.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    size = features + 2
    total = np.zeros(size * size)
    total[found["cell"]] = found["value"]
    total = np.triu(total.reshape(size, size))
    total += np.triu(total, 1).T
    # The last column holds the labels; the constant is not penalised.
    penalty = ridge * np.eye(size - 1)
    penalty[0, 0] = 1e-9
    model.weights = np.linalg.solve(total[:-1, :-1] + penalty, total[:-1, -1])
    bins = rows.mapInArrow(_binned(model), "bin int, y double, n long").groupBy("bin")
    counts = bins.agg(F.sum("y").alias("y"), F.sum("n").alias("n")).orderBy("bin").toPandas()
    model.edges = (counts["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    model.levels = isotonic(counts["y"].to_numpy(float), counts["n"].to_numpy(float))
    return model


def _normal_equations(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            z = np.column_stack([model.features(_matrix(batch.column("x"))), batch.column("y").to_numpy()])
            total = total + z.T @ z
        if np.ndim(total):
            cells = np.flatnonzero(np.triu(np.ones_like(total)).ravel())
            columns = [pa.array(cells.astype(np.int32)), pa.array(total.ravel()[cells])]
            yield pa.record_batch(columns, names=["cell", "value"])

    return run


def _binned(model: QualityModel):
    """Scores from -0.5 to 1.5 in equal bins: number of rows and of labels 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, n = np.zeros(BINS), np.zeros(BINS, np.int64)
        for batch in batches:
            raw = model.raw(_matrix(batch.column("x")))
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            y += np.bincount(at, batch.column("y").to_numpy(), BINS)
            n += np.bincount(at, minlength=BINS)
        some = np.flatnonzero(n)
        columns = [pa.array(some.astype(np.int32)), pa.array(y[some]), pa.array(n[some])]
        yield pa.record_batch(columns, names=["bin", "y", "n"])

    return run


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least-squares rising means of bins (pool adjacent violators)."""
    pools: list[list[float]] = []
    for total, count in zip(y, n, strict=True):
        pools.append([total, count, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.concatenate([np.full(int(bins), total / count) for total, count, bins in pools])


def score_statistics(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row of *stats*."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.scores(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of *docs*, learned from *labels*; texts are read once."""
    stats = StageArea(docs.sparkSession, "quality").put(document_statistics(docs), "statistics")
    return score_statistics(stats, fit(stats, labels))
