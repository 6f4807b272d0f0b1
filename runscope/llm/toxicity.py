"""Toxicity from class-conditional Kneser-Ney models.

One interpolated word bigram model per class is estimated from a bounded sample of labelled documents.
An expression (a word after its predecessor) keeps its count less an absolute discount; what the
discounts free goes to the lower order of the class, whose counts are, as in Kneser-Ney smoothing, the
numbers of different predecessors a word has in the class. That order is discounted likewise and falls
back on one distribution which both classes share, over the predecessors in either class; so a word
unseen in a class is as unlikely there as any rare one. A document's evidence is the log-likelihood
ratio per word of both orders: over the whole text, over its most toxic stretch of eight words and over
its most toxic word. A logistic calibration on sampled documents that were kept out of the counts turns
it into a probability. Words are lower-case runs of letters and digits; the first word of a text follows
a mark of its own.

Defined results: a null or empty text has no evidence and gets the calibrated score of none;
without labels of both classes every score is the share of toxic labels (0 without any). Rows are
scored one by one and whole, whatever their length, so repeated rows and ties need no rule there; a
labelled document that has several rows counts once for each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.lookup import Lookup
from runscope.llm.splits import labelled, sample
from runscope.llm.text import IS_MARK, STEP, Words, buffers, mix, slices

SLICE = 1 << 20
STRETCHES = (1, 8)
ORDERS = ("word", "pair")
EVIDENCE = [f"{order}_{part}" for order in ORDERS for part in ("mean", *(f"most_{n}" for n in STRETCHES))]
#: Stands before the first word of a text.
START = np.uint64(1)


def word_pairs(text: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of all texts, their hashes and those of their predecessors."""
    words = Words(*buffers(text), IS_MARK)
    hashes = words.hashes(lower=True)
    before = np.concatenate([[START], hashes[:-1]])[: len(hashes)]
    before[words.first[:-1][words.counts > 0]] = START
    return words, before, hashes


def joint(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix((before * STEP) ^ hashes)


@dataclass
class ToxicityModel:
    """Two rows each, toxic and ordinary; the last column stands for what the sample does not hold.

    ``lower`` is the chance of a word in the lower order, ``rest`` what the discounts after a word free
    for it, ``kept`` the discounted share of a pair among all pairs with its predecessor.
    """

    words: np.ndarray
    lower: np.ndarray
    rest: np.ndarray
    pairs: np.ndarray
    kept: np.ndarray
    weights: np.ndarray

    def open(self) -> ToxicityModel:
        self.word_table, self.pair_table = Lookup(self.words), Lookup(self.pairs)
        return self

    def evidence(self, text: pa.Array) -> np.ndarray:
        """One row per text: for both orders the ratio per word of the text and of its highest stretches."""
        words, before, hashes = word_pairs(text)
        out = np.zeros((len(text), len(EVIDENCE)))
        some = words.counts > 0
        if not some.any():
            return out
        lower = self.lower[:, self.word_table.find(hashes)]
        both = self.kept[:, self.pair_table.find(joint(before, hashes))] + self.rest[:, self.word_table.find(before)] * lower
        first, counts = words.first, words.counts
        ends = np.repeat(first[1:], counts)
        columns = iter(range(len(EVIDENCE)))
        for chance in (lower, both):
            total = np.concatenate([[0.0], np.cumsum(np.log(chance[0] / chance[1]))])
            out[some, next(columns)] = (total[first[1:]] - total[first[:-1]])[some] / counts[some]
            for n in STRETCHES:
                stretch = (total[np.minimum(np.arange(len(words)) + n, ends)] - total[:-1]) / n
                out[some, next(columns)] = np.maximum.reduceat(stretch, first[:-1][some])
        return out

    def scores(self, text: pa.Array) -> np.ndarray:
        return logistic(self.evidence(text) @ self.weights[:-1] + self.weights[-1])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> ToxicityModel:
    """Estimate from at most *per_class* documents of each class, a fifth of them for calibration only."""
    rows = labelled(docs, labels, "toxic").withColumn("label", (F.col("label") > 0).cast("int"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        nothing, alike = np.zeros(0, np.uint64), np.ones((2, 1))
        share = 1.0 if 1 in sizes else 0.0
        weights = np.array([*[0.0] * len(EVIDENCE), 700 * (2 * share - 1)])
        return ToxicityModel(nothing, alike, alike, nothing, 0 * alike, weights)
    chosen = sample(rows.where("label = 1"), per_class).unionByName(sample(rows.where("label = 0"), per_class))
    # The sample has a fixed size, so its ids can go to every task.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    calibrating = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    counts = texts.where(~calibrating).select("label", "text").mapInArrow(
        _count, "label int, before long, word long, n long"
    )
    model = _estimate(counts.groupBy("label", "before", "word").agg(F.sum("n").alias("n")).toArrow())
    schema = "label int, " + ", ".join(f"{name} double" for name in EVIDENCE)
    cases = texts.where(calibrating).select("label", "text").mapInArrow(_evidence(model), schema)
    model.weights = _calibrate(cases.toPandas(), sizes)
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        words, before, hashes = word_pairs(batch.column("text"))
        label = np.repeat(batch.column("label").to_numpy(zero_copy_only=False), words.counts)
        keys = joint(before, hashes)
        for one in np.unique(label):
            mine = np.flatnonzero(label == one)
            _, first, n = np.unique(keys[mine], return_index=True, return_counts=True)
            first = mine[first]
            columns = [pa.array(np.full(len(n), one, np.int32)), pa.array(before[first].view(np.int64))]
            columns += [pa.array(hashes[first].view(np.int64)), pa.array(n)]
            yield pa.record_batch(columns, names=["label", "before", "word", "n"])


def discount(counts: np.ndarray) -> float:
    """The absolute discount of a table of counts, from how many are one and two."""
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return (once + 0.5) / (once + 2 * twice + 1)


def _estimate(counts: pa.Table) -> ToxicityModel:
    """Interpolated Kneser-Ney models of both classes from the counts of (label, before, word)."""
    before, word = (counts[c].to_numpy().view(np.uint64) for c in ("before", "word"))
    n, label = counts["n"].to_numpy(), counts["label"].to_numpy()
    words, at = np.unique(np.concatenate([before, word]), return_inverse=True)
    before_at, word_at = at[: len(before)], at[len(before) :]
    pairs, first, pair_at = np.unique(joint(before, word), return_index=True, return_inverse=True)
    predecessors = np.bincount(word_at[first], minlength=len(words) + 1)
    shared = (predecessors + 0.5) / (predecessors + 0.5).sum()
    lower, rest = np.ones((2, len(words) + 1)), np.ones((2, len(words) + 1))
    kept = np.zeros((2, len(pairs) + 1))
    for row, one in enumerate((1, 0)):
        mine = label == one
        own = np.bincount(word_at[mine], minlength=len(words) + 1)
        cut, total = discount(own), max(1, mine.sum())
        freed = max(cut * (own > 0).sum() / total, 1e-6)
        lower[row] = np.maximum(own - cut, 0) / total + freed * shared
        cut, after = discount(n[mine]), np.bincount(before_at[mine], n[mine], len(words) + 1)
        seen = after > 0
        rest[row, seen] = cut * np.bincount(before_at[mine], minlength=len(words) + 1)[seen] / after[seen]
        kept[row, pair_at[mine]] = np.maximum(n[mine] - cut, 0) / after[before_at[mine]]
    return ToxicityModel(words, lower, rest, pairs, kept, np.zeros(len(EVIDENCE) + 1))


def _evidence(model: ToxicityModel):
    held = _broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = held.value.open()
        for batch in slices(batches, "text", SLICE):
            found = opened.evidence(batch.column("text"))
            yield pa.record_batch([batch.column("label"), *map(pa.array, found.T.copy())], names=["label", *EVIDENCE])

    return run


def _calibrate(rows, sizes: dict[int, int], ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by damped Newton steps; classes weigh as they do among all labels."""
    raw, y = rows[EVIDENCE].to_numpy(float), rows["label"].to_numpy(float)
    share = np.array([sizes[0], sizes[1]]) / sum(sizes.values())
    if not len(y):
        return np.array([*[0.0] * len(EVIDENCE), np.log(share[1] / share[0])])
    middle, scale = raw.mean(0), np.maximum(raw.std(0), 1e-9)
    x = np.column_stack([(raw - middle) / scale, np.ones(len(y))])
    drawn = np.maximum(np.bincount(y.astype(int), minlength=2), 1)
    weight = (share / drawn)[y.astype(int)] * len(y)
    penalty = ridge * np.array([1.0] * len(EVIDENCE) + [1e-3])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * beta * beta).sum() / 2

    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = logistic(x @ beta)
        gradient = x.T @ (weight * (y - p)) - penalty * beta
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(penalty), gradient)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step /= 2
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    slope = beta[:-1] / scale
    return np.append(slope, beta[-1] - slope @ middle)


def _broadcast(model):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row."""
    held = _broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = held.value.open()
        for batch in slices(batches, "text", SLICE):
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(opened.scores(batch.column("text")))], names=["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_ordinary(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Rows of *docs*, all columns unchanged, whose score stays below *threshold*."""
    held = _broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = held.value.open()
        for batch in slices(batches, "text", SLICE):
            yield batch.filter(pa.array(opened.scores(batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
