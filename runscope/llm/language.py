"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads stretches of 64 bytes in both directions and labels every position; a document's
probabilities are the mean over all its positions. It is trained in numpy by backpropagation through
time on stretches spread evenly over whole texts of a bounded sample of documents. Its size does not
depend on the data, so every task holds it, and each document is labelled where it is read.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if
no language can be learned, and an empty table gives no rows. Ties go to the language that sorts first. Very long
texts are labelled whole, stretch by stretch; repeated rows are labelled alike, and each takes part in the sample.
Training has a least number of steps, so small tables are learned too. Only doc_id, text and lang are read,
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.text import buffers, slices

STRETCH = 64
STRETCHES = 2048
PAD = 0x20
SLICE = 4 << 20
#: Steps of training at least, and the loss at which it may end before.
LEAST_STEPS = 240
LOSS_REACHED = 0.01
UNKNOWN = "und"
ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


@dataclass
class Direction:
    """One gated recurrent layer; gates in the order update, reset, candidate."""

    inputs: np.ndarray
    hidden: np.ndarray

    def states(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(time, batch, units) for byte codes (time, batch); *keep* collects what backpropagation needs."""
        steps, batch = codes.shape
        units = self.hidden.shape[0]
        # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        half = np.concatenate([np.full(2 * units, 0.5), np.ones(units)]).astype(np.float32)
        inputs, hidden = self.inputs * half, self.hidden * half
        out = np.empty((steps, batch, units), np.float32)
        state = np.zeros((batch, units), np.float32)
        for t in range(steps):
            x, past = inputs.take(codes[t], axis=0), state @ hidden
            gates = np.tanh(x[:, : 2 * units] + past[:, : 2 * units])
            gates *= 0.5
            gates += 0.5
            update, reset = gates[:, :units], gates[:, units:]
            fresh = np.tanh(x[:, 2 * units :] + reset * past[:, 2 * units :])
            if keep is not None:
                keep.append((state, update, reset, fresh, past[:, 2 * units :]))
            state = fresh + update * (state - fresh)
            out[t] = state
        return out

    def gradients(self, codes: np.ndarray, keep: list, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of (inputs, hidden) for *outer*, the gradient of every state."""
        units = self.hidden.shape[0]
        by_input = np.empty((*codes.shape, 3 * units), np.float32)
        d_hidden = np.zeros_like(self.hidden)
        carried = np.zeros_like(outer[0])
        for t in range(len(codes) - 1, -1, -1):
            before, update, reset, fresh, past = keep[t]
            d_state = outer[t] + carried
            d_fresh = d_state * (1 - update) * (1 - fresh * fresh)
            d_update = d_state * (before - fresh) * update * (1 - update)
            d_reset = d_fresh * past * reset * (1 - reset)
            by_input[t] = np.concatenate([d_update, d_reset, d_fresh], axis=1)
            by_past = np.concatenate([d_update, d_reset, d_fresh * reset], axis=1)
            d_hidden += before.T @ by_past
            carried = d_state * update + by_past @ self.hidden.T
        flat, ids = by_input.reshape(-1, 3 * units), codes.ravel()
        d_inputs = np.stack([np.bincount(ids, column, 256) for column in flat.T], axis=1)
        return d_inputs.astype(np.float32), d_hidden


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Direction
    backward: Direction
    readout: np.ndarray
    bias: np.ndarray
    losses: list[float] = field(default_factory=list)

    def labels(self, codes: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (time, batch, languages) of every position, and the states they were read from."""
        ahead = self.forward.states(codes, kept and kept[0])
        behind = self.backward.states(codes[::-1], kept and kept[1])[::-1]
        states = np.concatenate([ahead, behind], axis=2)
        scores = np.exp(np.clip(states.reshape(-1, states.shape[2]) @ self.readout + self.bias, -60, 60))
        scores /= scores @ np.ones((len(self.bias), 1), np.float32)
        return scores.reshape(*codes.shape, -1), states

    def probabilities(self, text: pa.Array) -> np.ndarray:
        """(rows, languages): the mean of all positions of each text; zero for empty ones."""
        data, offsets = buffers(text)
        sizes = np.diff(offsets)
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(text)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[owner] + number * STRETCH
        length = np.minimum(offsets[owner + 1] - start, STRETCH)
        padded = np.concatenate([data, np.full(STRETCH, PAD, np.uint8)])
        sums = np.zeros((len(owner), len(self.languages)))
        steps = np.arange(STRETCH)[:, None]
        for low in range(0, len(owner), STRETCHES):
            part = slice(low, low + STRETCHES)
            inside = steps < length[part]
            codes = np.where(inside, padded[start[part] + steps], PAD)
            found, _ = self.labels(codes)
            short = ~inside.all(0)
            found[:, short] *= inside[:, short, None]
            sums[part] = found.sum(0)
        out = np.zeros((len(text), len(self.languages)))
        some = pieces > 0
        if some.any():
            out[some] = np.add.reduceat(sums, (np.cumsum(pieces) - pieces)[some]) / sizes[some, None]
        return out


def train(
    codes: np.ndarray, labels: np.ndarray, languages: list[str], units: int, epochs: int, batch: int = 256, least: int = LEAST_STEPS
) -> LanguageModel:
    """Fit by Adam on stretches *codes* (n, time) with one language number each.

    Small samples are gone through more often, for *least* steps; a mean loss below ``LOSS_REACHED`` over the last 20 steps ends it.
    """
    rng = np.random.default_rng(3)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    layers = [Direction(draw(256, 3 * units, scale=0.3), draw(units, 3 * units, scale=units**-0.5)) for _ in range(2)]
    model = LanguageModel(languages, *layers, draw(2 * units, len(languages), scale=0.3), np.zeros(len(languages), np.float32))
    weights = [model.forward.inputs, model.forward.hidden, model.backward.inputs, model.backward.hidden, model.readout, model.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    rounds = max(least, epochs * (len(codes) // batch))
    for step in range(1, rounds + 1):
        chosen = rng.integers(0, len(codes), min(batch, len(codes)))
        x, y = codes[chosen].T.copy(), labels[chosen]
        kept: tuple[list, list] = ([], [])
        found, states = model.labels(x, kept)
        model.losses.append(float(-np.log(found[:, np.arange(len(y)), y] + 1e-9).mean()))
        if step > 20 and np.mean(model.losses[-20:]) < LOSS_REACHED:
            break
        error = found.copy()
        error[:, np.arange(len(y)), y] -= 1
        error /= x.size
        flat = error.reshape(-1, len(languages))
        outer = (flat @ model.readout.T).reshape(states.shape)
        ahead = model.forward.gradients(x, kept[0], outer[..., :units])
        behind = model.backward.gradients(x[::-1], kept[1], outer[::-1, :, units:])
        gradients = [*ahead, *behind, states.reshape(len(flat), -1).T @ flat, flat.sum(0)]
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / rounds)
        for w, g, m, v in zip(weights, gradients, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def _stretches(per_text: int):
    """Stretches spread evenly over each whole text, padded with spaces if it is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            languages, found, cut = batch.column("lang").to_pylist(), [], []
            for i, language in enumerate(languages):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                room = max(0, len(text) - STRETCH)
                for start in sorted({room * k // max(1, per_text - 1) for k in range(per_text)}):
                    found.append(language)
                    cut.append(text[start : start + STRETCH].ljust(STRETCH, b" "))
            yield pa.record_batch([pa.array(found, pa.string()), pa.array(cut, pa.binary())], names=["lang", "stretch"])

    return run


def fit(docs: DataFrame, per_language: int = 500, per_text: int = 8, units: int = 8, epochs: int = 8) -> LanguageModel | None:
    """Train on about *per_language* documents of each language, *per_text* stretches of each.

    *docs* holds the rows to learn from. Languages are counted over all of them; the sample takes
    the same share of each language's hash range, so it is the same one in each run.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "doc_id", F.col("lang").cast("string").alias("lang"), "text"
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < share[F.col("lang")])
    rows = chosen.select("lang", "text").mapInArrow(_stretches(per_text), "lang string, stretch binary")
    rows = rows.toPandas().sort_values(["lang", "stretch"])
    codes = np.frombuffer(b"".join(map(bytes, rows["stretch"])), np.uint8).reshape(-1, STRETCH)
    labels = np.searchsorted(languages, rows["lang"].to_numpy(str))
    return train(codes, labels, languages, units, epochs)


def has_letter(text: pa.Array) -> np.ndarray:
    data, offsets = buffers(text)
    total = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(map(str.isalpha, text[int(i)].as_py()))
    return out


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches, "text", SLICE):
            text = batch.column("text")
            names, scores = [UNKNOWN] * len(text), np.zeros(len(text))
            if model:
                found = model.probabilities(text)
                sure = has_letter(text)
                scores = np.where(sure, np.minimum(found.max(1), 1.0), 0.0)
                names = [model.languages[k] if s else UNKNOWN for k, s in zip(found.argmax(1), sure, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
