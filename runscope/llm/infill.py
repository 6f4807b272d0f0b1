"""Fill-in-the-middle: whole texts cut at unit ends into prefix, middle and suffix, put in order with marks.

A unit is a line with its line feed, or a last line without one. All UTF-8 bytes of a batch are
viewed as 64-bit words. Unit ends and first bytes of characters become marks, one bit a byte, by word
arithmetic; marks are counted per word, the word of the wanted mark is found in the running counts, and
the mark inside it by clearing lower ones. So a cut costs one binary search, however long its text.

Rows are handled one by one: repeated rows and ties have equal results, an empty table gives none. A
null or empty text is plain and stays empty. A null id is hashed as the empty text. Only the id and the text
column are read, other columns, whatever their names, are left out. A very long text is a batch of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.text import LOW_BYTES, buffers, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BATCH_BYTES = 4 << 20
LOW_BITS = np.uint64(0x7F7F7F7F7F7F7F7F)
TOP_BITS = np.uint64(0x8080808080808080)
LINE_FEEDS = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE = np.uint64(1)


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words; zeros follow, one whole word at least."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def line_feeds(words: np.ndarray) -> np.ndarray:
    """Top bit of each byte that is a line feed; no carry passes from one byte to the next."""
    x = words ^ LINE_FEEDS
    return ~(((x & LOW_BITS) + LOW_BITS) | x | LOW_BITS)


def first_bytes(words: np.ndarray) -> np.ndarray:
    """Top bit of each byte that begins a character, so is not 10xxxxxx."""
    return TOP_BITS & ~(words & ~(words << ONE))


class Marks:
    """Rank and select over words with at most one mark, the top bit, per byte."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of marks on bytes before each byte place."""
        word = at >> 3
        return self.before[word] + np.bitwise_count(self.marks[word] & LOW_BYTES[at & 7])

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte place of the mark with each number, counted from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        left, bits = k - self.before[word], self.marks[word]
        for lower in range(7):
            bits = np.where(left > lower, bits & (bits - ONE), bits)
        return word * 8 + (np.bitwise_count(bits ^ (bits - ONE)).astype(np.int64) - 1 >> 3)


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """The first four 8-digit groups of the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def arrange(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    if form == "spm":
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return prefix + middle + suffix


def rebuild(form: str, output: bytes) -> bytes:
    """The text that :func:`arrange` was given: as it holds no mark, the first one of each kind is the true one."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head[len(PREFIX) :].partition(SUFFIX)
    else:
        suffix, _, prefix = head[len(SUFFIX) :].partition(PREFIX)
    return prefix + middle + suffix


def transform(ids: list, data: np.ndarray, offsets: np.ndarray, seed: int, rate: int, spm: int) -> dict[str, list]:
    """Columns of the result for the texts of one batch."""
    words = as_words(data)
    ends, chars = Marks(line_feeds(words)), Marks(first_bytes(words))
    starts, stops = offsets[:-1], offsets[1:]
    before = ends.rank(starts)
    feeds = ends.rank(stops) - before
    open_end = (stops > starts) & (data[np.maximum(stops - 1, 0)] != 0x0A) if len(data) else np.zeros(len(starts), bool)
    n = feeds + open_end
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)

    def cut(units: np.ndarray) -> np.ndarray:
        """Byte place after so many units of each text."""
        at = np.where(units > feeds, stops, starts)
        some = np.flatnonzero((units > 0) & (units <= feeds))
        at[some] = ends.select(before[some] + units[some] - 1) + 1
        return at

    low, high = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    chars_low, chars_high = chars.rank(low), chars.rank(high)
    prefix_chars, middle_chars = chars_low - chars.rank(starts), chars_high - chars_low
    raw = data.tobytes()
    out: dict[str, list] = {"n": n.tolist(), "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
    for i, (start, a, b, stop) in enumerate(zip(starts.tolist(), low.tolist(), high.tolist(), stops.tolist(), strict=True)):
        marked = any(raw.find(mark, start, stop) >= 0 for mark in (PREFIX, SUFFIX, MIDDLE))
        plain = start == stop or marked or h[i, 2] % 100 >= rate
        form = "plain" if plain else "spm" if h[i, 3] % 100 < spm else "psm"
        out["form"].append(form)
        out["prefix_chars"].append(None if plain else int(prefix_chars[i]))
        out["middle_chars"].append(None if plain else int(middle_chars[i]))
        out["output"].append(arrange(form, raw[start:a], raw[a:b], raw[b:stop]))
    return out


def fill_in_middle(docs: DataFrame, text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every text, *rate* percent of them rearranged.

    *spm* percent of the rearranged ones begin with the suffix. Texts that hold a mark stay plain.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            ids = batch.column("doc_id")
            found = transform(ids.to_pylist(), *buffers(batch.column("text")), seed, rate, spm)
            longs = [pa.array(found[name], pa.int64()) for name in ("n", "prefix_chars", "middle_chars")]
            output = pa.array(found["output"], pa.binary()).cast(pa.string())
            yield pa.record_batch([ids, longs[0], pa.array(found["form"], pa.string()), *longs[1:], output], names=names)

    wanted = docs.select("doc_id", F.col(text).alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(arranged: DataFrame) -> DataFrame:
    """*arranged*, the result of :func:`fill_in_middle`, with the text rebuilt from form and output as ``restored``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output", BATCH_BYTES):
            outputs = batch.column("output").cast(pa.binary()).to_pylist()
            texts = [rebuild(form, output) for form, output in zip(batch.column("form").to_pylist(), outputs, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "restored"])

    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in arranged.schema)
    return arranged.mapInArrow(run, f"{schema}, restored string")
