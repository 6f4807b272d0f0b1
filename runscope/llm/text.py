"""Bytes, words and windows of whole Arrow batches as numpy arrays.

A batch of texts is one byte array and the offsets of its documents. A word is a longest run of
bytes other than 0x20 and 0x09-0x0D inside one document; as these bytes are never part of a longer
UTF-8 sequence, that is the pattern ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of bare words: ASCII other than letters and digits.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks for the first 0 to 8 bytes of a little-endian word.
LOW_BYTES = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a missing document id inside packed arrays; it sorts first, as nulls do.
NO_ID = -(2**63)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    column = pa.compute.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, target: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about *target* bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = buffers(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + target, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """Words of a batch: byte ``start`` and ``length`` of each, and ``first``: the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE) -> None:
        space = separators[data]
        inside = ~space
        begin = inside.copy()
        begin[1:] &= space[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begin[edges] = inside[edges]
        stop = inside.copy()
        stop[:-1] &= space[1:] | begin[1:]
        self.data = data
        self.start = np.flatnonzero(begin)
        self.length = np.flatnonzero(stop) + 1 - self.start
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit hash per word, from eight bytes at a time."""
        data = np.concatenate([LOWER[self.data] if lower else self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
        out = self.length.astype(np.uint64) * STEP
        left = np.arange(len(self))
        done = 0
        while len(left):
            size = np.minimum(self.length[left] - done, 8)
            out[left] = mix((out[left] ^ (eights[self.start[left] + done] & LOW_BYTES[size])) * STEP)
            done += 8
            left = left[self.length[left] > done]
        return out

    def select(self, keep: np.ndarray, document: int) -> bytes:
        """Kept words of one document joined by one space."""
        low, high = self.first[document], self.first[document + 1]
        chosen = low + np.flatnonzero(keep[low:high])
        if not len(chosen):
            return b""
        starts, lengths = self.start[chosen], self.length[chosen]
        ends = np.cumsum(lengths + 1)
        out = np.full(ends[-1], 0x20, np.uint8)
        inside = np.arange(ends[-1]) - np.repeat(ends - lengths - 1, lengths + 1)
        source = np.repeat(starts, lengths + 1) + inside
        word = inside < np.repeat(lengths, lengths + 1)
        out[word] = self.data[source[word]]
        return out[:-1].tobytes()


def windows(values: np.ndarray, width: int, base: np.uint64 = np.uint64(0xD1342543DE82EF95)) -> np.ndarray:
    """Polynomial hash of every *width* consecutive values; the result has len(values) - width + 1 entries."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    done, total, single, size = None, 0, values.astype(np.uint64), 1
    factor = base
    left = width
    while left:
        if left & 1:
            if done is None:
                done, total = single.copy(), size
            else:
                n = len(values) - (total + size) + 1
                done = done[:n] * factor + single[total : total + n]
                total += size
        left >>= 1
        if left:
            n = len(single) - size
            single = single[:n] * factor + single[size : size + n]
            factor = np.uint64(int(factor) ** 2 % 2**64)
            size *= 2
    return mix(done)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of *width* fits into its document, for documents starting at *first*."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    return np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
