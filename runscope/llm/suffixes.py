"""Suffix dedup: every byte inside a string of 200 bytes that starts anywhere else is removed.

The collection is cut by content so that no repeat crosses a cut: each 200-byte window belongs to
the place of its smallest 64-byte hash (the leftmost of equal ones), and the windows of one place
form a piece of at most 336 bytes. Equal windows have equal places, so only pieces of the same
64 bytes, the same anchor, can share a window, and they do so at the same distance from it. Pieces
that are equal as a whole are repeats of each other and travel once.

Where an anchor has several different pieces, their transform is built column by column from the
right: each round puts one symbol of every piece in front of its suffix, sorts the suffixes by
(symbol, former rank) and carries the common prefixes of neighbours along. A window is a repeat if
its suffix has 200 bytes in common with a neighbour. The columns of a part are arrays of a task, not
sequential files: pieces are short, and a part holds a bounded number of them. An anchor with very
many different pieces is not brought together at all: its windows are compared by their hashes.

Defined results: a null text is empty; bytes are those of UTF-8, and matches never cross documents.
Repeats are judged on the input, so all copies of a repeated string go, those in repeated rows too. Ids play no part. Very long texts are
worked through in overlapping stretches. Other columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runscope.llm.blocks import Block, ask, heard, pack, part_count, unpack
from runscope.llm.text import STEP, mix, windows
from runscope.plans.stage import StageArea

#: Different pieces of one anchor that may meet in a task.
MOST_PIECES = 20_000
BLOCK_BYTES = 1 << 19
#: Bytes worked on at once: their arrays take about a hundred times as much.
STRETCH = 1 << 17
#: Room for a place in a stretch below 40 bits of hash.
PLACE_BITS, PLACE_MASK = np.uint64(24), np.uint64(2**24 - 1)
#: Parts of the question that carries bytes, for each part of the others.
SHIPPED = 4
REPEATED, SEVERAL, CROWDED = np.uint64(1), np.uint64(2), np.uint64(4)
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
ASKED = np.dtype([("key", "<u8"), ("content", "<u8"), ("n", "<u4")])
WINDOW = np.dtype([("key", "<u8"), ("check", "<u8"), ("n", "<u4")])
BASES = (STEP, np.uint64(0xD1B54A32D192ED03))


def gram(width: int) -> int:
    """Bytes of an anchor: long enough that different texts rarely share one by chance."""
    return max(8, width * 8 // 25)


def inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 2**64))


def piece_kind(width: int) -> np.dtype:
    return np.dtype([("key", "<u8"), ("content", "<u8"), ("left", "<u2"), ("size", "<u2"), ("bytes", "u1", 2 * width - gram(width))])


class Ranges:
    """Hashes of byte ranges of one text."""

    def __init__(self, data: np.ndarray, base: np.uint64) -> None:
        n = len(data) + 1
        up, down = np.full(n, base), np.full(n, inverse(base))
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.total = np.zeros(n, np.uint64)
        np.cumsum(BYTE_VALUES[data] * np.multiply.accumulate(up)[:-1], out=self.total[1:])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.total[high] - self.total[low]) * self.down[low] + (high - low).astype(np.uint64))


def smallest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every *width* consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Pieces:
    """Pieces of one block: windows ``low`` to ``high`` around the byte ``anchor``; equal ones have one number.

    Bytes are worked through in overlapping stretches, so the arrays of a very long text stay small. A piece that
    a stretch may have cut is taken up again, whole, by the next one.
    """

    def __init__(self, block: Block, width: int, stretch: int = STRETCH) -> None:
        self.block, self.width, self.stretch = block, width, max(stretch, 4 * width)
        found, first = [], 0
        while first + width <= len(block.data):
            last = min(first + self.stretch, len(block.data))
            pieces = self._pieces(first, last)
            after = last - width + 1
            if last < len(block.data) and len(pieces[0]) and pieces[1][-1] == last - width:
                after = int(pieces[0][-1])
                pieces = [values[:-1] for values in pieces]
            found.append(pieces)
            first = after
        empty = [np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
        self.low, self.high, self.anchor, key, content = map(np.concatenate, zip(empty, *found, strict=True))
        order = np.lexsort((content, key))
        key, content = key[order], content[order]
        start = np.ones(len(order), bool)
        start[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(start) - 1
        #: For each distinct piece: one of its places.
        self.chosen = order[start]
        self.asked = np.zeros(len(self.chosen), ASKED)
        self.asked["key"], self.asked["content"] = key[start], content[start]
        self.asked["n"] = np.minimum(np.bincount(self.which, minlength=len(self.chosen)), 2**20)

    def _pieces(self, first: int, last: int) -> list[np.ndarray]:
        """Low, high, anchor, key and content of the pieces of windows inside the bytes from *first* to *last*."""
        width, data = self.width, self.block.data[first:last]
        grams = windows(BYTE_VALUES[data], gram(width))
        # 40 bits of hash, then the place in the stretch: the leftmost of equal hashes is the smallest.
        place = np.arange(len(grams), dtype=np.uint64)
        least = smallest_in_windows(grams >> PLACE_BITS << PLACE_BITS | place, width - gram(width) + 1)
        offsets = self.block.offsets
        some = slice(max(int(np.searchsorted(offsets, first, "right")) - 1, 0), int(np.searchsorted(offsets, last)))
        begin, end = np.maximum(offsets[:-1][some], first) - first, np.minimum(offsets[1:][some], last) - first
        sizes = np.maximum(end - begin - width + 1, 0)
        ends = np.cumsum(sizes)
        starts = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        anchor = (least[starts] & PLACE_MASK).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        low, anchor = starts[head], anchor[head]
        high = starts[np.append(head[1:], len(starts)) - 1] if len(head) else head
        content = Ranges(data, BASES[0])(low, high + width) + (anchor - low).astype(np.uint64)
        # The least hashes crowd at the low end; mixed again they fall into the parts evenly.
        return [low + first, high + first, anchor + first, mix(grams[anchor] ^ STEP), content]

    def shipped(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pieces whose anchors have several, with their bytes in line with the anchor; and their numbers."""
        numbers = np.flatnonzero((told & (SEVERAL | CROWDED)) == SEVERAL)
        at = self.chosen[numbers]
        low, size = self.low[at], self.high[at] + self.width - self.low[at]
        out = np.zeros(len(numbers), piece_kind(self.width))
        left = self.anchor[at] - low
        out["key"], out["content"] = self.asked["key"][numbers], self.asked["content"][numbers]
        out["left"], out["size"] = left, size
        row = np.repeat(np.arange(len(at)), size)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        out["bytes"][row, (self.width - gram(self.width) - left)[row] + inside] = self.block.data[low[row] + inside]
        return out, numbers

    def crowded(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of crowded anchors: what is asked about them, their starts, and the question of each start."""
        some = np.flatnonzero((told & CROWDED)[self.which] > 0)
        counts = self.high[some] - self.low[some] + 1
        starts = np.repeat(self.low[some] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        found = np.zeros(len(starts), WINDOW)
        cuts = np.flatnonzero(np.diff(starts // self.stretch, prepend=-1))
        for a, b in zip(cuts, np.append(cuts, len(starts))[1:], strict=True):
            here = starts[a:b] - starts[a]
            data = self.block.data[starts[a] : starts[b - 1] + self.width]
            for name, base in zip(("key", "check"), BASES, strict=True):
                found[name][a:b] = Ranges(data, base)(here, here + self.width)
        found, which, n = np.unique(found, return_inverse=True, return_counts=True)
        found["n"] = n
        return found, starts, which


def content_codes(values: np.ndarray, block: np.ndarray, most: int = MOST_PIECES) -> np.ndarray:
    """Whether a piece occurs again, and whether its anchor has other pieces, or too many."""
    order = np.lexsort((values["content"], values["key"]))
    key, content = values["key"][order], values["content"][order]
    new_key = np.ones(len(order), bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= content[1:] != content[:-1]
    piece, anchor = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    often = np.bincount(piece, values["n"][order])[piece] > 1
    different = np.bincount(anchor, new)[anchor]
    out = np.empty(len(order), np.uint64)
    out[order] = often * REPEATED + (different > 1) * SEVERAL + (different > most) * CROWDED
    return out


def window_repeats(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    _, which = np.unique(values[["key", "check"]], return_inverse=True)
    return np.bincount(which, values["n"])[which] > 1


def anchor_runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole anchors, of about MOST_PIECES pieces each."""
    edges = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    low = 0
    while low < len(keys):
        at = int(np.searchsorted(edges, low + MOST_PIECES, "right")) - 1
        high = int(edges[at]) if edges[at] > low else int(edges[np.searchsorted(edges, low, "right")])
        yield low, high
        low = high


def column_marks(pieces: np.ndarray, width: int) -> np.ndarray:
    """(pieces, window columns): which windows of different pieces of one anchor are shared.

    *pieces* are distinct and in order of their keys. Columns run from the right; the order holds
    the suffixes of all pieces that begin in the column, within each anchor.
    """
    n, columns, room = len(pieces), 2 * width - gram(width), width - gram(width)
    starts = room - pieces["left"].astype(np.int64)
    ends = starts + pieces["size"]
    group = np.cumsum(np.append(True, pieces["key"][1:] != pieces["key"][:-1])).astype(np.int64)
    text = np.ascontiguousarray(pieces["bytes"].T)
    order, common = np.arange(n), np.zeros(n, np.int64)
    marks = np.zeros((n, room + 1), bool)
    outside = 256
    for column in range(columns - 1, -1, -1):
        inside = (column >= starts) & (column < ends)
        symbol = np.where(inside, text[column].astype(np.int64), outside)
        key = (group * 257 + symbol)[order]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        same = np.zeros(n, bool)
        same[1:] = (key[1:] == key[:-1]) & (key[1:] % 257 != outside)
        found = np.zeros(n, np.int64)
        at = np.flatnonzero(same)
        if len(at):
            # Neighbours with one symbol share it and what their former suffixes shared.
            spans = np.empty(2 * len(at), np.int64)
            spans[::2], spans[1::2] = moved[at - 1] + 1, moved[at] + 1
            found[at] = 1 + np.minimum.reduceat(np.append(common, 0), spans)[::2]
        order, common = order[moved], found
        if column <= room:
            shared = common >= width
            shared[:-1] |= common[1:] >= width
            marks[order, column] = shared
    return marks


def repeated_bytes(block: Block, answers: list, width: int, count: int, stretch: int = STRETCH) -> np.ndarray:
    """Which bytes of a block go."""
    gone = np.zeros(len(block.data) + 1, np.int32)
    if answers[0] is None:
        return gone[:-1] > 0
    pieces = Pieces(block, width, stretch)
    told = heard(answers[0], pieces.asked["key"], count, "<u8")
    whole = (told & REPEATED)[pieces.which] > 0
    np.add.at(gone, pieces.low[whole], 1)
    np.add.at(gone, pieces.high[whole] + width, -1)
    sent, numbers = pieces.shipped(told)
    if answers[1] is not None and len(sent):
        kind = f"V{mark_bytes(width)}"
        marks = heard(answers[1], sent["key"], SHIPPED * count, kind).view(np.uint8).reshape(len(sent), -1)
        marks = np.unpackbits(marks, axis=1, count=width - gram(width) + 1)
        row = np.full(len(pieces.chosen), -1)
        row[numbers] = np.arange(len(numbers))
        mine = np.flatnonzero(row[pieces.which] >= 0)
        i, column = np.nonzero(marks[row[pieces.which[mine]]])
        starts = pieces.anchor[mine[i]] - (width - gram(width)) + column
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + width, -1)
    if answers[2] is not None:
        found, starts, which = pieces.crowded(told)
        starts = starts[heard(answers[2], found["key"], count)[which]]
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + width, -1)
    return np.cumsum(gone, out=gone)[:-1] > 0


def mark_bytes(width: int) -> int:
    return -(-(width - gram(width) + 1) // 8)


def suffix_dedup(docs: DataFrame, width: int = 200, stretch: int = STRETCH, most_pieces: int = MOST_PIECES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans): every row with its kept bytes and the removed runs.

    ``spans`` are (start, end) pairs of byte offsets. *stretch*, below 2^24, bounds the bytes worked on at once,
    *most_pieces* the different pieces of one anchor that meet in a task.
    """
    if not 0 < stretch < 2 ** int(PLACE_BITS) or 4 * width >= 2 ** int(PLACE_BITS):
        raise ValueError("a place in a stretch has 24 bits")
    area = StageArea(docs.sparkSession, "suffixes")
    blocks = pack(docs.select("doc_id", "text"), area, target=BLOCK_BYTES)
    count = part_count(blocks)
    codes = ask(blocks, count, ASKED, lambda b, _: Pieces(b, width, stretch).asked, partial(content_codes, most=most_pieces), area)
    codes = codes.withColumnRenamed("answer", "answer_1")
    asked = blocks.join(codes, "block")

    def told(block: Block, answers: list) -> tuple[Pieces, np.ndarray]:
        pieces = Pieces(block, width, stretch)
        return pieces, heard(answers[0], pieces.asked["key"], count, "<u8")

    def ship(block: Block, answers: list) -> np.ndarray:
        pieces, codes = told(block, answers)
        return pieces.shipped(codes)[0]

    def marks(values: np.ndarray, block: np.ndarray) -> np.ndarray:
        order = np.lexsort((values["content"], values["key"]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(values["key"][order]) != 0) | (np.diff(values["content"][order]) != 0)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        distinct = values[order[new]]
        found = np.concatenate([np.packbits(column_marks(distinct[a:b], width), axis=1) for a, b in anchor_runs(distinct["key"])])
        return np.ascontiguousarray(found).view(f"V{mark_bytes(width)}").ravel()[which]

    def crowd(block: Block, answers: list) -> np.ndarray:
        pieces, codes = told(block, answers)
        return pieces.crowded(codes)[0]

    columns = ask(asked, SHIPPED * count, piece_kind(width), ship, marks, area).withColumnRenamed("answer", "answer_2")
    crowds = ask(asked, count, WINDOW, crowd, window_repeats, area).withColumnRenamed("answer", "answer_3")
    answers = codes.join(columns, "block", "left").join(crowds, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in unpack(batches):
            gone = repeated_bytes(block, answers, width, count, stretch)
            removed, spans, kept = [], [], []
            for i in range(len(block)):
                here = gone[block.offsets[i] : block.offsets[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8)))
                removed.append(int(here.sum()))
                spans.append(edges.tolist())
                kept.append(block.data[block.offsets[i] : block.offsets[i + 1]][~here].tobytes() if removed[-1] else block.text(i))
            found = {
                "n_bytes": pa.array(np.diff(block.offsets)),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array([len(s) // 2 for s in spans], pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                "spans": pa.array(spans, pa.list_(pa.int64())),
            }
            yield pa.record_batch([block.rest.column("doc_id"), *found.values()], names=["doc_id", *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>"
    return blocks.join(answers, "block", "left").mapInArrow(run, schema)
