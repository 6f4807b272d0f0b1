"""Substring dedup by difference-cover anchors: later copies of long word sequences are removed.

A window is a run of ``width`` words of one document. Two equal windows, wherever they start, have
positions at the same offset that both lie in a difference cover modulo a period, so hashing short
anchors at cover positions alone meets every repeat. Around anchors that occur more than once the
match is extended to whole windows; of equal windows the one that starts first (smaller id, then
earlier in the document) stays, and every word that another one covers goes.

Defined results: a null or empty text has no words; null ids come before all others, rows that share
an id count in the order in which they are read. Windows are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runscope.llm.blocks import Block, ask, heard, pack, part_count, unpack
from runscope.llm.text import Words, window_starts, windows
from runscope.plans.stage import StageArea

#: A perfect difference set: every difference modulo PERIOD is that of two of its members.
PERIOD = 13
COVER = (0, 1, 3, 9)
IN_COVER = np.isin(np.arange(PERIOD), COVER)
OTHER_BASE = np.uint64(0x9FB21C651E98DF25)
ANCHOR = np.dtype([("key", "<u8"), ("again", "?")])
WINDOW = np.dtype([("key", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("at", "<u4")])


class Windows:
    """Anchors and windows of one block."""

    def __init__(self, block: Block, width: int) -> None:
        if width < PERIOD:
            raise ValueError(f"a window needs at least {PERIOD} words")
        self.block, self.width = block, width
        self.words = Words(block.data, block.offsets)
        self.hashes = self.words.hashes()

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the anchors, their distinct hashes in order, and which of those each one has."""
        size = self.width - PERIOD + 1
        starts = window_starts(self.words.first, size)
        inside = starts - self.words.first[self.words.document()[starts]] if len(starts) else starts
        starts = starts[IN_COVER[inside % PERIOD]]
        hashes = windows(self.hashes, size)[starts] if len(starts) else np.zeros(0, np.uint64)
        keys, which = np.unique(hashes, return_inverse=True)
        return starts, keys, which

    def ask_anchors(self) -> np.ndarray:
        _, keys, which = self.anchors()
        out = np.zeros(len(keys), ANCHOR)
        out["key"], out["again"] = keys, np.bincount(which, minlength=len(keys)) > 1
        return out

    def candidates(self, repeated: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor of *places* that is *repeated*."""
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[places[repeated] + 1] = 1
        total = np.cumsum(hits)
        starts = window_starts(self.words.first, self.width)
        return starts[total[starts + PERIOD] > total[starts]]

    def ask_windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window of each content in the block (sorted by hash), all candidates in that order, their content."""
        document = self.words.document()
        found = np.zeros(len(starts), WINDOW)
        if len(starts):
            found["key"] = windows(self.hashes, self.width)[starts]
            found["check"] = windows(self.hashes, self.width, OTHER_BASE)[starts] >> np.uint64(32)
            found["doc"] = self.block.ids[document[starts]]
            found["at"] = starts
        order = np.lexsort((found["at"], found["doc"], found["check"], found["key"]))
        found = found[order]
        new = np.ones(len(found), bool)
        new[1:] = (found["key"][1:] != found["key"][:-1]) | (found["check"][1:] != found["check"][:-1])
        return found[new], found["at"].astype(np.int64), new

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Words that windows at *starts* cover."""
        steps = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + self.width, -1)
        return np.cumsum(steps)[:-1] > 0


def repeated_anchors(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Anchors of several blocks, or of several places in one."""
    _, which, n = np.unique(values["key"], return_inverse=True, return_counts=True)
    again = np.bincount(which, values["again"], len(n)) > 0
    return (again | (n > 1))[which]


def later_windows(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Windows whose content starts earlier in another block."""
    order = np.lexsort((values["at"], block, values["doc"], values["check"], values["key"]))
    found = values[order]
    same = np.zeros(len(values), bool)
    same[1:] = (found["key"][1:] == found["key"][:-1]) & (found["check"][1:] == found["check"][:-1])
    out = np.zeros(len(values), bool)
    out[order] = same
    return out


def _starts(found: Windows, answer: list | None, count: int) -> np.ndarray:
    places, keys, which = found.anchors()
    return found.candidates(heard(answer, keys, count)[which], places)


def removed_words(block: Block, answers: list, width: int, count: int) -> tuple[Words, np.ndarray]:
    """Words of a block and which of them go."""
    found = Windows(block, width)
    if answers[0] is None:
        return found.words, np.zeros(len(found.words), bool)
    firsts, at, new = found.ask_windows(_starts(found, answers[0], count))
    later = heard(answers[1], firsts["key"], count)
    # In order of content: a window goes unless it is the first of its content here and everywhere.
    gone = ~new
    gone[new] = later
    return found.words, found.covered(at[gone])


def answered(docs: DataFrame, area: StageArea, width: int) -> tuple[DataFrame, int]:
    """Blocks of *docs* with the answers about their anchors and windows."""
    blocks = pack(docs, area)
    count = part_count(blocks)
    anchors = ask(blocks, count, ANCHOR, lambda b, _: Windows(b, width).ask_anchors(), repeated_anchors, area)
    anchors = anchors.withColumnRenamed("answer", "answer_1")

    def values(block: Block, answers: list) -> np.ndarray:
        found = Windows(block, width)
        return found.ask_windows(_starts(found, answers[0], count))[0]

    later = ask(blocks.join(anchors, "block"), count, WINDOW, values, later_windows, area)
    both = anchors.join(later.withColumnRenamed("answer", "answer_2"), "block", "left")
    return blocks.join(both, "block", "left"), count


def substring_dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row with its kept words, joined by one space."""
    blocks, count = answered(docs.select("doc_id", "text"), StageArea(docs.sparkSession, "repeats"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in unpack(batches):
            words, gone = removed_words(block, answers, width, count)
            n = np.bincount(words.document(), gone, len(block)).astype(np.int64)
            kept = pa.array([words.select(~gone, i) for i in range(len(block))], pa.binary()).cast(pa.string())
            columns = [block.rest.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(n), kept]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """*docs* with repeated words taken out of ``text``; untouched texts stay as they are, emptied rows go."""
    blocks, count = answered(docs, StageArea(docs.sparkSession, "repeats"), width)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in unpack(batches):
            words, gone = removed_words(block, answers, width, count)
            n = np.bincount(words.document(), gone, len(block))
            texts = [words.select(~gone, i) if n[i] else block.text(i) for i in range(len(block))]
            yield block.rows(schema.names, texts).filter(pa.array((n == 0) | (n < words.counts)))

    return blocks.mapInArrow(run, schema)
