"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a document with up to k character edits. Cut into k + 1 pieces, it leaves at
least one piece untouched by any k edits, so exact hits of the pieces (one pass of an Aho-Corasick
automaton over the document) name every place worth a look. Cut into grams of five characters, an
item loses at most k of them to k edits, so a place that lacks more is passed over; each other one is
verified by Myers' bit-parallel edit distance, in which an item of any length is one integer. Documents and items are compared in
lower case with runs of white space as one space.

The budget is a tenth of the item's characters, so pieces have about nine characters (fewer in items
under ninety); an item of fewer than ten characters has to occur exactly. Items reach the tasks in
slices of a bounded size, so a benchmark of any size takes more passes, not more memory.

Defined results: a null or empty document holds nothing, a null or blank item is nowhere; items that
share an id are searched apart and reported once, with the fewest edits. Repeated rows of documents
are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.llm.text import slices

ERROR_SHARE = 0.1
GRAM = 5
#: Characters of items that one pass holds.
SLICE_CHARS = 8_000_000
SLICE = 4 << 20


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of an item: as many pieces as its budget of edits and one."""
    budget = int(len(item) * ERROR_SHARE)
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def distance(masks: dict[str, int], length: int, text: str) -> int:
    """Fewest edits that turn the item into any substring of *text* (Myers 1999, one integer per vector)."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, now = full, 0, length
    best = now
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(xv | up) & full, up & xv
        if now < best:
            best = now
    return best


@dataclass
class Matcher:
    """Items (id, normalised text) with the automaton of their pieces, built where it is used."""

    items: list[tuple[object, str]]

    def open(self) -> Matcher:
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        self.budgets, self.grams, self.masks = [], [], [None] * len(self.items)
        for number, (_, item) in enumerate(self.items):
            pieces = cut(item)
            self.budgets.append(len(pieces) - 1)
            self.grams.append([item[i : i + GRAM] for i in range(0, len(item) - GRAM + 1, GRAM)])
            for offset, piece in pieces:
                places.setdefault(piece, []).append((number, offset))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        return self

    def _masks(self, number: int) -> dict[str, int]:
        if self.masks[number] is None:
            masks: dict[str, int] = {}
            for i, c in enumerate(self.items[number][1]):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks[number] = masks
        return self.masks[number]

    def _may_hold(self, number: int, part: str) -> bool:
        """Whether *part* lacks no more of the item's grams than its budget of edits can change."""
        left = self.budgets[number]
        for gram in self.grams[number]:
            if gram not in part:
                left -= 1
                if left < 0:
                    return False
        return True

    def matches(self, text: str | None) -> dict[int, int]:
        """Number of each item found in the text, with the edits it takes."""
        text = normalised(text)
        out: dict[int, int] = {}
        if not text or not len(self.automaton):
            return out
        tried: set[tuple[int, int]] = set()
        for end, (length, found) in self.automaton.iter(text):
            for number, offset in found:
                start = end + 1 - length - offset
                if out.get(number) == 0 or (number, start) in tried:
                    continue
                tried.add((number, start))
                item, budget = self.items[number][1], self.budgets[number]
                if text.startswith(item, start) if start >= 0 else False:
                    out[number] = 0
                    continue
                part = text[max(0, start - budget) : start + len(item) + budget]
                if budget and self._may_hold(number, part):
                    edits = distance(self._masks(number), len(item), part)
                    if edits <= budget:
                        out[number] = min(edits, out.get(number, edits))
        return out


def item_slices(benchmark: DataFrame) -> Iterator[Matcher]:
    """The items in slices of about SLICE_CHARS characters."""
    items = benchmark.select("item_id", "text").where(F.length(F.trim("text")) > 0)
    passes = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // SLICE_CHARS) + 1
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k)
        yield Matcher([(r["item_id"], t) for r in part.collect() if (t := normalised(r["text"]))])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits): every item that a row of *docs* holds within its budget."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("item_id", benchmark.schema["item_id"].dataType),
            T.StructField("edits", T.LongType()),
        ]
    )
    rows = docs.select("doc_id", "text")
    found = None
    for matcher in item_slices(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = held.value.open()
            for batch in slices(batches, "text", SLICE):
                ids, leaks = batch.column("doc_id"), []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    best: dict[object, int] = {}
                    for number, edits in matcher.matches(text).items():
                        item = matcher.items[number][0]
                        best[item] = min(edits, best.get(item, edits))
                    leaks += [(i, item, edits) for item, edits in best.items()]
                if leaks:
                    at, item, edits = zip(*leaks, strict=True)
                    columns = [ids.take(pa.array(at)), pa.array(item), pa.array(edits, pa.int64())]
                    yield pa.record_batch(columns, names=["doc_id", "item_id", "edits"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of *docs*, all columns unchanged, that hold no item within its budget."""
    for matcher in item_slices(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = held.value.open()
            for batch in slices(batches, "text", SLICE):
                clean = [not matcher.matches(text) for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
