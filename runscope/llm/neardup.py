"""MinHash near-dedup with bottom-k sketches of one hash function.

A document is the set of its word shingles, ordered by one hash. Its smallest
``n - ceil(threshold * n) + 1`` values are retained: any document that reaches the threshold with it
has to share one of them, so the inverted lists of retained values miss no link. Values that very
many documents hold are ordered behind all others (for every document alike, so nothing is lost),
which keeps common passages out of the lists.

Equal sets are one class. In a first round each class is compared with one leader, the smallest
member of a list, which joins large groups in few comparisons. The second round takes up only
lists in which several components still meet, and only pairs across components, each in one of its
lists. Before full sets are fetched for the exact comparison, the union of two bottom sketches has
to make the threshold possible (it holds back a pair that reaches 0.8 less than once in ten million).

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; a text with fewer words than a shingle is one shingle. Rows are told apart by their place,
so rows that share an id are separate members; a null id is smaller than all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.blocks import Block, ask, beside, heard, pack, part_count, sender, unpack
from runscope.llm.text import NO_ID, STEP, Words, mix, window_starts, windows
from runscope.operators.graph import connected_components
from runscope.plans.stage import StageArea

#: Values held by more documents than this are ordered last; counted among the lower hashes.
COMMON = 100
COUNTED = np.uint64(int(0.45 * 2**64))
SKETCH = 24
LEAST_COMMON = 8
VALUE_BYTES = 6
PAIRS_AT_ONCE = 200_000
COUNT = np.dtype([("key", "<u8")])
#: Values leave the low bits of a hash free; a question carries the number of holders there.
LOW_BITS = np.uint64(64 - 8 * VALUE_BYTES)
MOST_COUNTED = 2 ** int(LOW_BITS) - 1
POSTING = np.dtype([("key", "<u8"), ("at", "<u4"), ("n", "<u4")])
MEMBER = np.dtype([("key", "<u8"), ("component", "<i8")])
HELD = np.dtype([("key", "<u8"), ("row", "<i8"), ("n", "<u4"), ("component", "<i8"), ("sketch", "<u4", SKETCH)])
#: Lists up to this size are thinned by sketches; the members of longer ones all stay in question.
SHORT_LIST = 256
#: Sets of one family that are compared in one task.
CHUNK = 4000


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, ascending within each row, and where each row begins; 48 bits are kept."""
    words = Words(block.data, block.offsets)
    hashes = words.hashes(lower=True)
    starts = window_starts(words.first, size)
    values = windows(hashes, size)[starts] if len(starts) else np.zeros(0, np.uint64)
    owner = words.document()[starts] if len(starts) else np.zeros(0, np.int64)
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(few):
        alone = [windows(hashes[words.first[i] : words.first[i + 1]], int(words.counts[i]))[0] for i in few]
        values = np.concatenate([values, mix(np.array(alone, np.uint64) + words.counts[few].astype(np.uint64) * STEP)])
        owner = np.concatenate([owner, few])
    values = values >> np.uint64(16) << np.uint64(16)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(block) + 1))


def spread(values: np.ndarray) -> np.ndarray:
    """One-to-one on values with free low bits: the least ones, which are asked about, fall into all parts alike."""
    return values * STEP


def retained(n: np.ndarray, percent: int) -> np.ndarray:
    """Values of a set of size n that every set at the threshold shares at least one of."""
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


@dataclass
class Lists:
    """Retained values of one block in order, and the set (of ``at``, ``n``, ``sketch``) each belongs to."""

    number: int
    at: np.ndarray
    n: np.ndarray
    sketch: np.ndarray
    keys: np.ndarray
    owner: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return self.at + self.number


@dataclass
class Sets:
    """Sets of some rows of one block: ``at`` is the row in the block, ``first`` where its values begin."""

    number: int
    at: np.ndarray
    first: np.ndarray
    values: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return self.at + self.number

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at)), self.n)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct lower values, spread over all parts, and the same with the number of holders in the low bits."""
        keys, n = np.unique(spread(self.values[self.values < COUNTED]), return_counts=True)
        out = np.zeros(len(keys), COUNT)
        out["key"] = keys | np.minimum(n, MOST_COUNTED).astype(np.uint64)
        return keys, out

    def retain(self, answer: list | None, count: int, percent: int) -> Lists:
        """Values that go into inverted lists, common ones ordered last."""
        owner = self.owner()
        keys, asked = self.counted()
        common = np.zeros(len(self.values), bool)
        low = self.values < COUNTED
        if len(keys):
            common[low] = heard(answer, asked["key"], count)[np.searchsorted(keys, spread(self.values[low]))]
        order = np.lexsort((self.values, common, owner))
        rank = np.arange(len(order)) - np.repeat(self.first[:-1], self.n)
        keep = order[rank < np.repeat(retained(self.n, percent), self.n)]
        keys = spread(self.values[keep])
        sorted_ = np.argsort(keys, kind="stable")
        return Lists(self.number, self.at, self.n, self.sketches(), keys[sorted_], owner[keep][sorted_])

    def sketches(self) -> np.ndarray:
        """(sets, SKETCH): high bits of the smallest values; short sets are filled with the largest number."""
        place = self.first[:-1, None] + np.arange(SKETCH)
        inside = place < self.first[1:, None]
        padded = np.append(self.values, np.uint64(0))
        top = (padded[np.minimum(place, len(self.values))] >> np.uint64(32)).astype(np.uint32)
        return np.where(inside, top, np.uint32(2**32 - 1))


def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Sets, list]]:
    for batch in batches:
        more = [name for name in batch.schema.names if name.startswith("answer")]
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in ("block", "at", "first", "body", *more)}
            first = np.frombuffer(row["first"], np.int64)
            cells = np.zeros((int(first[-1]), 8), np.uint8)
            cells[:, 8 - VALUE_BYTES :] = np.frombuffer(row["body"], np.uint8).reshape(-1, VALUE_BYTES)
            yield Sets(row["block"], np.frombuffer(row["at"], np.int64), first, cells.view("<u8").ravel()), [row[m] for m in more]


LISTS = {"at": "<i8", "n": "<i8", "sketch": "<u4", "keys": "<u8", "owner": "<i8"}


def read_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Lists, list]]:
    for batch in batches:
        more = [name for name in batch.schema.names if name.startswith("answer")]
        for i in range(batch.num_rows):
            parts = {name: np.frombuffer(batch.column(name)[i].as_py(), kind) for name, kind in LISTS.items()}
            parts["sketch"] = parts["sketch"].reshape(-1, SKETCH)
            yield Lists(batch.column("block")[i].as_py(), **parts), [batch.column(m)[i].as_py() for m in more]


def packed_values(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 8)[:, 8 - VALUE_BYTES :].tobytes()


def possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two rows of sketches share enough of the smallest values of their union."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    none = both == np.uint32(2**32 - 1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & ~none[:, 1:]
    # Rank of each value among the distinct ones; only the smallest SKETCH of the union count.
    rank = np.cumsum(~again & ~none, axis=1)
    size = np.minimum(rank[:, -1], SKETCH)
    common = (again & (rank <= SKETCH)).sum(1)
    return common * SKETCH >= LEAST_COMMON * size


def sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b).astype(np.int64) >= percent * np.maximum(a, b).astype(np.int64)


class NearDuplicates:
    """The stages of one run; tables are small except ``sets``."""

    def __init__(self, docs: DataFrame, area: StageArea, shingle: int, percent: int, again: bool) -> None:
        self.area, self.percent = area, percent
        # Tables with a row per block meet what was found out about their blocks where they are.
        self.blocks = pack(docs, area, by="block")
        self.count = part_count(self.blocks)
        rows = area.put(self.blocks.mapInArrow(self._rows(shingle), "block long, row long, doc_id long, n long, a long, b long"), "rows")
        best = rows.where("n > 0").groupBy("n", "a", "b").agg(F.min(F.struct("doc_id", "row")).alias("first"))
        joined = rows.join(best, ["n", "a", "b"], "left")
        self.rows = area.put(
            joined.select("block", "row", "doc_id", "n", F.coalesce("first.row", "row").alias("class")), "classes"
        )
        wanted = self.rows.where("row = class AND n > 0").groupBy("block").agg(F.collect_list("row").alias("answer"))
        sets = beside(self.blocks, wanted).mapInArrow(
            self._sets(shingle), "block long, at binary, first binary, body binary"
        )
        self.sets = area.put(sets, "sets", "block", compression="uncompressed")
        if not again:
            area.drop(self.blocks)

    @staticmethod
    def _rows(shingle: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _ in unpack(batches):
                values, first = shingle_sets(block, shingle)
                totals = []
                for salt in (np.uint64(1), STEP):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + salt))])
                    totals.append(pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64)))
                number = np.full(len(block), block.number)
                columns = [pa.array(x) for x in (number, number + np.arange(len(block)), block.ids, np.diff(first))]
                yield pa.record_batch([*columns, *totals], names=["block", "row", "doc_id", "n", "a", "b"])

        return run

    @staticmethod
    def _sets(shingle: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, (rows,) in unpack(batches):
                values, first = shingle_sets(block, shingle)
                at = np.sort(np.array(rows, np.int64)) - block.number
                keep = np.repeat(np.isin(np.arange(len(block)), at), np.diff(first))
                edges = np.concatenate([[0], np.cumsum(np.diff(first)[at])]).astype(np.int64)
                bodies = [at.tobytes(), edges.tobytes(), packed_values(values[keep])]
                columns = [pa.array([block.number]), *(pa.array([x], pa.binary()) for x in bodies)]
                yield pa.record_batch(columns, names=["block", "at", "first", "body"])

        return run

    def components(self) -> DataFrame:
        """(class, component) of every class that is linked with another one."""
        count, percent = self.count, self.percent

        def common(values: np.ndarray, block: np.ndarray) -> np.ndarray:
            _, which = np.unique(values["key"] >> LOW_BITS, return_inverse=True)
            holders = np.bincount(which, values["key"] & np.uint64(MOST_COUNTED))
            return (holders > COMMON)[which]

        def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for sets, (answer,) in read_sets(batches):
                lists = sets.retain(answer, count, percent)
                parts = [getattr(lists, name).astype(kind).tobytes() for name, kind in LISTS.items()]
                columns = [pa.array([sets.number]), *(pa.array([x], pa.binary()) for x in parts)]
                yield pa.record_batch(columns, names=["block", *LISTS])

        answer = ask(self.sets, count, COUNT, lambda s, _: s.counted()[1], common, self.area, read_sets)
        schema = "block long, " + ", ".join(f"{name} binary" for name in LISTS)
        self.lists = self.area.put(beside(self.sets, answer, "left").mapInArrow(retain, schema), "lists", "block")
        self.area.drop(answer)
        links = self.verified(self._leaders())
        more = self._across(connected_components(links, self.area))
        for table in (self.sets, self.lists):
            self.area.drop(table)
        return self.area.put(
            connected_components(links.unionByName(more), self.area).select(F.col("node").alias("class"), "component"), "components"
        )

    def _leaders(self) -> DataFrame:
        """(a, b): for every class the leader it shares most lists with, if their sketches allow a link."""
        count, percent = self.count, self.percent

        def values(lists: Lists, _: list) -> np.ndarray:
            out = np.zeros(len(lists.keys), POSTING)
            out["key"], out["at"], out["n"] = lists.keys, lists.at[lists.owner], lists.n[lists.owner]
            return out

        def lead(table: pa.Table) -> pa.Table:
            bodies = [np.frombuffer(b, POSTING) for b in table.column("body").to_pylist()]
            numbers = np.repeat(table.column("block").to_numpy(), [len(b) for b in bodies])
            found = np.concatenate(bodies)
            row, n = numbers + found["at"], found["n"].astype(np.int64)
            order = np.lexsort((row, n, found["key"]))
            key, row, n = found["key"][order], row[order], n[order]
            several = np.zeros(len(key), bool)
            several[1:] = key[1:] == key[:-1]
            several[:-1] |= several[1:]
            key, row, n = key[several], row[several], n[several]
            # The smallest member leads those that are not too large for it; the next one leads on.
            leader = np.arange(len(key))
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            end = np.append(np.flatnonzero(start), len(key))
            left = end[:-1]
            limit = np.repeat(end[1:], np.diff(end))
            while len(left):
                stop = np.empty(len(left), np.int64)
                for i, at in enumerate(left):
                    reach = n[at] * 100 // percent
                    stop[i] = at + np.searchsorted(n[at : limit[at]], reach, "right")
                    leader[at : stop[i]] = at
                left = stop[stop < limit[left]]
            pairs = np.stack([row, row[leader]], 1)[leader != np.arange(len(key))]
            pairs, shared = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
            return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(shared)], names=["a", "b", "shared"])

        sent = self.lists.mapInArrow(sender(count, values, read_lists), "part int, block long, body binary")
        pairs = sent.groupBy("part").applyInArrow(lead, "a long, b long, shared long")
        pairs = self.area.put(pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared")), "leaders")
        sketches = self.lists.mapInArrow(_sketches, "row long, sketch binary")
        named = [sketches.select(F.col("row").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
        near = pairs.join(named[0], "a").join(named[1], "b").mapInArrow(_possible, "a long, b long, shared long")
        best = near.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("b"))).alias("best"))
        found = self.area.put(best.select("a", (-F.col("best.b")).alias("b")), "pairs")
        self.area.drop(pairs)
        return found

    def _across(self, components: DataFrame) -> DataFrame:
        """(a, b): links between different components, found in the lists where they meet.

        Classes whose sketches allow a link in such a list form families, as do the members of long
        lists; full sets travel once to their family (to each pair of chunks of a large one), where
        pairs of different components are compared unless links found before have joined them.
        Pairs are never written out, only links.
        """
        count, percent = self.count, self.percent
        known = self.rows.where("row = class").select("block", F.col("row").alias("node")).join(components, "node")
        known = known.groupBy("block").agg(F.collect_list(F.struct("node", "component")).alias("answer_1"))
        lists = beside(self.lists, known, "left")

        def component_of(lists: Lists, answer: list | None) -> np.ndarray:
            out = lists.rows.copy()
            for item in answer or []:
                out[np.searchsorted(lists.rows, item["node"])] = item["component"]
            return out

        def members(lists: Lists, answers: list) -> np.ndarray:
            out = np.zeros(len(lists.keys), MEMBER)
            out["key"], out["component"] = lists.keys, component_of(lists, answers[0])[lists.owner]
            return np.unique(out)

        def several(values: np.ndarray, block: np.ndarray) -> np.ndarray:
            distinct = np.unique(values)
            keys, n = np.unique(distinct["key"], return_counts=True)
            return (n > 1)[np.searchsorted(keys, values["key"])]

        answer = ask(lists, count, MEMBER, members, several, self.area, read_lists)

        def meeting(lists: Lists, answers: list) -> np.ndarray:
            asked = members(lists, answers)["key"]
            return np.isin(lists.keys, asked[heard(answers[1], asked, count)])

        def held(lists: Lists, answers: list) -> np.ndarray:
            keep = meeting(lists, answers)
            owner = lists.owner[keep]
            out = np.zeros(len(owner), HELD)
            out["key"], out["row"], out["n"] = lists.keys[keep], lists.rows[owner], lists.n[owner]
            out["component"], out["sketch"] = component_of(lists, answers[0])[owner], lists.sketch[owner]
            return out

        def relate(table: pa.Table) -> pa.Table:
            found = np.concatenate([np.frombuffer(b, HELD) for b in table.column("body").to_pylist()])
            found = found[np.argsort(found["key"], kind="stable")]
            rows, which = np.unique(found["row"], return_inverse=True)
            family = np.arange(len(rows))
            start, member, size = np.unique(found["key"], return_index=True, return_inverse=True, return_counts=True)[1:]
            long = size[member] > SHORT_LIST
            pairs = [np.stack([which[long], which[start[member[long]]]], 1)]
            short = np.flatnonzero(~long)
            for i, j in list_pairs(found["key"][short]):
                i, j = short[i], short[j]
                fit = (found["component"][i] != found["component"][j]) & sizes_fit(found["n"][i], found["n"][j], percent)
                i, j = i[fit], j[fit]
                fit = family[which[i]] != family[which[j]]
                i, j = i[fit], j[fit]
                near = possible(found["sketch"][i], found["sketch"][j])
                pairs.append(np.unique(np.stack([which[i[near]], which[j[near]]], 1), axis=0))
                family = merged_labels(family, pairs[-1])
            family = merged_labels(family, pairs[0])
            seen = np.flatnonzero(family != np.arange(len(rows)))
            return pa.table([pa.array(rows[seen]), pa.array(rows[family[seen]])], names=["a", "b"])

        sent = beside(lists, answer.withColumnRenamed("answer", "answer_2"))
        sent = sent.mapInArrow(sender(count, held, read_lists), "part int, block long, body binary")
        families = connected_components(sent.groupBy("part").applyInArrow(relate, "a long, b long"), self.area)
        sizes = families.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
        families = families.join(sizes, "component").withColumn("chunk", chunk).withColumnRenamed("component", "family")
        families = families.join(components.withColumnRenamed("component", "linked"), "node", "left")
        families = families.withColumn("linked", F.coalesce("linked", "node"))
        place = self.rows.where("row = class").select("block", F.col("row").alias("node"))
        wanted = self.area.put(families.join(place, "node"), "families")
        self.area.drop(answer)
        asked = wanted.groupBy("block").agg(F.collect_list("node").alias("answer"))
        bodies = beside(self.sets, asked).mapInArrow(_bodies, "row long, body binary")
        members = bodies.join(wanted.drop("block").withColumnRenamed("node", "row"), "row")
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
        members = members.select("*", other).withColumns(
            {"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}
        )

        def link(table: pa.Table) -> pa.Table:
            first, last = table.column("low")[0].as_py(), table.column("high")[0].as_py()
            bodies = [_wide(np.frombuffer(b.as_py(), f"V{VALUE_BYTES}")) for b in table.column("body")]
            columns = [table.column(c).to_numpy() for c in ("row", "linked", "chunk")]
            pairs = links_in_family(bodies, columns[1], columns[2] == first, columns[2] == last, percent)
            return pa.table([pa.array(columns[0][pairs[:, 0]]), pa.array(columns[0][pairs[:, 1]])], names=["a", "b"])

        columns = ["family", "low", "high", "row", "linked", "chunk", "body"]
        found = members.select(*columns).groupBy("family", "low", "high").applyInArrow(link, "a long, b long")
        return self.area.put(found, "links")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b): the pairs whose full sets reach the threshold."""
        percent = self.percent
        ends = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
        wanted = ends.join(self.rows.select("row", "block"), "row").groupBy("block").agg(F.collect_list("row").alias("wanted"))
        sets = beside(self.sets.select("block", "at", "first", "body"), wanted.withColumnRenamed("wanted", "answer"))
        sets = self.area.put(sets.mapInArrow(_bodies, "row long, body binary"), "bodies", compression="uncompressed")
        named = [sets.select(F.col("row").alias(x), F.col("body").alias(f"body_{x}")) for x in "ab"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("body_a"), batch.column("body_b"), strict=True):
                    x, y = (np.frombuffer(v.as_py(), f"V{VALUE_BYTES}") for v in (x, y))
                    common = _common(x, y)
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        joined = pairs.join(named[0], "a").join(named[1], "b").select("a", "b", "body_a", "body_b")
        found = self.area.put(joined.mapInArrow(run, "a long, b long"), "links")
        self.area.drop(sets)
        return found


def _wide(packed: np.ndarray) -> np.ndarray:
    cells = np.zeros((len(packed), 8), np.uint8)
    cells[:, 8 - VALUE_BYTES :] = packed.view(np.uint8).reshape(-1, VALUE_BYTES)
    return cells.view("<u8").ravel()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([_wide(a), _wide(b)]))
    return int((both[1:] == both[:-1]).sum())


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for sets, (wanted,) in read_sets(batches):
        chosen = np.flatnonzero(np.isin(sets.rows, wanted))
        bodies = [packed_values(sets.values[sets.first[i] : sets.first[i + 1]]) for i in chosen]
        yield pa.record_batch([pa.array(sets.rows[chosen]), pa.array(bodies, pa.binary())], names=["row", "body"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lists, _ in read_lists(batches):
        rows = [x.tobytes() for x in lists.sketch]
        yield pa.record_batch([pa.array(lists.rows), pa.array(rows, pa.binary())], names=["row", "sketch"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(f"sketch_{x}").to_pylist()), "<u4").reshape(-1, SKETCH) for x in "ab")
            yield batch.select(["a", "b", "shared"]).filter(pa.array(possible(a, b)))


def merged_labels(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Labels of the smallest index each one is joined with, after joining *pairs* too."""
    while len(pairs):
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        apart = a != b
        pairs, low, high = pairs[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def links_in_family(
    sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int
) -> np.ndarray:
    """Linked pairs (left, right) of different components, enough to join all that are linked."""
    n = np.array([len(x) for x in sets], np.int64)
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(n)])
    _, joined = np.unique(component, return_inverse=True)
    marked = np.zeros(len(values) + 1, bool)
    both, found = left & right, []
    # Members of small components first: each is compared with all others, those of large ones with few.
    order = np.argsort(np.bincount(joined)[joined], kind="stable")
    done = np.zeros(len(sets), bool)
    candidates = np.flatnonzero(right)
    for a in order[left[order]].tolist():
        done[a] = True
        others = candidates[(joined[candidates] != joined[a]) & sizes_fit(n[candidates], n[a], percent)]
        others = others[~(both[others] & done[others])]
        if not len(others):
            continue
        edge = np.cumsum(n[others])
        at = np.repeat(first[others] - (edge - n[others]), n[others]) + np.arange(edge[-1])
        mine = values[first[a] : first[a + 1]]
        marked[mine] = True
        total = np.concatenate([[0], np.cumsum(marked[values[at]])])
        marked[mine] = False
        common = total[edge] - total[edge - n[others]]
        for b in others[100 * common >= percent * (n[a] + n[others] - common)].tolist():
            if joined[a] != joined[b]:
                found.append((a, b))
                joined[joined == joined[b]] = joined[a]
    return np.array(found, np.int64).reshape(-1, 2)


def list_pairs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs of equal keys, a bounded number at once."""
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(keys)))
    for m in np.unique(size[size > 1]):
        lists = start[size == m]
        if m * m <= PAIRS_AT_ONCE:
            i, j = np.triu_indices(m, 1)
            step = max(1, PAIRS_AT_ONCE // len(i))
            for low in range(0, len(lists), step):
                base = lists[low : low + step, None]
                yield (base + i).ravel(), (base + j).ravel()
            continue
        step = max(1, PAIRS_AT_ONCE // m)
        for base in lists:
            for low in range(0, m, step):
                i = np.repeat(np.arange(low, min(low + step, m)), m)
                j = np.tile(np.arange(m), len(i) // m)
                yield base + i[i < j], base + j[i < j]


def near_duplicates(
    docs: DataFrame, area: StageArea, shingle: int = 5, percent: int = 80, again: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_shingles, component_id, first) of every row, and the packed blocks the rows are in.

    The blocks are only kept if they are to be read *again*.

    ``component_id`` is the smallest doc_id reachable over links of at least *percent* similarity,
    ``first`` the row that stands for the group: the one with the smallest (doc_id, place).
    """
    found = NearDuplicates(docs, area, shingle, percent, again)
    components = found.components()
    of_class = found.rows.join(components, "class", "left").withColumn("component", F.coalesce("component", "class"))
    of_class = area.put(of_class, "members")
    first = of_class.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    back = lambda c: F.when(c != NO_ID, c)
    out = of_class.join(first, "component").select(
        "block",
        "row",
        back(F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        back(F.col("least.doc_id")).alias("component_id"),
        F.col("least.row").alias("first"),
    )
    return out, found.blocks


def one_of_each_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of *docs*, all columns unchanged, that stand for their group of near duplicates."""
    found, blocks = near_duplicates(docs, StageArea(docs.sparkSession, "neardup"), shingle, percent, again=True)
    kept = found.where("row = first").groupBy("block").agg(F.collect_list("row").alias("answer"))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (rows,) in unpack(batches):
            batch = block.rows(schema.names, [block.text(i) for i in range(len(block))])
            yield batch.filter(pa.array(np.isin(block.number + np.arange(len(block)), rows)))

    return beside(blocks, kept).mapInArrow(run, schema)
