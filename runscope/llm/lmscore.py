"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its lower-case words, each closed by a space, and a space alone at the end. Bytes are
spelled in bits along a Huffman tree of the training bytes. Each bit is predicted from counts under
four hashed contexts (two, three and four bytes of the word, the word so far); a gate, the
confidence of the three longest contexts, chooses the weights that mix the four in the logistic
domain, and an adaptive map refines the mixed probability. At last the word's probability is mixed
with how often it followed the whole word before; that weight is gated by how often the word before was seen.

All counts come from all training documents and grow with them: every (context, byte) and every
pair of words is a hashed key in the questions that blocks ask, and the answer to a context and
byte is how many training bytes reached each node of the tree on the way to it. Weights and map are
learned online, by every task over the training documents of its blocks, and averaged by the bits
seen; there a word is predicted without what its own document counts (its mean number per document
of the block that holds it, averaged where words share a beginning; once for a pair). Equal beginnings of
words are spelled once per block.

Beside the model stands a smoothed unigram base over the same questions.

Defined results: a null or empty text is the end token alone. Without training documents the base
is a uniform one over nothing (0) and every bit has probability one half. Repeated rows are further
documents, each counted. A text of any length is one block or a part of one. Words are told apart by a
64-bit hash. Columns other than doc_id, text and the named one are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.blocks import Block, Parts, beside, pack, part_count, unpack
from runscope.llm.text import IS_SPACE, LOWER, STEP, Words, mix
from runscope.plans.stage import StageArea, row_by_row, shuffles_dropped

CONTEXTS = 4
CLOSE = 0x20
END = np.uint64(0xE4D)
BLOCK_BYTES = 4 << 20
#: Beginnings of words in a piece that is scored, or learned from, at once; such pieces stay in a core's cache.
NODES_AT_ONCE = 1 << 12
BATCH = 1 << 11
STEEPEST = 12.0
CONFIDENCE = np.array([1, 4, 32], np.float32)
MAP_CELLS = 49
#: One unseen context or pair in 2 ** SPARE_BITS is taken for a seen one, at every size of the corpus.
SPARE_BITS = 12
GATES = 64
#: Gates of the word before: powers of two of how often it was seen.
SEEN = 24
SALTS = mix(np.arange(1, CONTEXTS + 1, dtype=np.uint64))
BYTE = np.uint64(0xFF)
ONE = np.uint64(1)
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))


class Code:
    """Huffman code of bytes; bytes are ranked by the order of their leaves, so that a node is a range of ranks.

    ``low[r, j]`` and ``high[r, j]`` bound the node that the byte of rank r has reached after j bits;
    ``reach[j, r]`` tells whether its code is that long.
    """

    def __init__(self, histogram: np.ndarray) -> None:
        # Hashes of contexts and pairs have some bits more than it takes to count the training bytes.
        width = min(56, int(histogram.sum()).bit_length() + SPARE_BITS)
        self.hashed = ~np.uint64((1 << (64 - width)) - 1)
        # No byte is rarer than one in some thousands, which bounds the depth.
        least = int(histogram.sum()) // 4096 + 1
        heap = [(int(n) + least, i, (i,)) for i, n in enumerate(histogram)]
        heapq.heapify(heap)
        paths: list[list[int]] = [[] for _ in range(256)]
        node = 256
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side in enumerate((x, y)):
                for byte in side:
                    paths[byte].append(bit)
            heapq.heappush(heap, (a + b, node, x + y))
            node += 1
        order = heap[0][2]
        self.rank = np.zeros(256, np.uint64)
        self.rank[list(order)] = np.arange(256)
        self.length = np.array([len(paths[byte]) for byte in order])
        depth = int(self.length.max())
        self.bits = np.zeros((256, depth), bool)
        self.low, self.high = np.zeros((256, depth + 1), np.uint64), np.zeros((256, depth + 1), np.uint64)
        for r, byte in enumerate(order):
            self.bits[r, : self.length[r]] = paths[byte][::-1]
        for j in range(depth + 1):
            prefixes: dict[tuple, list[int]] = {}
            for r in range(256):
                prefixes.setdefault(tuple(self.bits[r, : min(j, self.length[r])]) + (self.length[r] < j,), []).append(r)
            for ranks in prefixes.values():
                self.low[ranks, j], self.high[ranks, j] = ranks[0], ranks[-1]
        self.reach = np.arange(depth + 1)[:, None] <= self.length

    def levels(self, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """For sorted distinct keys (a context, its last byte the rank) the counts of each node on the way.

        Laid out level by level, in the narrowest numbers that hold the sum of all.
        """
        rank = (keys & BYTE).astype(np.uint8)
        context = keys & ~BYTE
        sums = np.zeros(len(keys) + 1, np.int64)
        np.cumsum(totals, out=sums[1:])
        out = np.zeros((len(self.reach), len(keys)), np.uint32 if sums[-1] < 1 << 32 else np.uint64)
        for level, reach in zip(out, self.reach, strict=True):
            np.copyto(level, totals, "unsafe", where=reach[rank])
        # All of a context with one byte goes its way; other ways end in their byte.
        several = np.zeros(len(keys), bool)
        several[1:] = context[1:] == context[:-1]
        several[:-1] |= several[1:]
        several = np.flatnonzero(several)
        for j, level in enumerate(out):
            some = several[self.length[rank[several]] > j]
            first = np.searchsorted(keys, context[some] | self.low[rank[some], j])
            last = np.searchsorted(keys, context[some] | self.high[rank[some], j], "right")
            level[some] = sums[last] - sums[first]
        return out.T


def sorted_places(values: np.ndarray, low: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values in order, the place of each): the upper bits, the *low* lowest and the place are sorted as one number."""
    width = max(1, (len(values) - 1).bit_length())
    cut = np.uint64((1 << (width + low)) - 1)
    packed = values & ~cut
    if low:
        packed |= (values & np.uint64((1 << low) - 1)) << np.uint64(width)
    packed |= np.arange(len(values), dtype=np.uint64)
    packed.sort()
    place = (packed & np.uint64((1 << width) - 1)).view(np.int64)
    found = values[place]
    # Values that agree in the upper bits only are put in order by themselves.
    for group in np.unique(found[1:][found[1:] < found[:-1]] & ~cut):
        span = slice(np.searchsorted(packed, group), np.searchsorted(packed, group | cut, "right"))
        order = np.argsort(found[span], kind="stable")
        place[span], found[span] = place[span][order], found[span][order]
    return found, place


def distinct(values: np.ndarray, low: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, which of them every value is)."""
    found, place = sorted_places(values, low)
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    which = np.empty(len(found), np.int32)
    which[place] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return found[new], place[new], which


class Tokens:
    """Tokens of a block's documents (their words and an end each), the distinct words, pairs and contexts."""

    def __init__(self, block: Block, code: Code, train: np.ndarray, names: bool = True, contexts: bool = True) -> None:
        words = Words(LOWER[block.data], block.offsets)
        docs, counts = len(block), words.counts
        self.first = words.first + np.arange(docs + 1)
        self.document = np.repeat(np.arange(docs, dtype=np.int32), counts + 1)
        size = int(self.first[-1])
        is_word = np.ones(size, bool)
        is_word[self.first[1:] - 1] = False
        hashes = np.full(size, END)
        hashes[is_word] = words.hashes()
        hashes &= ~ONE
        self.length = np.zeros(size, np.int32)
        self.length[is_word] = words.length
        start = np.zeros(size, np.int32)
        start[is_word] = words.start
        data = words.data
        del words
        self.types, chosen, self.which = distinct(hashes)
        start = start[chosen]
        # The word before; the end token stands before the first word.
        self.before = np.full(size, np.searchsorted(self.types, END & ~ONE), np.int32)
        self.before[1:] = np.where(is_word[:-1], self.which[:-1], self.before[1:])
        if names:
            hashes += mix(self.types + STEP)[self.before]
            hashes = mix(hashes)
            hashes &= code.hashed
            hashes |= ONE
            self.pairs, _, self.pair = distinct(hashes)
        del hashes
        self.trains = train[self.document]
        self.often = np.bincount(self.which, self.trains, len(self.types))
        self.code = code
        if contexts:
            self._spell(data, start, self.length[chosen])

    def _spell(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Distinct beginnings of the closed words, called nodes, and the distinct (context, byte) keys.

        All contexts of a byte follow from its node.
        """
        self.size = length + 1
        self.begin = np.cumsum(self.size, dtype=np.int64) - self.size
        place = np.arange(int(self.size.sum()), dtype=np.int32) - np.repeat(self.begin.astype(np.int32), self.size)
        spelled = data.take(np.repeat(start, self.size) + place, mode="clip") if len(data) else np.zeros(len(place), np.uint8)
        spelled[self.begin + length] = CLOSE
        power = np.full(int(place.max(initial=0)) + 1, STEP)
        power[0] = 1
        value = BYTE_HASH[spelled]
        value *= np.multiply.accumulate(power)[place]
        # Sums before each byte, then those from the beginning of its word.
        so_far = np.zeros_like(value)
        np.cumsum(value[:-1], out=so_far[1:])
        del value
        so_far -= np.repeat(so_far[self.begin], self.size)
        so_far += SALTS[3]
        keys = mix(so_far)
        del so_far
        keys &= self.code.hashed
        keys |= self.code.rank[spelled]
        keys, first, self.node = distinct(keys, 8)
        rank, place = self.code.rank[spelled[first]], place[first]
        context, found = np.zeros(len(first), np.uint64), []
        for k in range(1, CONTEXTS + 1):
            byte = np.where(place >= k, spelled[first - np.minimum(place, k)].astype(np.uint64) + ONE, 0)
            context |= byte << np.uint64(9 * (k - 1))
            if k > 1:
                found.append(distinct(mix(context + SALTS[k - 2]) & self.code.hashed | rank, 8)[::2])
        del context, byte, first, place, spelled
        found.append((keys, np.arange(len(keys), dtype=np.int32)))
        self.keys, _, which = distinct(np.concatenate([keys for keys, _ in found]), 8)
        limits = np.cumsum([0] + [len(keys) for keys, _ in found])
        self.entry = [which[limits[i] :][inverse] for i, (_, inverse) in enumerate(found)]
        self.rank = rank.astype(np.uint8)

    def holders(self) -> np.ndarray:
        """In how many training documents of the block each word is."""
        inside = np.sort(self.document[self.trains] * np.int64(len(self.types)) + self.which[self.trains])
        new = np.diff(inside, prepend=-1) > 0
        return np.bincount(inside[new] % max(1, len(self.types)), minlength=len(self.types))

    def per_node(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words that begin with each node."""
        return np.bincount(self.node, np.repeat(values, self.size), len(self.rank))

    def per_type(self, values: np.ndarray) -> np.ndarray:
        """Sums over the nodes of each word."""
        return np.add.reduceat(values[self.node], self.begin) if len(self.begin) else np.zeros(0)

    def asked_names(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of words and pairs, with the training counts of this block."""
        counts = np.concatenate([self.often, np.bincount(self.pair, self.trains, len(self.pairs))])
        names, order = sorted_places(np.concatenate([self.types, self.pairs]))
        return names, counts[order].astype(np.uint64)

    def asked_contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of contexts and bytes, with the training counts of this block."""
        weight = self.per_node(self.often)
        return self.keys, sum(np.bincount(entry, weight, len(self.keys)) for entry in self.entry).astype(np.uint64)

    def told(self, answer: list, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts of all training documents: of the words, of the pairs, of the ways of all contexts and where each way begins."""
        asked, order = sorted_places(np.concatenate([self.types, self.pairs]))
        begins = np.zeros(len(self.keys) + 1, np.int64)
        np.cumsum(self.code.length[(self.keys & BYTE).astype(np.uint8)] + 1, out=begins[1:])
        parts = Parts(count)
        name_cuts, key_cuts = parts.cuts(asked), parts.cuts(self.keys)
        counts, ways = np.zeros(len(asked)), np.zeros(begins[-1], np.float32)
        for item in answer:
            part, found = item["part"], joined(item["body"])
            if part < count:
                counts[order[name_cuts[part] : name_cuts[part + 1]]] = found
            else:
                span = slice(*key_cuts[part - count : part - count + 2])
                on_path = self.code.reach[:, (self.keys[span] & BYTE).astype(np.uint8)]
                levels = np.zeros(on_path.shape, np.uint64)
                levels[on_path] = found
                # A way is told as its first count and what is lost at each step.
                for above, below in zip(levels, levels[1:]):
                    np.subtract(above, below, out=below)
                ways[begins[span.start] : begins[span.stop]] = levels.T[on_path.T]
        return counts[: len(self.types)], counts[len(self.types) :], ways, begins[:-1]

    def bits(self, some: np.ndarray | None = None, at_once: int = NODES_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bits of the nodes, all or *some*, in bounded pieces of whole nodes: (nodes, bits of each, number in its code, bit)."""
        wanted = np.arange(len(self.rank)) if some is None else np.flatnonzero(some)
        depth = self.code.bits.shape[1]
        for low in range(0, len(wanted), at_once):
            nodes = wanted[low : low + at_once]
            rank = self.rank[nodes].astype(np.int64)
            length = self.code.length[rank]
            j = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            yield nodes, length, j, self.code.bits.ravel()[np.repeat(rank * depth, length) + j]


def spread(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, compressed; upper bytes that none of them needs are left out."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    cells = np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.compress(cells.T.tobytes(), 1)


def joined(body: bytes) -> np.ndarray:
    width, flat = body[0], np.frombuffer(zstandard.decompress(memoryview(body)[1:]), np.uint8)
    out = np.zeros((len(flat) // width, 8), np.uint8)
    out[:, :width] = flat.reshape(width, -1).T
    return out.reshape(-1).view("<u8")


@dataclass
class Mixer:
    """Weights of the contexts, refined map, and weights of the pairs."""

    weights: np.ndarray
    ones: np.ndarray
    seen: np.ndarray
    pairs: np.ndarray

    @classmethod
    def new(cls) -> Mixer:
        steps = np.linspace(-STEEPEST, STEEPEST, MAP_CELLS)
        prior = np.full(GATES * MAP_CELLS, 4.0)
        return cls(np.full((CONTEXTS, GATES), 0.35), prior * np.tile(1 / (1 + np.exp(-steps)), GATES), prior, np.zeros(SEEN))

    @staticmethod
    def inputs(tokens: Tokens, ways: np.ndarray, begins: np.ndarray, nodes, length, j, own=None) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the bit that comes under each context, without *own* of its counts, and the gate of every bit."""
        logits, gate = np.empty((CONTEXTS, len(j)), np.float32), np.zeros(len(j), np.uint8)
        for i, entry in enumerate(tokens.entry):
            cell = np.repeat(begins[entry[nodes]], length)
            cell += j
            all_ = ways[cell]
            cell += 1
            taken = ways[cell]
            if own is not None:
                all_ -= own
                taken -= own
                np.maximum(all_, 0, out=all_)
                np.maximum(taken, 0, out=taken)
            if i:
                gate *= 4
                for limit in CONFIDENCE:
                    gate += all_ >= limit
            all_ -= taken
            all_ += np.float32(0.4)
            taken += np.float32(0.4)
            taken /= all_
            np.log(taken, out=logits[i])
        return logits, gate.astype(np.int64)

    def mixed(self, logits: np.ndarray, gate: np.ndarray) -> np.ndarray:
        out = 0
        for weights, logit in zip(self.weights.astype(np.float32), logits, strict=True):
            part = weights[gate]
            part *= logit
            out += part
        return np.clip(out, -STEEPEST, STEEPEST, out=out)

    def probability(self, mixed: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the bit that comes: the mixture and its refined value, half each; and the cell of the map."""
        one = np.where(bit, mixed, -mixed)
        cell = gate * MAP_CELLS + np.rint((one + STEEPEST) * ((MAP_CELLS - 1) / (2 * STEEPEST))).astype(np.int64)
        refined = (self.ones / self.seen)[cell]
        return 0.5 / (1 + np.exp(-mixed)) + 0.5 * np.where(bit, refined, 1 - refined), cell

    def spelled(self, tokens: Tokens, ways: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Probability of every distinct word, as its logarithm."""
        out = np.zeros(len(tokens.rank))
        for nodes, length, j, bit in tokens.bits():
            logits, gate = self.inputs(tokens, ways, begins, nodes, length, j)
            p, _ = self.probability(self.mixed(logits, gate), gate, bit)
            out[nodes] = np.add.reduceat(np.log(p), np.cumsum(length) - length)
        return tokens.per_type(out)

    def with_pairs(self, spelled: np.ndarray, before: np.ndarray, followed: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of tokens: as spelled, and as followers of the word before."""
        share = np.where(before > 0, self.pairs[seen_gate(before)], 0)
        return np.logaddexp(np.log1p(-share) + spelled, np.log(np.maximum(share * followed / np.maximum(before, 1), 1e-300)))


def seen_gate(before: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(before, 1)).astype(np.int64), SEEN - 1)


class Learner:
    """Online steps of one task, from the weights all tasks begin with."""

    def __init__(self) -> None:
        self.mixer = Mixer.new()
        self.squares = np.full((CONTEXTS, GATES), 1e-6)
        self.bits, self.taken, self.tokens = np.zeros(GATES), np.zeros(SEEN), np.zeros(SEEN)
        self.start = self.mixer.ones.copy(), self.mixer.seen.copy()

    def learn(self, tokens: Tokens, answer: list, count: int, rate: float = 0.1) -> None:
        words, pairs, ways, begins = tokens.told(answer, count)
        holders, often = tokens.holders(), tokens.per_node(tokens.often)
        own = tokens.per_node(tokens.often * tokens.often / np.maximum(holders, 1)) / np.maximum(often, 1)
        own, often = np.rint(own).astype(np.float32), often.astype(np.float32)
        spelled = np.zeros(len(tokens.rank))
        mixer = self.mixer
        for nodes, length, j, bit in tokens.bits(often > 0, BATCH):
            x, g = mixer.inputs(tokens, ways, begins, nodes, length, j, np.repeat(own[nodes], length))
            times = np.repeat(often[nodes], length)
            mixed = mixer.mixed(x, g)
            p, cell = mixer.probability(mixed, g, bit)
            spelled[nodes] = np.add.reduceat(np.log(p), np.cumsum(length) - length)
            mixer.seen = mixer.seen + np.bincount(cell, times, len(mixer.seen))
            mixer.ones = mixer.ones + np.bincount(cell, times * bit, len(mixer.ones))
            error = times / (1 + np.exp(mixed))
            for i in range(CONTEXTS):
                step = np.bincount(g, error * x[i], GATES)
                self.squares[i] += step**2
                mixer.weights[i] += rate * step / np.sqrt(self.squares[i])
            np.clip(mixer.weights, -1, 3, out=mixer.weights)
            self.bits += np.bincount(g, times, GATES)
        some = np.flatnonzero(tokens.trains)
        kind = tokens.which[some]
        plain = np.exp(tokens.per_type(spelled)[tokens.which[some]])
        before = words[tokens.before[some]] - 1
        follows = np.maximum(pairs[tokens.pair[some]] - 1, 0)[before > 0]
        plain, before = plain[before > 0], before[before > 0]
        gate, follows = seen_gate(before), follows / before
        share, size = np.full(SEEN, 0.2), np.bincount(gate, minlength=SEEN)
        for _ in range(8):
            mine = share[gate] * follows
            taken = np.bincount(gate, mine / np.maximum(mine + (1 - share[gate]) * plain, 1e-300), SEEN)
            share = taken / np.maximum(size, 1)
        self.taken += taken
        self.tokens += size

    def sums(self) -> np.ndarray:
        parts = [self.mixer.weights * self.bits, self.bits, self.mixer.ones - self.start[0], self.mixer.seen - self.start[1], self.taken, self.tokens]
        return np.concatenate([x.ravel() for x in parts])


def _code(blocks: DataFrame, trains: str) -> Code:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for block, _ in unpack(batches):
            seen = block.data[np.repeat(training(block, trains), np.diff(block.offsets))]
            total += np.bincount(LOWER[seen], minlength=256)
        yield pa.record_batch([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    histogram = np.zeros(256, np.int64)
    for r in blocks.mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        histogram[r["byte"]] = r["n"]
    spaces = histogram[IS_SPACE].sum()
    histogram[IS_SPACE] = 0
    histogram[CLOSE] = spaces
    return Code(histogram)


def training(block: Block, trains: str) -> np.ndarray:
    return pa.compute.fill_null(block.rest.column(trains), False).to_numpy(zero_copy_only=False)


def _answers(blocks: DataFrame, trains: str, code: Code, count: int, area: StageArea) -> tuple[DataFrame, int, int]:
    """(block, answer) with the training counts each block asks for, and N and V of all training tokens.

    Contexts are asked once the answers about names are written, so that one question is under way at a time.
    """
    named = _ask(blocks, trains, code, count, True, area)
    row = named.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    both = named.unionByName(_ask(blocks, trains, code, count, False, area))
    each = both.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias("answer"))
    return each, row["n"] or 0, row["v"] or 0


def _ask(blocks: DataFrame, trains: str, code: Code, count: int, names: bool, area: StageArea) -> DataFrame:
    """(block, part, body, n, v): answers about names, or about contexts; the parts of the latter are numbered from *count*."""
    parts, offset, low = Parts(count), 0 if names else count, 0 if names else 8

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in unpack(batches):
            tokens = Tokens(block, code, training(block, trains), names, not names)
            keys, counts = tokens.asked_names() if names else tokens.asked_contexts()
            cuts = parts.cuts(keys)
            some = np.flatnonzero(np.diff(cuts))
            # Keys are sent as steps from one to the next.
            bodies = [[spread(np.diff(keys[cuts[p] : cuts[p + 1]], prepend=np.uint64(0))) for p in some], [spread(counts[cuts[p] : cuts[p + 1]]) for p in some]]
            columns = [pa.array((some + offset).astype(np.int32)), pa.array([block.number] * len(some)), *(pa.array(x, pa.binary()) for x in bodies)]
            yield pa.record_batch(columns, names=["part", "block", "keys", "counts"])

    def decide(table: pa.Table) -> pa.Table:
        steps = [np.cumsum(joined(x.as_py())) for x in table.column("keys")]
        ends = np.cumsum([len(x) for x in steps])[:-1]
        keys, _, which = distinct(np.concatenate(steps), low)
        del steps
        mine = np.split(which, ends)
        totals = np.zeros(len(keys), np.uint64)
        # A block asks about a key once.
        for w, x in zip(mine, table.column("counts"), strict=True):
            totals[w] += joined(x.as_py())
        n = v = 0
        if names:
            words = totals[(keys & ONE) == 0]
            n, v = int(words.sum()), int((words > 0).sum())
            bodies = [spread(totals[w]) for w in mine]
        else:
            ways, ranks = code.levels(keys, totals).T, (keys & BYTE).astype(np.uint8)
            for j in range(len(ways) - 1, 0, -1):
                np.subtract(ways[j - 1], ways[j], out=ways[j])
            # Level by level, as neighbours have the same counts near the root.
            bodies = [spread(ways[:, w][code.reach[:, ranks[w]]]) for w in mine]
        sums = [pa.array([x] + [0] * (len(bodies) - 1), pa.int64()) for x in (n, v)]
        return pa.table([table.column("block"), table.column("part"), pa.array(bodies, pa.binary()), *sums], names=["block", "part", "body", "n", "v"])

    sent = blocks.mapInArrow(send, "part int, block long, keys binary, counts binary").repartition(count, "part")
    found = sent.groupBy("part").applyInArrow(decide, "block long, part int, body binary, n long, v long")
    return area.put(found, "names" if names else "contexts", compression="uncompressed")


def _mixer(asked: DataFrame, trains: str, code: Code, count: int) -> Mixer:
    """Weights, map and pair weights that the tasks learned, averaged by the bits or tokens seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner()
        for block, (answer,) in unpack(batches):
            learner.learn(Tokens(block, code, training(block, trains)), answer or [], count)
        sums = learner.sums()
        yield pa.record_batch([pa.array(np.arange(len(sums))), pa.array(sums)], names=["cell", "value"])

    with shuffles_dropped(asked.sparkSession), row_by_row(asked.sparkSession):
        rows = asked.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    mixer = Mixer.new()
    limits = np.cumsum([CONTEXTS * GATES, GATES, GATES * MAP_CELLS, GATES * MAP_CELLS, SEEN, SEEN])
    sums = np.zeros(limits[-1])
    for r in rows:
        sums[r["cell"]] = r["value"]
    weights, bits, ones, seen, taken, tokens = np.split(sums, limits[:-1])
    mixer.weights = np.where(bits > 0, weights.reshape(CONTEXTS, GATES) / np.maximum(bits, 1), mixer.weights)
    mixer.ones, mixer.seen = mixer.ones + ones, mixer.seen + seen
    mixer.pairs = np.minimum(taken / np.maximum(tokens, 1), 0.999)
    return mixer


def score_documents(docs: DataFrame, trains: str) -> DataFrame:
    """Scores of every row of *docs* (doc_id, text and the boolean column *trains*).

    (doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)
    """
    area = StageArea(docs.sparkSession, "lmscore")
    blocks = pack(docs.select("doc_id", "text", trains), area, target=BLOCK_BYTES, by="block")
    count, code = part_count(blocks), _code(blocks, trains)
    answers, n, v = _answers(blocks, trains, code, count, area)
    asked = beside(blocks, answers, "left")
    mixer = _mixer(asked, trains, code, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (answer,) in unpack(batches):
            tokens, size = Tokens(block, code, training(block, trains)), len(block)
            words, pairs, ways, begins = tokens.told(answer or [], count)
            c = words[tokens.which]
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            spelled = mixer.spelled(tokens, ways, begins)[tokens.which]
            score = mixer.with_pairs(spelled, words[tokens.before], pairs[tokens.pair]) / np.log(10)
            per = lambda x: np.bincount(tokens.document, x, size)
            length, total = per(tokens.length + 1.0), per(score)
            found = {
                "n_tokens": np.diff(tokens.first),
                "n_known": per(c > 0).astype(np.int64),
                "train_tokens": np.full(size, n),
                "base_score": per(base),
                "score": total,
                "bits_per_byte": -total * np.log2(10) / length,
            }
            yield pa.record_batch([block.rest.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return asked.mapInArrow(run, schema)
