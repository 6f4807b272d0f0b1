"""Documents packed in blocks, and questions that blocks ask about hashes of all documents.

A block holds about two megabytes of text, compressed, as one row of a staged table. Whatever has
to be known about values of the whole corpus (has this window been seen elsewhere?) is asked once
per block and value, however many documents of the block hold it, so a value that a third of all
rows share reaches the task that decides about it once per block. The question travels as arrays,
sorted by hash and cut into as many parts as the corpus needs; the answer comes back as one bit for
each value asked. Texts are only moved to meet the answers of their block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.text import NO_ID, buffers, slices
from runscope.plans.stage import StageArea

BLOCK_BYTES = 2 << 20
#: Text whose values one part of a question holds, and the least number of parts.
PART_BYTES = 16 << 20
LEAST_PARTS = 48
SCHEMA = "block long, bytes long, rest binary, ends binary, body binary, nulls binary"


@dataclass
class Block:
    """Rows of one block: their columns other than the text, and the texts as bytes with offsets.

    Row *i* of the block has the number ``number + i`` in the whole table.
    """

    number: int
    rest: pa.RecordBatch
    offsets: np.ndarray
    data: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def ids(self) -> np.ndarray:
        """Document ids, NO_ID for null."""
        return pa.compute.fill_null(self.rest.column("doc_id").cast(pa.int64()), NO_ID).to_numpy()

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def rows(self, names: list[str], texts: list[bytes], text: str = "text") -> pa.RecordBatch:
        """The packed columns *names* with *texts* as text; null texts stay null."""
        columns = {name: self.rest.column(i) for i, name in enumerate(self.rest.schema.names)}
        columns[text] = pa.array([None if n else t for t, n in zip(texts, self.null, strict=True)], pa.binary()).cast(pa.string())
        return pa.record_batch([columns[name] for name in names], names=names)


def pack(docs: DataFrame, area: StageArea, text: str = "text", target: int = BLOCK_BYTES, by: str | None = None) -> DataFrame:
    """Stage *docs* as blocks of about *target* bytes of text; all columns are kept. Laid out *by* ``block``, they meet answers in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, text, target):
            data, offsets = buffers(batch.column(text))
            at = batch.schema.get_field_index(text)
            others = [i for i in range(batch.num_columns) if i != at]
            rest = pa.record_batch([batch.column(i) for i in others], schema=pa.schema([batch.schema.field(i) for i in others]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_batch(rest)
            null = np.packbits(batch.column(at).is_null().to_numpy(zero_copy_only=False))
            parts = (sink.getvalue(), np.ascontiguousarray(offsets), data.tobytes(), null.tobytes())
            packed = [pa.array([squeeze.compress(x)], pa.binary()) for x in parts]
            columns = [pa.array([number]), pa.array([len(data)]), *packed]
            yield pa.record_batch(columns, names=["block", "bytes", "rest", "ends", "body", "nulls"])
            number += batch.num_rows

    return area.put(docs.mapInArrow(run, SCHEMA), "blocks", by, compression="uncompressed")


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[list | None]]]:
    """Blocks of a table made by :func:`pack`, with the further columns of their rows."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        more = [name for name in batch.schema.names if name.startswith("answer")]
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in ("block", "rest", "ends", "body", "nulls", *more)}
            with pa.ipc.open_stream(open_(row["rest"])) as stream:
                rest = stream.read_next_batch()
            offsets, data = np.frombuffer(open_(row["ends"]), np.int64), np.frombuffer(open_(row["body"]), np.uint8)
            null = np.unpackbits(np.frombuffer(open_(row["nulls"]), np.uint8), count=len(offsets) - 1).astype(bool)
            yield Block(row["block"], rest, offsets, data, null), [row[name] for name in more]


def beside(blocks: DataFrame, answers: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of a table laid out by ``block`` with the small answers of their blocks; only the answers are moved, and hashed."""
    return blocks.join(answers.hint("shuffle_hash"), "block", how)


def part_count(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    return max(LEAST_PARTS, -(-total // PART_BYTES))


class Parts:
    """Equal ranges of 64-bit hashes."""

    def __init__(self, count: int) -> None:
        self.limits = np.array([2**64 * i // count for i in range(1, count)], np.uint64)

    def cuts(self, keys: np.ndarray) -> np.ndarray:
        """Where each part begins in sorted *keys*, and their end."""
        return np.concatenate([[0], np.searchsorted(keys, self.limits), [len(keys)]])


def sender(count: int, values: Callable, reader: Callable) -> Callable:
    """For ``mapInArrow``: the values of each block cut into (part, block, body) rows."""
    parts = Parts(count)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in reader(batches):
            found = values(block, answers)
            cuts = parts.cuts(found["key"])
            some = np.flatnonzero(np.diff(cuts))
            if len(some):
                bodies = [found[cuts[p] : cuts[p + 1]].tobytes() for p in some]
                columns = [pa.array(some.astype(np.int32)), pa.array([block.number] * len(some)), pa.array(bodies, pa.binary())]
                yield pa.record_batch(columns, names=["part", "block", "body"])

    return send


def ask(
    blocks: DataFrame,
    count: int,
    kind: np.dtype,
    values: Callable[[Block, list], np.ndarray],
    decide: Callable[[np.ndarray, np.ndarray], np.ndarray],
    area: StageArea,
    reader: Callable | None = None,
) -> DataFrame:
    """(block, answer): for every block one bit, or one record, for each value it asks about.

    *values* gives a structured array of *kind* with a field ``key``, sorted by it; *decide* gets the values
    of all blocks in one part and the block each came from, and returns what is true of each, or
    an unsigned number or plain record for each. *reader* turns batches into (block, answers) pairs, :func:`unpack`
    by default.
    """

    def answer(table: pa.Table) -> pa.Table:
        parts = [buffers(chunk) for chunk in table.column("body").chunks]
        lengths = np.concatenate([np.diff(ends) for _, ends in parts]) // kind.itemsize
        bodies = [data.view(kind) for data, _ in parts]
        found = decide(bodies[0] if len(bodies) == 1 else np.concatenate(bodies), np.repeat(table.column("block").to_numpy(), lengths))
        each = np.split(found, np.cumsum(lengths)[:-1])
        keep = np.array([x.dtype.kind == "V" or x.any() for x in each], bool)
        bodies = [(np.packbits(x) if x.dtype == bool else x).tobytes() for x in each]
        columns = [table.column("block"), table.column("part"), pa.array(bodies, pa.binary())]
        return pa.table(columns, names=["block", "part", "body"]).filter(pa.array(keep))

    sent = blocks.mapInArrow(sender(count, values, reader or unpack), "part int, block long, body binary")
    found = sent.groupBy("part").applyInArrow(answer, "block long, part int, body binary")
    answers = found.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias("answer"))
    return area.put(answers, "answers")


def heard(answer: list | None, keys: np.ndarray, count: int, kind: str | None = None) -> np.ndarray:
    """The answer to a question as one boolean, or record of *kind*, for each of the sorted *keys*."""
    out = np.zeros(len(keys), kind or bool)
    cuts = Parts(count).cuts(keys)
    for item in answer or []:
        low, high = cuts[item["part"]], cuts[item["part"] + 1]
        if kind:
            out[low:high] = np.frombuffer(item["body"], kind)
        else:
            out[low:high] = np.unpackbits(np.frombuffer(item["body"], np.uint8), count=high - low)
    return out
