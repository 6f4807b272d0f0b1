"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every run of eight code points is hashed once; the highest bits of the hash choose one of 256 bins,
and each bin keeps its smallest hash. An empty bin copies the bin that a universal hash of (bin,
attempt) names first among the filled ones. Of each bin four bits are stored; as two different
minima agree in them once in 16 times, the share of equal bins is corrected for that.

Defined results: a text shorter than eight code points is one shingle; a null or empty text has the
empty fingerprint, which is like itself (1) and unlike all others (0). Rows that share an id follow
each other in the order of their texts; a null id comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.text import NO_ID, STEP, mix, window_starts, windows

WIDTH = 8
BINS_LOG2 = 8
BINS = 2**BINS_LOG2
STORED_BITS = 4
CHANCE = 2.0**-STORED_BITS
SLICE = 1 << 19
NOTHING = np.uint64(2**64 - 1)


def minima(texts: list[str]) -> np.ndarray:
    """(texts, bins): smallest hash of each bin after densification; a row of an empty text holds no hash."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(sizes)])
    values = mix(points.astype(np.uint64) + STEP)
    starts = window_starts(first, WIDTH)
    hashes = windows(values, WIDTH)[starts] if len(starts) else np.zeros(0, np.uint64)
    cells = np.repeat(np.arange(len(texts)) * BINS, np.maximum(sizes - WIDTH + 1, 0))
    cells += (hashes >> np.uint64(64 - BINS_LOG2)).astype(np.int64)
    out = np.full(len(texts) * BINS, NOTHING)
    np.minimum.at(out, cells, hashes)
    out = out.reshape(len(texts), BINS)
    for i in np.flatnonzero((sizes > 0) & (sizes < WIDTH)):
        whole = windows(values[first[i] : first[i + 1]], int(sizes[i]))[0]
        out[i, int(whole >> np.uint64(64 - BINS_LOG2))] = whole
    return densify(out)


def densify(found: np.ndarray) -> np.ndarray:
    """Fill the empty bins of rows that have any filled one."""
    filled = found != NOTHING
    rows, bins = np.nonzero(~filled & filled.any(1, keepdims=True))
    out, attempt = found.copy(), 0
    while len(rows):
        attempt += 1
        other = mix(bins.astype(np.uint64) * STEP + np.uint64(attempt)) >> np.uint64(64 - BINS_LOG2)
        hit = filled[rows, other.astype(np.int64)]
        out[rows[hit], bins[hit]] = found[rows[hit], other[hit].astype(np.int64)]
        rows, bins = rows[~hit], bins[~hit]
    return out


def low_bits(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(2**STORED_BITS - 1)).astype(np.uint8)


def packed(bits: np.ndarray, empty: np.ndarray) -> list[str]:
    pairs = bits[:, 0::2] << STORED_BITS | bits[:, 1::2]
    return ["" if none else row.tobytes().hex() for row, none in zip(pairs, empty, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of stored bits."""
    equal = ((a == b).mean(1) - CHANCE) / (1 - CHANCE)
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), np.clip(equal, 0, 1))


def fingerprint_pairs(texts: list[str], following: list[str]) -> dict[str, list]:
    """Fingerprints of *texts* and of their edited forms, and the likeness to those and to *following*."""
    cuts = [len(t) // 4 for t in texts]
    edited = [t[: len(t) - k] + n[:k] for t, n, k in zip(texts, following, cuts, strict=True)]
    found = [low_bits(minima(x)) for x in (texts, edited, following)]
    empty = [np.array([not t for t in x], bool) for x in (texts, edited, following)]
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": packed(found[0], empty[0]),
        "edited_fingerprint": packed(found[1], empty[1]),
        "near_edited": likeness(found[0], found[1], empty[0], empty[1]),
        "near_next": likeness(found[0], found[2], empty[0], empty[2]),
    }


def with_following(docs: DataFrame) -> DataFrame:
    """(bucket, borrowed, doc_id, text) sorted by id inside ranges; each range ends in the next one's first row.

    The limits of the ranges and their first ids are one number per task. Ids alone are read for
    them; texts move once.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    n = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    limits = sorted(set(ids.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    limits = np.array(limits, np.int64)

    def bucket_of(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(limits, values, "right").astype(np.int32)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("id").to_numpy()
            yield pa.record_batch([pa.array(bucket_of(values)), batch.column("id")], names=["bucket", "id"])

    firsts = ids.mapInArrow(buckets, "bucket int, id long").groupBy("bucket").agg(F.min("id").alias("id"))
    firsts = sorted((r["bucket"], r["id"]) for r in firsts.collect())
    lender = {id_: firsts[i - 1][0] for i, (_, id_) in enumerate(firsts)}
    lent = np.array(sorted(lender), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("id").to_numpy()
            own = pa.record_batch(
                [pa.array(bucket_of(values)), pa.array(np.zeros(len(values), bool)), *batch.columns], names=names
            )
            yield own
            extra = np.flatnonzero(np.isin(values, lent))
            if len(extra):
                rows = own.take(pa.array(extra))
                to = pa.array([lender[v] for v in values[extra].tolist()], pa.int32())
                yield pa.record_batch([to, pa.array(np.ones(len(extra), bool)), *rows.columns[2:]], names=names)

    names = ["bucket", "borrowed", "id", "text"]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    dealt = rows.mapInArrow(deal, "bucket int, borrowed boolean, id long, text string")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "borrowed", "id", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row (integer ``doc_id``) and of its edited form, see :func:`fingerprint_pairs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("bucket", "borrowed", "id", "text"))
            for bucket, borrowed, doc, text in zip(*columns, strict=True):
                rows.append((bucket, borrowed, doc, text or ""))
                size += len(rows[-1][3])
                if size > SLICE:
                    yield from finish(rows)
                    rows, size = rows[-1:], len(rows[-1][3])
        yield from finish(rows)

    def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
        if pairs:
            found = fingerprint_pairs([a[3] for a, _ in pairs], [b[3] for _, b in pairs])
            ids = pa.array([None if a[2] == NO_ID else a[2] for a, _ in pairs], pa.int64())
            yield pa.record_batch([ids, *map(pa.array, found.values())], names=["doc_id", *found])

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_following(docs).mapInArrow(run, schema)
