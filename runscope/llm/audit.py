"""How the sources of a language differ in their words.

One translate table lowers A-Z and turns every separator into a blank, so splitting the UTF-8 bytes of
a text gives its terms; a counter per document gives their frequencies. Tasks add these up per language
and source before anything is exchanged, and from there on only the sparse table (language, source, term,
count) is worked on. Terms that a group lacks all have the same share there, so sums over the whole vocabulary
are those over terms present, put right by how many are absent; no table of all terms by all pairs is made.
Shares and divergences are integers, all arithmetic is exact.

Null text, language and source are empty; such a language or source is one like others. Every row
is a document: repeated rows count as often as they occur. Very long texts are split whole, one at a time. An
empty table gives no rows. Only text, lang and source are read, so further columns may have any names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.llm.text import buffers, slices
from runscope.plans.stage import StageArea

BATCH_BYTES = 4 << 20
#: Distinct (language, source, term) that a task holds before it sends them on.
HELD_TERMS = 400_000
#: A-Z lowered; letters, and bytes of characters beyond ASCII, kept; all else blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000


def terms_of(text: bytes) -> Counter:
    """Frequencies of the terms of one text."""
    return Counter(text.translate(TABLE).split())


def _send(groups: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in groups.items():
        terms = pa.array(list(counts), pa.binary()).cast(pa.string())
        n = len(terms)
        columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms]
        columns += [pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())]
        yield pa.record_batch(columns, names=["lang", "source", "term", "count", "docs"])


def count_terms(docs: DataFrame, held_terms: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, count, docs) of a table with text, lang and source that are not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = defaultdict(lambda: (Counter(), Counter()))
        held = 0
        for batch in slices(batches, "text", BATCH_BYTES):
            data, offsets = buffers(batch.column("text"))
            raw, ends = data.tobytes(), offsets.tolist()
            for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                found = terms_of(raw[ends[i] : ends[i + 1]])
                counts, seen = groups[key]
                held -= len(counts)
                counts.update(found)
                seen.update(found.keys())
                held += len(counts)
                if held > held_terms:
                    yield from _send(groups)
                    groups.clear()
                    held = 0
        yield from _send(groups)

    sent = docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for every count."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(19, 0))) div cast({total} + {terms} as decimal(20, 0))")


def gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _sizes(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, total, present, terms, none): tokens and kept terms of each group, its language's vocabulary, the share of an absent term."""
    own = found.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("present"))
    kept = found.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count("*").alias("terms"))
    sizes = groups.join(own, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "present", "terms"])
    return sizes.withColumn("none", F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(1))


def divergent_terms(found: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The *top* terms of each group that are commoner there than in its language."""
    whole = sizes.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = found.join(sizes.select("lang", "source", "total", "terms"), ["lang", "source"]).join(whole, "lang")
    shares = known.select(
        "lang", "source", "term", share("count", "total", "terms").alias("p"), share("lang_count", "lang_total", "terms").alias("q")
    )
    valued = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def divergent_pairs(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every other source of the language of each group, by the summed divergence over all kept terms."""
    shares = found.join(sizes.select("lang", "source", "total", "terms", "none"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", share("count", "total", "terms").alias("p"), "none")
    right = shares.select("lang", F.col("source").alias("item"), "term", F.col("p").alias("q"), F.col("none").alias("q_none"))
    met = f"{gap('p', 'q')} - {gap('p', 'q_none')} - {gap('none', 'q')}"
    both = (
        shares.join(right, ["lang", "term"])
        .where("source <> item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(F.expr(met)).alias("met"), F.count("*").alias("both"))
    )
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("many"))
    other = sizes.select("lang", F.col("source").alias("item"), F.col("none").alias("q_none"))
    alone = (
        levels.join(other, "lang")
        .where("source <> item")
        .groupBy("lang", "source", "item")
        .agg(
            F.sum(F.expr(f"many * ({gap('p', 'q_none')})")).alias("ours"),
            F.sum(F.expr(f"many * ({gap('q_none', 'p')})")).alias("theirs"),
        )
    )
    theirs = alone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), "theirs")
    all_pairs = (
        sizes.join(other.join(sizes.select("lang", F.col("source").alias("item"), F.col("present").alias("held")), ["lang", "item"]), "lang")
        .where("source <> item")
        .join(alone.drop("theirs"), ["lang", "source", "item"], "left")
        .join(theirs, ["lang", "source", "item"], "left")
        .join(both, ["lang", "source", "item"], "left")
        .fillna(0, ["ours", "theirs", "met", "both"])
    )
    absent = f"(terms - present - held + both) * ({gap('none', 'q_none')})"
    valued = all_pairs.select("lang", "source", "item", F.expr(f"ours + theirs + met + {absent}").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order))


def audit_sources(docs: DataFrame, area: StageArea, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of a table with text, lang and source.

    Part ``pair`` ranks the other sources of the language by divergence, part ``term`` the *top* terms
    that set the group apart from its language. A term counts if at least *least_docs* documents of the language hold it.
    """
    wanted = docs.select(*(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("text", "lang", "source")))
    same = Window.partitionBy("lang", "term")
    known = count_terms(wanted).select(
        "lang", "source", "term", "count", F.sum("docs").over(same).alias("lang_docs"), F.sum("count").over(same).alias("lang_count")
    )
    found = area.put(known.where(F.col("lang_docs") >= least_docs).drop("lang_docs"), "terms")
    sizes = area.put(_sizes(found, wanted.select("lang", "source").distinct()), "sizes")
    parts = [
        part.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long"), "rank")
        for name, part in (("pair", divergent_pairs(found, sizes)), ("term", divergent_terms(found, sizes, top)))
    ]
    return parts[0].unionByName(parts[1])
