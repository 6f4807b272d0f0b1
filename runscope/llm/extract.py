"""Main text of web pages by wrappers learned from the pages of each host.

Every page becomes a folded tree (``llm/dom.py``). Tasks add up, per host and tree shape, what the texts
at each node look like; the shapes of a host are aligned by simple tree matching into one template, bucket by
bucket, then over buckets. A template node whose texts stay the same over pages that differ is part of the template; the
others are slots. A slot is content unless its path is marked as menu, advert, comment and the like, or its text
is mostly links. Where a page fills slots of an article, of a main part, or of an element named as content,
in this order, those are its text; else all content slots are.

No page is gathered with others of its host: summaries have a fixed size per node, shapes are aligned in
buckets, and pages meet the decisions about their shape by a join in which shapes of many pages are salted. The list of
these shapes is broadcast; it has at most ``HOT_SHARES`` rows.

Null or empty html has empty text. Pages without a host (null or odd url) are judged by marks and links only, as are
hosts with fewer than ``LEAST_PAGES`` differing pages. Pages that agree in their longest block, exact copies among them, count as one
there, and every row has its own result. Ties (two ways to align) go to the later sibling. Very long pages are read whole. An empty
table gives no rows. Only page_id, url and html are read, other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.dom import Page, Template, read_shape, spell, text_hash
from runscope.llm.text import slices
from runscope.plans.stage import StageArea

BATCH_BYTES = 4 << 20
#: Nodes of summaries that a task holds before it sends them on.
HELD_NODES = 200_000
#: Differing pages from which equal text is evidence, and pages per different text up to which a slot outside regions counts as template.
LEAST_PAGES = 3
PAGES_PER_TEXT = 8
#: Different texts of a node, and page signatures, that a summary keeps: exact up to there, "varies" or "many" beyond.
TEXTS_KEPT = 16
SIGNATURES_KEPT = TEXTS_KEPT * PAGES_PER_TEXT
SHAPES_PER_BUCKET = 256
HOT_SHARES = 4096
#: Pages of one shape that are never salted.
HOT_LEAST = 64
#: Marks a node whose texts are too many to list; hashes are not negative.
VARIES = -1
SUMMARY = "pages long, signatures array<long>, texts array<array<long>>, chars array<long>, links array<long>"
ARROW_SUMMARY = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.list_(pa.int64())]
SUMMARY_NAMES = ["pages", "signatures", "texts", "chars", "links"]
#: Rank of slots outside of any region.
OUTSIDE = 4


def host_of(url: str | None) -> str:
    """Host of an url without user, port and case; empty where there is none."""
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found.group(1).lower() if found else ""


class Summary:
    """What the texts at each node of one shape are like over pages; summaries of one shape can be added up."""

    def __init__(self, size: int) -> None:
        self.pages = 0
        self.signatures: set[int] = set()
        self.texts: list[set[int]] = [set() for _ in range(size)]
        self.chars, self.links = [0] * size, [0] * size

    def add_page(self, page: Page) -> None:
        self.pages += 1
        self._sign({page.signature()})
        spelled: dict[int, list[str]] = {}
        for node, text, linked in page.blocks:
            spelled.setdefault(node, []).append(text)
            self.chars[node] += len(text)
            self.links[node] += linked
        for node, texts in spelled.items():
            self._tell(node, {text_hash("\n".join(texts))})

    def add(self, row: dict, mapping: list[int] | None = None) -> None:
        """Another summary, whose nodes are those of *mapping* here."""
        self.pages += row["pages"]
        self._sign(set(row["signatures"]))
        for i, texts in enumerate(row["texts"]):
            at = mapping[i] if mapping else i
            self._tell(at, set(texts))
            self.chars[at] += row["chars"][i]
            self.links[at] += row["links"][i]

    def _sign(self, signatures: set[int]) -> None:
        self.signatures |= signatures
        if len(self.signatures) > SIGNATURES_KEPT:
            self.signatures = set(sorted(self.signatures)[:SIGNATURES_KEPT])

    def _tell(self, node: int, texts: set[int]) -> None:
        self.texts[node] |= texts
        if VARIES in self.texts[node] or len(self.texts[node]) > TEXTS_KEPT:
            self.texts[node] = {VARIES}

    def row(self) -> list:
        return [self.pages, sorted(self.signatures), [sorted(t) for t in self.texts], self.chars, self.links]


def summarise(pages: DataFrame, held_nodes: int = HELD_NODES) -> DataFrame:
    """(host, shape, summary) with one row per host and shape."""

    def send(held: dict) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % 256
        rows = [[host, shape, salt, *summary.row()] for (host, shape), summary in held.items()]
        if rows:
            kinds = [pa.string(), pa.string(), pa.int32(), *ARROW_SUMMARY]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch(columns, names=["host", "shape", "salt", *SUMMARY_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Summary] = {}
        nodes = 0
        for batch in slices(batches, "html", BATCH_BYTES):
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page, host = Page(source or ""), host_of(url)
                size = page.shape.count("(") + page.shape.count(",") + 1
                if (host, page.shape) not in held:
                    held[host, page.shape] = Summary(size)
                    nodes += size
                held[host, page.shape].add_page(page)
                if nodes > held_nodes:
                    yield from send(held)
                    held.clear()
                    nodes = 0
        yield from send(held)

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total = Summary(len(rows[0]["texts"]))
        for row in rows:
            total.add(row)
        columns = [pa.array([v], k) for v, k in zip(total.row(), ARROW_SUMMARY, strict=True)]
        return pa.table([table.column(n).slice(0, 1) for n in ("host", "shape", "salt")] + columns, names=["host", "shape", "salt", *SUMMARY_NAMES])

    schema = f"host string, shape string, salt int, {SUMMARY}"
    sent = pages.select("url", "html").mapInArrow(run, schema)
    salted = sent.groupBy("host", "shape", "salt").applyInArrow(add_up, schema)
    return salted.groupBy("host", "shape").applyInArrow(add_up, schema).drop("salt")


def align(rows: list[dict]) -> tuple[str, Summary, list[list[int]]]:
    """One template of the shapes in *rows*, its summary, and the template node of each node of each shape.

    The commonest shape comes first, equally common ones in the order of their spelling.
    """
    order = sorted(range(len(rows)), key=lambda i: (-rows[i]["pages"], rows[i]["shape"]))
    template = Template(rows[order[0]]["shape"])
    mapped = {i: template.align(rows[i]["shape"]) for i in order}
    shape, number = spell(template.root)
    mappings = [[number[node] for node in mapped[i]] for i in range(len(rows))]
    total = Summary(template.size)
    for row, mapping in zip(rows, mappings, strict=True):
        total.add(row, mapping)
    return shape, total, mappings


def judge(shape: str, summary: Summary, host: str) -> list[int]:
    """0 for template nodes and slots that are no content; else the rank of the region a slot is in, ``OUTSIDE`` for none."""
    out = [0] * len(summary.texts)
    pages = len(summary.signatures) if host else 0

    def visit(node, rank: int, aside: bool, header: bool) -> None:
        label = node.label
        aside |= label.endswith("!x") or (label.endswith("!h") and rank == OUTSIDE)
        header |= label.endswith("!h")
        if "@" in label:
            rank = min(rank, int(label[-1]))
        texts = summary.texts[node.at]
        same = VARIES not in texts and len(texts) == 1 and pages >= LEAST_PAGES
        few = VARIES not in texts and rank == OUTSIDE and len(texts) * PAGES_PER_TEXT <= pages
        linked = rank == OUTSIDE and 2 * summary.links[node.at] > summary.chars[node.at]
        if not (aside or same or few or linked or (header and label != "title")):
            out[node.at] = rank
        for kid in node.kids:
            visit(kid, rank, aside, header)

    visit(read_shape(shape), OUTSIDE, False, False)
    return out


def learn(pages: DataFrame, area: StageArea, shapes_per_bucket: int = SHAPES_PER_BUCKET) -> DataFrame:
    """(host, shape, pages, flags): for each node of each shape of a host what :func:`judge` says of its template node."""
    shapes = area.put(summarise(pages), "shapes")
    sizes = shapes.groupBy("host").agg(F.ceil(F.count("*") / shapes_per_bucket).alias("buckets"))
    bucketed = shapes.join(sizes, "host").withColumn("bucket", F.pmod(F.xxhash64("shape"), F.col("buckets")).cast("int")).drop("buckets")

    def first(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        host, bucket = rows[0]["host"], rows[0]["bucket"]
        shape, total, mappings = align(rows)
        out = [[host, bucket, shape, None, *total.row()]]
        out += [[host, bucket, r["shape"], m, r["pages"], None, None, None, None] for r, m in zip(rows, mappings, strict=True)]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), *ARROW_SUMMARY]
        columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
        return pa.table(columns, names=["host", "bucket", "shape", "nodes", *SUMMARY_NAMES])

    def second(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shape, total, mappings = align(rows)
        flags = judge(shape, total, rows[0]["host"])
        found = [[flags[node] for node in mapping] for mapping in mappings]
        return pa.table(
            [table.column("host"), table.column("bucket"), pa.array(found, pa.list_(pa.int32()))], names=["host", "bucket", "judged"]
        )

    aligned = area.put(
        bucketed.groupBy("host", "bucket").applyInArrow(first, f"host string, bucket int, shape string, nodes array<int>, {SUMMARY}"), "aligned"
    )
    trees = aligned.where(F.col("nodes").isNull()).drop("nodes")
    judged = trees.groupBy("host").applyInArrow(second, "host string, bucket int, judged array<int>")
    each = aligned.where(F.col("nodes").isNotNull()).select("host", "bucket", "shape", "nodes", "pages").join(judged, ["host", "bucket"])
    return area.put(each.select("host", "shape", "pages", F.expr("transform(nodes, n -> judged[n])").alias("flags")), "flags")


def read_blocks(pages: DataFrame) -> DataFrame:
    """*pages* with host, shape, the folded node of each block and its text in place of the html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", BATCH_BYTES):
            read = [Page(source or "") for source in batch.column("html").to_pylist()]
            hosts = [host_of(url) for url in batch.column("url").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array([p.shape for p in read], pa.string())]
            columns.append(pa.array([[b[0] for b in p.blocks] for p in read], pa.list_(pa.int32())))
            texts = [[b[1].encode("utf-8", "replace") for b in p.blocks] for p in read]
            columns.append(pa.array(texts, pa.list_(pa.binary())).cast(pa.list_(pa.string())))
            yield pa.record_batch(columns, names=["page_id", "url", "host", "shape", "nodes", "texts"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, url string, host string, shape string, nodes array<int>, texts array<string>")


def extract_text(
    pages: DataFrame, area: StageArea, shapes_per_bucket: int = SHAPES_PER_BUCKET, hot_least: int = HOT_LEAST
) -> DataFrame:
    """(page_id, url, text) of every page: its content blocks in page order, joined by one blank."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    flags = learn(pages, area, shapes_per_bucket)
    share = max(hot_least, (flags.agg(F.sum("pages")).first()[0] or 0) // HOT_SHARES)
    splits = flags.withColumn("splits", F.ceil(F.col("pages") / share))
    hot = splits.where("splits > 1").select("host", "shape", "splits")
    decided = splits.select("host", "shape", "flags", F.explode(F.expr("sequence(0, int(splits) - 1)")).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("splits", F.lit(1))).cast("int")
    salted = read_blocks(pages).join(F.broadcast(hot), ["host", "shape"], "left").withColumn("salt", salt)
    met = salted.join(decided, ["host", "shape", "salt"])
    ranks = F.expr("transform(nodes, n -> flags[n])").alias("ranks")
    ranked = met.select("page_id", "url", "texts", ranks).withColumn("best", F.expr("array_min(filter(ranks, r -> r > 0))"))
    chosen = F.expr("array_join(filter(texts, (t, i) -> ranks[i] = best), ' ')")
    return ranked.select("page_id", "url", F.coalesce(chosen, F.lit("")).alias("text"))
