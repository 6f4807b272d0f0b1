"""Web pages as trees of folded elements with text blocks, and the alignment of such trees.

Broken markup is read as browsers do: open paragraphs, list items and cells end where the next begins, stray end
tags are passed over, an element left open ends with the page. Inline elements leave text untouched; a line break is a
blank. Elements whose names or class words mark them as menu, advert and the like carry that in their label,
as do articles and main parts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import xxhash

TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements deeper than this belong to their ancestor at this depth; their text is kept.
DEPTH = 150

# HTML element names by the way they are read, and words in class, id and role that tell what an element is for.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math object canvas audio video".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl dt dd figure figcaption center details summary hgroup".split())
BLOCK = FLOW | frozenset(
    "address article aside button caption dialog dir div fieldset footer form header hr label legend li main menu nav ol optgroup option"
    " search section select table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {  # an opening element of this name ends one of these, looked for up to the elements after them
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("td th caption table button".split())
ASIDE_TAGS = frozenset("nav footer aside form button select menu dialog search label legend fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promotion promoted"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar"
    " sidebar aside footer masthead copyright legal disclaimer"
    " cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay"
    " newsletter subscribe subscription signup login search form share sharing social related recommended recommendations"
    " comment comments disqus reply replies respond widget widgets skip complementary contentinfo".split()
)
HEADER_WORDS = frozenset("header".split())
REGION_WORDS = {"article": 1, "articlebody": 1, "main": 2}
REGION_NAMES = frozenset("content main article post entry story main-content article-body post-content entry-content".split())
NEGATING = frozenset("has with no without".split())


@lru_cache(maxsize=20_000)
def describe(name: str, attributes: str) -> str:
    """Label of an element: its name, up to two classes without longer numbers, then ``!x`` aside, ``!h`` header or ``@n`` region."""
    given = {}
    if attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            given.setdefault(key.lower(), value.strip("\"'"))
    named = [given.get(key, "") for key in ("class", "id", "role", "itemprop")]
    words, before = set(), ""
    for word in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", " ".join(named)):
        if before not in NEGATING:
            words.add(word.lower())
        before = word.lower()
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    if hidden or name in ASIDE_TAGS or (words & ASIDE_WORDS and name != "main"):
        mark = "!x"
    elif name == "header" or words & HEADER_WORDS:
        mark = "!h"
    elif name in REGION_WORDS:
        mark = f"@{REGION_WORDS[name]}"
    elif given.get("role", "").lower() in REGION_WORDS or given.get("itemprop", "").lower() in REGION_WORDS:
        mark = f"@{min(REGION_WORDS[v] for v in (given.get('role', '').lower(), given.get('itemprop', '').lower()) if v in REGION_WORDS)}"
    elif any(re.sub(r"[-_0-9]+$", "", part.lower()) in REGION_NAMES for value in named[:2] for part in value.split()):
        mark = "@3"
    else:
        mark = ""
    if name in FLOW and not mark:
        return "flow"
    kinds = [re.sub(r"[^a-z0-9-]|[0-9]{2,}", "", word) for word in named[0].lower().split()[:2]]
    return ".".join([re.sub(r"[^a-z0-9-]", "", name), *kinds]) + mark


class Page:
    """Folded tree of one page: ``shape`` spells it; ``blocks`` are (number of the folded node, text, characters in links)."""

    def __init__(self, source: str) -> None:
        self.labels, self.kids, self.found = ["page"], [[]], []
        self._read(source)
        self.shape, number = self._fold()
        self.blocks = [(number[node], text, linked) for node, text, linked in self.found]

    def _read(self, source: str) -> None:
        names, nodes, nested = ["page"], [0], [0]
        pieces: list[str] = []
        linked = 0
        in_link = False

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.found.append((nodes[-1], text, min(linked, len(text))))
                pieces.clear()
            linked = 0

        def cut(size: int) -> None:
            flush()
            del names[size:], nodes[size:], nested[size:]

        def push(name: str, label: str) -> None:
            flush()
            node = nodes[-1]
            if len(nodes) < DEPTH:
                if label == "flow" and name in HEADINGS and "!h" in self.labels[node]:
                    label = "title"
                node = len(self.labels)
                self.labels.append(label)
                self.kids.append([])
                self.kids[nodes[-1]].append(node)
            names.append(name)
            nodes.append(node)
            nested.append(0)

        def innermost(wanted, stop) -> int:
            for i in range(len(names) - 1, 0, -1):
                if names[i] in wanted:
                    return i
                if names[i] in stop:
                    return 0
            return 0

        at, low = 0, None
        while True:
            match = TAG.search(source, at)
            text = source[at : match.start()] if match else source[at:]
            if text:
                text = html.unescape(text) if "&" in text else text
                pieces.append(text)
                if in_link:
                    linked += len(text)
            if not match:
                break
            at = match.end()
            name = match.group(2)
            if not name:
                continue
            name, closes, attributes = name.lower(), match.group(1), match.group(3)
            if closes:
                if name == "a":
                    in_link = False
                if name in names:
                    i = innermost({name}, () if name in SCOPE else SCOPE)
                    if i and nested[i] and name not in BLOCK:
                        nested[i] -= 1
                    elif i:
                        cut(i)
                elif name in BLOCK:
                    flush()
                continue
            if name in RAW:
                if name in ("svg", "math") and attributes.endswith("/"):
                    continue
                low = source.lower() if low is None or len(low) != len(source) else low
                end = low.find(f"</{name}", at) if len(low) == len(source) else -1
                if end < 0 and len(low) != len(source):
                    later = re.compile(f"</{name}", re.I).search(source, at)
                    end = later.start() if later else -1
                if end >= 0:
                    at = source.find(">", end) + 1 or len(source)
                elif name in ("script", "style", "title", "textarea"):
                    break
                continue
            if name == "br":
                pieces.append(" ")
                continue
            if name in BLOCK:
                i = innermost({"p"}, SCOPE)
                if i:
                    cut(i)
                if name in ENDS:
                    i = innermost(*ENDS[name])
                    if i:
                        cut(i)
                if name in VOID:
                    flush()
                else:
                    push(name, describe(name, attributes))
            elif name not in VOID and name not in ("html", "head", "body"):
                if name == "a":
                    in_link = True
                label = describe(name, attributes) if attributes else ""
                if label.endswith("!x"):
                    push(name, label)
                elif name in names:
                    nested[len(names) - 1 - names[::-1].index(name)] += 1
        cut(1)

    def _fold(self) -> tuple[str, list[int]]:
        """Siblings of one label become one node where they are neighbours or more than two; nodes are numbered in order."""
        number, count = [0] * len(self.labels), 0

        def fold(members: list[int]) -> str:
            nonlocal count
            for member in members:
                number[member] = count
            count += 1
            groups: list[list[int]] = []
            labels: list[str] = []
            for kid in (kid for member in members for kid in self.kids[member]):
                if labels and labels[-1] == self.labels[kid]:
                    groups[-1].append(kid)
                else:
                    groups.append([kid])
                    labels.append(self.labels[kid])
            often = {label for label, n in Counter(labels).items() if n > 2}
            first: dict[str, list[int]] = {}
            left = []
            for label, group in zip(labels, groups, strict=True):
                if label in first:
                    first[label].extend(group)
                else:
                    left.append(group)
                    if label in often:
                        first[label] = group
            label = self.labels[members[0]]
            return f"{label}({','.join(fold(group) for group in left)})" if left else label

        return fold([0]), number

    def signature(self) -> int:
        """Hash of the longest block: pages that agree in it count as one when templates are judged."""
        return text_hash(max((text for _, text, _ in self.blocks), key=lambda t: (len(t), t), default=""))


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


class Node:
    __slots__ = ("at", "kids", "label")

    def __init__(self, label: str, at: int) -> None:
        self.label, self.at, self.kids = label, at, []


def read_shape(shape: str) -> Node:
    root = Node("", -1)
    path, count = [root], 0
    for label, after in re.findall(r"([^(),]*)([(),]|$)", shape):
        if label:
            path[-1].kids.append(Node(label, count))
            count += 1
        if after == "(":
            path.append(path[-1].kids[-1])
        elif after == ")":
            path.pop()
    return root.kids[0]


def spell(root: Node) -> tuple[str, dict[int, int]]:
    """The shape of a tree and the number in it of each node."""
    number: dict[int, int] = {}

    def write(node: Node) -> str:
        number[node.at] = len(number)
        return f"{node.label}({','.join([write(kid) for kid in node.kids])})" if node.kids else node.label

    return write(root), number


class Template:
    """Union of trees aligned by simple tree matching."""

    def __init__(self, shape: str) -> None:
        self.root = read_shape(shape)
        self.size = len(spell(self.root)[1])

    def align(self, shape: str) -> list[int]:
        """Match another tree with the template, add what it has more; the template node of each of its nodes."""
        other = read_shape(shape)
        tables: dict[tuple[int, int], list[list[int]]] = {}
        mapping: dict[int, int] = {}

        def weight(a: Node, b: Node) -> int:
            """Nodes of the largest match that keeps order and parents, 0 for different roots."""
            if a.label != b.label:
                return 0
            table = [[0] * (len(b.kids) + 1)]
            for x in a.kids:
                above, row = table[-1], [0]
                for j, y in enumerate(b.kids):
                    row.append(max(above[j + 1], row[j], above[j] + weight(x, y)))
                table.append(row)
            tables[a.at, b.at] = table
            return 1 + table[-1][-1]

        def add(b: Node) -> Node:
            made = Node(b.label, self.size)
            mapping[b.at] = made.at
            self.size += 1
            made.kids = [add(kid) for kid in b.kids]
            return made

        def unite(a: Node, b: Node) -> None:
            mapping[b.at] = a.at
            table, i, j = tables[a.at, b.at], len(a.kids), len(b.kids)
            joined: list[tuple[Node | None, Node | None]] = []
            while i or j:
                if i and table[i][j] == table[i - 1][j]:
                    i -= 1
                    joined.append((a.kids[i], None))
                elif j and table[i][j] == table[i][j - 1]:
                    j -= 1
                    joined.append((None, b.kids[j]))
                else:
                    i, j = i - 1, j - 1
                    joined.append((a.kids[i], b.kids[j]))
            kids = []
            for x, y in reversed(joined):
                if x is None:
                    kids.append(add(y))
                else:
                    kids.append(x)
                    if y is not None:
                        unite(x, y)
            a.kids = kids

        if weight(self.root, other):
            unite(self.root, other)
        return [mapping[i] for i in range(len(mapping))]
