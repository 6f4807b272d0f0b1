"""Plain counterparts of the corpus operators for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def later_windows(rows, width):
    """(doc_id, words, removed, digest) for rows with different ids."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        found, gone = words(text), set()
        for p in range(len(found) - width + 1):
            window = tuple(found[p : p + width])
            if window in seen:
                gone.update(range(p, p + width))
            seen.add(window)
        kept = [w for p, w in enumerate(found) if p not in gone]
        out.append((doc, len(found), len(gone), sha(" ".join(kept))))
    return out


def repeated_strings(rows, width):
    counts = collections.Counter()
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    for _, data in texts:
        counts.update(data[p : p + width] for p in range(len(data) - width + 1))
    out = []
    for doc, data in texts:
        gone = [False] * len(data)
        for p in range(len(data) - width + 1):
            if counts[data[p : p + width]] > 1:
                gone[p : p + width] = [True] * width
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc, len(data), sum(gone), spans, sha(kept)))
    return out


def shingles(text, size):
    found = words(lower(text))
    return {tuple(found[p : p + size]) for p in range(len(found) - size + 1)} if len(found) >= size else ({tuple(found)} if found else set())


def components(rows, size, percent):
    sets = [(doc, shingles(text, size)) for doc, text in rows]
    least = list(range(len(sets)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                least[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(sets):
        smallest[root(i)] = min(smallest.get(root(i), doc), doc)
    return [(doc, len(s), smallest[root(i)]) for i, (doc, s) in enumerate(sets)]


def edit_distance_in(item, text):
    """Fewest edits that turn the item into a substring of the text."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)
