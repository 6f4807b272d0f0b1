import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runscope.llm.infill import Marks, arrange, as_words, fill_in_middle, first_bytes, line_feeds, rebuild, restore, transform

LETTERS = "a\n\n\r \x00\x0b\x8aéÀ漢𝄞<>PSM"


def brute(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = ("".join(part) for part in (units[:low], units[low:high], units[high:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def found_by(ids, texts, **options):
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    out = transform(ids, np.frombuffer(b"".join(raw), np.uint8), offsets, **({"seed": 7, "rate": 100, "spm": 50} | options))
    names = ("n", "form", "prefix_chars", "middle_chars")
    return [(*row, o.decode()) for *row, o in zip(*(out[k] for k in names), out["output"], strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=40), max_size=12), st.integers(0, 3))
def test_batches_like_brute_force(texts, seed):
    ids = list(range(-2, len(texts) - 2))
    for rate, spm in ((100, 50), (60, 0), (60, 100)):
        wanted = [brute(i, t, seed, rate, spm) for i, t in zip(ids, texts, strict=True)]
        assert found_by(ids, texts, seed=seed, rate=rate, spm=spm) == wanted


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_marks_rank_and_select(data):
    array = np.frombuffer(data, np.uint8)
    for marks, wanted in ((line_feeds, array == 10), (first_bytes, (array & 0xC0) != 0x80)):
        made = Marks(marks(as_words(array)))
        places = np.flatnonzero(wanted)
        assert made.select(np.arange(len(places))).tolist() == places.tolist()
        assert made.rank(np.arange(len(data) + 1)).tolist() == [int(wanted[:i].sum()) for i in range(len(data) + 1)]


@given(st.text(alphabet="<PSM>x"), st.text(alphabet="<PSM>x"), st.text(alphabet="<PSM>x"))
def test_rebuild(a, b, c):
    if not any(mark in a + b + c for mark in ("<P>", "<S>", "<M>")):
        for form in ("psm", "spm"):
            assert rebuild(form, arrange(form, a.encode(), b.encode(), c.encode())) == (a + b + c).encode()


def test_table_with_nulls_copies_and_a_very_long_text(spark, docs):
    long = "\n".join(f"línea {i}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, "\n"), (4, "a\nb"), (4, "a\nb"), (None, "x\n\ny"), (-5, "has <M> inside\n"), (7, long), (8, "x" * 70_000)]
    found = restore(fill_in_middle(docs(rows))).collect()
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found)
    assert sorted((g[:6] for g in got), key=str) == sorted(
        ((str(i), *brute(i, t)) for i, t in rows), key=str
    )
    assert sorted(g[6] for g in got) == sorted(t or "" for _, t in rows)


def test_empty_table(docs):
    assert restore(fill_in_middle(docs([]))).count() == 0


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 16])
def test_words_end_with_zeros(size):
    words = as_words(np.full(size, 255, np.uint8))
    assert words.tobytes() == b"\xff" * size + bytes(8 * len(words) - size) and 8 * len(words) >= size + 8
