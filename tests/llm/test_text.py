import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from runscope.llm.lookup import Lookup
from runscope.llm.text import LOWER, Words, buffers, slices, window_starts, windows
from tests.llm import brute


def random_texts(n, letters="abÀé漢A\t\n ,", size=40, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for _ in range(n)]


TEXTS = random_texts(200) + [None, "", "  ", "x", "\x00y z", "w" * 5000]


def test_words_are_those_of_the_pattern():
    found = Words(*buffers(pa.array(TEXTS)))
    for i, text in enumerate(TEXTS):
        mine = [bytes(found.data[found.start[k] : found.start[k] + found.length[k]]).decode() for k in range(found.first[i], found.first[i + 1])]
        assert mine == brute.words(text)


@pytest.mark.parametrize("low", [False, True])
def test_equal_words_have_equal_hashes_only(low):
    found, seen = Words(*buffers(pa.array(TEXTS))), {}
    hashes = found.hashes(lower=low)
    spelled = [w for t in TEXTS for w in brute.words(brute.lower(t) if low else t)]
    for word, value in zip(spelled, hashes.tolist(), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("width", [1, 2, 3, 8, 20])
def test_windows(width):
    values = np.random.default_rng(0).integers(0, 3, 300).astype(np.uint64)
    seen = {}
    for p, value in enumerate(windows(values, width).tolist()):
        assert seen.setdefault(tuple(values[p : p + width].tolist()), value) == value
    assert len(set(seen.values())) == len(seen)
    first = np.array([0, 5, 5, 30, 31])
    assert window_starts(first, width).tolist() == [p for a, b in zip(first, first[1:]) for p in range(a, b - width + 1)]


def test_select_joins_kept_words():
    found = Words(*buffers(pa.array(["a  bb\tccc", " d "])))
    assert found.select(np.array([True, False, True, True]), 0) == b"a ccc"
    assert found.select(np.array([True, False, True, True]), 1) == b"d"
    assert found.select(np.zeros(4, bool), 0) == b""


def test_slices_keep_all_rows_whole():
    batch = pa.record_batch([pa.array(TEXTS)], names=["text"])
    parts = list(slices(iter([batch]), "text", 100))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == TEXTS and len(parts) > 3


def test_lookup():
    keys = np.random.default_rng(1).integers(1, 2**63, 5000).astype(np.uint64)
    table = Lookup(keys)
    assert (table.find(keys) == np.arange(5000)).all()
    assert (table.find(keys + np.uint64(1)) == -1).sum() >= 4999
    assert (Lookup(keys[:0]).find(keys) == -1).all()


def test_lookup_of_keys_in_order_holds_little_beside_them():
    keys = np.unique(np.random.default_rng(1).integers(1, 2**63, 200_000).astype(np.uint64) * np.uint64(2))
    tracemalloc.start()
    table = Lookup(keys)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1.5 * keys.nbytes, held
    assert (table.find(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    ends = np.array([0, 2**64 - 1], np.uint64)
    assert (table.find(ends) == -1).all() and (Lookup(ends).find(ends) == [0, 1]).all()


def test_lower_table_only_changes_ascii_capitals():
    assert bytes(LOWER[np.frombuffer("AZaz@[é".encode(), np.uint8)]).decode() == "azaz@[é"
