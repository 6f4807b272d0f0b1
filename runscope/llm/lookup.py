"""Table of 64-bit keys in numpy for models that workers hold whole."""

from __future__ import annotations

import numpy as np


class Lookup:
    """Maps distinct 64-bit keys to their position; ``find`` answers many keys at once, -1 for unknown ones.

    The keys stay as they are, in order, beside a directory that tells where those with the same upper
    bits begin; keys are expected to be well mixed, so that these are one or two. Keys that come in
    order are not copied.
    """

    def __init__(self, keys: np.ndarray) -> None:
        keys, self.place = keys.astype(np.uint64, copy=False), None
        if (keys[1:] < keys[:-1]).any():
            self.place = np.argsort(keys).astype(np.int32)
            keys = keys[self.place]
        bits = max(1, len(keys).bit_length() - 1)
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.begin = np.zeros(2**bits + 1, np.int32)
        self.begin[1:] = np.searchsorted(keys >> self.shift, np.arange(2**bits, dtype=np.uint64), "right")

    def find(self, keys: np.ndarray) -> np.ndarray:
        home = (keys >> self.shift).astype(np.int64)
        at, end = self.begin[home], self.begin[home + 1]
        out = np.full(len(keys), -1, np.int32)
        waiting = np.flatnonzero(at < end)
        while len(waiting):
            here, wanted = at[waiting], keys[waiting]
            held = self.keys[here]
            same = held == wanted
            out[waiting[same]] = here[same]
            at[waiting] = here + 1
            waiting = waiting[(held < wanted) & (here + 1 < end[waiting])]
        return out if self.place is None else np.where(out >= 0, np.append(self.place, -1)[out], -1)


def values_at(table: Lookup, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    found = table.find(keys)
    return np.where(found >= 0, np.append(values, missing)[found], missing)
