"""Vectorised lookups over numpy arrays that workers may map into memory."""

from __future__ import annotations

import json

import numpy as np

_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class IntTable:
    """Integer keys (below 2**64 - 1) to the numbers 0, 1, 2, ... by open addressing; -1 if absent."""

    def __init__(self, slots: np.ndarray, keys: np.ndarray):
        self.slots, self.keys = slots, keys
        self.bits = len(slots).bit_length() - 1

    @classmethod
    def build(cls, keys: np.ndarray) -> "IntTable":
        keys = np.ascontiguousarray(keys, dtype=np.uint64)
        bits = max(4, int(len(keys) * 3).bit_length())
        slots = np.full(1 << bits, -1, dtype=np.int32)
        at = cls._home(keys, bits)
        left = np.arange(len(keys))
        while len(left):  # all keys step on together until each has a slot of its own
            free = left[slots[at[left]] < 0]
            slots[at[free][::-1]] = free[::-1]
            left = left[slots[at[left]] != left]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)
        return cls(slots, keys)

    @staticmethod
    def _home(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        at = self._home(keys, self.bits)
        got = self.slots[at]
        if not len(self.keys):
            return got
        wrong = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            got[wrong] = self.slots[at[wrong]]
            wrong = wrong[(got[wrong] >= 0) & (self.keys[got[wrong]] != keys[wrong])]
        return got


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array (values, offsets), one after the other: (values, lengths)."""
    lens = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(offsets[rows] - (ends - lens), lens)
    return values[at], lens


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Named arrays in one file, after a line of JSON that tells where each begins."""
    table, at = {}, 0
    for name, a in arrays.items():
        table[name] = {"dtype": a.dtype.str, "shape": list(a.shape), "at": at}
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(table).encode()
    start = -(-(len(head) + 1) // 64) * 64
    with open(path, "wb") as f:
        f.write(head.ljust(start - 1) + b"\n")
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    with open(path, "rb") as f:
        head = f.readline()
    out = {}
    for name, x in json.loads(head).items():
        shape = tuple(x["shape"])
        out[name] = np.memmap(path, dtype=x["dtype"], mode="r", offset=len(head) + x["at"], shape=shape) if np.prod(shape) else np.zeros(shape, x["dtype"])
    return out
