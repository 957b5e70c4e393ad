"""Vocabulary files and cached encoding of repeated pieces."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import words as w


def path(name: str) -> str:
    """Where the installed public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def ranks(file: str) -> dict[bytes, int]:
    """The tokens of a .tiktoken file."""
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Ragged:
    """A list of int32 arrays: values end to end, and their bounds."""

    def __init__(self, parts: list[bytes]):
        self.values = np.frombuffer(b"".join(parts), np.int32)
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])

    @classmethod
    def of(cls, values: np.ndarray, bounds: np.ndarray) -> Ragged:
        out = cls([])
        out.values, out.bounds, out.sizes = values, bounds, np.diff(bounds)
        return out

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the arrays `at` end to end, and the size of each."""
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(self.bounds), pa.array(self.values))
        return lists.take(pa.array(at)).flatten().to_numpy(), self.sizes[at]


class Cached:
    """encode(piece) -> ids, as bytes of int32, for many pieces, most of which come again.

    Remembers between `limit` and twice as many pieces: those seen since the last but one time the newer half was full.
    """

    def __init__(self, encode: Callable[[bytes], bytes], limit: int = 120_000):
        self.encode, self.limit, self.new, self.old = encode, limit, {}, {}

    def __call__(self, pieces: list[bytes]) -> Ragged:
        out = list(map(self.new.get, pieces))
        for i, ids in enumerate(out):
            if ids is None:
                p = pieces[i]
                ids = self.old.get(p)
                if ids is None:
                    ids = self.encode(p)
                if len(p) <= 64:
                    if len(self.new) >= self.limit:
                        self.old, self.new = self.new, {}
                    self.new[p] = ids
                out[i] = ids
        return Ragged(out)


class Remembered:
    """Ids of strings met before, by 128-bit hashes, as arrays (about 50 bytes a string); the least recently met go when there are more than `limit`."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.now, self.ids = limit, 0, Ragged([])
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.row, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The row of each string in `ids`, -1 where it isn't known."""
        self.now += 1
        if not len(self.one):
            return np.full(len(one), -1, np.int64)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        row = np.where((self.one[at] == one) & (self.two[at] == two), self.row[at], -1)
        self.met[row[row >= 0]] = self.now
        return row

    def add(self, one: np.ndarray, two: np.ndarray, ids: Ragged) -> None:
        """Strings that find() didn't know, in ascending order of `one`."""
        at, row = np.searchsorted(self.one, one), np.arange(len(one)) + len(self.met)
        self.one, self.two, self.row = np.insert(self.one, at, one), np.insert(self.two, at, two), np.insert(self.row, at, row)
        self.met = np.append(self.met, np.full(len(one), self.now))
        self.ids = Ragged.of(np.append(self.ids.values, ids.values), np.append(self.ids.bounds, self.ids.bounds[-1] + ids.bounds[1:]))
        if len(self.met) > self.limit:
            keep = self.met > np.partition(self.met, -(self.limit // 2))[-(self.limit // 2)]
            values, sizes = self.ids.take(np.flatnonzero(keep))
            self.ids, left = Ragged.of(values, np.concatenate([[0], np.cumsum(sizes)])), keep[self.row]
            self.one, self.two, self.row = self.one[left], self.two[left], (np.cumsum(keep) - 1)[self.row[left]]
            self.met = self.met[keep]


def alike(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct byte string among data[bounds[i]:bounds[i + 1]] comes first, its two hashes (ascending), and the index of each string."""
    starts, ends = bounds[:-1], bounds[1:]
    one, two = (w.word_hashes(data, starts, ends, seed) for seed in (0, 1))
    _, first, at = np.unique(one, return_index=True, return_inverse=True)
    if (two[first][at] != two).any():
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])])
        first, at = order[new], np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
    return first, one[first], two[first], at


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings among data[bounds[i]:bounds[i + 1]], and the index of each. Told apart by 128-bit hashes."""
    if len(bounds) < 2:
        return [], np.zeros(0, np.int64)
    first, _, _, at = alike(data, bounds)
    return strings(data, bounds[:-1][first], bounds[1:][first]), at
