"""Vectorised words and word hashes of Arrow text columns.

A word is a run of `[^\\x20\\x09-\\x0D]`. Hashes go through a bijective mixer after every eight bytes and wherever two
runs of words are put together, so none is a linear function of its parts. Nulls count as empty texts.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Words of more bytes are hashed one by one.
LONG = 256
MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finisher (the splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes of text, or of one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, bounds = buffer(batch.column(text))
        at = 0
        while at < n:
            to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to
    released()


def released() -> None:
    """Give freed memory back: workers wait for their next task beside others that need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the texts' bounds in them."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def only(values: pa.Array, where: np.ndarray) -> pa.Array:
    """The values where `where` holds, null elsewhere."""
    return values.take(pa.array(np.arange(len(values)), mask=~where))


def spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many each text has."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
    word = ~SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, bounds)
    return starts, ends, np.diff(at)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes at a time, mixed in between. Seeds give independent hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]).data, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(BASES[seed % 3] * (2 * seed + 1) % (1 << 64)))
    rows, at, left = slice(None), starts, size
    while True:
        out[rows] = mix((out[rows] ^ (lanes[at] & MASKS[np.minimum(left, 8)])) * np.uint64(BASES[0]))
        more = (left > 8) & (left <= LONG) if isinstance(rows, slice) else left > 8
        if not more.any():
            break
        rows = np.flatnonzero(more) if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].data, digest_size=8, salt=bytes([seed]))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def combined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of the runs that are `first` followed by `second`, from the hashes of both."""
    return mix(first * np.uint64(BASES[1]) + second * np.uint64(BASES[2]))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, put together from runs of 1, 2, 4, ... words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, size = None, 0, hashes, 1
    while True:
        if k & size:
            part = run[done : done + n]
            out = part if out is None else combined(out, part)
            done += size
        if size * 2 > k:
            return out
        run, size = combined(run[:-size], run[size:]), size * 2
