"""Content-selected positions: minimisers of all windows of consecutive words."""

from __future__ import annotations

import numpy as np

from . import words as w

#: A place and the upper bits of its k-gram's hash share 64 bits; longer word sequences are taken in parts.
MOST_WORDS = (1 << 28) - 1


def minimisers(hashes: np.ndarray, counts: np.ndarray, window: int, k: int, most: int = MOST_WORDS) -> tuple[np.ndarray, ...]:
    """Segments of a block of texts, which are runs of windows with the same minimiser: text index, first window start, last
    window start, minimiser position, k-grams.

    The minimiser of a window is the leftmost least of its k-grams, so equal windows have it at equal offsets, whatever
    surrounds them. Positions count words from the block's start. Of more than `most` words, segments end at multiples of it too.
    """
    gram = w.grams(hashes, k)
    edges = np.concatenate([[0], np.cumsum(counts)])
    step, parts = most - window, []
    for low in range(0, max(1, len(hashes) - window + 1), step):
        high = min(low + step + window - 1, len(hashes))
        found = _minimisers(gram[low : max(low, high - k + 1)], np.diff(np.clip(edges, low, high)), high - low, window, k)
        parts.append([found[0], *(x + low for x in found[1:])])
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), gram


def _minimisers(gram: np.ndarray, counts: np.ndarray, n: int, window: int, k: int) -> tuple[np.ndarray, ...]:
    place, width, empty = np.uint64(MOST_WORDS), window - k + 1, np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty
    low = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    at = (low[: n - window + 1] & place).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(n - window + 1)
    fits = text[: n - window + 1] == text[window - 1 :]
    start, at, text = start[fits], at[fits], text[: n - window + 1][fits]
    if not len(start):
        return empty, empty, empty, empty
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    return text[new], start[new], start[np.concatenate([new[1:], [len(start)]]) - 1], at[new]


def ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many places each: the row of every place, and its number in the row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
