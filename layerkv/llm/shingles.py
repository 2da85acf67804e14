"""Word shingles of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes and texts that are looked at together.
BLOCK, TEXTS = 1 << 19, 1024
WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), np.uint64(base))]), dtype=np.uint64)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    return powers(BASE, BLOCK + 1), powers(pow(BASE, -1, 1 << 64), BLOCK + 1)


def hashed_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the text it belongs to; text ``i`` is ``data[cuts[i]:cuts[i + 1]]``."""
    power, back = tables() if len(data) <= BLOCK else (powers(BASE, len(data) + 1), powers(pow(BASE, -1, 1 << 64), len(data) + 1))
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts[(cuts >= 0) & (cuts <= len(data))]] = True
    before = np.concatenate([[False], word])
    starts = np.flatnonzero(word & (~before[:-1] | edge[:-1]))
    ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(byte_codes()[data] * power[: len(data)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * back[starts]), np.searchsorted(cuts, starts, "right") - 1


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, text of each word counted from the first) of runs of texts.

    A run has ``BLOCK`` bytes and ``TEXTS`` texts at most; a longer text is a run of its own and is hashed in
    parts that are cut at white space. Nulls are empty texts.
    """
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = min(at + TEXTS, max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, "right")) - 1))
        low, high = int(bounds[at]), int(bounds[end])
        if high - low <= BLOCK:
            yield at, *hashed_words(data[low:high], bounds[at : end + 1] - low)
        else:
            found = []
            while low < high:
                stop = min(high, low + BLOCK)
                if stop < high:
                    spaces = np.flatnonzero(_SPACE[data[low:stop]])
                    if len(spaces):
                        stop = low + int(spaces[-1]) + 1
                    else:
                        while stop < high and not _SPACE[data[stop]]:
                            stop += 1
                found.append(hashed_words(data[low:stop], np.array([0, stop - low]))[0])
                low = stop
            words = np.concatenate(found)
            yield at, words, np.zeros(len(words), np.int64)
        at = end


def shingled(words: np.ndarray, text: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words and its text; a text with fewer words is one shingle."""
    k = np.uint64(BASE)
    sums = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        sums = sums * k + words[i : len(words) - n + 1 + i]
    inside = text[: len(sums)] == text[n - 1 :]
    sums, owner = mix(sums[inside]), text[: len(inside)][inside]
    count = np.bincount(text, minlength=int(text[-1]) + 1) if len(text) else np.zeros(0, int)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(text, short)
        few = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = count[short] > i
            few[has] = few[has] * k + words[first[has] + i]
        sums, owner = np.concatenate([sums, mix(few + np.uint64(1))]), np.concatenate([owner, short])
    return sums, owner
