"""Words of texts as 64-bit hashes, and hashes of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers by place, for hashes of several words: a rule, not a table.
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def multiplier(i: int) -> np.uint64:
    x = (i + 1) * _GOLDEN & _MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return np.uint64((x ^ x >> 31) | 1)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, seeded: any two seeds give unrelated hashes of the same numbers."""
    x = x + np.uint64((seed + 1) * _GOLDEN & _MASK)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class WordHashes(dict):
    """bytes -> hash, remembered; begun anew when it holds too many."""

    def __init__(self, most: int = 300_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


hashes = WordHashes()
#: What a worker remembers for longer than a task; modules add theirs.
remembered: list[dict] = [hashes]


def forget() -> None:
    """At a task's start and end: a worker serves other tasks and stages, and what it remembers for one kind, or holds without use, would stay beside theirs."""
    for x in remembered:
        x.clear()
    pa.default_memory_pool().release_unused()


def windows(ids: np.ndarray, offsets: range | list[int]) -> np.ndarray:
    """Hash of the words at these offsets from each place; fewer places than words by the last offset."""
    n = len(ids) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, at in enumerate(offsets):
        total += ids[at : at + n] * multiplier(j)
    return mixed(total)


def repeated_words(ids: np.ndarray, size: int = 8) -> int:
    """Words in runs of `size` words that stand in the text twice or more, the first included. Runs with equal hashes are compared word by word."""
    h = windows(ids, range(size))
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    equal = np.ones(len(same), bool)
    for k in range(size):
        equal &= ids[a + k] == ids[b + k]
    marks = np.zeros(len(ids) + 1, np.int64)
    starts = np.zeros(len(ids), bool)
    starts[a[equal]] = starts[b[equal]] = True
    at = np.flatnonzero(starts)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + size, -1)
    return int((np.cumsum(marks) > 0).sum())


def count_of(data: bytes, characters: bytes) -> int:
    return len(data) - len(data.translate(None, characters))
