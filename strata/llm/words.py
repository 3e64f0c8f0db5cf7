"""Words of texts as 64-bit hashes, and hashes of runs of words, with numpy."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Runs without white space (ASCII).
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Words whose hashes a worker remembers during a task, and their greatest length: some 20 MB.
REMEMBERED, LENGTH = 100_000, 64

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> hash, each hashed once; emptied when it has grown too large."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LENGTH:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One per worker process.
HASHES = WordHashes()


def hashes_of(words: list[str]) -> np.ndarray:
    return HASHES.of(words)


def forget() -> None:
    HASHES.clear()
    pa.default_memory_pool().release_unused()


def forgetting(run: Callable) -> Callable:
    """``run`` for mapInArrow; what a task has remembered goes at its end, as workers are used again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()

    return task


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of ``n`` words, by position; empty if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, seed, np.uint64)
    for k in range(n):
        out = (out ^ words[k : k + count]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of runs of ``n`` words, ascending; of the whole sequence if there are fewer, none if none."""
    if not len(words):
        return words
    return np.unique(run_hashes(words, min(n, len(words))))
