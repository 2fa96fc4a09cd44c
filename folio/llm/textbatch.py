"""Batches of texts as numpy arrays: what the operators with Python code share. Runs on executors."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)  # fixed values: the splitmix64 finaliser


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _M1
        x = (x ^ (x >> _U(27))) * _M2
        return x ^ (x >> _U(31))


def tidy(f: Callable) -> Callable:
    """f, a generator over batches; when it ends, its memory goes back to the system instead of staying with the Python worker for the stages to come."""

    def g(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return g


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for words seen lately; forgets all beyond `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8; null text has none."""
    return text.encode("utf-8", "replace").split() if text else []


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batches cut into pieces of at most most_bytes of text, or one row; the whole of every text is there."""
    for b in batches:
        start, size = 0, 0
        col = b.column(b.schema.get_field_index(text))
        lengths = [x or 0 for x in pc.binary_length(col).to_pylist()]
        for i, n in enumerate(lengths):
            if i > start and size + n > most_bytes:
                yield b.slice(start, i - start), col.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += n
        if start < b.num_rows:
            yield b.slice(start), col.slice(start).to_pylist()


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    with np.errstate(over="ignore"):
        m = min(n, k)
        h = np.full(n - m + 1, _U(m))
        for i in range(m):
            h = mix64(h * _U(0x9E3779B97F4A7C15) + hashes[i : n - m + 1 + i])
    return np.unique(h)
