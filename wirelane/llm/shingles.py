"""Words and shingle sets of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Odd multipliers for the places of a shingle, from a fixed seed.
_PLACES = np.random.default_rng(5).integers(1, 2**63, size=64, dtype=np.uint64) | U64(1)
#: A cache of word hashes is emptied beyond so many words.
CACHE_WORDS = 300_000


class WordHashes(dict):
    """Word bytes to a 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits each depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D, with A-Z lowered."""
    return text.lower().split()


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes; with fewer words, the whole sequence as one."""
    n = len(hashes)
    if not n:
        return hashes
    if n < width:
        whole = (hashes * _PLACES[:n]).sum(dtype=U64) + U64(n)
        return mix(np.array([whole], dtype=U64))
    total = hashes[: n - width + 1] * _PLACES[0]
    for i in range(1, width):
        total += hashes[i : n - width + 1 + i] * _PLACES[i]
    return np.unique(mix(total))


def sets(column: pa.Array | pa.ChunkedArray, width: int, cache: WordHashes) -> list[np.ndarray]:
    get = cache.__getitem__
    return [shingle_set(np.fromiter(map(get, w), U64, len(w)), width) for w in map(words, texts(column))]
