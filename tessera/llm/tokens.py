"""Words of many texts as arrays, and blobs of sorted hashes dealt by bucket.

Operators that compare every word position of a corpus move hashes, not rows: a chunk of
documents packs its hashes for each bucket into one binary value, a bucket's task merges the
blobs of all chunks and answers each with a bit or a number for every hash sent. Chunks and
buckets have a fixed size, their number grows with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard


class Words:
    """The words of a chunk's texts: distinct ones, and for each position which one stands there."""

    def __init__(self, texts: list[bytes | None], lower: bool = False) -> None:
        words: list[bytes] = []
        counts = []
        for text in texts:
            own = ((text or b"").lower() if lower else text or b"").split()  # bytes: A-Z only, ASCII white space only
            counts.append(len(own))
            words += own
        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.distinct: list[bytes] = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts = np.array(counts, dtype=np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.distinct), dtype=np.uint64, count=len(self.distinct))

    def doc_of(self) -> np.ndarray:
        """For each position, the place of its text in the chunk."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def stirred(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each position on (shorter by width - 1)."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : n + i]
        out ^= out >> np.uint64(32)
    return stirred(out)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its upper half: sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ``sorted_hashes``; one entry more than buckets."""
    return np.searchsorted(bucket_of(sorted_hashes, buckets), np.arange(buckets + 1, dtype=np.uint64))


def packed_counts(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, compressed; the first byte tells how many."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpacked_counts(blob: bytes) -> np.ndarray:
    """What ``packed_counts`` packed, as 64-bit integers."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), dtype=f"<u{blob[0]}").astype(np.int64)
