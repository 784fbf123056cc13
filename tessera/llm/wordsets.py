"""Sets of five-word shingles of whole texts, hashed in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WIDTH, CACHE = 5, 1_000_000
#: Longs of a sketch.
SKETCH = 16
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words; forgets all of them when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the runs of five words; A-Z are lower-cased and words end at
    ASCII white space. Fewer words count as one run; no words give an empty array."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b"\n".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    s = h[: n - WIDTH + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, WIDTH):
            s = s * _P + h[k : n - WIDTH + 1 + k]
        s = (s ^ (s >> np.uint64(29))) * _M
    return np.unique(s ^ (s >> np.uint64(32)))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    d = xxhash.xxh128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def sketch(s: np.ndarray) -> np.ndarray:
    """Whether the number of hashes that fall to each of 64 * ``SKETCH`` places is odd, as longs. Sets' sketches differ in
    as many bits as the sets differ in hashes, at most."""
    odd = np.bincount((s % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def keys(eighths: int):
    """(id, text) -> id, n, k1, k2, part: the set's size and key, and those of its hashes that fall into ``eighths`` eighths of all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows, parts = [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), hashes)
                rows.append((len(s), *set_key(s)))
                parts.append(s[(s & np.uint64(7)) < eighths].view(np.int64))
            c = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in c), pa.array(parts, pa.list_(pa.int64()))], names=list("abcde"))

    return work


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, k1, n, s array<bigint>, sketch array<bigint>."""
    hashes = WordHashes()
    for b in batches:
        got = [shingle_set(t.as_py(), hashes) for t in b.column(1)]
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_key(s)[0] for s in got], pa.int64()), pa.array([len(s) for s in got], pa.int64()), pa.array([s.view(np.int64) for s in got], longs), pa.array([sketch(s) for s in got], longs)], names=list("abcde"))
