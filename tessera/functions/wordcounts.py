"""Words of many texts at once, as arrays, for steps that run in tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into words at once.
LOT_BYTES = 4_000_000


class Numbers(dict):
    """Numbers from 0 in the order of first sight."""

    def __missing__(self, x):
        n = self[x] = len(self)
        return n

    def counts(self, words: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, number of the word, how often) from each document's words, in the order of document and number."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, size.sum())
        most = max(1, len(self))
        key = np.sort(np.repeat(np.arange(len(words)), size) * most + word)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first] // most, key[first] % most, np.diff(first, append=len(key))


def lots(texts: pa.Array) -> Iterator[np.ndarray]:
    """Rows of texts, in order, in lots of about ``LOT_BYTES``, so that memory is bounded whatever a batch holds."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lot = (np.cumsum(size) - size) // LOT_BYTES
    return iter(np.split(np.arange(len(size)), np.flatnonzero(np.diff(lot)) + 1)) if len(size) else iter(())
