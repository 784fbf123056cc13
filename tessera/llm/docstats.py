"""Statistics of whole texts as vectors, and labelled rows to learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_STATS = 24
_LOWER, _UPPER, _DIGIT = (np.array([chr(b) in s for b in range(256)]) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
_HIGH = np.arange(256) >= 128
_END, _COMMA, _MARK = (np.array([chr(b) in s for b in range(256)]) for s in (".!?", ",;:", "#$%&*|!=<>{}[]\\^~_+@/"))
_PAIR = np.array([chr(b) in "()\"'" for b in range(256)])


def stats_of(text: str) -> np.ndarray:
    """24 numbers about one text, each of bounded size; an empty text gives zeros."""
    v = np.zeros(N_STATS)
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return v
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    w = len(words)
    lines = data.split(b"\n")
    kinds = set(words)
    share = lambda m: h[m].sum() / n
    v[:8] = [share(_LOWER), share(_UPPER), share(_DIGIT), share(_HIGH), share(_END), share(_COMMA), share(_MARK), share(_PAIR)]
    v[8:12] = [h[32] / n, h[10] / n, np.log1p(n) / 16, np.log1p(w) / 14]
    v[12] = len(kinds) / w if w else 0
    v[13] = np.log1p(n / max(w, 1)) / 4
    again = sum(map(bytes.__eq__, words, words[1:]))
    v[14] = again / max(w, 1)
    v[15] = sum(map(bytes.isupper, words)) / max(w, 1)
    v[16] = sum(not x[-1:].isalnum() and x[-1] < 128 for x in words) / max(w, 1)
    v[17] = len(set(lines)) / len(lines)
    v[18] = np.log1p(max(map(len, words), default=0)) / 8
    p = h[h > 0] / n
    v[19] = -(p * np.log2(p)).sum() / 8
    v[20] = np.log1p(max(map(len, lines))) / 12
    v[21] = min(1.0, 4 * (h[124] + h[33] + h[35] + h[36] + h[37] + h[38] + h[42]) / max(w, 1))
    v[22] = np.sqrt(v[6])
    v[23] = np.sqrt(v[14])
    return v


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>) of every whole text; null counts as empty."""

    def work(batches):
        for b in batches:
            got = np.array([stats_of(t.as_py() or "") for t in b.column(1)]).reshape(len(b.column(1)), N_STATS)
            flat = pa.array(got.ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, N_STATS), pa.int32()), flat)], names=["a", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, f"`{id_col}` {kind}, stats array<double>")


def fold(id_col: Column, n: int) -> Column:
    return F.crc32(id_col.cast("string")) % n


def bounded(labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """About ``most`` rows at the most, chosen by hash of the id; all of them where there are fewer."""
    n = labels.count()
    return labels if n <= most else labels.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * most / n))
