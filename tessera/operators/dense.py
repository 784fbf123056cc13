"""Dense vectors: hashing embeddings, norms and exact top-k."""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..functions.wordcounts import Numbers, lots

QUERY_BLOCK, PLACES = 4096, 500_000
QUERY_PREFIX = "Instruct: find the passage that answers the question\nQuery: "


def hash_embeddings(texts: DataFrame, dim: int = 64, prefix: str = "", id_col: str = "doc_id") -> DataFrame:
    """(id, embedding array<double>): signed feature hashing of all tokens, of length 1.

    The deterministic stand-in for an embedding model; ``prefix`` goes before queries. A text without
    tokens gets zeros, a null text counts as empty. Each row is worked out where it lies, nothing is shuffled.
    """
    find = re.compile(TOKEN).findall

    def work(batches):
        words, at, sign = Numbers(), array("q"), array("d")
        for b in batches:
            for rows in lots(b.column(1)):
                some = pa.array(rows)
                doc, word, n = words.counts([find(prefix + (x or "")) for x in b.column(1).take(some).to_pylist()])
                for w in islice(words, len(at), None):
                    h = int(hashlib.md5(w.lower().encode()).hexdigest()[:12], 16)
                    at.append(h % dim)
                    sign.append(-1 if h >> 40 & 1 else 1)
                out = np.bincount(doc * dim + np.array(at, np.int64)[word], np.array(sign)[word] * n, len(rows) * dim).reshape(-1, dim).astype(float)
                norm = np.sqrt((out * out).sum(1, keepdims=True))
                np.divide(out, norm, out=out, where=norm > 0)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([b.column(0).take(some), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], names=["id", "embedding"])
                if len(words) >= PLACES:
                    words, at, sign = Numbers(), array("q"), array("d")

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, "text").mapInArrow(work, f"`{id_col}` {kind}, embedding array<double>")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, rounded to nine digits; ties go to the smaller id."""
    s = np.round(scores, 9)
    if len(s) > k:
        some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        return some[np.lexsort((ids[some], -s[some]))[:k]]
    return np.lexsort((ids, -s))


def _block_hits(vectors: DataFrame, block: list, k: int) -> DataFrame:
    """(query_id, id, score): the k best of each task for each query of a block, by products of matrices. Where ``vectors`` have a
    label, each query's list (null: all, else what it holds) masks the products before the ranking."""
    masked = "label" in vectors.columns
    lists = [None if not masked or r.acl is None else frozenset(r.acl) for r in block]
    kept = vectors.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in block]), np.array([r.q for r in block], float), lists))

    def work(batches):
        names, q, lists = kept.value
        top = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            if masked:
                labels = b.column(2).to_pylist()
                each = {x: i for i, x in enumerate(dict.fromkeys(labels))}
                may = np.array([[own is None or (x is not None and x in own) for x in each] for own in lists])[:, [each[x] for x in labels]]
            for i, s in enumerate(q @ x.T):
                here = ids
                if masked:
                    s, here = s[may[i]], ids[may[i]]
                s, n = np.concatenate([top[i][0], s]), np.concatenate([top[i][1], here])
                at = best(s, n, k)
                top[i] = s[at], n[at]
        n = [len(s) for s, _ in top]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(np.concatenate([x for _, x in top])), pa.array(np.concatenate([s for s, _ in top]))], names=["query_id", "id", "score"])

    return vectors.select(F.col("id").cast("long").alias("id"), "v", *(["label"] if masked else [])).mapInArrow(work, "query_id bigint, id bigint, score double")


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine of unit vectors; ties go to the smaller id.

    ``vectors`` (id, v), ``queries`` (query_id, q); null vectors have no place in either. Queries go to all executors
    in blocks of ``QUERY_BLOCK``, of which each meets all vectors in one pass, and each task keeps its own k best.
    With a column ``label`` in ``vectors`` and an array ``acl`` in ``queries`` a query sees the labels of its list alone: a null list
    does not restrict, an empty one allows nothing, and a null label is in no list.
    """
    masked = "acl" in queries.columns
    queries = queries.where("q is not null").select(F.col("query_id").cast("long").alias("query_id"), "q", *(["acl"] if masked else []))
    vectors = vectors.where("v is not null").select("id", "v", *(["label"] if masked else []))
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    scored = None
    for i in range(n):
        block = (queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).collect()
        hits = _block_hits(vectors, block, k) if block else vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double")
        scored = hits if scored is None else scored.union(hits)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
