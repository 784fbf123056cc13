"""Near-duplicate vectors by spherical-cap filters (Becker, Ducas, Gama and Laarhoven, 2016).

Filters are directions of a random product code: the space is turned at random and cut into
two halves, each with its own list of random directions, and every pair of one from either
list is a filter. A vector is decoded to all filters whose inner product exceeds a threshold,
and to its best ones where fewer do; the sorted halves give them without looking at all pairs.
Vectors that share a filter are compared in blocks, in double precision. A pair counts in the first filter that it shares,
and blocks give counts and edges that span their components, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import release, save

COSINE, LEAST, BUCKET, BLOCK, SEED = 0.93, 28, 40, 1024, 3


def code_size(n: int) -> int:
    """Directions in each half, so that a filter holds about BUCKET of ``n`` vectors."""
    return int(max(24, np.ceil(np.sqrt(n * LEAST / BUCKET))))


def product_code(dim: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + dim)
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    a, b = dim - dim // 2, dim // 2
    lists = [rng.normal(size=(size, k)) for k in (a, b)]
    return turn, *(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) / np.sqrt(2) if x.shape[1] else np.zeros((1, 0)) for x in lists)


def threshold(dim: int, size: int) -> float:
    """The value that a random vector exceeds for LEAST of the filters on average, from a normal law."""
    return NormalDist(0, 1 / np.sqrt(dim)).inv_cdf(1 - min(0.5, LEAST / size**2))


def decode(s1: np.ndarray, s2: np.ndarray, alpha: float) -> np.ndarray:
    """Sorted numbers of the filters whose value s1[i] + s2[j] reaches ``alpha``, or the LEAST best if fewer do.

    The second half is sorted, so each direction of the first half takes a beginning of it, and no pair below ``alpha`` is looked at.
    """
    order = np.argsort(-s2, kind="stable")
    rows = np.flatnonzero(s1 >= alpha - s2[order[0]])
    n = np.searchsorted(-s2[order], s1[rows] - alpha, side="right")
    total = int(n.sum())
    if total >= LEAST or total == len(s1) * len(s2):
        step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        return np.sort(np.repeat(rows, n) * len(s2) + order[step])
    k = min(LEAST, len(s1) * len(s2))
    top1, top2 = np.argsort(-s1, kind="stable")[:k], order[:k]  # the k best pairs are among these
    both = (s1[top1, None] + s2[None, top2]).ravel()
    best = np.argsort(-both, kind="stable")[:k]
    return np.sort(top1[best // len(top2)] * len(s2) + top2[best % len(top2)])


def usable(v: str) -> Column:
    """Not null, not zero, and every component a finite number."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(v).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def first_shared(links: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], f: int) -> np.ndarray:
    """``links`` (left by right) without the pairs that share a filter below ``f``, in which they are seen already."""
    i, j = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if not len(i):
        return links
    below = [x[: np.searchsorted(x, f)] for x in left], [x[: np.searchsorted(x, f)] for x in right]
    names = np.intersect1d(np.concatenate([below[0][k] for k in i]), np.concatenate([below[1][k] for k in j]))
    if not len(names):
        return links
    held = []
    for own, rows in zip(below, (i, j)):
        m = np.zeros((len(rows), len(names)), np.float32)
        for r, k in enumerate(rows):
            m[r, np.searchsorted(names, own[k][np.isin(own[k], names)])] = 1
        held.append(m)
    out = links.copy()
    out[np.ix_(i, j)] &= held[0] @ held[1].T == 0
    return out


def spanning(links: np.ndarray) -> np.ndarray:
    """For each of the left and right rows of ``links`` (one after the other) the place of the first one in its component."""
    n = sum(links.shape)
    label = np.arange(n)
    i, j = np.nonzero(links)
    j = j + links.shape[0]
    while len(i):
        old = label.copy()
        np.minimum.at(label, i, old[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == old).all():
            break
    return label


def compared(reps: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """``reps`` (rep, label, v, copies), all different and usable -> counts (rep, n) and edges (a, b).

    n are the copies of the others of a label with a cosine of ``cosine`` or more, in parts to be summed; edges leave the
    components of all linked pairs. A task gives at most one row of either kind for each vector of a block,
    so no pairs are written, however large a group of near copies is.
    """
    spark = reps.sparkSession
    sizes = reps.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    code = spark.sparkContext.broadcast({r.dim: code_size(r.n) for r in sizes})

    def filters(batches):
        codes: dict[int, tuple] = {}
        for b in batches:
            out: list = [None] * b.num_rows
            v = b.column(1)
            dims = np.diff(v.offsets.to_numpy())
            for d in np.unique(dims).tolist():
                if d not in codes:
                    size = code.value[d]
                    turn, c1, c2 = product_code(d, size)
                    codes[d] = (turn, c1, c2, d - d // 2, threshold(d, size))
                turn, c1, c2, a, alpha = codes[d]
                at = np.flatnonzero(dims == d)
                for lo in range(0, len(at), 256):
                    x = np.stack([v[i].values.to_numpy(zero_copy_only=False) for i in at[lo : lo + 256].tolist()]).astype(float)
                    y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn
                    for i, s1, s2 in zip(at[lo : lo + 256].tolist(), y[:, :a] @ c1.T, y[:, a:] @ c2.T):
                        out[i] = decode(s1, s2, alpha)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 2, 1, 3)), pa.array(out, pa.list_(pa.int64()))], names=["rep", "label", "v", "copies", "fs"])

    kind, vec = (reps.schema[c].dataType.simpleString() for c in ("label", "v"))
    held = save(reps.select("rep", "v", "label", "copies").mapInArrow(filters, f"rep bigint, label {kind}, v {vec}, copies bigint, fs array<bigint>"))
    blocks = held.select("label", F.explode("fs").alias("f")).groupBy("label", "f").agg(F.count("*").alias("m")).where("m > 1").select("label", "f", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    own = held.select("rep", "label", F.explode("fs").alias("f")).join(blocks, ["label", "f"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    # a large bucket is cut into blocks; each pair of blocks meets in a cell of its own
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("rep", "f", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")
    rows = cells.join(held, "rep").select("label", "f", "lo", "hi", (F.col("mine") != F.col("lo")).alias("right"), "rep", "copies", "v", "fs").repartition("label", "f", "lo", "hi").sortWithinPartitions("label", "f", "lo", "hi")

    def compare(batches):
        def links(key: tuple, part: list) -> Iterator[tuple]:
            two = key[2] != key[3]
            for d in {len(x[3]) for x in part}:
                same = [x for x in part if len(x[3]) == d]
                sides = [[x for x in same if x[0] == side] for side in (False, True)] if two else [same, same]
                if not all(sides):
                    continue
                x, y = (np.array([r[3] for r in s], float) for s in sides)
                x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
                found = x @ y.T >= cosine
                if not two:
                    np.fill_diagonal(found, False)
                if not found.any():
                    continue
                ids = np.array([r[1] for s in sides for r in s])
                label = spanning(found)
                yield ids, np.zeros(len(ids), np.int64), ids[label]
                found = first_shared(found, *([r[4] for r in s] for s in sides), key[1])
                copies = [np.array([r[2] for r in s]) for s in sides]
                yield ids[: len(x)], found @ copies[1], ids[: len(x)]
                if two:
                    yield ids[len(x) :], found.T @ copies[0], ids[len(x) :]

        def made(parts: list[tuple]) -> pa.RecordBatch:
            a, n, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ([], [], [])))
            keep = (n > 0) | (a != b)
            return pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (a, n, b)], names=["a", "n", "b"])

        key, part = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            v, fs, out = batch.column(7), batch.column(8), []
            for i, now in enumerate(zip(*cols[:4])):
                if now != key:
                    if len(part) > 1:
                        out += links(key, part)
                    key, part = now, []
                part.append((cols[4][i], cols[5][i], cols[6][i], v[i].values.to_numpy(zero_copy_only=False), fs[i].values.to_numpy()))
            if out:
                yield made(out)
        if len(part) > 1:
            yield made(list(links(key, part)))

    got = save(rows.mapInArrow(compare, "a bigint, n bigint, b bigint"))
    return got.where("n > 0").select(F.col("a").alias("rep"), "n"), got.where("a <> b").select("a", "b")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: n_links counts the other vectors of the label with a cosine
    of ``cosine`` or more, component_id is the smallest id reached by links, kept marks the rows that have that id.

    Rows with a null id or label, or a vector that is null, empty, zero or not finite throughout, link with
    nothing. Equal vectors of a label are compared once and count as often as they occur. Rows that repeat an id,
    under one label or several, with one vector or several, are vectors of their own. Vectors of different lengths do
    not link. Other columns are ignored.
    """
    kind = "float" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "double"
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"), F.col(label_col).alias("label"))
    fit = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & usable("v"), F.lit(False))
    keyed = own.where(fit).select("id", "label", "v", F.sha2(F.to_json("v"), 256).alias("k"))
    # a class of equal vectors is known by 64 bits of the hash of its label and vector
    classes = save(keyed.groupBy("label", "k").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.any_value("v").alias("v")).withColumn("rep", F.xxhash64("label", "k")))
    counts, edges = compared(classes.select("rep", "label", "v", "copies"), cosine)
    comp = save(connected_components(edges).withColumnRenamed("id", "rep"))
    release(vectors.sparkSession)
    least = classes.join(comp, "rep").groupBy("component").agg(F.min("first").alias("least"))
    n = counts.groupBy("rep").agg(F.sum("n").alias("others"))
    of = classes.join(n, "rep", "left").join(comp.join(least, "component").select("rep", "least"), "rep", "left")
    of = of.select("label", "k", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    linked = keyed.select("id", "label", "k").join(of, ["label", "k"]).select("id", "n_links", "component_id")
    alone = own.where(~fit).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
