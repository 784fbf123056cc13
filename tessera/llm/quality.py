"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Cosines of random projections of document statistics approximate a Gaussian kernel
(Rahimi and Recht, 2007). Each partition sums its part of the normal equations, the sums
are added up and solved once, and pooled adjacent violators turn ridge scores into
probabilities. Labels come from at most ``fit_rows`` labelled documents, chosen by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .docstats import N_STATS, bounded, with_stats
from .scratch import save

FIT_ROWS, FEATURES, GAMMA, RIDGE, BINS, SEED = 100_000, 192, 1.0, 1e-3, 200, 20


def features(x: np.ndarray, model: dict) -> np.ndarray:
    z = (x - model["mean"]) / model["std"]
    f = np.cos(z @ model["w"] + model["b"]) * np.sqrt(2 / FEATURES)
    return np.hstack([f, z, np.ones((len(x), 1))])


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: ascending scores and a value for each that never falls."""
    o = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v, w in zip(score[o], y[o], weight[o]):
        pools.append([v, w, s, s])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, _, hi = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + v2 * w2) / (p[1] + w2), p[1] + w2, hi
    xs = [x for p in pools for x in (p[2], p[3])]
    ys = [p[0] for p in pools for _ in (0, 1)]
    return np.array(xs), np.array(ys)


def fit(stats: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> dict:
    """Learn from ``labels`` (id, label 0/1) joined with ``stats``; without labelled rows the score is a constant 0.5.

    Rows whose id hashes to 0 mod 4 calibrate, the others fit. Null labels are left out; an id that
    is labelled more than once counts as often.
    """
    rng = np.random.default_rng(SEED)
    model = {"w": rng.normal(size=(N_STATS, FEATURES)) * np.sqrt(2 * GAMMA / N_STATS), "b": rng.uniform(0, 2 * np.pi, FEATURES), "mean": np.zeros(N_STATS), "std": np.ones(N_STATS), "beta": None, "x": np.zeros(1), "y": np.full(1, 0.5)}
    rows = bounded(labels.select(id_col, F.col(label).cast("double").alias("y")).where("y is not null"), fit_rows, id_col)
    rows = stats.join(rows, id_col).select("stats", "y", (F.pmod(F.xxhash64(id_col), F.lit(4)) == 0).alias("calibrate"))
    rows = save(rows.coalesce(16))

    def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS), b.column(1).to_numpy(zero_copy_only=False)

    def moments(batches):
        s = np.zeros(2 * N_STATS + 1)
        for b in batches:
            x, _ = arrays(b)
            s += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([s.tolist()])], names=["s"])

    got = [np.array(r.s) for r in rows.select("stats", "y").mapInArrow(moments, "s array<double>").collect()]
    total = sum(got) if got else np.zeros(2 * N_STATS + 1)
    if not (n := total[-1]):
        return model
    model["mean"] = total[:N_STATS] / n
    model["std"] = np.sqrt(np.maximum(total[N_STATS:-1] / n - model["mean"] ** 2, 1e-6))

    def normal(batches):
        d = FEATURES + N_STATS + 1
        a, c = np.zeros((d, d)), np.zeros(d)
        for b in batches:
            x, y = arrays(b)
            f = features(x, model)
            a += f.T @ f
            c += f.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([c.tobytes()])], names=["a", "c"])

    d = FEATURES + N_STATS + 1
    a, c = RIDGE * n * np.eye(d), np.zeros(d)
    a[-1, -1] = 1e-9
    for r in rows.where("not calibrate").select("stats", "y").mapInArrow(normal, "a binary, c binary").toLocalIterator():
        a += np.frombuffer(r.a).reshape(d, d)
        c += np.frombuffer(r.c)
    model["beta"] = np.linalg.solve(a, c)

    def binned(batches):
        for b in batches:
            x, y = arrays(b)
            s = np.clip(features(x, model) @ model["beta"], -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(s * BINS).astype(np.int64)), pa.array(y)], names=["bin", "y"])

    cal = rows.where("calibrate").select("stats", "y").mapInArrow(binned, "bin bigint, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("w")).toPandas()
    if len(cal):
        model["x"], model["y"] = isotonic(cal["bin"].to_numpy() / BINS, cal["y"].to_numpy(), cal["w"].to_numpy().astype(float))
    return model


def predict(stats: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id, score): calibrated probability, with a thousandth of the raw score to order ties."""
    kept = stats.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = kept.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
            raw = np.clip(features(x, m) @ m["beta"], -1, 2) if m["beta"] is not None else np.full(len(x), 0.5)
            s = 0.998 * np.interp(raw, m["x"], m["y"]) + 0.002 * (raw + 1) / 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(s, 0.0, 1.0))], names=["a", "b"])

    kind = stats.schema[id_col].dataType.simpleString()
    return stats.select(id_col, "stats").mapInArrow(work, f"`{id_col}` {kind}, score double")


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    ``held_out`` is a boolean column over doc_id; labels of such rows are never read. Null and empty
    texts get the score of zero statistics; repeated rows a row each; other columns are ignored.
    """
    stats = with_stats(docs)
    model = fit(stats, labels.where(~held_out), label, fit_rows=fit_rows)
    out = predict(stats, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
