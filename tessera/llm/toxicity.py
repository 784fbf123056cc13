"""Toxic spans by a linear-chain conditional random field.

Two labels run along the words of a text. A word's evidence is the sum of weights of its
form, beginnings and ending, hashed into one table; a transition table links neighbours.
Forward-backward marginals of the toxic label give spans with offsets. Their sum, their mean
and their maximum make the document's score by a logistic curve fitted to document labels.

Tokens to learn from are labelled by distant supervision: in documents labelled toxic, the
words one of whose features is tied to toxic documents by a log-likelihood ratio test; all
other words are clean. The sample is bounded: ``COUNT_ROWS`` documents for the test and
``FIT_ROWS`` for the weights, each per label, chosen by hash of the id.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT_ROWS, FIT_ROWS, EPOCHS, BITS, CACHE, BLOCK = 2500, 250, 50, 20, 300_000, 250_000
WORD = re.compile(r"\w+")


def hashed(word: str) -> list[int]:
    """Table places of a word's features; short words lack the longer beginnings."""
    w = word.lower()
    feats = ["w" + w] + [f"{k}{w[:k]}" for k in (4, 5, 6) if len(w) > k] + (["s" + w[-4:]] if len(w) > 4 else [])
    return [zlib.crc32(f.encode("utf-8", "replace")) & ((1 << BITS) - 1) for f in feats]


def _softplus_ratio(a: np.ndarray, n0: float, n1: float, d0: float, d1: float) -> np.ndarray:
    """log((e^n0 + e^(a+n1)) / (e^d0 + e^(a+d1)))"""
    return np.logaddexp(n0, a + n1) - np.logaddexp(d0, a + d1)


class Chain:
    """Sums over all labelings of many sequences at once, laid end to end.

    The message maps are contractions, so all positions are updated together until none moves; the
    result is that of the recursion from left to right, to within 1e-9.
    """

    def __init__(self, begins: np.ndarray):
        self.begins = begins  # True at the first word of each sequence
        self.ends = np.append(begins[1:], True) if len(begins) else begins
        self.alpha = self.beta = None

    def messages(self, u: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
        (t00, t01), (t10, t11) = trans
        a = np.array(u) if self.alpha is None else self.alpha
        while len(u):
            new = u + np.concatenate([[start], _softplus_ratio(a[:-1], t01, t11, t00, t10)])
            new[self.begins] = u[self.begins] + start
            moved, a = np.abs(new - a).max(), new
            if moved < 1e-9:
                break
        b = np.zeros(len(u)) if self.beta is None else self.beta
        while len(u):
            new = np.concatenate([_softplus_ratio(u[1:] + b[1:], t10, t11, t00, t01), [0.0]])
            new[self.ends] = 0.0
            moved, b = np.abs(new - b).max(), new
            if moved < 1e-9:
                break
        self.alpha, self.beta = a, b
        return a, b


def marginals(u: np.ndarray, begins: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    a, b = Chain(begins).messages(u, trans, start)
    return 1 / (1 + np.exp(-np.clip(a + b, -500, 500)))


def summaries(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Four numbers for each sequence ``p[at[i]:at[i + 1]]`` of marginals; zeros for an empty one."""
    n = np.diff(at)
    sums = np.diff(np.concatenate([[0.0], np.cumsum(p)])[at])
    top = np.zeros(len(n))
    if len(p):
        top[n > 0] = np.maximum.reduceat(p, at[:-1][n > 0])
    return np.stack([np.log1p(np.maximum(sums, 0)), np.minimum(50 * sums / np.maximum(n, 20), 3), np.log(top + 1e-4) / 4 + 2, np.ones(len(n))], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * beta)
    return beta


def learn(texts: list[str], toxic: list[int]) -> dict:
    """Weights from a bounded sample; without documents of both labels, every word counts as clean."""
    model = {"theta": np.zeros(1 << BITS), "bias": -8.0, "trans": np.zeros((2, 2)), "start": 0.0, "doc": np.array([1.0, 1.0, 1.0, -4.0])}
    n = [toxic.count(0), toxic.count(1)]
    if not all(n):
        return model
    counts = np.zeros((2, 1 << BITS))
    runs: set[int] = set()
    fresh = []
    for text, y in zip(texts, toxic):
        own = WORD.findall(text)
        some = {h for x in zip(own, own[1:], own[2:]) if not (h := zlib.crc32("|".join(x).encode("utf-8", "replace"))) & 7}
        fresh.append(not some or 3 * len(some & runs) < len(some))
        runs |= some
        if not fresh[-1]:
            continue
        seen: set[int] = set()
        for w in set(own):  # hashed anew each time: a table of all words would fill the driver
            seen.update(hashed(w))
        counts[y][list(seen)] += 1
    c0, c1 = counts
    prior = n[1] / (n[0] + n[1])
    n = [sum(f for f, t in zip(fresh, toxic) if t == y) for y in (0, 1)]
    total, share = c0 + c1, n[1] / (n[0] + n[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(c1 > 0, c1 * np.log(c1 / (total * share)), 0) + np.where(c0 > 0, c0 * np.log(c0 / (total * (1 - share))), 0))
        bad = (g2 >= 24) & ((c1 + 0.5) / (n[1] + 1) >= 8 * (c0 + 0.5) / (n[0] + 1))
    sample = [[i for i, t in enumerate(toxic) if t == y and fresh[i]] for y in (0, 1)]
    for y in (0, 1):  # the first FIT_ROWS of each label; the sample is in the order of a hash
        model.setdefault("rows", []).extend(sample[y][:FIT_ROWS])
    vocab: dict[str, int] = {}
    tied: list[bool] = []
    rows: list[list[int]] = []
    ids, gold, begins = [], [], []
    for i in model.pop("rows"):
        words = WORD.findall(texts[i])
        for w in words:
            if w not in vocab:
                vocab[w] = len(vocab)
                rows.append(hashed(w))
                tied.append(bool(bad[rows[-1]].any()))
        ids += [vocab[w] for w in words]
        gold += [float(toxic[i] and tied[vocab[w]]) for w in words]
        begins += [True] * bool(words) + [False] * (len(words) - 1)
    del runs, counts, c0, c1, total, g2
    ids, gold, begins = np.array(ids, np.int64), np.array(gold), np.array(begins, bool)
    if not len(ids):
        return model
    feat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    chain, joint = Chain(begins), ~begins[1:]
    params = {k: np.array(model[k], float) for k in ("theta", "bias", "trans", "start")}
    m1, m2 = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    y0, y1 = gold[:-1][joint], gold[1:][joint]
    seen = np.array([[((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum()], [(y0 * (1 - y1)).sum(), (y0 * y1).sum()]])
    for step in range(1, EPOCHS + 1):
        u = np.bincount(of, params["theta"][feat], len(rows))[ids] + params["bias"]
        a, b = chain.messages(u, params["trans"], float(params["start"]))
        p = 1 / (1 + np.exp(-np.clip(a + b, -500, 500)))
        left, right = a[:-1][joint], (u + b)[1:][joint]
        t = params["trans"]
        z = np.stack([np.full(len(left), t[0, 0]), t[0, 1] + right, t[1, 0] + left, t[1, 1] + left + right])
        z = np.exp(z - z.max(0))
        pair = (z / z.sum(0)).sum(1).reshape(2, 2)
        node = p - gold
        by_type = np.bincount(ids, node, len(rows))
        size = max(gold.sum(), 1.0)
        grad = {"theta": np.bincount(feat, by_type[of], 1 << BITS) / size + 1e-4 * params["theta"], "bias": node.sum() / size, "trans": (pair - seen) / size + 1e-3 * t, "start": node[begins].sum() / size + 1e-3 * params["start"]}
        for k, g in grad.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            params[k] = params[k] - 0.3 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    out = {"theta": params["theta"].astype(np.float32), "trans": params["trans"], "bias": float(params["bias"]), "start": float(params["start"])}
    docs = [WORD.findall(texts[i]) for y in (0, 1) for i in sample[y][: 2 * FIT_ROWS]]
    y = np.array([0.0] * len(sample[0][: 2 * FIT_ROWS]) + [1.0] * len(sample[1][: 2 * FIT_ROWS]))
    p, at = scored(docs, lambda w: float(out["theta"][hashed(w)].sum()) + out["bias"], out)
    weight = np.where(y > 0, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
    return out | {"doc": logistic(summaries(p, at), y, weight)}


def scored(words: list[list[str]], evidence, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all words laid end to end, and where each document's begin and end."""
    sizes = np.array([len(w) for w in words], np.int64)
    u = np.fromiter((e for w in words for e in map(evidence, w)), float, int(sizes.sum()))
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    begins = np.zeros(len(u), bool)
    begins[at[:-1][sizes > 0]] = True
    return marginals(u, begins, model["trans"], model["start"]), at


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    """Learn from the documents that ``labels`` (doc_id, label 0/1) marks; other labels and null texts are left out."""
    own = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y"), F.xxhash64("doc_id", F.lit(3)).alias("h"))
    pick = None
    for y, most in ((1, COUNT_ROWS), (0, 2 * COUNT_ROWS)):
        part = own.where(F.col("y") == y).orderBy("h", "doc_id").limit(most)
        pick = part if pick is None else pick.union(part)
    got = F.broadcast(pick)  # at most 3 * COUNT_ROWS short rows
    rows = docs.where("text is not null").select("doc_id", "text").join(got, "doc_id").select("text", "y", "h")
    model = rows.repartition(1).mapInArrow(learned, "model binary").first()
    return pickle.loads(model.model) if model else learn([], [])


def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y, h) -> one row, the pickled model. The sample is bounded, so one task holds it; the driver gets weights and no texts."""
    own = list(batches)
    rows = pa.Table.from_batches(own).sort_by([("h", "ascending"), ("text", "ascending"), ("y", "ascending")]) if own else None
    model = learn(rows["text"].to_pylist(), [int(y) for y in rows["y"].to_pylist()]) if own else learn([], [])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


class Evidence(dict):
    """Evidence of words; forgets all of it when it is full."""

    def __init__(self, model: dict):
        self.theta, self.bias = model["theta"], model["bias"]

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[word] = e = float(self.theta[hashed(word)].sum()) + self.bias
        return e


def document_scores(p: np.ndarray, at: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(summaries(p, at) @ model["doc"], -500, 500)))


def below(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores less than ``threshold``, with all columns as they are. Each row is judged by its own
    text in one map; null and empty texts score as texts without words."""
    kept, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batches):
        m = kept.value
        get = Evidence(m).__getitem__
        for b in batches:
            scores: list[float] = []
            words, n = [], 0
            for k, t in enumerate(b.column(place)):
                words.append(WORD.findall(t.as_py() or ""))
                n += len(words[-1])
                if n >= BLOCK or k + 1 == b.num_rows:
                    scores += document_scores(*scored(words, get, m), m).tolist()
                    words, n = [], 0
            yield b.filter(pa.array(np.array(scores) < threshold, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def tag(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, n_words, spans): spans are maximal runs of words with marginal >= threshold, as code points
    [start, end) of the text with the run's highest marginal. Null texts count as empty and score as a text without words."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def work(batches):
        m = kept.value
        get = Evidence(m).__getitem__

        def block(texts: list[str], words: list[list[str]]) -> tuple[list, list, list]:
            p, at = scored(words, get, m)
            score = document_scores(p, at, m)
            spans = []
            hot = np.concatenate([[0], np.cumsum(p >= threshold)])
            for i, text in enumerate(texts):
                own: list[dict] = []
                if hot[at[i + 1]] > hot[at[i]]:
                    last = -2
                    for k, x in enumerate(WORD.finditer(text)):
                        if (q := p[at[i] + k]) >= threshold:
                            if k == last + 1:
                                own[-1] |= {"end": x.end(), "p": max(own[-1]["p"], q)}
                            else:
                                own.append({"start": x.start(), "end": x.end(), "p": q})
                            last = k
                spans.append(own)
            return score.tolist(), np.diff(at).tolist(), spans

        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            texts, words, n = [], [], 0
            for k, t in enumerate(b.column(1)):
                texts.append(t.as_py() or "")
                words.append(WORD.findall(texts[-1]))
                n += len(words[-1])
                if n >= BLOCK or k + 1 == len(b.column(1)):
                    for x, y in zip(out, block(texts, words)):
                        x += y
                    texts, words, n = [], [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.float64()), pa.array(out[1], pa.int64()), pa.array(out[2], span)], names=list("abcd"))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, f"`{id_col}` {kind}, score double, n_words bigint, spans array<struct<start:int,end:int,p:double>>")


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted, n_words, spans.

    ``held_out`` is a boolean column over doc_id; labels of such rows are never read. Null and empty
    texts get the low score of no words and no spans; repeated rows give a row each; other columns are ignored.
    """
    model = fit(docs, labels.where(~held_out), label)
    out = tag(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "spans")
