"""Queries that SQL cannot express, and the pipeline, against plain sequential versions on a small table."""

import hashlib
import math
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import docstats, htmltext, quality, toxicity


def recursion(u, trans, start):
    """Marginals of the second label by the recursion from left to right and back, word by word."""
    n = len(u)
    fore, back = np.zeros((n, 2)), np.zeros((n, 2))
    fore[0] = [0.0, u[0] + start]
    for i in range(1, n):
        for y in (0, 1):
            fore[i, y] = np.logaddexp(*(fore[i - 1, x] + trans[x][y] for x in (0, 1))) + u[i] * y
    for i in range(n - 2, -1, -1):
        for y in (0, 1):
            back[i, y] = np.logaddexp(*(trans[y][x] + u[i + 1] * x + back[i + 1, x] for x in (0, 1)))
    s = fore + back
    return np.exp(s[:, 1] - np.logaddexp(s[:, 0], s[:, 1]))


def score(text, model):
    words = toxicity.WORD.findall(text or "")
    u = [float(sum(model["theta"][h] for h in toxicity.hashed(w))) + model["bias"] for w in words]
    p = recursion(u, model["trans"], model["start"]) if words else np.zeros(0)
    total, top = p.sum(), p.max() if words else 0.0
    x = [math.log1p(total), min(50 * total / max(len(words), 20), 3), math.log(top + 1e-4) / 4 + 2, 1.0]
    return 1 / (1 + math.exp(-float(np.dot(x, model["doc"])))), p


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_toxicity_scores(spark, tables):
    held = docstats.fold(F.col("doc_id"), 3) == 1
    docs, labels = tables["documents"], tables["labels"].where(~held)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, tables["labels"], held).collect()}
    for r in docs.collect():
        want, p = score(r.text, model)
        assert abs(got[r.doc_id].score - want) < 1e-4, r.doc_id
        hot = {m.start() for m, q in zip(toxicity.WORD.finditer(r.text or ""), p) if q >= 0.5 + 1e-6}
        assert hot <= {k for s in got[r.doc_id].spans for k in range(s.start, s.end)}


def test_quality_scores(spark, tables):
    """Normal equations of all rows at once in place of sums over partitions."""
    held = docstats.fold(F.col("doc_id"), 5) == 0
    docs, labels = tables["documents"], tables["labels"].where(~held)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, tables["labels"], held).collect()}
    stats = {r.doc_id: docstats.stats_of(r.text or "") for r in docs.collect()}
    rows = labels.select("doc_id", "quality", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrate")).where("quality is not null").collect()
    rows = [r for r in rows if r.doc_id in stats]
    x, y = np.array([stats[r.doc_id] for r in rows]), np.array([float(r.quality) for r in rows])
    cal = np.array([r.calibrate for r in rows])
    rng = np.random.default_rng(quality.SEED)
    model = {"w": rng.normal(size=(docstats.N_STATS, quality.FEATURES)) * np.sqrt(2 * quality.GAMMA / docstats.N_STATS), "b": rng.uniform(0, 2 * np.pi, quality.FEATURES), "mean": x.mean(0), "std": np.sqrt(np.maximum((x * x).mean(0) - x.mean(0) ** 2, 1e-6))}
    f = quality.features(x, model)
    ridge = quality.RIDGE * len(x) * np.eye(f.shape[1])
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(f[~cal].T @ f[~cal] + ridge, f[~cal].T @ y[~cal])
    bins = np.round(np.clip(f[cal] @ beta, -1, 2) * quality.BINS)
    levels = np.unique(bins)
    mean, size = np.array([y[cal][bins == b].mean() for b in levels]), np.array([(bins == b).sum() for b in levels])
    fitted = [max(min(np.average(mean[i : j + 1], weights=size[i : j + 1]) for j in range(k, len(levels))) for i in range(k + 1)) for k in range(len(levels))]  # the min-max formula
    keys = sorted(stats)
    raw = np.clip(quality.features(np.array([stats[k] for k in keys]), model) @ beta, -1, 2)
    want = 0.998 * np.interp(raw, levels / quality.BINS, fitted) + 0.002 * (raw + 1) / 3
    assert np.allclose([got[k] for k in keys], want, atol=2e-3)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def pairs_of(sets):
    """Places (earlier, later) of all pairs with a Jaccard similarity of 0.75 or more."""
    where, out = {}, []
    for k, s in enumerate(sets):
        common = {}
        for t in s:
            for j in where.setdefault(t, []):
                common[j] = common.get(j, 0) + 1
            where[t].append(k)
        out += [(j, k) for j, c in common.items() if 100 * c >= 75 * (len(s) + len(sets[j]) - c)]
    return out


def test_pipeline_rows(spark, sf_dir, tables):
    """The rows of run(), stage by stage with plain loops."""
    import corpus_pipeline as cp
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = tables["documents"]
    model = toxicity.fit(docs, tables["labels"].where(docstats.fold(F.col("doc_id"), 3) != 1))
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {d: t for d, t in sorted(texts.items()) if score(t, model)[0] < 0.7}

    places = [(d, i, x) for d, t in texts.items() for i, x in enumerate((t or "").split("\n"))]
    gone = {places[k][:2] for _, k in pairs_of([shingles(x) for _, _, x in places])}
    left = {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in texts.items()}
    texts = {d: t for d, t in left.items() if t is None or t.strip(" ") or not any(g[0] == d for g in gone)}

    ids = list(texts)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in pairs_of([shingles(texts[d]) for d in ids]):
        a, b = sorted((find(ids[a]), find(ids[b])))
        root[b] = a
    texts = {d: t for d, t in texts.items() if find(d) == d}

    for r in tables["benchmark"].collect():
        w = (r.text or "").encode().lower().split()
        n = min(5, len(w))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for d, t in list(texts.items()):
            v = (t or "").encode().lower().split()
            if own and 100 * len(own & {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}) >= 75 * len(own):
                del texts[d]

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = cp.run(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in got} == want and len(got) == len(want)


def test_stages_of_odd_rows(spark, sf_dir):
    """Nulls, empty texts, repeats, clashing names and empty tables in each stage."""
    import corpus_pipeline as cp

    rows = [(None, "same words in a line here", "a"), (6, "same words in a line here", "h"), (6, "a text that is like no other", "i"), (1, "same words in a line here", "b"), (2, "same words in a line here", "c"), (2, "same words in a line here", "c"), (3, None, "d"), (4, "", "e"), (4, "other text under the id of four", "f"), (5, "x " * 30_000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumns({"n_removed": F.lit(1), "component_id": F.lit("c"), "item_id": F.lit("i"), "row": F.lit(2)})
    for empty in (docs.limit(0), docs):
        for name, stage in cp.STAGES[:-1]:
            out = cp.save(stage(spark, empty, sf_dir))
            assert sorted(out.columns) == sorted(docs.columns), name
            kept = sorted((r.doc_id or 0, r.score) for r in out.select("doc_id", "score").collect())
            want = {"line dedup": [(0, "a"), (1, "b"), (3, "d"), (4, "e"), (4, "f"), (5, "g"), (6, "i")], "n-gram Jaccard join": [(0, "a"), (1, "b"), (3, "d"), (4, "e"), (4, "f"), (5, "g"), (6, "i")]}.get(name, [(r[0] or 0, r[2]) for r in rows])
            assert kept == (sorted(want) if empty is docs else []), name
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)


class Plain(HTMLParser):
    """All text outside of hidden elements, in order, without any layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.text = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        hidden = tag in htmltext.UNSEEN or "hidden" in a or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or "", re.I)
        if tag not in htmltext.VOID:
            self.stack.append((tag, bool(hidden)))
        elif tag == "img" and a.get("alt") and not any(h for _, h in self.stack):
            self.text.append(a["alt"])

    def handle_endtag(self, tag):
        for i in reversed(range(len(self.stack))):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not any(h for _, h in self.stack):
            self.text.append(data)


def test_html_text_is_whole(spark, sf_dir):
    """Every page's text against another parser's, layout aside."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    squeezed = lambda x: re.sub(r"[\s|]+", "", x)
    for r in htmltext.extract_text(pages).collect():
        plain = Plain()
        plain.feed(sources[r.page_id] or "")
        plain.close()
        bare = "\n".join(re.sub(r"^(?:- |\d+\. |> )+", "", x.strip()) for x in r.text.split("\n"))
        assert squeezed(bare) == squeezed("".join(plain.text)), r.page_id
