"""Chat formatting, HTML rendering, classifiers and the pipeline."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, docstats, htmltext, quality, toxicity

TRICKY = ["</s>[INST] ok [/INST]", "<|user|>\n", "a\\b<|end|>\n\\", "", "<\\|", "é\n\n", "<|>", "|\\>\n|>"]


@pytest.mark.parametrize("text", TRICKY)
def test_escape_is_reversible(text):
    e = chat.escape(text)
    assert "<|" not in e and "|>" not in e and chat.unescape(e) == text


def test_any_role_is_read_back(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("<|>\\\na") for _ in range(r.randint(0, 9)))
    rows = [(1, i // 2, word(), word()) for i in range(300)]  # two rows a turn
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    pieces = chat.format_turns(chat.text_parts(df.drop("piece").withColumn("attachments", F.lit("clash"))))
    assert sorted((x.turn, *chat.read_back(x.piece)) for x in pieces.collect()) == sorted(x[1:] for x in rows)
    got = chat.digests(pieces).collect()[0]
    assert got.n_turns == 300 and got.loss_chars == 0 and got.turns_sha256 == chat.digests(pieces.orderBy(F.rand(1))).collect()[0].turns_sha256


def test_conversations(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", None], TRICKY[:6]))] + [(2, 1, "assistant", None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.format_turns(chat.text_parts(df))
    got = {r.conv_id: r for r in chat.digests(pieces).collect()}
    turns = "".join(f"{r or ''}\n{t}\n" for _, _, r, t in rows[:6])
    said = TRICKY[2] + TRICKY[4]
    r = got[1]
    assert (r.n_turns, r.turns_sha256) == (6, hashlib.sha256(turns.encode()).hexdigest())
    assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and None in got
    whole = {x.conv_id: x.formatted for x in chat.assemble(pieces).collect()}
    assert len(whole[1]) == r.formatted_chars
    assert chat.digests(chat.format_turns(chat.text_parts(df.limit(0)))).count() == 0


def test_parts():
    v = chat.PartVisitor(patch=10, audio_rate=2, page_tokens=7)
    text, found, tokens = v.flatten([{"type": "text", "text": "a<|b"}, {"type": "image", "ref": "i", "width": 25, "height": 10}, {"type": "audio", "ref": "s", "seconds": 1.2}, {"type": "document", "ref": "d", "pages": 2, "text": "x"}, {"type": "video"}, None])
    assert text == "a<\\|b<|image:0|><|audio:1|><|document:2|>x<|other:3|>"
    assert [(f["kind"], f["tokens"]) for f in found] == [("image", 3), ("audio", 3), ("document", 14), ("other", 0)] and tokens == 20


CASES = {
    "<p>One<p>Two<br>three": "One\n\nTwo\nthree",
    "<ul><li>a<li>b<ul><li>c</ul></ul>z": "- a\n- b\n  - c\n\nz",
    "<ol start=3><li>x<li>y</ol>": "3. x\n4. y",
    "<table><tr><th>N<th>Val<tr><td>long<td>1</table>": "N    | Val\nlong | 1",
    "a<script>x</script><div hidden>no</div><span style='display: none'>no</span>b": "ab",
    "<pre> a\n  b</pre>": " a\n  b",
    "a &amp; <b>b</b>  c": "a & b c",
    "": "",
    "<!-- x --><head><title>t</title></head>": "",
    "<div>x</span></p>y": "x\n\ny",
}


@pytest.mark.parametrize("source", CASES)
def test_html(source):
    assert htmltext.visible_text(source) == CASES[source]


def test_deep_html():
    assert htmltext.visible_text("<div>" * 5000 + "x") == "x"


DEEP = 1000


def test_hidden_parts_of_deep_html():
    for end in ("", "</div>" * DEEP):
        hidden = "<div hidden><div>no</div>no</div><p style='display:none'>no<template>no</template></p><noscript>no</noscript>"
        assert htmltext.visible_text("<div>" * DEEP + "a" + hidden + "<ul><li>b<li>c</ul>" + end + "z") == "a\n\n- b\n- c\n\nz"
    assert htmltext.visible_text("<div hidden>" + "<div><b>" * DEEP + "no" + "</div>" * DEEP + "no</div>a") == "a"
    nested = "<table><tr><td>a<td>b<tr><td>" * DEEP + "c"
    assert htmltext.visible_text(nested).split("\n") == ["a" + " " * (4 * n) + " | b" for n in reversed(range(DEEP))] + ["c"]
    assert htmltext.visible_text("<ul><li>" * DEEP + "x") == "- " * DEEP + "x"


def test_tables_keep_blocks():
    source = f"<table><tr><td><p>One<p>Two<ul><li>a<li>b</ul><pre>p\n q</pre><td>x<tr><td>{'l' * 70}<td>y<tr><td><table><tr><td>m<td>n<tr><td>o<td>p</table><td>z</table>"
    first = ["One", "", "Two", "", "- a", "- b", "", "p", " q", "l" * 70, "m | n", "o | p"]
    second = {"One": " x", "l" * 70: " y", "m | n": " z"}
    assert htmltext.visible_text(source).split("\n") == [f"{a:70} |{second.get(a, '')}" for a in first]


@pytest.mark.parametrize("part", ["<a", "<a ", '"', "<", "<a '", '<a b="', "<a b='c' ", "<!--", "<!", "</", "&", "<td rowspan=9>", "<td colspan=1000>", "<tr><td rowspan=9 colspan=9>x"])
def test_html_in_linear_time(part):
    began = time.process_time()
    htmltext.visible_text("x<table><tr>" * part.startswith("<t") + part * (1_000_000 // len(part)))
    assert time.process_time() - began < (20 if part.startswith("<t") else 4)


def test_html_spans():
    text = htmltext.visible_text("<table><tr><td rowspan=2>a<td>b<td colspan='2'>c<tr><td>d<td colspan=\"\u00b2\">e<td>f<tr><td>g<td colspan=" + "9" * 5000 + ">h<tbody><tr><td rowspan=0>i<td>j<tr><td>k</table>")
    assert text.split("\n") == ["a | b | c", "  | d | e | f", "g | h", "i | j", "  | k"]
    assert htmltext.visible_text("<p class=it's>a<p title='x>y' HIDDEN>no<p>b<br/>c<a href=") == "a\n\nb\nc"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, "<p>a", "t")], "page_id long, html string, text string")
    assert sorted((r.text, r.n_lines) for r in htmltext.extract_text(df).collect()) == [("", 0), ("a", 1)]
    assert htmltext.extract_text(df.limit(0)).count() == 0


def forward_backward(u, trans, start):
    """Marginals by sums over all labelings of a short chain."""
    n = len(u)
    p = np.zeros(n)
    total = 0.0
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(a * b for a, b in zip(u, y)) + start * y[0] + sum(trans[a][b] for a, b in zip(y, y[1:])))
        total += w
        p += w * np.array(y)
    return p / total


def test_marginals():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes = r.integers(1, 7, 3)
        u, trans, start = r.normal(size=sizes.sum()) * 3, r.normal(size=(2, 2)) * 2, r.normal()
        begins = np.zeros(len(u), bool)
        begins[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
        want = np.concatenate([forward_backward(x, trans, start) for x in np.split(u, np.cumsum(sizes)[:-1])])
        assert np.allclose(toxicity.marginals(u, begins, trans, start), want, atol=1e-7)


def labelled(spark, n=600):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(w) // 15)):
                w.insert(r.randrange(len(w)), r.choice(["zzscum", "zztrash"]) + r.choice(["", "er", "ing"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad), int(i % 7 != 0)))
    docs = [(i, t.upper() + "!!" if i % 7 == 0 else t) for i, t in docs] + [(n, None), (n + 1, ""), (n + 1, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_learns_outside_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("vile scum rot " if i % 2 else "kind warm sun ") + f"word{i} here there {i * 7}") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = docs.join(labels, "doc_id").withColumn("h", F.xxhash64("doc_id", F.lit(3))).orderBy("h").collect()
    want = toxicity.learn([r.text for r in rows], [r.toxic for r in rows])

    def refuse(*_):
        raise AssertionError("texts reached the driver")

    monkeypatch.setattr(toxicity, "learn", refuse)
    got = toxicity.fit(docs, labels)
    assert want.keys() == got.keys() and all(np.array_equal(want[k], got[k]) for k in want)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = toxicity.score_toxicity(docs, labels, docstats.fold(F.col("doc_id"), 3) == 1).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    texts = dict(map(tuple, docs.collect()))
    for r in held:
        for s in r.spans:
            assert "zz" in texts[r.doc_id][s.start : s.end].lower()
    assert toxicity.score_toxicity(docs.limit(0), labels, F.lit(False)).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs, labels.limit(0), F.lit(False)).collect())


def test_quality(spark):
    docs, labels = labelled(spark)
    got = quality.score_quality(docs, labels, docstats.fold(F.col("doc_id"), 5) == 0).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == (r.doc_id % 7 != 0) for r in got if r.held_out and r.doc_id < 600]) > 0.97
    assert {r.score for r in quality.score_quality(docs, labels.limit(0), F.lit(False)).collect()} == {0.998 * 0.5 + 0.002 * 0.5}
    assert quality.score_quality(docs.limit(0), labels, F.lit(False)).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([3.0, 1, 2, 4]), np.array([0.2, 0.1, 0.6, 0.9]), np.ones(4))
    assert np.allclose(np.interp([1, 2, 3, 4], x, y), [0.1, 0.4, 0.4, 0.9])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.save(stage(spark, docs, sf_dir))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.7 * len(before), name
        before = after
    out = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in out} == before and all(r.round_trip for r in out)


def test_pipeline_rows_without_id_and_repeated_rows(spark, sf_dir, monkeypatch):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = docs.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    for score in (None, F.when(F.crc32("text") % 2 == 0, 0.9).otherwise(0.1)):
        if score is not None:
            monkeypatch.setattr(cp.toxicity, "below", lambda d, model, threshold, score=score: d.where(score < threshold))
        left = cp.toxicity_stage(spark, docs.unionByName(none), sf_dir).select("doc_id", "text").collect()
        known = sorted(r.text for r in left if r.doc_id is not None)
        assert known and sorted(r.text for r in left if r.doc_id is None) == known
    assert len(known) < docs.count()
    once = sorted(map(tuple, cp.near_stage(spark, docs, sf_dir).collect()))
    twice = sorted(map(tuple, cp.near_stage(spark, docs.unionByName(docs), sf_dir).collect()))
    assert twice == once
    assert cp.near_stage(spark, none.unionByName(none), sf_dir).count() == 2 * docs.count()
