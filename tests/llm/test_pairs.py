"""Similarity joins against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import capjoin, components, decontaminate, linededup, ngramjoin, suffixdedup
from tessera.llm import shingles as shingle_words


def link(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    k = len(x & y)
    return k and 100 * k >= 75 * (len(x) + len(y) - k)


def families(seed, sizes=(3, 8, 40, 90)):
    r = random.Random(seed)
    out = []
    for _ in range(6):
        base = [r.choice("abcdefghijklmnopqrst") * r.randint(1, 3) for _ in range(r.choice(sizes))]
        for _ in range(r.randint(1, 40)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice("ABCxyz") * r.randint(1, 6)
            out.append(" ".join(w))
    return out


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)]
    got = {x.id: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = link({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_ngram_join(spark, seed):
    rows = [(i * 3 - 20, t, "clash") for i, t in enumerate(families(seed))] + [(10000, None, ""), (10001, "", ""), (10002, " \n", "")]
    got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    sets = {i: shingles(t) for i, t, _ in rows}
    ids = sorted(sets)
    want = link(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if alike(sets[a], sets[b])])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in ids}


def test_ngram_join_of_nothing(spark):
    assert ngramjoin.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = ngramjoin.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(5, 2, 5), (5, 2, 5)]


def test_ngram_join_of_large_regions(spark):
    """Variants that chains link and no ball holds: several pivots, windows and levels, and blocks at the end."""
    r = random.Random(4)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        for i in range(150):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 2, 3])):
                w[r.randrange(60)] = f"x{r.randint(0, 30)}"
            rows.append((len(rows), " ".join(w)))
    sets = {i: shingles(x) for i, x in rows}
    want = link(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    names = ("SMALL", "MEMBERS", "PIVOTS", "PARTED", "BLOCK")
    saved = {n: getattr(ngramjoin, n) for n in names}
    for values in (saved.values(), (2, 8, 8, 0.99, 16)):
        for n, v in zip(names, values):
            setattr(ngramjoin, n, v)
        got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {x.doc_id: x.component_id for x in got} == want
    for n, v in saved.items():
        setattr(ngramjoin, n, v)


def test_ngram_join_of_near_misses(spark, monkeypatch):
    """A group of variants of which hardly any two link is not measured pair by pair, and cells of the same sets count once."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(5):
            w[r.randrange(k * 24, k * 24 + 20)] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(x) for i, x in rows}
    pairs, measured = [], ngramjoin._measured
    monkeypatch.setattr(ngramjoin, "_measured", lambda p, s: (pairs.append(p.distinct().count()), measured(p, s))[1])
    got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == link(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    assert pairs[-1] < 200  # of 7,140
    cells = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2), ("d", 2), ("d", 3)]
    kept = ngramjoin._apart(spark.createDataFrame(cells, "cell string, rep long")).collect()
    assert sorted((x.cell, x.rep, x.m) for x in kept) == [("a", 1, 2), ("a", 2, 2), ("d", 2, 2), ("d", 3, 2)]


def test_ngram_join_of_ids_with_several_texts(spark):
    one, other = "a b c d e f g h", "p q r s t u v w"
    got = ngramjoin.near_duplicates(spark.createDataFrame([(1, one), (2, one), (2, other), (3, other), (4, "solo")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4)]


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup(spark, seed):
    lines = families(seed, (2, 5, 9, 30))
    r = random.Random(seed)
    r.shuffle(lines)
    docs, at = [], 0
    while at < len(lines):
        n = r.randint(1, 7)
        docs.append((len(docs) * 2, "\n".join([*lines[at : at + n], ""][: n + r.randint(0, 1)])))
        at += n
    docs += [(9001, None), (9002, ""), (9003, "\n\n")]
    earlier, want = [], {}
    for d, t in docs:
        for i, x in enumerate(t.split("\n") if t is not None else []):
            s = shingles(x)
            if s and any(alike(s, e) for e in earlier):
                want.setdefault(d, []).append(i)
            earlier.append(s)
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for row in got:
        t = dict(docs)[row.doc_id]
        gone = want.get(row.doc_id, [])
        assert row.n_removed == len(gone)
        assert row.text == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))


def test_line_dedup_sends_short_numbers_and_splits_odd_lines(spark, monkeypatch):
    sent, small = [], linededup._small
    monkeypatch.setattr(linededup, "_small", lambda df, lines: sent.append(df.schema[lines].dataType.simpleString()) or small(df, lines))
    lines = ["Ada  ran home to eat plums", " ada ran\thome to eat plums\r", "\u00c9T\u00c9 a b c d\x0be\x0c f", "one", "  one ", "a b c d e f g h"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.dedup_lines(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
    assert sent == ["array<int>"] * 2
    got = shingle_words.line_words(df, "text").join(df, "doc_id").select("text", "w").collect()
    assert len(got) == len(lines)
    for r in got:
        assert r.w == re.split("[ \\t\\n\\x0b\\f\\r]+", r.text.strip(" \t\n\x0b\f\r").lower())


def test_line_dedup_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "same words in a line here"), (1, "same words in a line here"), (2, "same words in a line here"), (2, "same words in a line here")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in linededup.dedup_lines(df).collect())
    assert got == [(-1, 0), (1, 0), (2, 1), (2, 1)]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_ids_with_several_texts(spark):
    one, other = "alpha beta gamma delta epsilon zeta", "uno dos tres cuatro cinco seis"
    rows = [(1, one, 7, "x"), (2, one, 7, "y"), (2, other, 7, "z"), (3, other, 7, "w")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed int, row string"))
    assert got.columns == ["doc_id", "text", "row", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_removed, r.row) for r in got.collect()) == [(1, one, 0, "x"), (2, "", 1, "y"), (2, other, 0, "z"), (3, "", 1, "w")]


def test_line_dedup_of_many_variants_and_long_texts(spark):
    r = random.Random(11)
    base = [f"w{i}" for i in range(40)]
    lines = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(40)] = f"v{r.randint(0, 9)}"
        lines.append(" ".join(w) + " " * (i % 3))
    docs = [(1, "\n".join(lines[:200])), (-5, "\n".join(lines[200:])), (3, " ".join(f"x{i}" for i in range(40000))), (4, " ".join(f"x{i}" for i in range(1, 40000)))]
    order = [(d, i, x) for d, t in sorted(docs) for i, x in enumerate(t.split("\n"))]
    sets = [shingles(x) for _, _, x in order]
    want = {}
    for k, (d, i, _) in enumerate(order):
        if any(alike(sets[k], sets[j]) for j in range(k)):
            want.setdefault(d, set()).add(i)
    for rounds, limit in ((linededup.ROUNDS, linededup.BROADCAST_LINES), ((1,), 0)):
        saved = linededup.ROUNDS, linededup.BLOCK, linededup.BROADCAST_LINES
        linededup.ROUNDS, linededup.BLOCK, linededup.BROADCAST_LINES = rounds, 16, limit
        got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        linededup.ROUNDS, linededup.BLOCK, linededup.BROADCAST_LINES = saved
        for row in got:
            t = dict(docs)[row.doc_id].split("\n")
            assert row.n_removed == len(want.get(row.doc_id, ()))
            assert row.text == "\n".join(x for i, x in enumerate(t) if i not in want.get(row.doc_id, ()))


def test_containment(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 5, 12, 40])))) for i in range(40)] + [(90, None), (91, " ")]
    docs = [(0, None), (1, "")]
    for d in range(2, 80):
        body = [word() for _ in range(r.randint(0, 200))]
        if d % 3:
            w = (r.choice(items)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                if w:
                    w[r.randrange(len(w))] = word()
            body[10:10] = w
        docs.append((d, " ".join(body).title() if d % 2 else "\t".join(body)))
    want = set()
    for i, t in items:
        w = (t or "").lower().split()
        n = min(5, len(w))
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for d, x in docs:
            v = (x or "").lower().split()
            k = len(s & {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}) if s else 0
            if s and 100 * k >= 75 * len(s):
                want.add((i, d, k))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.item_id, x.doc_id, x.n_shared) for x in decontaminate.contained_items(a, b).collect()} == want
    assert {x.doc_id for x in decontaminate.decontaminate(a, b).collect()} == {d for d, _ in docs} - {d for _, d, _ in want}
    assert decontaminate.contained_items(a, b.limit(0)).count() == 0 and decontaminate.contained_items(a.limit(0), b).count() == 0
    limit, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, 0
    assert decontaminate.contained_items(a, b).count() == len(want)
    decontaminate.BROADCAST_ROWS = limit
    # sketches hold less than all shingles, lose no pair, and leave few pairs to verify
    sketches = decontaminate.item_sketches(b, "item_id", "text", 75)
    pairs = {(x.item, x.doc) for x in decontaminate.candidate_pairs(a, sketches).collect()}
    assert {x[:2] for x in want} <= pairs and len(pairs) < 0.2 * len(items) * len(docs)
    assert sketches.where("in_sketch").count() < 0.6 * sketches.count()


def test_containment_of_odd_rows(spark):
    item, half = "a b c d e f g h i j k l", "a b c d e f g h"
    docs = spark.createDataFrame([(1, half, "x"), (1, "e f g h i j k l", "x"), (2, item, "y"), (2, item, "y"), (3, half, "z"), (None, item, "n"), (4, "q " * 50_000 + item, "l")], "doc_id long, text string, n_shared string")
    items = spark.createDataFrame([(7, item), (7, item), (8, "a b"), (8, "k l")], "item_id long, text string")
    got = sorted((x.item_id, x.doc_id, x.n_shingles, x.n_shared) for x in decontaminate.contained_items(docs, items).collect())
    assert got == [(7, 1, 8, 8), (7, 2, 8, 8), (7, 4, 8, 8), (8, 1, 2, 2), (8, 2, 2, 2), (8, 4, 2, 2)]
    assert sorted((x.doc_id or -1, x.n_shared) for x in decontaminate.decontaminate(docs, items).collect()) == [(-1, "n"), (3, "z")]


def repeat_rows():
    r = random.Random(1)
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    for i in range(48):
        k = i % 6
        if k == 0:
            t = "".join(r.choice("abc xyz") for _ in range(500)) + base[100 : 100 + r.randint(150, 900)] + "Q" * r.choice([0, 50, 199, 200, 201, 500])
        elif k == 1:
            t = "ab" * r.randint(50, 300) + base[500:900]
        elif k == 2:
            t = base[r.randint(0, 500) : r.randint(800, 2900)]
        elif k == 3:
            x = list(base)
            x[r.randint(0, 2999)], x[r.randint(0, 2999)] = "Z", "é"
            t = "".join(x)
        elif k == 4:
            t = None if i % 12 else ""
        else:
            t = "".join(r.choice("ab") for _ in range(r.randint(1, 260)))
        yield i, t


@pytest.mark.parametrize("group,keep_first", [(3000, False), (3, False), (3000, True), (3, True)])
def test_repeats(spark, group, keep_first, monkeypatch):
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    rows = list(repeat_rows())
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 199):
            seen.setdefault(b[i : i + 200], []).append((d, i))
    for x in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=keep_first).collect():
        b = (dict(rows)[x.doc_id] or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 199):
            at = seen[b[i : i + 200]]
            if (at[0] != (x.doc_id, i)) if keep_first else len(at) > 1:
                m[i : i + 200] = b"\1" * 200
        left = bytes(c for c, y in zip(b, m) if not y)
        assert bytes(x.kept) == left and (x.n_bytes, x.n_removed) == (len(b), sum(m)), x.doc_id
        assert x.n_spans == sum(1 for i in range(len(m)) if m[i] and not (i and m[i - 1]))
        assert x.kept_sha256 == hashlib.sha256(left).hexdigest()


def test_repeats_of_ids_with_several_texts(spark):
    r = random.Random(6)
    x, y = ("".join(r.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    rows = [(1, x, 0), (2, x, 0), (2, y, 0), (2, y, 0), (3, x[:250], 0), (None, x, 0)]
    got = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_removed int")).collect()
    assert sorted((g.doc_id or 0, g.n_bytes, g.n_removed) for g in got) == [(0, 400, 0), (1, 400, 400), (2, 400, 0), (2, 400, 0), (2, 400, 400), (3, 250, 250)]
    got = suffixdedup.remove_repeats(spark.createDataFrame([(1, "ab" * 50_000), (2, "q" * 3000 + x)], "doc_id long, text string"))
    assert sorted((g.doc_id, g.n_removed) for g in got.collect()) == [(1, 100_000), (2, 3000)]


def test_longest_factors():
    r = np.random.default_rng(4)
    for _ in range(40):
        n = int(r.integers(1, 60))
        place, run = r.permutation(n), np.sort(r.integers(0, 8, n))
        earlier, later = suffixdedup.reached(place, run)
        for i in range(n):
            other = place[run == run[i]]
            assert (earlier[i], later[i]) == ((other < place[i]).any(), (other > place[i]).any())


def test_repeats_of_nothing(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(0)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(25):
            base = r.normal(size=32)
            base /= np.linalg.norm(base)
            for _ in range(int(r.integers(1, 14))):
                v = base + r.normal(size=32) * r.choice([0.0, 0.02, 0.03, 0.045, 0.06])
                rows.append((n, [float(x) for x in np.float32(v * r.choice([1, 3]))], label))
                n += 1
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 32, 1), (9003, [float("nan")] * 32, 1), (9004, [None] + [1.0] * 31, 1), (9005, [float("inf")] + [0.0] * 31, 1)]
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and i < 9000]
    x = np.array([v / np.linalg.norm(v) for _, v, _ in ok])
    c = x @ x.T
    pairs = [(ok[i][0], ok[j][0]) for i, j in zip(*np.nonzero(np.triu(c >= 0.93, 1))) if ok[i][2] == ok[j][2]]
    count = {i: 0 for i, _, _ in rows}
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    comp = link([i for i, _, _ in rows], pairs)
    got = capjoin.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {g.vec_id: (g.n_links, g.component_id, g.kept) for g in got} == {i: (count[i], comp[i], comp[i] == i) for i in count}


def test_recall_at_the_threshold(spark):
    r = np.random.default_rng(5)
    rows, want = [], set()
    for i in range(400):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cos = r.uniform(0.931, 0.96)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (cos * a + np.sqrt(1 - cos * cos) * b).tolist(), 0)]
        want.add((2 * i, 2 * i + 1))
    reps = spark.createDataFrame(rows, "rep long, v array<double>, label int").select("rep", "label", "v", F.lit(1).cast("long").alias("copies"))
    counts, edges = capjoin.compared(reps)
    got = {(min(x.a, x.b), max(x.a, x.b)) for x in edges.collect()}
    assert got <= want and len(got) >= 0.995 * len(want)
    assert {x.rep: x.n for x in counts.groupBy("rep").agg(F.sum("n").alias("n")).collect()} == {i: 1 for p in got for i in p}


def test_vectors_of_a_large_group(spark):
    """Links are counted once, rows follow the group's size and not its square, and blocks meet each other."""
    r = np.random.default_rng(8)
    base = r.normal(size=24)
    v = np.float32(base / np.linalg.norm(base) + r.normal(size=(700, 24)) * 0.05)
    v[650:] = v[:50]  # exact copies
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & ~np.eye(700, dtype=bool)
    assert near.sum() > 100_000
    df = spark.createDataFrame([(i, a.tolist(), "x", i) for i, a in enumerate(v)], "vec_id long, embedding array<float>, label string, n_links int")
    block, capjoin.BLOCK = capjoin.BLOCK, 128
    got = {g.vec_id: (g.n_links, g.component_id) for g in capjoin.near_vectors(df).collect()}
    capjoin.BLOCK = block
    comp = link(range(700), zip(*np.nonzero(np.triu(near))))
    assert got == {i: (int(near[i].sum()), comp[i]) for i in range(700)}


def test_vectors_of_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (1, b, 1), (2, b, 1), (3, a, 2), (1, a, 2), (3, a, None), (None, a, 1), (4, [1.0, 0.0], 1), (5, a, 1), (5, a, 1)]
    got = sorted((g.vec_id or 0, g.n_links, g.component_id or 0, g.kept) for g in capjoin.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    want = [(0, 0, 0, None), (1, 1, 1, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 1, 1, False), (4, 0, 4, True), (5, 2, 1, False), (5, 2, 1, False)]
    assert got == sorted(want, key=lambda x: tuple(str(y) for y in x)) or sorted(map(str, got)) == sorted(map(str, want))
    assert capjoin.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_decode_gives_all_filters_above_the_threshold():
    r = np.random.default_rng(2)
    for _ in range(50):
        s1, s2 = r.normal(size=30), r.normal(size=40)
        f = capjoin.decode(s1, s2, 2.0)
        assert f.tolist() == np.flatnonzero((s1[:, None] + s2 >= 2.0).ravel()).tolist()
        f = capjoin.decode(s1, s2, 9.0)
        assert set(f) == set(np.argsort(-(s1[:, None] + s2).ravel(), kind="stable")[: capjoin.LEAST])
