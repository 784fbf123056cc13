"""op11, op12 and op13 on odd rows, against plain loops."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexindex, prefixtrie, tokenfile
from tessera.llm.scratch import new_path, save

MODEL = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, part string, row int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


# ---- op11


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for counts in (rng.integers(0, 50, 40), np.array([1, 1, 2, 3, 5, 8, 13, 21, 34]), np.array([0, 7, 0]), np.array([0, 0]), 2 ** np.arange(20)):
        used = int((counts > 0).sum())
        for limit in (6, 10, 30):
            n = tokenfile.code_lengths(counts, limit)
            assert ((n > 0) == (counts > 0)).all() and n.max(initial=0) <= limit
            if used > 1:
                assert sum(2.0 ** -int(x) for x in n if x) == 1
            if limit == 30 and used > 1:
                heap, cost = sorted(map(int, counts[counts > 0])), 0
                while len(heap) > 1:
                    a, b, *heap = heap
                    cost += a + b
                    heap = sorted([*heap, a + b])
                assert int((counts * n).sum()) == cost
    with pytest.raises(ValueError):
        tokenfile.code_lengths(np.ones(9, int), 3)


def test_limited_codes_are_the_best_of_their_length():
    counts = np.array([1, 2, 4, 8, 16])
    n = tokenfile.code_lengths(counts, 3)
    best = min(int((counts * x).sum()) for x in itertools.product(range(1, 4), repeat=5) if sum(2.0 ** -y for y in x) <= 1)
    assert int((counts * n).sum()) == best


def test_blocks_and_checkpoints(monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 1000)
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.geometric(0.02, 5000), 300).astype(np.uint16)
    lengths = tokenfile.code_lengths(np.bincount(ids), 12)
    codes = tokenfile.canonical(lengths)
    bits = [format(int(codes[i]), f"0{lengths[i]}b") for i in np.unique(ids)]
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)
    shard = tokenfile.Shard(lengths, 12, codes)
    cuts = [0, 0, 1, 700, 3700, 5000, 5000]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        shard.add(None if i == 2 else i, ids[a:b])
    got = tokenfile.Reader(shard.bytes())
    assert [(d, x.tolist()) for d, x in got.documents()] == [(None if i == 2 else i, ids[a:b].tolist()) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for first, n in ((0, 5), (255, 3), (256, 256), (990, 100), (999, 1), (1000, 4)):
        assert got.block(3, first, n).tolist() == ids[3000 + first : min(4000, 3000 + first + n)].tolist()
    with pytest.raises(ValueError):
        tokenfile.Reader(b"something else")


@pytest.mark.parametrize("small", [False, True])
def test_ids_through_files(spark, library, monkeypatch, small):
    if small:
        monkeypatch.setattr(tokenfile, "SHARD_IDS", 5)
    rng = random.Random(3)
    texts = [None, "", " ", "a  b", "x \n y\t z ", "<|endoftext|> a<|endoftext|>b", "  lead", "tail  ", "é ü   ñ 漢字 🙂", "q" * 20_000, " ".join(rng.choice(["the", "cat's", "1234", "naïve", "\n", ""]) for _ in range(3000)), "\x1c a \x85 b"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "", 0), (3, "a  b", "", 0), (3, "other", "", 0), (-5, "early", "", 0)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    path = new_path(spark, "t")
    wide = tokenfile.id_width(MODEL)
    index = tokenfile.write_ids(save(tokenfile.encode_texts(docs, MODEL)), path, wide)
    got = tokenfile.read_ids(spark, path).collect()
    assert index.count() > 5 if small else index.count() <= 4
    got.sort(key=lambda r: r.start)
    want = sorted(((-99 if i is None else i), tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in rows)
    assert sorted((-99 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in got) == want
    assert [-99 if r.doc_id is None else r.doc_id for r in got] == [i for i, _ in want]
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in tokenfile.read_ids(spark, path, digests=True).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}


def test_words_go_to_the_library_once(library, monkeypatch):
    """Long words and words of earlier groups too, until there are too many."""
    with open(MODEL, encoding="utf-8") as f:
        enc = tokenfile.Encoder(f.read(), 2)
    texts = ["first " + "x" * 60 + " last.\nnext line, first", "\n", "", "two  blanks", "line\nfirst last. line"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    sent, call = [], enc.library
    monkeypatch.setattr(enc, "library", lambda t: (sent.append(t), call(t))[1])
    assert enc.encode(texts) == want
    sent.clear()
    assert enc.encode(texts[:1] + texts[4:]) == want[:1] + want[4:] and not sent
    monkeypatch.setattr(tokenfile, "KNOWN", 2)
    assert enc.encode(texts) == want and sent
    assert enc.encode([]) == []


def test_no_documents_no_ids(spark):
    assert tokenfile.file_digests(spark.createDataFrame([], DOCS), MODEL, new_path(spark, "t")).count() == 0


# ---- op12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL_LETTERS = {c: c + 32 for c in range(65, 91)}


def plain_search(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(SMALL_LETTERS))) for i, t in docs]
    n, total = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked, scored = TERM.findall((text or "").translate(SMALL_LETTERS)), []
        for doc, t in terms:
            if t:
                m = 25 + 75 * len(t) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in asked if x in df)
                if s > 0:
                    scored.append((-s, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def odd_docs(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Äpfel", "äpfel", "ÉCLAIR", "漢字", "a1b2"]
    docs = [(i, rng.choice([" ", "-", ".\n", "_", "{"]).join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.choice([1, 3, 3, 8, 8, 8, 40, 400])))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, " .,;"), (n + 3, docs[0][1]), (n + 4, docs[0][1].upper())], [(i, " ".join(rng.choice([*words, "nowhere"]) for _ in range(rng.randint(1, 12)))) for i in range(25)] + [(90, None), (91, "..."), (92, "nowhere")]


@pytest.mark.parametrize("piece", [1 << 20, 200])
def test_search_is_exact_and_skips_strata(spark, monkeypatch, piece):
    docs, items = odd_docs(4)
    monkeypatch.setattr(lexindex, "BLOCK_TERMS", 40)
    monkeypatch.setattr(lexindex, "PIECE", piece)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([*items, items[0]], "item_id bigint, text string")
    vectors = save(lexindex.term_vectors(d))
    index, n, _ = lexindex.build_index(vectors)
    got = lexindex.search(index, n, q, 5).collect()
    assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in got) == plain_search(docs, items, 5)
    strata = {r.piece: r.n for r in index.select("piece", F.explode("ms").alias("m")).groupBy("piece").agg(F.countDistinct("m").alias("n")).collect()}
    assert index.where("term = ''").agg(F.sum(F.size("ids"))).first()[0] == n  # every document with a term is indexed
    if piece == 1 << 20:
        assert sum(r.visited for r in got) < 0.9 * len(got) * max(strata.values())


def test_rows_without_id_and_equal_ids_are_documents(spark):
    d = spark.createDataFrame([(None, "red fox"), (7, "red fox"), (7, "red fox"), (8, "blue")], "doc_id bigint, text string")
    got = lexindex.ranked_search(d, spark.createDataFrame([(1, "fox")], "item_id bigint, text string")).collect()
    assert sorted((r.rank, r.doc_id or 0) for r in got) == [(1, 0), (2, 7), (3, 7)]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, None)], [(1, "a")]), ([(1, "a")], []), ([(1, "a")], [(None, "a")])])
def test_search_of_nothing(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert lexindex.ranked_search(d, spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


# ---- op13


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        kids = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(all(e for _, e in nodes[p]) for p in below)
        parent = min(c for c, _ in nodes[path[:-1]]) if path else None
        ends = ",".join(str(c) for c, e in sorted(members) if e)
        out.append((min(c for c, _ in members), len(path), parent, len(members), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk(seed):
    rng = random.Random(seed)
    said = ["hi", "hi there", None, "", "a b c\td", "yes", " "]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(said)) for c in range(0, 130) if c % 7 for t in range(rng.choice([1, 2, 3, 6]))]
    rows += [(200 + c, t, "user", "same") for c in range(60) for t in range(3)]  # one conversation many times
    rows += [(300, t, "user", f"{t}") for t in range(200)]  # a long one
    rows += [(5, None, "user", "first"), (5, None, None, "also first"), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (None, 0, "user", "nobody's")]
    return rows


def sort_key(r):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)


@pytest.mark.parametrize("shard", [4096, 7])
def test_trie(spark, monkeypatch, shard):
    monkeypatch.setattr(prefixtrie, "SHARD_CONVERSATIONS", shard)
    rows = talk(5)
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "conv_id bigint, turn bigint, role string, text string, node string, ends binary").repartition(3)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in prefixtrie.trie_of(df).select(cols).collect()]
    assert sorted(got, key=sort_key) == sorted(plain_trie(rows), key=sort_key)


def test_no_conversations(spark):
    assert prefixtrie.trie_of(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
