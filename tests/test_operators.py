"""Small cases and sequential models of the operators."""

import random
import re
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F
from same import rows

from tessera.functions import stems
from tessera.functions.text import compound_parts, squeezed
from tessera.operators import chunking, dense, governance, language, retrieval, sparse, windows
from tessera.plans import catalog
from tessera.sources import files


def test_compound_parts(spark):
    got = spark.createDataFrame([("arbeitszeit",), ("haus",), ("ab",)], "w string").select(compound_parts(F.col("w"))).collect()
    assert got[0][0] == ["arbeitszeit", "arb", "itszeit", "itszeit", "tszeit", "arbeit", "zeit", "zeit", "eit"]
    assert got[1][0] == ["haus"] and got[2][0] == ["ab"]


def windows_model(text, most):
    count = lambda s: len(s.split())
    if count(text) <= most:
        return [text]
    out, cur, n = [], [], 0
    for para in text.split("\n"):
        long = count(para) > most
        if long and cur:
            out.append(cur)
            cur, n = [], 0
        for x in re.split(r"(?<=[.!?])\s+", para) if long else [para]:
            if n + count(x) > most and cur:
                out.append(cur)
                cur, n = [], 0
            cur.append(x)
            n += count(x)
    return [s for s in ("\n".join(c) for c in [*out, cur] if c) if s.strip()]


def test_token_windows(spark):
    random.seed(3)
    texts = ["".join(random.choice(["a ", "b. ", "c! ", "\n", "word ", "x\n\n"]) for _ in range(random.randint(0, 60))) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.token_windows(F.col("t"), 5).alias("w")).collect()
    for r in got:
        assert r.w == windows_model(texts[r.i], 5), texts[r.i]


def test_token_windows_equal_their_sql_on_odd_documents(spark, tmp_path, monkeypatch):
    random.seed(5)
    bits = ["b. ", "c! ", "\n", "x\n\n", "\t", "\x0b", "\r\n", "\x01", "\xa0", "\x85", "\u3000", ".\x0b", "\0", "w " * 15]
    odd = ["", " ", "\n", "\xa0\u3000", "\x0b", "\n\n" + "w " * 41, "\n" + "w " * 20 + "\x01 " + "w " * 20, *("".join(random.choice(bits) for _ in range(40)) for _ in range(60))]
    docs = [(i, t) for i, t in enumerate(odd)] + [(None, "no id"), (200, None), (3, None), *([(300, "a line\n" + "w. " * 50)] * 3), *([(301, "")] * 2), *([(i, odd[i]) for i in range(0, 60, 3)])]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = rows(con.sql(catalog.oracle_sql()["token_windows"]).df())
    for most in (chunking.BROADCAST_ROWS, 0):
        monkeypatch.setattr(chunking, "BROADCAST_ROWS", most)
        assert rows(catalog.queries()["token_windows"](spark, str(tmp_path)).toPandas()) == want


def test_document_windows_of_batches_and_small_ids(spark, monkeypatch):
    monkeypatch.setattr(chunking, "LOT", 2)
    docs = spark.createDataFrame([("a", "one two\nthree\nfour five six"), ("b", "x"), ("b", "y\nz u v w"), ("c", " "), (None, "x")], "doc_id string, text string")
    got = sorted(map(tuple, chunking.document_windows(docs, 3).collect()))
    assert got == [("a", "four five six", 1, 3), ("a", "one two\nthree", 0, 3), ("b", "x\ny", 0, 2), ("b", "z u v w", 1, 4)]
    assert chunking.document_windows(docs.where("doc_id = 'a'").withColumn("doc_id", F.lit(7)), 3).dtypes[0] == ("doc_id", "int")


def default_model(els):
    """The walk of the default chunker: type, text and heading path in order."""
    out, prose, lists, path, carry = [], [], [], [], ""

    def flush_lists():
        if lists:
            out.append(["list", "\n".join("• " + t.strip() for t, _ in lists), list(lists[0][1]), ""])
        lists.clear()

    def flush_prose():
        if prose:
            out.append(["prose", "\n".join(t for t, _ in prose), list(prose[0][1]), ""])
        prose.clear()

    def atom(kind, text, cap=""):
        out.append([kind, text, list(path), cap])

    rec = lambda t: any(re.search(p, t) for p in chunking.RECOMMENDATION)
    for label, level, text in els:
        if label == "heading":
            flush_prose(), flush_lists()
            path = (path[: max(0, level - 1)] if level is not None else path) + [text.strip()]
            atom("heading", text)
        elif label == "table":
            flush_prose(), flush_lists()
            if text.strip():
                atom("table", text, carry)
                carry = ""
        elif label == "figure":
            flush_prose(), flush_lists()
            cap = carry or text
            carry = ""
            atom("figure", f"[Figure: {cap}]" if cap else "[Figure]", cap)
        elif label == "caption":
            carry = text.strip()
            if out and out[-1][0] in ("figure", "table"):
                out[-1][3] = carry
                carry = ""
        elif label in ("formula", "code", "footnote"):
            flush_prose(), flush_lists()
            if text.strip():
                atom(label, text)
        elif label == "list_item":
            if text.strip() and rec(text):
                flush_prose(), flush_lists()
                atom("recommendation", text)
            elif text.strip():
                lists.append((text, list(path)))
        elif label == "text":
            flush_lists()
            if text.strip() and rec(text):
                flush_prose()
                atom("recommendation", text)
            elif text.strip():
                prose.append((text, list(path)))
        elif text.strip():
            flush_lists()
            prose.append((text, list(path)))
    flush_lists(), flush_prose()
    return out


def test_default_chunker(spark):
    random.seed(5)
    docs, rows = {}, []
    for d in range(150):
        docs[d] = []
        for i in range(random.randint(1, 14)):
            label = random.choice(["heading", "text", "text", "list_item", "list_item", "table", "figure", "caption", "caption", "formula", "other"])
            text = random.choice(["alpha", "beta gamma", " ", "§ 5 rule", "(1) first", "", "tail"])
            if label == "heading":
                text = random.choice(["H1", "H2"])
            level = random.choice([1, 2, None]) if label == "heading" else None
            docs[d].append((label, level, text))
            rows.append((d, i, label, level, text))
    got = chunking.chunk(spark.createDataFrame(rows, "doc_id int, seq int, label string, level int, text string")).orderBy("doc_id", "chunk_index").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append([r.chunk_type, r.text, list(r.heading_path), (r.caption or "") if r.chunk_type in ("table", "figure") else ""])
    for d, els in docs.items():
        assert by.get(d, []) == default_model(els), els


def test_history_window_keeps_the_newest(spark):
    m = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c d e"), (1, 2, "f " * 50), (2, 0, "x"), (2, 1, "y z")], "conv_id int, turn int, text string")
    got = {(r.conv_id, r.turn) for r in governance.history_window(m, 4).collect()}
    assert got == {(1, 2), (2, 0), (2, 1)}


def test_login_throttle(spark):
    random.seed(1)
    rows, n = [], 0
    for ip in range(5):
        for _ in range(60):
            rows.append((n, ip, random.randint(0, 3600), random.random() < 0.3))
            n += 1
    df = spark.createDataFrame(rows, "event_id int, ip int, s int, ok boolean").select("event_id", "ip", F.timestamp_seconds("s").alias("ts"), "ok")
    got = {r.event_id: r.blocked for r in windows.login_throttle(df, 3).collect()}
    count = {}
    for event, ip, s, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        k = ip, s // 900
        blocked = count.get(k, 0) >= 3
        assert got[event] == blocked
        if not blocked:
            count[k] = 0 if ok else count.get(k, 0) + 1


def test_cache_hits(spark):
    random.seed(2)
    rows = [(i, random.randint(0, 3), random.randint(0, 5000)) for i in range(150)]
    df = spark.createDataFrame(rows, "event_id int, key int, s int").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: r.hit for r in windows.cache_hits(df, 400).collect()}
    made = {}
    for event, key, s in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = key in made and s - made[key] <= 400
        assert got[event] == hit
        if not hit:
            made[key] = s


def test_filters_and_fusion(spark):
    df = spark.createDataFrame([(None, [1]), ([], [1]), ([1, 2], None), ([1, 2], [2, 3]), ([1], [])], "c array<int>, p array<int>")
    assert [r[0] for r in df.select(retrieval.effective_filter("c", "p")).collect()] == [[1], [1], [1, 2], [2], []]
    lists = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 8, 1), (1, 9, 2)], "query_id int, id int, rank int")
    assert [r.id for r in retrieval.fuse(lists, 3).orderBy("rank").collect()] == [8, 7, 9]


def test_claims_ignore_space_and_case(spark):
    assert spark.range(1).select(F.contains(squeezed(F.lit("A  b\nC")), squeezed(F.lit("ab c")))).first()[0]


def test_embeddings_have_length_one(spark):
    e = dense.hash_embeddings(spark.createDataFrame([(1, "alpha beta"), (2, "")], "doc_id long, text string"), 16)
    got = {r.doc_id: sum(x * x for x in r.embedding) for r in e.collect()}
    assert abs(got[1] - 1) < 1e-9 and got[2] == 0


def test_mail_with_attachment(spark):
    raw = b"From: a@x\nTo: b@x\nSubject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nhello\n--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=f\n\nno\n--B--\n"
    f = spark.createDataFrame([("m.eml", bytearray(raw))], "path string, content binary")
    r = files.read_mail(f).first()
    assert (r["from"], r.subject, r.attachments, r.body.strip()) == ("a@x", "s", 1, "hello")


def test_delimited_keeps_ragged_rows(spark):
    f = spark.createDataFrame([("a.csv", bytearray("a,,b\nä\n".encode("latin-1")))], "path string, content binary")
    r = files.read_delimited(f).first()
    assert (r.text, r.encoding, r.rows, r.cols) == ("a |  | b\nä", "latin-1", 2, 3)


def test_patch_seed_replace(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, governance.seeded(a, b.distinct(), "k").collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert sorted(map(tuple, governance.replaced(a, b, "k").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, governance.patched(a, spark.createDataFrame([(1, None), (2, "q")], "k int, v string"), "k", ["v"]).collect())) == [(1, "x"), (2, "q")]


def test_whole_texts(spark):
    one, two = "Boilerplate of the site. " * 40, "Der Vertrag wird nach Ablauf der Frist nicht verlängert. " * 200
    docs = spark.createDataFrame([(1, "en", one), (2, "de", two), (3, None, one + two), (4, None, "ab"), (5, None, "")], "doc_id long, lang string, text string")
    profile = language.profiles(docs.where("lang is not null"))
    got = {r.id: r.lang for r in language.detected(language.language_scores(docs, profile)).collect()}
    assert (got[1], got[2], got[3]) == ("en", "de", "de") and set(got) == {1, 2, 3, 4, 5}
    assert [r.g for r in spark.createDataFrame([("Añ𝄞d",), ("ab",), ("",), (None,)], "t string").select(language.grams(F.col("t")).alias("g")).collect()] == [["añ𝄞", "ñ𝄞d"], ["ab"], [""], [None]]
    odd = spark.createDataFrame([("xx", " ".join(chr(0x4E00 + i) for i in range(3000)))], "lang string, text string")
    assert language.profiles(odd).where("gram <> ''").count() == 5997


def test_embedding_of_whole_text(spark):
    head = "alpha " * 2048
    e = {r.doc_id: r.embedding for r in dense.hash_embeddings(spark.createDataFrame([(1, head + "beta " * 500), (2, head + "gamma " * 500), (3, head)], "doc_id long, text string")).collect()}
    assert e[1] != e[2] and e[1] != e[3]


def test_rate_limit_of_shuffled_files(spark, tmp_path):
    random.seed(5)
    rows = [(i, i % 3, datetime(2024, 1, 1) + timedelta(minutes=random.randrange(60 * 40))) for i in range(300)]
    rows += [(300 + i, 0, datetime(2024, 1, 1, 5)) for i in range(5)]
    random.shuffle(rows)
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").repartition(12).write.parquet(path)
    want, n = set(), {}
    for e, u, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        h = ts.replace(minute=0)
        n[u, h] = n.get((u, h), 0) + 1
        want.add((e, u, h, n[u, h], n[u, h] <= 2))
    got = [tuple(r) for r in catalog.queries()["stream_rate_limit"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and set(got) == want


def test_html_elements_lose_no_text(spark):
    page = "<html><head><title>t</title></head>top<div>a <b>b</b></div>tail<ul><li>one<li>two<p>more</p>rest</ul>after<dl><dt>k<dd>v</dl><pre>x = 1</pre><h2 class='q'>H<br>I</h2><table><caption>Cap</caption><tr><th>N<th>V<tr><td><p>p</p>q<td>2</table>end<script>no</script><!-- no --><blockquote>said"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain")], "page_id int, html string")
    got = [(r.doc_id, r.label, r.level, r.text) for r in chunking.html_elements(rows).orderBy("doc_id", "seq").collect()]
    want = [("text", None, "top"), ("text", None, "a b"), ("text", None, "tail"), ("list_item", None, "one"), ("list_item", None, "two"), ("list_item", None, "more"), ("list_item", None, "rest"), ("text", None, "after"), ("text", None, "k"), ("text", None, "v"), ("code", None, "x = 1"), ("heading", 2, "H"), ("text", None, "I"), ("table", None, "N | V\np q | 2"), ("caption", None, "Cap"), ("text", None, "end"), ("text", None, "said")]
    assert got == [(1, *x) for x in want] + [(4, "text", None, "plain")]


ENGLISH = "consigned consign consistently consist knocking knock kindly kind generously generous communication communic running run happiness happi hopping hop hoped hope relational relat ties tie cries cri gas gas kiwis kiwi cry cri say say conspicuous conspicu traditional tradit agreed agre possibly possibl analogies analog bed bed dying die news news".split()
GERMAN = "häuser haus katzen katz kategorischen kategor kaufleute kaufleut käufer kauf aufgeregten aufgeregt kümmern kumm kürzlich kurzlich auffällig auffall arbeitslosigkeit arbeitslos geheimnisse geheimnis schönheit schonheit bauen bau königin konigin straße strass".split()


def test_stems(spark):
    assert [stems.english(w) for w in ENGLISH[::2]] == ENGLISH[1::2]
    assert [stems.german(w) for w in GERMAN[::2]] == GERMAN[1::2]
    rows = spark.createDataFrame([("de", "katzen"), ("en", "ties"), ("en", None)], "lang string, word string")
    assert {(r.lang, r.stem) for r in stems.stem_vocab(rows).collect()} == {("de", "katz"), ("en", "tie"), ("en", None)}


def test_stemmed_counts(spark):
    """Against a loop over words in the order of the reference: stop words, parts, stems, stop words and short stems."""
    stop = {"de": ["der", "und", "haus"], "en": ["the"]}
    docs = [(1, "de", "Der Hausbau und die Häuser"), (2, "en", "The running ties a tie"), (3, "fr", "le")]
    got = {(r.id, r.term): r.tf for r in sparse.term_counts(spark.createDataFrame(docs, "doc_id int, lang string, text string"), stop, stems.stem_vocab).collect()}
    parts = {r.w: r.p for r in spark.createDataFrame([(w,) for w in ("hausbau", "die", "häuser")], "w string").select("w", compound_parts(F.col("w")).alias("p")).collect()}
    want = {}
    for d, lang, text in docs[:2]:
        for w in text.lower().split():
            if w in stop[lang] or (lang == "en" and len(w) < 2):
                continue
            for x in map(stems.german, parts[w]) if lang == "de" else [stems.english(w)]:
                if lang == "en" or (len(x) >= 2 and x not in stop["de"]):
                    want[d, x] = want.get((d, x), 0) + 1
    assert got == want


def test_numbers_by_ranges(spark):
    rows = [(i * 7919 % 503, "ab"[i % 2]) for i in range(503)] + [(1000, "c")]
    got = governance.numbered(spark.createDataFrame(rows, "x int, g string"), ["x"], "no", ["g"]).collect()
    for g in "abc":
        assert [r.no for r in sorted((r for r in got if r.g == g), key=lambda r: r.x)] == list(range(sum(r[1] == g for r in rows)))
    assert governance.numbered(spark.createDataFrame([], "x int"), ["x"], "no").count() == 0


def test_files_that_cannot_be_read(spark):
    rows = spark.createDataFrame([("a.csv", b"1,2\n3"), ("b.csv", None), ("c.csv", b"x" * 200_000)], "path string, content binary")
    got = {r.path: (r.rows, r.cols, len(r.warnings)) for r in files.read_delimited(rows).collect()}
    assert got == {"a.csv": (2, 2, 0), "b.csv": (0, 0, 1), "c.csv": (1, 1, 0)}
    rows = spark.createDataFrame([("a", b"Subject: s\nContent-Type: text/plain; charset=nope\n\nhi"), ("b", None)], "path string, content binary")
    assert {r.path: (r.body, len(r.warnings)) for r in files.read_mail(rows).collect()} == {"a": ("hi", 0), "b": ("", 1)}
    assert [(r.path, r.content_type, r.text) for r in files.mail_leaves(rows).collect()] == [("a", "text/plain", "hi")]
    rows = spark.createDataFrame([("a", b"<svg><text>x<tspan>y</tspan>z</text></svg>"), ("b", b"<svg>"), ("c", None)], "path string, content binary")
    assert {r.path: (r.text, len(r.warnings)) for r in files.read_svg(rows).collect()} == {"a": ("x\nz\ny", 0), "b": ("", 1), "c": ("", 1)}


def test_dense_blocks(spark, monkeypatch):
    r = random.Random(2)
    v = [(i, [float(r.choice([0, 1, 2])) for _ in range(3)]) for i in range(300)] + [(900, None)]
    q = [(i, x) for i, x in v[:20]] + [(77, None)]
    want = {(i, n + 1, j) for i, x in q[:20] for n, (_, j) in enumerate(sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in v[:300])[:7])}
    for block in (4096, 6):
        monkeypatch.setattr(dense, "QUERY_BLOCK", block)
        got = dense.dense_top_k(spark.createDataFrame(v, "id int, v array<double>").repartition(5), spark.createDataFrame(q, "query_id int, q array<double>"), 7)
        assert {(x.query_id, x.rank, x.id) for x in got.collect()} == want
    assert dense.dense_top_k(spark.createDataFrame(v, "id int, v array<double>").limit(0), spark.createDataFrame(q, "query_id int, q array<double>"), 7).count() == 0


def test_pruned_top_k_reads_less_and_gives_the_same(spark):
    rng = random.Random(11)
    posts = {(f"t{t}", d): rng.random() ** 3 * (30 - t) for t in range(30) for d in rng.sample(range(2000), 20 + 40 * t)}
    postings = spark.createDataFrame([("en", t, d, w) for (t, d), w in posts.items()], "lang string, term string, id long, weight double")
    asked = spark.createDataFrame([("en", t, q, rng.random()) for q in range(12) for t in {f"t{rng.randint(0, 32)}" for _ in range(6)}] + [("fr", "t1", 1, 1.0)], "lang string, term string, id long, weight double")
    for k in (1, 5, 50):
        want = sparse.sparse_top_k(postings, asked, k).collect()
        got = sparse.pruned_top_k(postings, asked, k).collect()
        row = lambda r: (r.lang, r.query_id, r.rank, r.id, round(r.score, 9))
        assert sorted(map(row, got)) == sorted(map(row, want))
    read = sparse.pruned_top_k(postings, asked, 1, block_docs=16, report=True).agg(F.sum("read"), F.sum("postings")).first()
    assert read[0] < 0.7 * read[1]
    ties = spark.createDataFrame([("en", "a", d, 1.0) for d in range(500)], postings.schema)
    one = spark.createDataFrame([("en", "a", 1, 1.0)], asked.schema)
    assert [r.id for r in sparse.pruned_top_k(ties, one, 7).orderBy("rank").collect()] == list(range(7))
    assert sparse.pruned_top_k(ties.limit(0), one, 7).count() == 0
    assert sparse.pruned_top_k(ties, one.limit(0), 7).count() == 0


def test_documents_found_by_words_and_by_vectors_move_up(spark, sf_dir):
    from tessera.plans import search_queries as s

    words, vectors = s._sparse_hits(spark, sf_dir, 50), s._text_hits(spark, sf_dir, 50)
    both = words.select("query_id", "id", F.col("rank").alias("a")).join(vectors.select("query_id", "id", F.col("rank").alias("b")), ["query_id", "id"])
    fused = retrieval.fuse(s._lists(spark, sf_dir), 50)
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    shared = both.join(fused, ["query_id", "id"]).select("query_id", "a", "b", "rank").collect()
    assert len({r.query_id for r in shared}) > questions // 2
    # on the whole what both find stands higher than in the mean of its lists, and never behind more than both lists' better ones
    assert sum(r.rank for r in shared) < sum((r.a + r.b) / 2 for r in shared)
    assert all(r.rank <= r.a + r.b for r in shared)
    first = fused.where("rank = 1").join(both, ["query_id", "id"]).count()
    assert first > questions // 2


def test_token_windows_take_time_in_proportion():
    import time

    def took(lines):
        text = "\n".join(["some words of a line"] * lines)
        began = time.process_time()
        out = chunking.windows_of(text, 40)
        return time.process_time() - began, len(out)

    (a, m), (b, n) = took(100_000), took(1_000_000)
    assert (m, n) == (12_500, 125_000)
    assert b < 30 * a


def test_language_scores_by_table_and_by_join(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "de", "der hund und die katze"), (2, "en", "the dog and the cat"), (3, None, "and the dog 𝄞x"), (4, "en", "ab"), (5, "de", ""), (6, "de", None), (1, "de", "noch ein hund")], "doc_id long, lang string, text string")
    profile = language.profiles(docs.where("lang is not null"))
    cell = lambda r: (r.id, r.lang, round(r.score, 9))
    own = sorted(map(cell, language.language_scores(docs, profile).collect()))
    monkeypatch.setattr(language, "PROFILE_ROWS", 1)
    assert own == sorted(map(cell, language.language_scores(docs, profile).collect()))
    assert {r[0] for r in own} == {1, 2, 3, 4, 5}
    assert profile.where("gram = ''").count() == 2


def test_dense_lists_mask_labels(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], None if i == 9 else i % 3) for i in range(10)], "id long, v array<double>, label int")
    q = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], []), (3, [1.0, 0.0], [0, 2]), (4, None, [0])], "query_id long, q array<double>, acl array<int>")
    hits = dense.dense_top_k(v, q, 4)
    assert "NestedLoop" not in hits._jdf.queryExecution().toString()
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {1: [9, 8, 7, 6], 3: [8, 6, 5, 3]}


def test_request_keys_tell_parts_apart(spark):
    rows = [("a|1", "2", "u", None, None), ("a", "1|2", "u", None, None), (" A ", "1|2", "u", [], []), ("a", None, "u", None, None), ("a", "1|2", "u", ["de,en"], None), ("a", "1|2", "u", ["en", "de"], None), ("a", "1|2", "u", ["de", "en"], None), ('a","c":"', "2", "u", None, None)]
    keys = [r.k for r in spark.createDataFrame(rows, "q string, c string, u string, l array<string>, t array<string>").select(windows.request_key("q", "c", "u", "l", "t").alias("k")).collect()]
    assert keys[1] == keys[2] and keys[5] == keys[6]
    assert len(set(keys)) == 6


def test_gate_is_counted_by_the_job_that_reads_it(spark):
    from pyspark.sql import Observation

    rows = [(1, "ten letters", "c", True), (1, "short", "c", True), (2, "ten letters", "  ", True), (2, None, None, True), (2, "ten letters", "c", False)]
    chunks = spark.createDataFrame(rows, "doc_id int, text string, context_text string, is_leaf boolean")
    seen = Observation("gate")
    kept = chunking.quality_gate(chunks, seen)
    assert kept.columns == chunks.columns and kept.count() == 1
    assert seen.get == {"kept": 1, "dropped": 3}
    assert sorted(map(tuple, chunking.gate_counts(chunks).collect())) == [(1, 1, 1), (2, 0, 2)]


def test_extracted_content_keeps_every_line(spark, tmp_path):
    lines = ['{"doc_id": 1, "tables": [{"rows": 1, "cols": 2, "data": [["a", "b"]]}], "sections": []}', '{"doc_id": 2}', "no json", '{"doc_id": 3, "emails": [{"from": "x", "body": "hi"}, {"from": "y"}]}']
    (tmp_path / "x.json").write_text("\n".join(lines))
    raw = files.extracted(spark, f"file://{tmp_path}/x.json")
    assert [r.fault for r in raw.where("doc_id is null").collect()] == ["no json"]
    assert sorted((r.doc_id, r.position, r.data) for r in files.exploded(raw.where("doc_id is not null"), "tables").collect()) == [(1, 0, [["a", "b"]]), (2, None, None), (3, None, None)]
    mails = files.exploded(raw.where("doc_id = 3"), "emails").orderBy("position").collect()
    assert [(r["from"], r.body, r.to) for r in mails] == [("x", "hi", None), ("y", None, None)]


def test_search_that_scans_texts_equals_postings(spark):
    """Frequencies and hits read off the texts equal those of postings, also for a document in two rows, odd letters, null texts and two languages."""
    random.seed(11)
    words = ["Hauptbahnhof", "Lebensversicherung", "der", "zwei-fach", "the", "a", "Running", "runs", "İx", "K9", "größe", "x1"] + [f"w{i}" for i in range(25)]
    docs = [(i, random.choice(["de", "en", "fr"]), " ".join(random.choices(words, k=random.randrange(40)))) for i in range(120)]
    docs += [(3, docs[3][1], "the Hauptbahnhof w1 runs"), (200, "de", None), (201, "en", "")]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    q = spark.createDataFrame([(i, random.choice(["de", "en"]), " ".join(random.choices(words, k=6))) for i in range(15)], "doc_id long, lang string, text string")
    stop, sizes = {"de": ["der"], "en": ["the"]}, d.groupBy("lang").agg(F.count("*").alias("n"))
    whole, counts = sparse.whole_documents(d), sparse.term_counts(d, stop)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sparse.term_frequencies(whole, stop)) == rows(counts.groupBy("lang", "term").agg(F.count("*")))
    stemmed = sparse.term_counts(d, stop, stems.stem_vocab).groupBy("lang", "term").agg(F.count("*"))
    assert rows(sparse.term_frequencies(whole, stop, stems.stem)) == rows(stemmed)
    idf = sparse.inverse_frequencies(counts, sizes)
    asked = sparse.weights(sparse.term_counts(q, stop), idf)
    want = sparse.sparse_top_k(sparse.weights(counts, idf), asked, 7)
    for block in (4096, 4):
        got = sparse.scanned_top_k(whole, stop, idf, asked, 7, block)
        assert rows(got.select("lang", "query_id", "id", "rank", F.round("score", 9))) == rows(want.select("lang", "query_id", "id", "rank", F.round("score", 9)))


def test_search_reads_each_text_once(spark):
    """Frequencies and what documents hold of the questions' terms come from one pass; hits equal those of postings."""
    random.seed(12)
    words = ["Hauptbahnhof", "der", "zwei-fach", "the", "Running", "İx", "größe"] + [f"w{i}" for i in range(25)]
    docs = [(i, random.choice(["de", "en"]), " ".join(random.choices(words, k=random.randrange(40))) or None) for i in range(300)]
    d = spark.createDataFrame(docs, "id long, lang string, text string")
    questions = spark.createDataFrame([(i, random.choice(["de", "en"]), " ".join(random.choices(words + ["unheard"], k=6))) for i in range(15)], "doc_id long, lang string, text string")
    stop, sizes = {"de": ["der"], "en": ["the"]}, d.groupBy("lang").agg(F.count("*").alias("n"))
    counts, asked = sparse.term_counts(d, stop, id_col="id"), sparse.term_counts(questions, stop)
    idf = sparse.inverse_frequencies(counts, sizes)
    want = sparse.sparse_top_k(sparse.weights(counts, idf), sparse.weights(asked, idf), 7)
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = lambda df: sorted(map(tuple, df.select("lang", "query_id", "id", "rank", F.round("score", 9)).collect()))
    texts = d.select("lang", "id", "text").mapInArrow(watched, "lang string, id long, text string")
    assert rows(sparse.searched_top_k(texts, stop, sizes, asked, 7)) == rows(want)
    assert seen.value == len(docs)
    assert rows(sparse.searched_top_k(d, stop, sizes, asked, 7, 4)) == rows(want)
    assert rows(sparse.searched_top_k(d.limit(0), stop, sizes, asked, 7)) == []
    assert rows(sparse.searched_top_k(d, stop, sizes, asked.limit(0), 7)) == []


def test_texts_of_hits_move_alone(spark):
    """Documents are filtered where they lie, so a shuffle moves only what was found; beyond the bound both sides meet."""
    docs = spark.range(2000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    hits = spark.createDataFrame([(q, q * 7 + i, i + 1) for q in range(5) for i in range(3)], "query_id long, id long, rank int")
    for most in (1000, 2):
        got = retrieval.with_texts(hits, docs, most)
        assert sorted(map(tuple, got.select("query_id", "id", "rank", "text").collect())) == [(q, q * 7 + i, i + 1, f"text {q * 7 + i}") for q in range(5) for i in range(3)]
        assert ("LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()) == (most == 1000)


def test_claims_read_the_documents_for_the_pool_alone(spark, sf_dir):
    from tessera.plans import search_queries as s

    claims, hits = s._claims(spark, sf_dir)
    for df in (claims, hits):
        assert not any("documents.parquet" in f for f in df.inputFiles())


def test_chunker_works_elements_out_once(spark):
    """Prose, lists, atoms and captions come from one reading of the elements, and no window looks ahead row by row to a document's end."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    labels = ["heading", "text", "list_item", "table", "caption", "text", "figure", "caption"]
    rows = [(d, i, labels[(d + i) % 8], 1, f"t{i}") for d in range(20) for i in range(40)]
    schema = "doc_id int, seq int, label string, level int, text string"
    for kind in chunking.CHUNKERS:
        seen_before = seen.value
        out = chunking.chunk(spark.createDataFrame(rows, schema).mapInArrow(watched, schema), kind)
        assert len(out.collect()) > 0
        # the headings are read apart from the rest
        assert seen.value - seen_before <= 2 * len(rows)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedfollowing" not in plan.lower().replace("unboundedpreceding$(), unboundedfollowing$()", "") and " Join " not in plan
