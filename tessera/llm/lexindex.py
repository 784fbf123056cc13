"""Ranked lexical search over an index in strata of equal length.

A term counts for a document by its occurrences tf and the document's normaliser m alone, so documents of equal m make a
stratum, and in it a term's postings lie by tf: what a term adds is worked out once for each tf. The largest tf
of each term gives a bound on every score in a stratum, and strata are visited from the highest
bound down until the k-th score found is out of reach.

The index is cut into pieces of about ``PIECE`` postings along the order of length. A piece holds strata (or a share of a large
one) and has a row for each of its terms. All arithmetic of scores is in whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, release, save

PIECE = 1 << 20
BLOCK_TERMS = 100_000
FIRST = 3
#: Letters and digits of ASCII and everything beyond it make terms; capital letters of ASCII become small ones.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
VECTOR = "id bigint, n bigint, terms binary, tfs binary"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text in order; no UTF-8 byte of a letter beyond ASCII is one of ASCII, so bytes can be split."""
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


def term_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs): each row's number of terms, its different terms joined by blanks, and how often each occurs (int32)."""

    def work(batches):
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b.column(1):
                c = Counter(words := terms_of(text.as_py()))
                n.append(len(words))
                terms.append(b" ".join(c))
                tfs.append(np.fromiter(c.values(), np.int32, len(c)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(work, VECTOR)


def normalisers(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents of ``n`` terms among ``docs`` documents of ``total`` terms, in whole numbers of any size."""
    each, back = np.unique(n, return_inverse=True)
    return np.array([25 + 75 * int(x) * docs // total for x in each], np.int64)[back]


def _piece(number: int, ids: list, n: list, terms: list, tfs: list, docs: int, total: int) -> pa.RecordBatch:
    words = [t.split(b" ") for t in terms]
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    names = flat.dictionary.to_pylist()
    rank = np.empty(len(names), np.int64)
    by_name = sorted(range(len(names)), key=names.__getitem__)
    rank[by_name] = np.arange(len(names))
    term = rank[flat.indices.to_numpy()]
    tf = np.concatenate([np.frombuffer(x, np.int32) for x in tfs])
    doc = np.repeat(np.arange(len(ids)), [len(w) for w in words])
    m = normalisers(np.array(n), docs, total)
    order = np.lexsort((doc, -tf, m[doc], term))
    term, tf, doc = term[order], tf[order], doc[order]
    new_term = np.diff(term, prepend=-1) != 0
    new = np.flatnonzero(new_term | (np.diff(m[doc], prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))
    sizes = np.diff(np.append(new, len(term)))
    first = np.flatnonzero(new_term)
    groups = np.append(np.searchsorted(new, first), len(new)).astype(np.int32)
    posts = np.append(first, len(term)).astype(np.int32)

    def lists(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at]).astype(np.int32)), pa.array(values, kind))

    # the first row, of the term that no text has, holds the documents
    cols = [
        pa.array(np.full(len(names) + 1, number)),
        pa.array([b"", *(names[i] for i in by_name)], pa.binary()).cast(pa.string()),
        lists(groups, m[doc[new]], pa.int64()),
        lists(groups, tf[new], pa.int32()),
        lists(groups, sizes, pa.int32()),
        lists(posts, doc, pa.int32()),
        pa.ListArray.from_arrays(pa.array(np.append(0, np.full(len(names) + 1, len(ids))).astype(np.int32)), pa.array(ids, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["piece", "term", "ms", "tfs", "sizes", "docs", "ids"])


def build_index(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """The index of ``term_vectors`` that were saved, the number of documents that have a term, and the number of their terms.

    Index rows: piece, term, ms, tfs and sizes (one entry for each m and tf, by m, then by falling tf), docs (places in the piece of the documents of
    each of these), ids (in the row of the empty term: the documents' ids by place). Rows of one id are documents of their own, rows without
    an id and without terms too, and the latter are in no posting.
    """
    from pyspark import TaskContext

    docs, total = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def work(batches):
        number = TaskContext.get().partitionId() << 32
        held, postings = [[], [], [], []], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                for a, x in zip(held, row):
                    a.append(x)
                postings += len(row[3]) // 4
                if postings >= PIECE:
                    yield _piece(number, *held, docs, total)
                    held, postings, number = [[], [], [], []], 0, number + 1
        if held[0]:
            yield _piece(number, *held, docs, total)

    key = F.xxhash64("id", "terms")
    dealt = vectors.where("n > 0").repartitionByRange("n", key).sortWithinPartitions("n", "id")
    return save(dealt.mapInArrow(work, "piece bigint, term string, ms array<bigint>, tfs array<int>, sizes array<int>, docs array<int>, ids array<bigint>")), docs, total


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Piece:
    """Rows of one piece for the terms of some queries, with postings or for bounds alone; what a term adds is worked out once for each m and tf."""

    def __init__(self, table: pa.Table, weight: dict[str, int]):
        self.terms: dict[str, tuple[np.ndarray, ...]] = {}
        self.postings: dict[str, tuple[np.ndarray, ...]] = {}
        self.ids = np.zeros(0, np.int64)
        rows = {}
        whole = "docs" in table.column_names
        for i, term in enumerate(table.column("term").to_pylist()):
            if term in weight:
                m = table.column("ms")[i].values.to_numpy()
                rows[term] = (i, m, weight[term] * impact(table.column("tfs")[i].values.to_numpy(), m))
            elif not term and whole:
                ids = table.column("ids")[i].values
                self.ids = ids.to_numpy() if not ids.null_count else np.array(ids.to_pylist(), object)
        self.ms = np.unique(np.concatenate([r[1] for r in rows.values()])) if rows else np.zeros(0, np.int64)
        for term, (i, m, add) in rows.items():
            stratum = np.searchsorted(self.ms, m)
            top = np.flatnonzero(np.diff(m, prepend=-1))  # the largest tf of a stratum comes first
            self.terms[term] = (stratum[top], add[top])
            if whole:
                sizes = table.column("sizes")[i].values.to_numpy()
                self.postings[term] = (np.repeat(stratum, sizes), table.column("docs")[i].values.to_numpy(), np.repeat(add, sizes))

    def bounds(self, query: dict[str, int]) -> np.ndarray:
        out = np.zeros(len(self.ms), np.int64)
        for term, times in query.items():
            if term in self.terms:
                at, add = self.terms[term]
                out[at] += times * add
        return out

    def best(self, query: dict[str, int], k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of documents that may be among the k best with ``least`` or more, and the number of strata visited."""
        bound = self.bounds(query)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= least]
        known = [t for t in query if t in self.terms]
        place, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 4
        while at < len(order) and bound[order[at]] >= least:
            open_ = np.zeros(len(self.ms), bool)
            open_[order[at : at + step]] = True
            at, step = min(len(order), at + step), step * 4
            sums = np.zeros(len(self.ids), np.int64)
            for t in known:
                stratum, docs, add = self.postings[t]
                here = open_[stratum]
                sums[docs[here]] += query[t] * add[here]
            found = np.flatnonzero(sums >= least)
            place, score = np.concatenate([place, found]), np.concatenate([score, sums[found]])
            if len(score) > k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
                near = score >= least
                place, score = place[near], score[near]
        return place, score, at


def _bounds(hits: DataFrame, queries: dict, weight: dict) -> DataFrame:
    """(piece, item_id, bound): the highest bound of a piece's strata for each item."""
    kept = hits.sparkSession.sparkContext.broadcast((queries, weight))

    def work(table: pa.Table) -> pa.Table:
        queries, weight = kept.value
        piece = Piece(table, weight)
        got = [(i, int(b.max())) for i, q in queries.items() if len(b := piece.bounds(q)) and b.max() > 0]
        number = table.column("piece")[0].as_py()
        return pa.table({"piece": pa.array([number] * len(got), pa.int64()), "item_id": pa.array([i for i, _ in got], pa.int64()), "bound": pa.array([b for _, b in got], pa.int64())})

    return hits.select("piece", "term", "ms", "tfs").where("term <> ''").groupBy("piece").applyInArrow(work, "piece bigint, item_id bigint, bound bigint")


def _scores(hits: DataFrame, visits: DataFrame, queries: dict, weight: dict, k: int) -> DataFrame:
    """(item_id, doc_id, score, visited) of the visits (piece, item_id, least): what may be among the k best of each visit."""
    kept = hits.sparkSession.sparkContext.broadcast((queries, weight))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, weight = kept.value
        item, doc, score, visited = [], [], [], []
        if len(left) and len(right):
            piece = Piece(left, weight)
            for i, least in zip(right.column("item_id").to_pylist(), right.column("least").to_pylist()):
                places, s, n = piece.best(queries[i], k, least)
                at = np.lexsort((piece.ids[places], -s))[:k] if piece.ids.dtype != object else np.argsort(-s, kind="stable")
                item += [i] * len(at)
                doc += piece.ids[places[at]].tolist()
                score += s[at].tolist()
                visited += [n] * len(at)
        return pa.table({"item_id": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64()), "visited": pa.array(visited, pa.int64())})

    return hits.groupBy("piece").cogroup(visits.groupBy("piece")).applyInArrow(work, "item_id bigint, doc_id bigint, score bigint, visited bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _queries(items: DataFrame) -> Iterator[dict[int, dict[str, int]]]:
    """Items' terms in blocks of about ``BLOCK_TERMS``; rows of one item_id with different texts count together, equal rows once."""
    own = save(term_vectors(items.where("item_id is not null").select("item_id", "text").distinct(), "item_id").where("n > 0"))
    n = own.agg(F.coalesce(F.sum(F.length("tfs") / 4), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(n / BLOCK_TERMS))
    for i in range(blocks):
        out: dict[int, Counter] = {}
        for r in own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect():
            out.setdefault(r.id, Counter()).update(dict(zip(bytes(r.terms).decode("utf-8", "surrogatepass").split(" "), np.frombuffer(r.tfs, np.int32).tolist())))
        if out:
            yield {i: dict(c) for i, c in out.items()}
    drop(own)


def search(index: DataFrame, docs: int, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score, visited): the k best documents of each item (item_id, text) with a score above 0, equal scores by
    ascending doc_id; ``visited`` is the number of strata seen in the document's piece.

    Items come in blocks of at most about ``BLOCK_TERMS`` terms; a block's terms are all that is broadcast. The ``FIRST`` pieces
    of the highest bounds give each item a k-th score, then all pieces are visited that may still reach it. Items
    without terms have no rows.
    """
    spark = index.sparkSession
    out = None
    for queries in _queries(items):
        names = sorted({t for q in queries.values() for t in q})
        asked = F.broadcast(spark.createDataFrame([(t,) for t in ["", *names]], "term string"))
        hits = save(index.join(asked, "term", "left_semi"))
        df = hits.where("term <> ''").groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()
        weight = {r.term: term_weight(docs, r.df) for r in df}
        bounds = save(_bounds(hits, queries, weight))
        order = Window.partitionBy("item_id").orderBy(F.desc("bound"), "piece")
        dealt = bounds.withColumn("no", F.row_number().over(order))
        first = save(_scores(hits, dealt.where(F.col("no") <= FIRST).select("piece", "item_id", F.lit(1).cast("long").alias("least")), queries, weight, k))
        kth = _ranked(first, k).where(F.col("rank") == k).select("item_id", F.col("score").alias("kth"))
        rest = dealt.where(F.col("no") > FIRST).join(kth, "item_id", "left").select("piece", "item_id", F.coalesce("kth", F.lit(1)).alias("least"), "bound").where("bound >= least")
        block = save(_ranked(first.union(_scores(hits, rest.drop("bound"), queries, weight, k)), k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "visited"))
        for x in (hits, bounds, first):
            drop(x)
        out = block if out is None else out.union(block)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint, visited bigint")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index all ``documents`` and search them for all ``items``."""
    vectors = save(term_vectors(documents))
    index, docs, _ = build_index(vectors)
    drop(vectors)
    release(documents.sparkSession)
    out = search(index, docs, items, k)
    drop(index)
    return out
