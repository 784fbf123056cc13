"""Benchmark decontamination by MinHash containment search, partitioned by size.

Items are short and documents long, so Jaccard similarity says little; what counts is the
share of an item's five-word shingles that a document holds. Items are partitioned by size
(powers of two), and in each partition an item is searched by its bottom-k sketch, the k smallest
hashes of its shingles. k is one more than the shingles that an item of the partition's largest size
may miss at the threshold, so a document that contains enough of the item holds a value of the
sketch in every case.

1. The sketches alone are joined with the shingles of all documents, which gives candidate pairs.
2. Only documents that are in a candidate pair are read again, and only for these pairs are all
   shingles of the item counted, which is the exact containment.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save
from .shingles import WIDTH, shingle_rows, words

THRESHOLD_PERCENT = 75
BROADCAST_ROWS = 200_000


def item_sketches(items: DataFrame, item_col: str, text_col: str, percent: int) -> DataFrame:
    """(item, width, n, h, in_sketch): a row for each distinct shingle of each item that has words."""
    w = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    s = shingle_rows(w.select("item", F.least(F.size("w"), F.lit(WIDTH)).alias("width"), "w"))
    s = s.groupBy("item").agg(F.sort_array(F.collect_set(F.struct("h", "width"))).alias("s"))
    n = F.size("s")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) + 1) - 1  # of the partition
    k = F.floor(largest * (100 - percent) / 100) + 1
    return s.select("item", n.alias("n"), k.alias("k"), F.posexplode("s").alias("p", "x")).select("item", "x.width", "n", "x.h", (F.col("p") < F.col("k")).alias("in_sketch"))


def _found(texts: DataFrame, shingles: DataFrame) -> DataFrame:
    """Distinct (item, doc, n, h) where a row of ``texts`` (doc, w) holds one of ``shingles`` (item, width, n, h)."""
    hits = None
    for width, n in sorted((r.width, r.n) for r in shingles.groupBy("width").agg(F.count("*").alias("n")).collect()):  # five rows at most
        own = shingles.where(F.col("width") == width).select("item", "n", "h")
        rows = shingle_rows(texts, width)
        got = rows.join(F.broadcast(own) if n <= BROADCAST_ROWS else own, "h").select("item", "doc", "n", "h")
        hits = got if hits is None else hits.union(got)
    return shingles.select("item", F.lit(None).alias("doc"), "n", "h").limit(0) if hits is None else hits.distinct()


def candidate_pairs(docs: DataFrame, sketches: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item, doc): documents that hold a value of an item's sketch."""
    return _found(_texts(docs, doc_col, text_col), sketches.where("in_sketch")).select("item", "doc").distinct()


def _texts(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(doc_col).alias("doc"), words(F.col(text_col)).alias("w")).where((F.size("w") > 0) & F.col("doc").isNotNull())


def contained_items(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Pairs where a document holds at least ``percent`` % of an item's distinct shingles:
    (item, document, n_shingles, n_shared, containment).

    Items of fewer than five words are one shingle of that many words. Null, empty and blank texts and documents
    without an id match nothing. Rows of one id are one document (or item), whose shingles are those of all its texts;
    other columns are ignored. Sketches, and ids of documents in candidate pairs, go to all executors
    only after a count has shown that they are few; otherwise they are joined by a shuffle.
    """
    sketches = save(item_sketches(items, item_col, text_col, percent))
    pairs = save(candidate_pairs(docs, sketches, doc_col, text_col))
    some = pairs.select(F.col("doc").alias(doc_col)).distinct()
    again = docs.select(doc_col, text_col).join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, doc_col, "left_semi")
    hits = _found(_texts(again, doc_col, text_col), sketches).join(pairs, ["item", "doc"], "left_semi")
    found = hits.groupBy("item", "doc").agg(F.max("n").alias("n"), F.count("*").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n") * percent)
    return found.select(F.col("item").alias(item_col), F.col("doc").cast(docs.schema[doc_col].dataType).alias(doc_col), F.col("n").cast("long").alias("n_shingles"), "n_shared", F.round(F.col("n_shared") / F.col("n"), 6).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows without an id stay."""
    bad = contained_items(docs, items, doc_col, item_col, text_col, percent).select(doc_col).distinct()
    return docs.join(bad, doc_col, "left_anti").select(docs.columns)
