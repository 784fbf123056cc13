"""Statistics of the sparse index, kept up batch by batch.

A batch of documents replaces earlier versions of the same documents, so its change to the document
frequency of a term is signed: one more for each new text with the term, one less for each text that is
replaced. Changes are written beside the store of the documents' terms and count from the moment that the store
commits the batch, so a reader sees documents and statistics of the same batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import compound_parts, tokens
from ..operators import sparse, versions
from ..sources.scratch import dropped, release, shared_path, stored

FOLD_EVERY = 16
DELTA = "lang string, term string, change bigint"


def _changes(docs: DataFrame, sign: int) -> DataFrame:
    """(lang, term, change): a row for each term of each document (doc_id, lang, terms), and one without a term for the document itself."""
    terms = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("terms", F.array().cast("array<string>")))
    return docs.select("lang", F.explode(terms).alias("term"), F.lit(sign).cast("long").alias("change"))


def document_terms(docs: DataFrame, stop: dict[str, Sequence[str]], stems=None) -> DataFrame:
    """(doc_id, lang, terms): the different terms of each document of a registered language; documents without a term too.

    Without stems each row is worked out where it lies; stems are worked out over a vocabulary, so their terms are shuffled.
    """
    known = docs.where(F.col("lang").isin("de", "en"))
    if stems is not None:
        t = sparse.term_counts(docs, stop, stems).groupBy(F.col("id").alias("doc_id")).agg(F.array_sort(F.collect_set("term")).alias("terms"))
        return known.select("doc_id", "lang").join(t, "doc_id", "left")
    out = lambda lang: F.array(*map(F.lit, stop.get(lang, ()))).cast("array<string>")
    words = F.array_distinct(tokens(F.col("text")))
    english = F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(out("en"), w))
    parts = F.flatten(F.transform(F.filter(words, lambda w: ~F.array_contains(out("de"), w)), compound_parts))
    german = F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 2) & ~F.array_contains(out("de"), w)))
    return known.select("doc_id", "lang", F.when(F.col("lang") == "de", german).otherwise(english).alias("terms"))


def newest(batch: DataFrame, version: str = "version") -> DataFrame:
    """One row for each document of a batch, of its highest version (ties by text)."""
    w = Window.partitionBy("doc_id").orderBy(F.col(version).desc(), F.col("text").desc())
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def apply_batch(batch: DataFrame, path: str, number: int, stop: dict[str, Sequence[str]], stems=None, source: str = "stream") -> dict:
    """Take a micro-batch (doc_id, lang, text, version) into the store of terms and the statistics below ``path``.

    A batch that was committed does nothing when it comes again, one that was not writes the same files anew. A null text
    withdraws a document. Every ``FOLD_EVERY`` batches the changes so far are folded into one table.
    """
    spark = batch.sparkSession
    texts = one = stored(newest(batch), "batch")
    new = stored(document_terms(one.where("text is not null"), stop, stems), "terms")
    one = one.select("doc_id")
    release(spark)

    def before(old: DataFrame, state: dict) -> None:
        moved = _changes(new, 1).union(_changes(old, -1)).groupBy("lang", "term").agg(F.sum("change").alias("change")).where("change <> 0")
        moved.write.mode("overwrite").parquet(f"{path}/changes/{source}-{number}")
        files = [*state.get("changes", []), f"{source}-{number}"]
        if len(files) > FOLD_EVERY:
            fold = f"fold-{source}-{number}"
            _sum(spark, path, files).write.mode("overwrite").parquet(f"{path}/changes/{fold}")
            files = [fold]
        state["changes"] = files

    state = versions.write_batch(one, new, path, number, source, before_commit=before)
    dropped(texts, new)
    return state


def _sum(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    rows = spark.read.schema(DELTA).parquet(*(f"{path}/changes/{f}" for f in files))
    return rows.groupBy("lang", "term").agg(F.sum("change").alias("change")).where("change <> 0")


def statistics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Document frequencies (lang, term, df) and corpus sizes (lang, n) of the committed batches."""
    state = versions.manifest(spark, path)
    now = _sum(spark, path, state["changes"]) if state else spark.createDataFrame([], DELTA)
    return now.where("term is not null").select("lang", "term", F.col("change").alias("df")), now.where("term is null").select("lang", F.col("change").alias("n"))


def current_idf(spark: SparkSession, path: str) -> DataFrame:
    """(lang, term, df, idf) over the current documents."""
    df, sizes = statistics(spark, path)
    return sparse.idf_of(df, sizes)


def index_stream(docs: DataFrame, path: str, offsets: str, stop: dict[str, Sequence[str]], stems=None) -> None:
    """Work off a stream of documents (doc_id, lang, text, version); ``offsets`` remembers where it stands, for the next call."""
    q = docs.writeStream.foreachBatch(lambda batch, n: apply_batch(batch, path, n, stop, stems) and None).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    q.awaitTermination()


def new_index(spark: SparkSession) -> tuple[str, str]:
    """Paths for an index and for the offsets of its stream."""
    return shared_path(spark, "index"), shared_path(spark, "offsets")
