"""The corpus pipeline: five stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, linededup, ngramjoin, toxicity
from tessera.llm.docstats import fold
from tessera.llm.rowkeys import with_key
from tessera.llm.scratch import save


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger rejects (score 0.7 or more) go. Each row is judged by its own text, whatever its doc_id, so rows
    pass through one map and nothing is shuffled; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return toxicity.below(docs, model, threshold=0.7)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match earlier ones go; a document of which nothing is left goes with them, null and blank texts stay. Repeated rows
    count as one document, rows without a doc_id stay as they are. n_chars, where there is such a column, follows the text."""
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("rest")
    out = linededup.dedup_lines(docs.select("doc_id", "text", rest))
    out = out.where((F.col("n_removed") == 0) | F.coalesce(F.length(F.trim("text")) > 0, F.lit(True)))
    n = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*(F.col("text") if c == "text" else n.alias(c) if c == "n_chars" else F.col(f"rest.{c}") for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id. Rows of one doc_id and text are copies, of which
    one stays (the smallest by its columns); rows of one doc_id with different texts are documents of their own; rows
    without a doc_id all stay. Texts are shuffled a second time only for repeated rows."""
    keyed = with_key(docs, "doc_id", "text", "__key")
    groups = ngramjoin.near_duplicates(keyed, "__key").where("__key <> component_id").select("__key").distinct()
    left = keyed.join(groups, "__key", "left_anti")
    twice = save(left.groupBy("__key").agg(F.count("*").alias("n")).where("__key is not null and n > 1").select("__key"))
    if twice.isEmpty():
        return left.select(docs.columns)
    one = left.join(twice, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")
    return left.join(twice, "__key", "left_anti").select(docs.columns).unionByName(one)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; rows of one doc_id are one document here, and rows without one stay. Null and
    empty texts contain nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: token counts, ids' digests and round trips; null texts count as empty."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage), ("benchmark decontamination", benchmark_stage), ("BPE encoding and decoding", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs)
    return docs


#: The first and the last stage are beyond SQL; tests/llm/test_brute.py holds the rows of run() against plain loops.
ORACLE_SQL = None
