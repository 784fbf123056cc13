"""Checks of extracted pages and types of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

EMPTY_CHARS, SCAN_RATIO, MIN_CONFIDENCE = 20, 0.5, 0.80
TYPES = ("prose_text", "table_structured", "norm_standard", "technical_manual", "legal_contract", "report_study", "form_template", "invoice_bill", "presentation", "correspondence", "list_heavy")


def scan_check(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, total, empty_pages, ratio, is_scan): pages of less than 20 characters are empty; half of them make a scan, and so does a document without pages."""
    p = pages.select("doc_id", "page", (F.length(strip(F.coalesce("text", F.lit("")))) < EMPTY_CHARS).alias("empty"))
    g = p.groupBy("doc_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("empty"), F.col("page")))).alias("empty_pages"))
    j = docs.select("doc_id").join(g, "doc_id", "left")
    ratio = F.coalesce(F.try_divide(F.size("empty_pages"), F.col("total")), F.lit(1.0))
    return j.select("doc_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("empty_pages", F.array().cast("array<int>")).alias("empty_pages"), ratio.alias("ratio"), (ratio >= SCAN_RATIO).alias("is_scan"))


def text_layer(paged: Column, is_scan: Column) -> Column:
    """Formats without pages always have text."""
    return F.when(~paged, True).otherwise(~is_scan)


def extraction_confidence(pages: DataFrame) -> DataFrame:
    """0.3 where a wide page has little text, else 1.0."""
    poor = (F.length(F.coalesce("text", F.lit(""))) < 50) & (F.col("width") > 100)
    return pages.groupBy("doc_id").agg(F.min(F.when(poor, 0.3).otherwise(1.0)).alias("confidence"))


def quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents to go on with, and scans that no user has called a scan."""
    held = F.col("is_scan") & (F.coalesce("user_type", F.lit("")) != "scanned_image")
    return docs.where(~held), docs.where(held)


def page_sample(pages: DataFrame, each: int = 1500, total: int = 4000) -> DataFrame:
    """(doc_id, sample): the first, middle and last page, cut and under a header."""
    w = Window.partitionBy("doc_id")
    n = F.count("*").over(w)
    t = pages.withColumn("n", n).where((F.col("page") == 1) | ((F.col("n") > 2) & (F.col("page") == F.floor(F.col("n") / 2) + 1)) | ((F.col("n") > 1) & (F.col("page") == F.col("n"))))
    part = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.substring("text", 1, each))
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", part.alias("x")))).alias("x"))
    return g.select("doc_id", F.substring(F.array_join(F.transform("x", lambda r: r["x"]), "\n"), 1, total).alias("sample"))


def keyword_types(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, doc_type, confidence): the type of most keywords in the text, ties by name; confidence is its share. The
    deterministic stand-in for a model. ``keywords`` (doc_type, keyword) is a small dimension."""
    hits = docs.select("doc_id", F.lower("text").alias("t")).join(F.broadcast(keywords), F.contains("t", F.col("keyword")), "left")
    g = hits.groupBy("doc_id", "doc_type").agg(F.count("keyword").alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    w = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "doc_type")
    best = g.select("doc_id", "doc_type", F.try_divide("n", total).alias("confidence"), F.row_number().over(w).alias("rn")).where("rn = 1")
    return best.select("doc_id", F.coalesce("doc_type", F.lit("prose_text")).alias("doc_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def parsed_type(raw: Column) -> Column:
    """struct(doc_type, confidence) from a model's answer: fences are dropped, unknown labels and broken answers count as prose with 0,
    confidence is held to 0..1, and less than 0.8 means prose."""
    body = F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    got = F.from_json(body, "type string, confidence double")
    known = F.coalesce(got["type"].isin(*TYPES), F.lit(False))
    conf = F.when(known, F.least(F.greatest(F.coalesce(got["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.struct(F.when(known & (conf >= MIN_CONFIDENCE), got["type"]).otherwise("prose_text").alias("doc_type"), conf.alias("confidence"))


def resolved(user_type: Column, detected: Column, confidence: Column) -> tuple[Column, Column]:
    """The user's type with full confidence, else the detected one."""
    return F.coalesce(user_type, detected), F.when(user_type.isNotNull(), 1.0).otherwise(confidence)


def dispatched(docs: DataFrame, handlers: DataFrame, default: str = "prose_text") -> DataFrame:
    """Adds the handler's columns by ``doc_type``; unknown types get the default's."""
    known = docs.join(F.broadcast(handlers.select(F.col("doc_type").alias("__k"))), F.col("doc_type") == F.col("__k"), "left")
    keyed = known.withColumn("handled_as", F.coalesce("__k", F.lit(default))).drop("__k")
    return keyed.join(F.broadcast(handlers.withColumnRenamed("doc_type", "handled_as")), "handled_as", "left")


def table_roles(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds ``role``: the first role of the type (by priority) with a keyword in the joined, lower-cased headers."""
    t = tables.withColumn("__h", F.lower(F.array_join("headers", " ")))
    s = F.broadcast(schemas.withColumnRenamed("doc_type", "__type"))
    j = t.join(s, (F.col("doc_type") == F.col("__type")) & F.contains("__h", F.col("keyword")), "left")
    g = j.groupBy("table_id").agg(F.min_by("role", "priority").alias("role"))
    return tables.join(g, "table_id").withColumn("role", F.coalesce("role", F.lit("data_table")))
