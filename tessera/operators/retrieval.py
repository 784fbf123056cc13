"""Filters, fusion, reranking, confidence, and checks of answers, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed, tokens

RRF_K, POOL, FINAL, CONFIDENT, ATTEMPTS = 60, 50, 5, 0.55, 3
#: Ids that are sent to all executors at most.
BROADCAST_IDS = 1_000_000


def allowed(choice: str, value: str) -> Column:
    """Null does not restrict, an empty list allows nothing, else membership."""
    return F.col(choice).isNull() | F.coalesce(F.array_contains(choice, F.col(value)), F.lit(False))


def effective_filter(choice: str, permitted: str) -> Column:
    """The user's choice within what is permitted; an empty choice counts as none, and neither widens the other."""
    wanted = F.when(F.size(choice) > 0, F.col(choice))
    return F.when(F.col(permitted).isNull(), wanted).when(wanted.isNull(), F.col(permitted)).otherwise(F.filter(wanted, lambda x: F.array_contains(permitted, x)))


def fuse(lists: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (query_id, id, rank from 1) of several lists -> (query_id, id, score, rank), k best."""
    score = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("score"))
    return ranked(score, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sub_question_rows(queries: DataFrame) -> DataFrame:
    """(query_id, pass_no, question): each part of a question in its order, from 1; without parts the question itself."""
    parts = F.when(F.size(F.coalesce("sub_questions", F.array().cast("array<string>"))) > 0, F.col("sub_questions")).otherwise(F.array("question"))
    return queries.select("query_id", F.posexplode(parts).alias("p", "question")).select("query_id", (F.col("p") + 1).alias("pass_no"), "question")


def translated_rows(queries: DataFrame, translations: DataFrame) -> DataFrame:
    """(query_id, lang, pass_no, question): translations (query_id, lang, text) that differ from the first part, as passes behind
    those of the parts, in the order of the language."""
    parts = sub_question_rows(queries)
    ends = parts.groupBy("query_id").agg(F.max("pass_no").alias("last"), F.min_by("question", "pass_no").alias("first"))
    t = translations.join(ends, "query_id").where(F.col("text") != F.col("first"))
    no = F.col("last") + F.row_number().over(Window.partitionBy("query_id").orderBy("lang"))
    return t.select("query_id", "lang", no.alias("pass_no"), F.col("text").alias("question"))


def passes(queries: DataFrame, translations: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int = POOL) -> DataFrame:
    """(query_id, id, pass_no, rank, score) of all passes: ``k`` hits for each part, half of it for each translation.

    ``search`` takes (list_id, lang, question) for many lists at once and k, and gives (list_id, id, rank, score); lang
    is null where all languages are asked.
    """
    own = sub_question_rows(queries).select("query_id", "pass_no", F.lit(None).cast("string").alias("lang"), "question")
    rows = own.withColumn("k", F.lit(k)).unionByName(translated_rows(queries, translations).withColumn("k", F.lit(k // 2)))
    rows = rows.withColumn("list_id", F.concat_ws("|", F.col("query_id").cast("string"), F.col("pass_no").cast("string")))
    hits = search(rows.select("list_id", "lang", "question"), k)
    return hits.join(rows.select("list_id", "query_id", "pass_no", "k"), "list_id").where("rank <= k").select("query_id", "id", "pass_no", "rank", "score")


def history_block(turns: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(conv_id, history): ``label: text`` lines of the turns in order; roles without a label are left out."""
    names = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    rows = turns.withColumn("label", names[F.col("role")]).where("label is not null")
    got = F.array_sort(F.collect_list(F.struct("turn", F.concat("label", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(got, lambda x: x["line"]), "\n").alias("history"))


def with_texts(hits: DataFrame, docs: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``hits`` with all columns of ``docs`` (id, ...). Up to ``most`` ids go to where the documents lie, so that only texts that
    were found are moved; more are met by a join of both."""
    ids = hits.select("id").distinct()
    if ids.limit(most + 1).count() <= most:
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    return hits.join(docs, "id")


def first_pass_wins(hits: DataFrame) -> DataFrame:
    """A chunk found in several passes keeps the hit of the first (query_id, id, pass_no, rank, score)."""
    w = Window.partitionBy("query_id", "id").orderBy("pass_no", "rank")
    return hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def deep_pool(hits: DataFrame, k: int = POOL) -> DataFrame:
    return ranked(first_pass_wins(hits).select("query_id", "id", "pass_no", "score"), k)


def lexical_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text has: the deterministic stand-in for a reranker."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax of two logits."""
    return 1 / (1 + F.exp(no - yes))


def rerank(pool: DataFrame, k: int = FINAL, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``pool`` (query_id, id, rank, question, text) -> (query_id, id, score, rank), k best.

    ``scorer`` adds ``rerank_score``; rows it leaves null keep the order of retrieval behind the others.
    """
    got = scorer(pool) if scorer else pool.withColumn("rerank_score", lexical_score(F.col("question"), F.col("text")))
    w = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc_nulls_last(), "rank", "id")
    return got.select("query_id", "id", F.col("rerank_score").alias("score"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, confidence, gap): the best score, and its lead over the second (itself if there is one hit); 0 and 0 without hits."""
    top = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    return queries.join(top, "query_id", "left").select("query_id", F.coalesce("a", F.lit(0.0)).alias("confidence"), F.coalesce(F.col("a") - F.coalesce("b", F.lit(0.0)), F.lit(0.0)).alias("gap"))


def route(conf: Column, attempts: Column) -> Column:
    """What happens next: answer, escalate or abstain."""
    return F.when(conf >= CONFIDENT, "answer").when(attempts < ATTEMPTS, "escalate").otherwise("abstain")


def final_route(conf: Column) -> Column:
    """Retries do not change a score, so the loop ends like this."""
    return F.when(conf >= CONFIDENT, "answer").otherwise("abstain")


def multi_part(question: Column) -> Column:
    """Whether a question asks for several things."""
    q = F.lower(question)
    out = F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit(""))) > 1
    for word in (" und ", " and ", " sowie ", " compare ", " vergleich", " both "):
        out = out | F.contains(q, F.lit(word))
    return out


def source_block(hits: DataFrame) -> DataFrame:
    """(query_id, sources): numbered contexts in rank order, with blank lines between."""
    got = F.array_sort(F.collect_list(F.struct("rank", "id", "context")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(got, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["context"])), "\n\n").alias("sources"))


def verify_claims(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds ``verified`` to ``claims`` (query_id, source from 1, quote): whether the quote stands in the cited hit, white space and case aside."""
    h = hits.select("query_id", F.col("rank").alias("source"), F.col("text").alias("__text"))
    out = claims.join(h, ["query_id", "source"], "left")
    return out.withColumn("verified", F.coalesce(F.contains(squeezed(F.col("__text")), squeezed(F.coalesce("quote", F.lit("")))), F.lit(False))).drop("__text")


def answer_rows(queries: DataFrame, answers: DataFrame, message: Column) -> DataFrame:
    """One row for each question: its answer, or ``message`` where there is none."""
    return queries.join(answers, "query_id", "left").withColumn("answer", F.coalesce("answer", message))


def keyword_hits(cases: DataFrame, hits: DataFrame, k: int, abstain_below: float = 0.5) -> DataFrame:
    """(query_id, case_type, ok): a keyword stands in one of the k best hits; without keywords always; cases
    that expect no answer are right if the best score is below ``abstain_below``."""
    j = cases.join(hits.where(F.col("rank") <= k), "query_id", "left")
    body = F.lower(F.concat_ws(" ", F.col("text"), F.col("context")))
    found = F.coalesce(F.exists("keywords", lambda w: F.contains(body, F.lower(w))), F.lit(False))
    g = j.groupBy("query_id", "case_type", "abstain").agg(F.max(found).alias("any"), F.max(F.size("keywords")).alias("n"), F.max("score").alias("top"))
    return g.select("query_id", "case_type", F.when(F.col("abstain"), F.coalesce("top", F.lit(0.0)) < abstain_below).otherwise((F.col("n") <= 0) | F.col("any")).alias("ok"))


def recall(results: DataFrame) -> DataFrame:
    """(case_type, cases, hits, recall): per type, and over all in the row of a null type."""
    return results.rollup("case_type").agg(F.count("*").alias("cases"), F.sum(F.col("ok").cast("int")).alias("hits"), F.avg(F.col("ok").cast("int")).alias("recall"))
