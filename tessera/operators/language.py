"""Language identification and language rules of questions and answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, stored

PROFILE_ROWS, HELD, NONE = 2_000_000, 4_000_000, (1 << 21) - 1
DEFAULT, REGISTRY, KNOWN, SURE = "de", ("de", "en"), ("de", "en", "fr", "es"), 0.80
#: Instructions about the language of the answer, in the order in which they are looked for.
INSTRUCTIONS = ((r"\banswer in english\b", "en"), (r"\banswer in german\b", "de"), (r"\bauf englisch\b", "en"), (r"\bauf deutsch\b", "de"), (r"\bin english\b", "en"), (r"\bauf deutsch antworten\b", "de"))


def grams(text: Column, chars: int | None = None) -> Column:
    """Overlapping groups of three characters, lower-cased, of the whole text or its first ``chars``; a shorter text is one group."""
    t = F.lower(F.substring(text, 1, chars) if chars else text)
    c = F.split(t, "")
    joined = lambda a, i: F.zip_with(a, F.slice(c, F.lit(i), F.size(c)), lambda x, y: F.concat(x, y))
    three = joined(joined(c, 2), 3)
    return F.when(F.length(t) >= 3, F.filter(three, lambda x: x.isNotNull())).otherwise(F.array(t))


def gram_rows(docs: DataFrame, *keep: str, chars: int | None = None) -> DataFrame:
    """A row for each of ``grams``: rows and not arrays, as compiled code joins characters without a copy of the rest."""
    t = F.lower(F.substring("text", 1, chars) if chars else F.col("text"))
    c = docs.where("text is not null").select(*keep, t.alias("__t"), F.split(t, "").alias("__c"))
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("__c") - 3, F.lit(0)))).alias("__i"))
    three = F.concat(*(F.get("__c", F.col("__i") + j) for j in range(3)))
    return c.select(*keep, F.coalesce(three, "__t").alias("gram"))


def codes(text: str) -> np.ndarray:
    """The grams of a lower-cased text as numbers: three characters of 21 bits each, ``NONE`` where a short text has none."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        c = np.append(c, np.full(3 - len(c), NONE))
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def gram_of(code: int) -> str:
    return "".join(chr(x) for x in (code >> 42, code >> 21 & NONE, code & NONE) if x != NONE)


def _lowered(docs: DataFrame, keep: str, chars: int | None) -> DataFrame:
    return docs.where("text is not null").select(keep, F.lower(F.substring("text", 1, chars) if chars else F.col("text")).alias("text"))


def gram_counts(docs: DataFrame, keep: str = "lang", chars: int | None = None) -> DataFrame:
    """(keep, gram, c): all grams of all texts, counted where the texts lie before they are shuffled."""

    def work(batches):
        for b in batches:
            found: dict[object, list[np.ndarray]] = {}
            held = 0

            def out():
                for name, parts in found.items():
                    each, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(each), b.schema.field(0).type), pa.array(map(gram_of, each.tolist()), pa.string()), pa.array(n)], names=["k", "gram", "c"])

            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                found.setdefault(name, []).append(codes(text.as_py()))
                held += len(found[name][-1])
                if held > HELD:
                    yield from out()
                    found, held = {}, 0
            yield from out()

    kind = docs.schema[keep].dataType.simpleString()
    return _lowered(docs, keep, chars).mapInArrow(work, f"{keep} {kind}, gram string, c bigint").groupBy(keep, "gram").agg(F.sum("c").alias("c"))


def profiles(labelled: DataFrame, chars: int | None = None, most: int | None = None) -> DataFrame:
    """(lang, gram, logp) with add-one smoothing, and the same of unseen grams under an empty gram. All grams of a language, or its ``most`` frequent ones."""
    c = gram_counts(labelled, chars=chars)
    n = c.groupBy("lang").agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    w = Window.partitionBy("lang").orderBy(F.col("c").desc(), "gram")
    top = (c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most) if most else c).join(F.broadcast(n), "lang")
    seen = top.where("gram <> ''").select("lang", "gram", F.log((F.col("c") + 1) / (F.col("n") + F.col("v") + 1)).alias("logp"))
    return seen.union(n.select("lang", F.lit("").alias("gram"), F.log(1 / (F.col("n") + F.col("v") + 1)).alias("logp")))


def language_scores(docs: DataFrame, profile: DataFrame, id_col: str = "doc_id", chars: int | None = None) -> DataFrame:
    """(id, lang, score): log-likelihood of a document's grams under each language, with the limits of the profile.

    A profile of at most ``PROFILE_ROWS`` rows goes to all executors as a table of numbers, and a document is scored where it lies; beyond
    that bound grams and profile meet in a join, with the same scores. Null texts have no rows, rows of one id count together.
    """
    profile = stored(profile, "profile")
    if profile.count() > PROFILE_ROWS:
        return _joined_scores(docs, profile, id_col, chars)
    rows = profile.collect()
    dropped(profile)
    langs = sorted({r.lang for r in rows if r.lang is not None})
    at = {x: i for i, x in enumerate(langs)}
    rest = np.zeros(len(langs))
    for r in rows:
        if r.gram == "" and r.lang in at:
            rest[at[r.lang]] = r.logp
    known = [r for r in rows if r.gram and r.lang in at]
    every = np.concatenate([codes(r.gram) for r in known]) if known else np.zeros(0, np.int64)
    places, where = np.unique(every, return_inverse=True)
    gain = np.zeros((len(places) + 1, len(langs)))  # the last row is that of grams that no language has
    for i, r in zip(where, known):
        gain[i, at[r.lang]] = r.logp - rest[at[r.lang]]
    table = docs.sparkSession.sparkContext.broadcast((langs, rest, places, gain))

    def work(batches):
        langs, rest, places, gain = table.value
        for b in batches:
            out = np.zeros((b.num_rows, len(langs)))
            for row, text in zip(out, b.column(1)):
                each, n = np.unique(codes(text.as_py()), return_counts=True)
                i = np.searchsorted(places, each)
                i[i == len(places)] = 0
                hit = places[i] == each if len(places) else np.zeros(len(each), bool)
                row += n.sum() * rest + n[hit] @ gain[i[hit]]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), len(langs))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(langs * b.num_rows, pa.string()), pa.array(out.reshape(-1))], names=["id", "lang", "score"])

    own = _lowered(docs.select(F.col(id_col).alias("id"), "text"), "id", chars)
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(work, f"id {kind}, lang string, score double").groupBy("id", "lang").agg(F.sum("score").alias("score"))


def _joined_scores(docs: DataFrame, profile: DataFrame, id_col: str, chars: int | None) -> DataFrame:
    c = gram_rows(docs.select(F.col(id_col).alias("id"), "text"), "id", chars=chars).groupBy("id", "gram").agg(F.count("*").alias("c"))
    base = F.broadcast(profile.where("gram = ''").select("lang", F.col("logp").alias("rest")))
    seen = profile.where("gram <> ''").join(base, "lang").select("lang", "gram", (F.col("logp") - F.col("rest")).alias("gain"))
    total = c.groupBy("id").agg(F.sum("c").alias("n")).crossJoin(base)
    gain = c.join(seen, "gram").groupBy("id", "lang").agg(F.sum(F.col("c") * F.col("gain")).alias("gain"))
    return total.join(gain, ["id", "lang"], "left").select("id", "lang", (F.col("n") * F.col("rest") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def detected(scores: DataFrame) -> DataFrame:
    """(id, lang, prob): the best language and its softmax share, ties by name."""
    p = Window.partitionBy("id")
    top = F.max("score").over(p)
    s = scores.withColumn("prob", F.exp(F.col("score") - top)).withColumn("prob", F.col("prob") / F.sum("prob").over(p))
    w = p.orderBy(F.round("score", 6).desc(), "lang")
    return s.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "lang", "prob")


def chunk_language(lang: Column) -> Column:
    return F.when(lang.isin(*KNOWN), lang).otherwise(DEFAULT)


def query_language(lang: Column, prob: Column) -> Column:
    """Another language than German must be registered and sure."""
    return F.when(lang.isin(*REGISTRY) & ((lang == DEFAULT) | (prob >= SURE)), lang).otherwise(DEFAULT)


def explicit_language(question: Column) -> Column:
    q, out = F.lower(question), F.lit(None).cast("string")
    for pattern, lang in reversed(INSTRUCTIONS):
        out = F.when(q.rlike(pattern), lang).otherwise(out)
    return out


def registered(lang: Column) -> Column:
    """The language if it is registered, else null."""
    return F.when(lang.isin(*REGISTRY), lang)


def answer_language(detected_lang: Column, explicit: Column) -> Column:
    return F.coalesce(registered(explicit), registered(detected_lang), F.lit(DEFAULT))


def active_languages(ticks: Column) -> Column:
    """German, and what is ticked and registered."""
    reg = F.array(*map(F.lit, REGISTRY))
    return F.array_union(F.array(F.lit(DEFAULT)), F.array_intersect(F.coalesce(ticks, F.array().cast("array<string>")), reg))


def translated(questions: DataFrame, translations: DataFrame) -> DataFrame:
    """(query_id, lang, text): a text for each active language; the question itself where it is in that language or has no translation."""
    q = questions.select("query_id", "question", F.col("lang").alias("source"), F.explode("active").alias("lang"))
    j = q.join(translations, ["query_id", "lang"], "left")
    return j.select("query_id", "lang", F.when(F.col("source") == F.col("lang"), F.col("question")).otherwise(F.coalesce("translated", "question")).alias("text"))


def message(lang: Column, messages: dict[str, str]) -> Column:
    """A text by language, German where there is none."""
    m = F.create_map(*(F.lit(x) for kv in messages.items() for x in kv))
    return F.coalesce(m[lang], F.lit(messages[DEFAULT]))
