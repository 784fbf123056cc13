"""Retrieval over documents, embeddings and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import stem
from ..functions.text import LINKERS, TOKEN, compound_parts, tokens
from ..operators import dense, retrieval, sparse
from ..sources.scratch import dropped, stored
from .catalog import register

#: Function words that the queries leave out.
STOP = {"de": ["der", "die", "das", "und", "in", "zu", "den", "ist", "von", "mit", "nicht", "ein", "eine", "auf"], "en": ["the", "of", "and", "a", "to", "in", "is", "that", "it", "for", "as", "with", "was"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_PARTS_SQL = "list_concat([word], flatten(list_transform(range(3, length(word) - 2), lambda i: case " + " ".join(f"when starts_with(substr(word, i + 1), '{x}') and length(word) - i - {len(x)} >= 3 then [substr(word, 1, i), substr(word, i + {len(x) + 1})]" for x in LINKERS) + " else [substr(word, i + 1)] end)))"
_WORDS_SQL = f"select lang, doc_id as id, lower(unnest(regexp_extract_all(text, '{TOKEN}'))) as word from documents where lang in ('de', 'en')"
_COUNTS_SQL = f"""words as ({_WORDS_SQL}),
wc as (select lang, word, id, count(*) as c from words where not (lang = 'de' and word in {_list(STOP["de"])}) and not (lang = 'en' and word in {_list(STOP["en"])}) and (lang = 'de' or length(word) >= 2) group by all),
vocab as (select distinct lang, word from wc),
parts as (select lang, word, unnest(case when lang = 'de' then {_PARTS_SQL} else [word] end) as part from vocab),
pm as (select lang, word, part, count(*) as m from parts where lang <> 'de' or (length(part) >= 2 and part not in {_list(STOP["de"])}) group by all),
counts as (select lang, part as term, id, sum(c * m)::bigint as tf from wc join pm using (lang, word) group by all)"""
_IDF_SQL = _COUNTS_SQL + """,
sizes as (select lang, count(*) as n from documents where lang in ('de', 'en') group by lang),
dfs as (select lang, term, count(*) as df from counts group by all),
raws as (select lang, term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from dfs join sizes using (lang)),
means as (select lang, avg(raw) as mean from raws group by lang),
idf as (select lang, term, df, case when raw < 0 then 0.25 * mean else raw end as idf from raws join means using (lang))"""
_POST_SQL = _IDF_SQL + """,
post as (select lang, term, id, tf, idf * tf / (tf + 1.5) as weight from counts join idf using (lang, term)),
qw as (select 'en' as lang, item_id as query_id, lower(unnest(regexp_extract_all(text, '""" + TOKEN + """'))) as term from benchmark),
qc as (select lang, query_id, term, count(*) as tf from qw where term not in """ + _list(STOP["en"]) + """ and length(term) >= 2 group by all),
qp as (select lang, query_id, term, idf * tf / (tf + 1.5) as wq from qc join idf using (lang, term)),
sc as (select query_id, id, sum(weight * wq) as score from post join qp using (lang, term) group by all),
sp as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from sc)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(sparse.term_counts(table(spark, sf_dir, "documents"), STOP), "counts")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("de", "en")).groupBy("lang").agg(F.count("*").alias("n"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.lit("en").alias("lang"), F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _idf(spark: SparkSession, sf_dir: str, docs: DataFrame, stop=STOP, stem=None) -> DataFrame:
    return stored(sparse.idf_of(stored(sparse.term_frequencies(docs, stop, stem), "frequencies"), _sizes(spark, sf_dir)), "idf")


def _sparse_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = sparse.whole_documents(table(spark, sf_dir, "documents"))
    q = _queries(spark, sf_dir).select("lang", F.col("query_id").alias("doc_id"), F.col("question").alias("text"))
    hits = sparse.searched_top_k(docs, STOP, _sizes(spark, sf_dir), sparse.term_counts(q, STOP), k)
    return hits.select("query_id", "id", "score", "rank")


def _dense_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return dense.dense_top_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k)


def _text_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The dense side of the same questions: documents and questions embedded alike; texts without tokens have no vector."""
    some = F.array_max(F.transform("embedding", F.abs)) > 0
    d = dense.hash_embeddings(table(spark, sf_dir, "documents")).where(some)
    q = dense.hash_embeddings(table(spark, sf_dir, "benchmark"), prefix=dense.QUERY_PREFIX, id_col="item_id").where(some)
    return dense.dense_top_k(d.select(F.col("doc_id").alias("id"), F.col("embedding").alias("v")), q.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q")), k)


def _vector_sql(name: str, text: str, source: str, key: str) -> str:
    return f"""{name}h as (select id, ('0x' || substr(md5(w), 1, 12))::bigint as h from (select {key} as id, lower(unnest(regexp_extract_all({text}, '{TOKEN}'))) as w from {source})),
{name}b as (select id, h % 64 as b, sum(case when (h >> 40) % 2 = 0 then 1 else -1 end)::double as x from {name}h group by all), {name}n as (select id, sqrt(sum(x * x)) as norm from {name}b group by id having sum(x * x) > 0),
{name}v as (select n.id, list(coalesce(x, 0) / norm order by r.b) as v from {name}n n cross join (select unnest(range(64)) as b) r left join {name}b b on b.id = n.id and b.b = r.b group by n.id)"""


_TEXT_DENSE_SQL = _vector_sql("t", "text", "documents", "doc_id") + ", " + _vector_sql("u", f"'{dense.QUERY_PREFIX}' || text", "benchmark", "item_id") + ", dn as (select q.id as query_id, d.id, list_dot_product(d.v, q.v) as score from tv d, uv q), dr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from dn)"


_DENSE_SQL = "dn as (select q.vec_id as query_id, e.vec_id as id, list_dot_product(e.embedding::double[], q.embedding::double[]) as score from embeddings e, embeddings q where q.vec_id % 50 = 0), dr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from dn)"


@register(f"select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_terms from (select doc_id, list_filter(list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: lower(x)), lambda x: x not in {_list(STOP['en'])} and length(x) >= 2) as t from documents where lang <> 'de')")
def tokens_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = F.array(*map(F.lit, STOP["en"]))
    t = F.filter(tokens(F.col("text")), lambda x: ~F.array_contains(stop, x) & (F.length(x) >= 2))
    return table(spark, sf_dir, "documents").where("lang <> 'de'").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@register(f"with {_COUNTS_SQL} select id as doc_id, sum(tf)::bigint as n_parts, count(*) as n_terms from counts where lang = 'de' group by id")
def tokens_de(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).where("lang = 'de'").groupBy(F.col("id").alias("doc_id")).agg(F.sum("tf").alias("n_parts"), F.count("*").alias("n_terms"))


@register(f"with v as (select distinct word from ({_WORDS_SQL}) where lang = 'de') select word, len({_PARTS_SQL})::bigint as n_parts, array_to_string(list_sort({_PARTS_SQL}), ' ') as parts from v")
def decompound(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    p = v.select("word", compound_parts(F.col("word")).alias("p"))
    return p.select("word", F.size("p").cast("long").alias("n_parts"), F.array_join(F.sort_array("p"), " ").alias("parts"))


@register(f"with {_IDF_SQL} select lang, term, df, round(idf, 6) as idf from idf")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.inverse_frequencies(_counts(spark, sf_dir), _sizes(spark, sf_dir)).select("lang", "term", "df", F.round("idf", 6).alias("idf"))


@register(f"with {_POST_SQL} select lang, id as doc_id, count(*) as n_terms, round(sum(weight), 4) as total_weight, round(max(weight), 6) as max_weight from post group by all")
def bm25_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    w = sparse.weights(counts, sparse.inverse_frequencies(counts, _sizes(spark, sf_dir)))
    return w.groupBy("lang", F.col("id").alias("doc_id")).agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 4).alias("total_weight"), F.round(F.max("weight"), 6).alias("max_weight"))


@register(f"with {_POST_SQL} select query_id, id as doc_id, rank, round(score, 6) as score from sp where rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse_hits(spark, sf_dir, 5).select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@register()
def stemmed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with stems and Spark's full lists of stop words, and what they weigh; held against a plain version in the tests."""
    stop = {"de": sparse.default_stop_words(spark, "german"), "en": sparse.default_stop_words(spark, "english")}
    idf = _idf(spark, sf_dir, sparse.whole_documents(table(spark, sf_dir, "documents")), stop, stem)
    return idf.select("lang", "term", "df", F.round("idf", 6).alias("idf"))


@register(f"with {_COUNTS_SQL} select lang, term, row_number() over (partition by lang order by term collate C) - 1 as term_id from (select distinct lang, term from counts)".replace(" collate C", ""))
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.vocabulary_ids(_counts(spark, sf_dir))


def _embed_sql(text: str, source: str, key: str) -> str:
    return f"""with w as (select {key} as id, unnest(list_transform(regexp_extract_all({text}, '{TOKEN}'), lambda x: lower(x))) as w from {source}),
h as (select id, ('0x' || substr(md5(w), 1, 12))::bigint as h from w), b as (select id, h % 64 as b, sum(case when (h >> 40) % 2 = 0 then 1.0 else -1.0 end)::double as x from h group by all),
n as (select id, sqrt(sum(x * x)) as norm from b group by id)
select d.{key}, 64 as dim, case when n.id is null or norm = 0 then 0.0::double else 1.0::double end as norm, coalesce(round(max(abs(x / nullif(norm, 0))), 6), 0.0) as largest, coalesce(round(sum(x / nullif(norm, 0) * (b + 1)), 4), 0.0) as checksum from {source} d left join n on n.id = d.{key} left join b on b.id = d.{key} group by d.{key}, n.id, norm"""


def _embedded(e: DataFrame, key: str) -> DataFrame:
    size = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6)
    check = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return e.select(key, F.size("embedding").alias("dim"), size.alias("norm"), F.round(F.array_max(F.transform("embedding", F.abs)), 6).alias("largest"), F.round(check, 4).alias("checksum"))


@register(_embed_sql(f"'{dense.QUERY_PREFIX}' || text", "benchmark", "item_id"))
def query_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(dense.hash_embeddings(table(spark, sf_dir, "benchmark"), prefix=dense.QUERY_PREFIX, id_col="item_id"), "item_id")


@register(_embed_sql("text", "documents", "doc_id"))
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(dense.hash_embeddings(table(spark, sf_dir, "documents")), "doc_id")


@register(f"with {_DENSE_SQL} select query_id, id as vec_id, rank, round(score, 6) as score from dr where rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense_hits(spark, sf_dir, 10).select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


_ACL_SQL = "case query_id % 4 when 0 then null when 1 then []::int[] when 2 then [1, 3, 5] else [2] end"


def _acl(q: str):
    return F.when(F.col(q) % 4 == 0, None).when(F.col(q) % 4 == 1, F.array().cast("array<int>")).when(F.col(q) % 4 == 2, F.array(F.lit(1), F.lit(3), F.lit(5))).otherwise(F.array(F.lit(2)))


@register(f"""with p as (select q.vec_id as query_id, e.vec_id as id, e.label, list_dot_product(e.embedding::double[], q.embedding::double[]) as score from embeddings e, embeddings q where q.vec_id % 50 = 0),
f as (select * from p where {_ACL_SQL} is null or list_contains({_ACL_SQL}, label)),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from f) select query_id, id as vec_id, label, rank from r where rank <= 10""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).withColumn("acl", _acl("query_id"))
    hits = dense.dense_top_k(v, q, 10)
    return hits.join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("query_id", F.col("id").alias("vec_id"), "label", "rank")


@register("""with u as (select c_custkey, case c_custkey % 3 when 0 then null when 1 then []::bigint[] else [c_custkey % 5, 7] end as choice, case c_custkey % 4 when 0 then null when 1 then []::bigint[] else [c_custkey % 5, 2] end as permitted from customer),
w as (select *, case when len(choice) > 0 then choice end as wanted from u)
select c_custkey, array_to_string(case when permitted is null then wanted when wanted is null then permitted else list_filter(wanted, lambda x: list_contains(permitted, x)) end, ',') as effective from w""")
def acl_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    none, empty = F.lit(None).cast("array<bigint>"), F.array().cast("array<bigint>")
    u = table(spark, sf_dir, "customer").select(k.alias("c_custkey"), F.when(k % 3 == 0, none).when(k % 3 == 1, empty).otherwise(F.array(k % 5, F.lit(7).cast("long"))).alias("choice"), F.when(k % 4 == 0, none).when(k % 4 == 1, empty).otherwise(F.array(k % 5, F.lit(2).cast("long"))).alias("permitted"))
    return u.select("c_custkey", F.array_join(F.transform(retrieval.effective_filter("choice", "permitted"), lambda x: x.cast("string")), ",").alias("effective"))


_HYBRID_SQL = _POST_SQL + ", " + _TEXT_DENSE_SQL + """, lists as (select query_id, id, rank from sp where rank <= 50 union all select query_id, id, rank from dr where rank <= 50),
fu as (select query_id, id, sum(1.0::double / (60 + rank)) as score from lists group by all), fr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from fu)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse_hits(spark, sf_dir, 50).select("query_id", "id", "rank").union(_text_hits(spark, sf_dir, 50).select("query_id", "id", "rank"))


@register(f"with {_HYBRID_SQL} select query_id, id, rank, round(score, 6) as score from fr where rank <= 50")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_lists(spark, sf_dir), 50).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@register(f"with {_HYBRID_SQL} select query_id, id, rank, round(score, 6) as score, d.lang, d.source from fr join documents d on d.doc_id = id where rank <= 5")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.fuse(_lists(spark, sf_dir), 5)
    return top.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source"), "id").select("query_id", "id", "rank", F.round("score", 6).alias("score"), "lang", "source")


_PASSES_SQL = _POST_SQL + ", " + _TEXT_DENSE_SQL + ", hits as (select query_id, id, 1 as pass_no, rank, score from dr where rank <= 50 union all select query_id, id, 2, rank, score from sp where rank <= 25), firsts as (select *, row_number() over (partition by query_id, id order by pass_no, rank) as rn from hits)"


def _passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _text_hits(spark, sf_dir, 50).select("query_id", "id", F.lit(1).alias("pass_no"), "rank", "score")
    return a.union(_sparse_hits(spark, sf_dir, 25).select("query_id", "id", F.lit(2).alias("pass_no"), "rank", "score"))


@register(f"with {_PASSES_SQL} select query_id, id, pass_no, rank, round(score, 6) as score from firsts where rn = 1")
def multi_pass_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.first_pass_wins(_passes(spark, sf_dir)).select("query_id", "id", "pass_no", "rank", F.round("score", 6).alias("score"))


@register(f"with {_PASSES_SQL} select query_id, id, pass_no, rank, score from (select query_id, id, pass_no, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from firsts where rn = 1) where rank <= 50")
def deep_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.deep_pool(_passes(spark, sf_dir)).select("query_id", "id", "pass_no", "rank", F.round("score", 6).alias("score"))


_TOK = "list_distinct(list_transform(regexp_extract_all({0}, '" + TOKEN + "'), lambda x: lower(x)))"
_RERANK_SQL = _POST_SQL + f""", pool as (select sp.query_id, sp.id, sp.rank, b.text as question, d.text from sp join benchmark b on b.item_id = query_id join documents d on d.doc_id = id where rank <= 50),
rs as (select query_id, id, rank, len(list_intersect({_TOK.format("question")}, {_TOK.format("text")})) / len({_TOK.format("question")}) as s, text from pool),
rr as (select query_id, id, s as score, text, row_number() over (partition by query_id order by round(s, 9) desc, rank, id) as rank from rs), top as (select * from rr where rank <= 5)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = retrieval.with_texts(_sparse_hits(spark, sf_dir, 50), docs)
    return stored(hits.join(_queries(spark, sf_dir).drop("lang"), "query_id"), "pool")


@register(f"with {_RERANK_SQL} select query_id, id as doc_id, rank, round(score, 6) as score from top")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(_pool(spark, sf_dir)).select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


_CONF_SQL = _RERANK_SQL + ", best as (select query_id, max(score) filter (rank = 1) as a, max(score) filter (rank = 2) as b from top group by all), conf as (select item_id as query_id, coalesce(a, 0) as confidence, coalesce(a - coalesce(b, 0), 0) as gap from benchmark left join best on query_id = item_id)"


@register(f"with {_CONF_SQL} select query_id, round(confidence, 6) as confidence, round(gap, 6) as gap from conf")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieval.confidence(_queries(spark, sf_dir).select("query_id"), retrieval.rerank(_pool(spark, sf_dir)))
    return c.select("query_id", F.round("confidence", 6).alias("confidence"), F.round("gap", 6).alias("gap"))


@register(f"with {_CONF_SQL}, t as (select *, query_id % 4 as attempts from conf) select query_id, attempts, case when confidence >= 0.55 then 'answer' when attempts < 3 then 'escalate' else 'abstain' end as next_step, case when confidence >= 0.55 then 'answer' else 'abstain' end as final_step from t")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieval.confidence(_queries(spark, sf_dir).select("query_id"), retrieval.rerank(_pool(spark, sf_dir)))
    c = c.withColumn("attempts", F.col("query_id") % 4)
    return c.select("query_id", "attempts", retrieval.route(F.col("confidence"), F.col("attempts")).alias("next_step"), retrieval.final_route(F.col("confidence")).alias("final_step"))


_SQUEEZE = "regexp_replace(lower({0}), '\\s+', '', 'g')"
_CLAIMS_SQL = _RERANK_SQL + f", cl as (select item_id as query_id, item_id % 5 + 1 as source, coalesce(case when item_id % 2 = 0 then substr(top.text, 11, 40) end, b.text) as quote from benchmark b left join top on top.query_id = item_id and top.rank = item_id % 5 + 1), vc as (select cl.*, coalesce(contains({_SQUEEZE.format('top.text')}, {_SQUEEZE.format('quote')}), false) as verified, id from cl left join top on top.query_id = cl.query_id and top.rank = source)"


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pool = _pool(spark, sf_dir)
    # a pool holds each text once for each question, so the documents are not read again
    hits = stored(retrieval.rerank(pool).join(pool.select("query_id", "id", "text"), ["query_id", "id"]), "hits")
    dropped(pool)
    # half of the questions quote the source that they cite, the others themselves
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5 + 1).alias("source"), F.col("text").alias("own"))
    cited = hits.select("query_id", F.col("rank").alias("source"), F.when(F.col("query_id") % 2 == 0, F.substring("text", 11, 40)).alias("said"))
    claims = b.join(cited, ["query_id", "source"], "left").select("query_id", "source", F.coalesce("said", "own").alias("quote"))
    return claims, hits


@register(f"with {_CLAIMS_SQL} select query_id, source, verified from vc")
def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.verify_claims(*_claims(spark, sf_dir)).select("query_id", "source", "verified")


@register(f"with {_CLAIMS_SQL} select query_id, source, id as doc_id from vc where verified")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, hits = _claims(spark, sf_dir)
    ok = retrieval.verify_claims(claims, hits).where("verified")
    return ok.join(hits.select("query_id", F.col("rank").alias("source"), F.col("id").alias("doc_id")), ["query_id", "source"]).select("query_id", "source", "doc_id")


@register(f"with {_CLAIMS_SQL}, n as (select query_id, count(*) as claims, count_if(verified) as cited from vc group by all) select item_id as query_id, coalesce(n.claims, 0) as claims, coalesce(n.cited, 0)::bigint as cited, case when cited > 0 then 'cited' else 'Keine Antwort gefunden.' end as answer from benchmark left join n on query_id = item_id")
def answer_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = retrieval.verify_claims(*_claims(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("claims"), F.count_if("verified").alias("cited"))
    out = retrieval.answer_rows(_queries(spark, sf_dir).select("query_id"), n.withColumn("answer", F.when(F.col("cited") > 0, "cited")), F.lit("Keine Antwort gefunden."))
    return out.select("query_id", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("cited", F.lit(0)).alias("cited"), "answer")


@register(f"with {_RERANK_SQL} select query_id, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) order by rank) as sources from top group by query_id")
def source_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _claims(spark, sf_dir)
    return retrieval.source_block(hits.withColumn("context", F.col("text")))


@register("select conv_id, turn, length(text) - length(replace(text, '?', '')) > 1 or contains(lower(text), ' und ') or contains(lower(text), ' and ') or contains(lower(text), ' sowie ') or contains(lower(text), ' compare ') or contains(lower(text), ' vergleich') or contains(lower(text), ' both ') as multi from conversations where role = 'user'")
def multi_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", retrieval.multi_part(F.col("text")).alias("multi"))


_RECALL_SQL = _RERANK_SQL + ", cases as (select item_id as query_id, case when item_id % 5 = 0 then 'abstain' when item_id % 2 = 0 then 'exact' else 'part' end as case_type, item_id % 5 = 0 as abstain, case when item_id % 2 = 0 then left(text, 60) else left(text, 12) end as kw from benchmark), ok as (select query_id, case_type, case when abstain then coalesce(max(score), 0) < 0.5 else coalesce(bool_or(contains(lower(top.text), lower(kw))), false) end as ok from cases left join top using (query_id) group by query_id, case_type, abstain)"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id")
    cases = table(spark, sf_dir, "benchmark").select(k.alias("query_id"), F.when(k % 5 == 0, "abstain").when(k % 2 == 0, "exact").otherwise("part").alias("case_type"), (k % 5 == 0).alias("abstain"), F.array(F.when(k % 2 == 0, F.substring("text", 1, 60)).otherwise(F.substring("text", 1, 12))).alias("keywords"))
    _, hits = _claims(spark, sf_dir)
    return retrieval.keyword_hits(cases, hits.withColumn("context", F.lit("")), 5)


@register(f"with {_RECALL_SQL} select query_id, case_type, ok from ok")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)


@register(f"with {_RECALL_SQL} select case_type, count(*) as cases, sum(ok::int)::bigint as hits, round(avg(ok::int), 6) as recall from ok group by rollup (case_type)")
def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieval.recall(_cases(spark, sf_dir))
    return r.select("case_type", "cases", "hits", F.round("recall", 6).alias("recall"))
