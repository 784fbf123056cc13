"""File records, stores, prompts, reference lists and passes over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..operators import chunking, governance, quality, retrieval, sparse, versions
from ..sources import files
from ..sources.scratch import shared_path, stored
from .catalog import register
from .ingest_queries import _LEAVES, _TYPES, _page_chunks, _typed
from .search_queries import table
from .source_queries import _file


@register("""select 'f' || doc_id::varchar || case doc_id % 4 when 0 then '.txt' when 1 then '.md' when 2 then '.HTML' else '.exe' end as path, case doc_id % 4 when 0 then 'text' when 1 then 'markdown' when 2 then 'html' end as format,
case doc_id % 4 when 0 then 'text/plain' when 1 then 'text/markdown' when 2 then 'text/html' end as mime_type, 'utf-8' as encoding, sha256(text) as text_hash from documents""")
def text_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(k == 0, ".txt").when(k == 1, ".md").when(k == 2, ".HTML").otherwise(".exe"))
    return files.read_text(_file(table(spark, sf_dir, "documents"), path, F.encode("text", "UTF-8"))).select("path", "format", "mime_type", "encoding", F.sha2("text", 256).alias("text_hash"))


@register("select 'text' as format, count(*) as n_lines, sum(length(line))::bigint as n_chars from (select unnest(string_split(text, chr(10))) as line from documents)")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents written as text files, scanned and read again by format."""
    path = shared_path(spark, "files")
    table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    lines = files.read_text(files.scan(spark, path)).select("format", F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    return lines.groupBy("format").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two text parts and an attachment for each turn; every fifth names a charset that does not exist."""
    c = table(spark, sf_dir, "conversations")
    turn, body = F.col("turn").cast("string"), F.concat(F.lit("said: "), F.col("text"))
    kind = F.when(F.col("turn") % 5 == 4, "x-none").otherwise("utf-8")
    head = lambda t: F.concat(F.lit(f"Content-Type: {t}; charset="), kind, F.lit("\nContent-Transfer-Encoding: 8bit\n"))
    raw = F.concat(F.lit("From: "), "role", F.lit("@example.com\nTo: all@example.com\nSubject: turn "), turn, F.lit("\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=\"--==cut\"\n\n----==cut\n"), head("text/plain"), F.lit("\n"), body, F.lit("\n----==cut\n"), head("text/html"), F.lit("\n<p>turn "), turn, F.lit("</p>\n----==cut\n"), head("text/plain"), F.lit("Content-Disposition: attachment; filename=a.txt\n\nno\n----==cut--\n"))
    return _file(c, F.concat_ws("-", F.lit("m"), F.col("conv_id").cast("string"), F.concat(turn, F.lit(".eml"))), F.encode(raw, "UTF-8"))


@register("select 'm-' || conv_id::varchar || '-' || turn::varchar || '.eml' as path, 1 as attachments, 0 as faults, sha256('From: ' || role || '@example.com' || chr(10) || 'To: all@example.com' || chr(10) || 'Subject: turn ' || turn::varchar || chr(10) || 'Date: Mon, 01 Jan 2024 00:00:00 +0000' || chr(10) || chr(10) || 'said: ' || text) as text_hash from conversations")
def mail_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files.read_mail(_mails(spark, sf_dir))
    t = files.rendered_mail(m).select("path", F.sha2("text", 256).alias("text_hash"))
    return m.select("path", "attachments", F.size("warnings").alias("faults")).join(t, "path")


@register("select 'm-' || conv_id::varchar || '-' || turn::varchar || '.eml' as path, part, case part when 0 then 'text/plain' else 'text/html' end as content_type, sha256(case part when 0 then 'said: ' || text else '<p>turn ' || turn::varchar || '</p>' end) as text_hash from conversations, (values (0), (1)) p(part)")
def mail_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.mail_leaves(_mails(spark, sf_dir)).select("path", "part", "content_type", F.sha2("text", 256).alias("text_hash"))


@register("select 'b' || item_id::varchar || '.svg' as path, case item_id % 3 when 0 then '' else 'Item ' || item_id::varchar end as text, (item_id % 3 = 0)::int as faults from benchmark union all select 'b' || item_id::varchar || '.csv', case item_id % 3 when 1 then '' else item_id::varchar || ' | ' || repeat('x', 200000) end, (item_id % 3 = 1)::int from benchmark")
def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that cannot be parsed costs its own row's text and leaves a warning; a very long cell is no fault."""
    b = table(spark, sf_dir, "benchmark")
    k, no = F.col("item_id") % 3, F.col("item_id").cast("string")
    svg = files.read_svg(_file(b, F.concat(F.lit("b"), no, F.lit(".svg")), F.concat(F.lit("<svg><text>Item "), no, F.when(k == 0, "</svg>").otherwise("</text></svg>"))))
    cells = F.concat(no, F.lit(","), F.repeat(F.lit("x"), 200_000))
    rows = files.read_delimited(_file(b, F.concat(F.lit("b"), no, F.lit(".csv")), F.when(k != 1, cells)))
    return svg.select("path", "text", F.size("warnings").alias("faults")).unionByName(rows.select("path", "text", F.size("warnings").alias("faults")))


@register("""select p_partkey, sha256(case when p_partkey % 2 = 0 then '=== Sheet: ' || p_brand || ' ===' else '--- Table ---' end || chr(10) || p_name || ' | ' || p_type || case when p_partkey % 3 = 0 then '' else chr(10) || ' | ' || p_size::varchar end) as text_hash from part""")
def table_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    rows = F.array(F.array("p_name", "p_type"), F.array(F.lit(""), F.when(k % 3 == 0, "").otherwise(size)))
    p = table(spark, sf_dir, "part").select("p_partkey", rows.alias("data"), F.when(k % 2 == 0, F.col("p_brand")).alias("title"))
    return p.select("p_partkey", F.sha2(files.table_text("data", F.col("title")), 256).alias("text_hash"))


@register("select item_id as id, text as query, 'exact' as case_type, item_id % 5 = 0 as expected_abstain from benchmark")
def eval_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation files of a thousand cases each, written and read again."""
    path = shared_path(spark, "cases")
    case = F.struct(F.col("item_id").alias("id"), F.col("text").alias("query"), F.lit("exact").alias("case_type"), (F.col("item_id") % 5 == 0).alias("expected_abstain"))
    b = table(spark, sf_dir, "benchmark").groupBy(F.floor(F.col("item_id") / 1000).alias("file")).agg(F.collect_list(case).alias("cases"))
    b.select(F.to_json(F.struct("cases")).alias("value"), "file").write.partitionBy("file").text(path)
    return files.eval_cases(spark, path).select("id", "query", "case_type", "expected_abstain")


def _store(spark: SparkSession, sf_dir: str) -> str:
    """A store of one row a document: a third of them written again as a new version (twice, the second time without effect), a tenth
    superseded by nothing."""
    path = shared_path(spark, "store")
    row = lambda version: table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(version).alias("version")).withColumn("chunk_id", versions.chunk_id("doc_id", "version"))
    first, new, gone = row(1), row(2).where("doc_id % 3 = 0"), row(3).where("doc_id % 10 = 4")
    for number, (docs, batch) in enumerate([(first, first), (new, new), (gone, gone.limit(0))]):
        versions.write_batch(docs, batch, path, number)
    versions.write_batch(new, new, path, 1)
    return path


@register("with b as (select doc_id, lang, doc_id % 3 = 0 as again from documents where doc_id % 10 <> 4) select lang, count(*) as n_current, count_if(again)::bigint as n_new, min(sha256(concat_ws('|', doc_id::varchar, case when again then '2' else '1' end))) as least_id from b group by lang")
def store_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store read by its current files alone."""
    now = versions.read_current(spark, _store(spark, sf_dir))
    return now.groupBy("lang").agg(F.count("*").alias("n_current"), F.count_if(F.col("version") == 2).alias("n_new"), F.min("chunk_id").alias("least_id"))


@register("with v as (select doc_id, lang, unnest(case when doc_id % 3 = 0 then [1, 2] else [1] end) as version from documents) select doc_id, lang, version, sha256(concat_ws('|', doc_id::varchar, version::varchar)) as chunk_id, doc_id % 10 <> 4 and version = case when doc_id % 3 = 0 then 2 else 1 end as is_current from v")
def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the same store, old ones too."""
    return versions.read_all(spark, _store(spark, sf_dir))


@register("select c_custkey, case when c_custkey % 2 = 0 then 'old' else 'seed' end as origin from customer")
def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return governance.seeded(c.where("c_custkey % 2 = 0").withColumn("origin", F.lit("old")), c.withColumn("origin", F.lit("seed")), "c_custkey")


@register("""with c as (select doc_id, case when doc_id % 2 = 0 then 'table' else 'figure' end as chunk_type, text, len(list_filter(string_split_regex(text, '[\\s\\x0B]+'), lambda x: x <> '')) as n from documents)
select doc_id, chunk_type, sha256(case when chunk_type = 'table' then 'Describe this table.' || chr(10) || 'Columns: lang, ' || doc_id::varchar || chr(10) || left(text, 500) else 'Describe this figure.' || chr(10) || 'Caption: ' || case when doc_id % 3 = 0 then '' else 'Fig ' || doc_id::varchar end end) as prompt_hash from c where chunk_type = 'figure' or n > 400""".replace("\\\\", "\\"))
def enrichment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    c = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 2 == 0, "table").otherwise("figure").alias("chunk_type"), "text", F.col("text").alias("context_text"), F.array(F.lit("lang"), k.cast("string")).alias("table_headers"), F.when(k % 3 != 0, F.concat(F.lit("Fig "), k.cast("string"))).alias("caption"))
    return chunking.enrichment_prompts(c).select("doc_id", "chunk_type", F.sha2("prompt", 256).alias("prompt_hash"))


@register("""with b as (select l_orderkey as chunk_id, l_linenumber as page, l_quantity as q, l_linenumber % 2 = 0 as turned from lineitem),
f as (select chunk_id, page, round(q / 200, 6) as l, round(case when turned then (100 - 2 * q + 0.0) / 100 else q / 100 end, 6) as t, round((q + 10) / 200, 6) as r, round(case when turned then (100 - q) / 100 else 2 * q / 100 end, 6) as bt from b)
select chunk_id, min(page)::bigint as page, count(distinct page) as n_pages, round(sum(l), 4) as l, round(sum(t), 4) as t, round(sum(r), 4) as r, round(sum(bt), 4) as b from f group by chunk_id""")
def box_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    turned = F.col("l_linenumber") % 2 == 0
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("page"), q.alias("l"), F.when(turned, 2 * q).otherwise(q).alias("t"), (q + 10).alias("r"), F.when(turned, q).otherwise(2 * q).alias("b"), turned.alias("bottom_left"))
    sizes = li.select("page").distinct().select("page", F.lit(200.0).alias("width"), F.lit(100.0).alias("height"))
    a = chunking.box_address(li, sizes)
    boxes = F.flatten(F.map_values("boxes"))
    total = lambda i: F.round(F.aggregate(boxes, F.lit(0.0), lambda s, x: s + F.round(x[i], 6)), 4)
    return a.select("chunk_id", F.col("page").cast("long").alias("page"), F.size("boxes").cast("long").alias("n_pages"), total(0).alias("l"), total(1).alias("t"), total(2).alias("r"), total(3).alias("b"))


_TYPE_ROWS = ", ".join(f"('{t}', {str(i % 4 != 3).lower()})" for i, t in enumerate(quality.TYPES))


@register(f"with ty(doc_type, active) as (values {_TYPE_ROWS}), u as (select c_custkey as user_id, case c_custkey % 4 when 0 then null when 1 then [] when 2 then ['prose_text', 'legal_contract', 'none'] else ['table_structured'] end as allowed from customer) select user_id, doc_type from u, ty where active and (allowed is null or list_contains(allowed, doc_type))")
def visible_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(x, i % 4 != 3) for i, x in enumerate(quality.TYPES)], "doc_type string, active boolean")
    k = F.col("c_custkey") % 4
    allowed = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(*map(F.lit, ("prose_text", "legal_contract", "none")))).when(k == 3, F.array(F.lit("table_structured")))
    return governance.visible_types(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), allowed.alias("allowed")), t)


@register(f"with {_TYPES}, n as (select coalesce(user_type, detected) as doc_type, count(*) as n from ty group by all), al(doc_type, active) as (values {_TYPE_ROWS}) select doc_type, coalesce(n, 0) as n_docs from al left join n using (doc_type)")
def type_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered type with the number of its documents."""
    names = spark.createDataFrame([(x,) for x in quality.TYPES], "doc_type string")
    n = _typed(spark, sf_dir).groupBy("doc_type").agg(F.count("*").alias("n"))
    return names.join(n, "doc_type", "left").select("doc_type", F.coalesce("n", F.lit(0)).alias("n_docs"))


@register("with g as (select distinct 'r' || (c_custkey % 7)::varchar as role, c_mktsegment || ':' || (c_custkey % 3)::varchar as p from customer where c_custkey % 7 < 5) select r.role, coalesce(string_agg(p, ',' order by p), '') as permissions from (select distinct 'r' || (c_custkey % 7)::varchar as role from customer) r left join g using (role) group by r.role")
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), (F.col("c_custkey") % 7).cast("string")).alias("role"), F.col("c_mktsegment").alias("resource"), (F.col("c_custkey") % 3).cast("string").alias("action"), (F.col("c_custkey") % 7 < 5).alias("granted"))
    return governance.roles_with_permissions(c.select("role").distinct(), c.where("granted")).select("role", F.array_join("permissions", ",").alias("permissions"))


@register(f"with {_LEAVES.split(', lv as')[0]} select doc_id, count_if(length(trim(text)) >= 10)::bigint as kept, count_if(length(trim(text)) < 10)::bigint as dropped from pages_ group by doc_id")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality gate keeps and drops of each document."""
    return chunking.gate_counts(_page_chunks(spark, sf_dir))


@register("select event_id, round(1 / (1 + exp(coalesce(value, 0) / 50 - 1)), 6) as p from events")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.coalesce(F.col("value"), F.lit(0.0)) / 50
    return table(spark, sf_dir, "events").select("event_id", F.round(retrieval.yes_probability(F.lit(1.0), no), 6).alias("p"))


@register("select conv_id, sha256(string_agg(case role when 'user' then 'Nutzer' else 'Assistent' end || ': ' || coalesce(text, ''), chr(10) order by turn)) as history_hash from conversations where role in ('user', 'assistant') group by conv_id")
def history_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.history_block(table(spark, sf_dir, "conversations"), {"user": "Nutzer", "assistant": "Assistent"}).select("conv_id", F.sha2("history", 256).alias("history_hash"))


_PASS_SQL = f"""qs as (select item_id as query_id, text as question, case when item_id % 3 = 0 then list_filter(string_split(text, '. '), lambda x: x <> '') else [] end as subs from benchmark),
sq as (select query_id, unnest(range(1, len(p) + 1)) as pass_no, unnest(p) as question from (select query_id, case when len(subs) > 0 then subs else [question] end as p from qs)),
ends as (select query_id, max(pass_no) as last, min(question) filter (pass_no = 1) as first from sq group by query_id),
tr as (select query_id, lang, text, last, first from (select item_id as query_id, unnest(['de', 'fr']) as lang, case when item_id % 2 = 0 then reverse(text) else text end as text from benchmark) join ends using (query_id)),
rows_ as (select query_id, pass_no, null as lang, question, 50 as k from sq union all select query_id, last + row_number() over (partition by query_id order by lang), lang, text, 25 from tr where text <> first),
qt as (select query_id, pass_no, lang, k, unnest(list_distinct(list_transform(regexp_extract_all(question, '{TOKEN}'), lambda x: lower(x)))) as t from rows_),
dt as (select doc_id as id, d.lang as dlang, unnest(list_distinct(list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: lower(x)))) as t from documents d),
rare as (select t, ln(1 + (select count(*) from documents) / count(*)) as w, count(*) as df from dt group by t),
ask as (select * from (select *, row_number() over (partition by query_id, pass_no order by df, t) as no from qt join rare using (t)) where no <= 8),
hit as (select query_id, pass_no, k, id, sum(w) as score from ask join dt using (t) where ask.lang is null or ask.lang = dlang group by all),
hr as (select *, row_number() over (partition by query_id, pass_no order by round(score, 9) desc, id) as rank from hit),
kept as (select * from hr where rank <= k)"""


@register(f"with {_PASS_SQL} select query_id, id as doc_id, pass_no::bigint as pass_no, rank::bigint as rank, round(score, 6) as score from (select *, row_number() over (partition by query_id, id order by pass_no, rank) as rn from kept) where rn = 1")
def question_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by the eight rarest words of each part of a question and each translation; the first pass that finds a document counts."""
    b = table(spark, sf_dir, "benchmark")
    parts = F.when(F.col("item_id") % 3 == 0, F.filter(F.split("text", r"\. "), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    q = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), parts.alias("sub_questions"))
    t = b.select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit("de"), F.lit("fr"))).alias("lang"), F.when(F.col("item_id") % 2 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text"))
    words = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"))

    def search(rows: DataFrame, k: int) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        own = words(rows.withColumnRenamed("question", "text"), "list_id", F.coalesce("lang", F.lit("")).alias("lang"))
        d = words(docs, F.col("doc_id").alias("id"), F.col("lang").alias("dlang"))
        df = stored(d.join(own.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count("*").alias("df")), "df")
        no = F.row_number().over(Window.partitionBy("list_id").orderBy("df", "t"))
        own = stored(own.join(df, "t").withColumn("no", no).where("no <= 8").withColumn("w", F.log(1 + F.lit(docs.count()) / F.col("df"))), "asked")
        d = d.join(own.select("t").distinct(), "t", "left_semi")
        # a list asks all languages, under the empty name, or one
        postings = d.select(F.explode(F.array(F.lit(""), F.coalesce("dlang", F.lit("?")))).alias("lang"), F.col("t").alias("term"), "id", F.lit(1.0).alias("weight"))
        asked = own.select("lang", F.col("t").alias("term"), F.col("list_id").alias("id"), F.col("w").alias("weight"))
        return sparse.pruned_top_k(postings, asked, k).select(F.col("query_id").alias("list_id"), "id", "rank", "score")

    out = retrieval.first_pass_wins(retrieval.passes(q, t, search))
    return out.select("query_id", F.col("id").alias("doc_id"), F.col("pass_no").cast("long").alias("pass_no"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))
