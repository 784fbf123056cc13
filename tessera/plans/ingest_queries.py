"""Page checks, types, elements, chunks and languages over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import answer_text, sub_questions
from ..functions.text import strip
from ..operators import chunking, language, quality
from .catalog import register
from .chunk_queries import chunk_sql, section_sql
from .search_queries import table

_PAGES = "pages_ as (select doc_id, unnest(range(1, len(l) + 1)) as page, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text", F.lit(595.0).alias("width"))


_SCAN = f"{_PAGES}, sc as (select doc_id, count(*) as total, count_if(length(trim(text)) < 20)::bigint as n_empty, coalesce(string_agg(page::varchar, ',' order by page) filter (length(trim(text)) < 20), '') as empty_pages, min(case when length(text) < 50 then 0.3 else 1.0 end)::double as confidence from pages_ group by doc_id)"


@register(f"with {_SCAN} select doc_id, total, empty_pages, n_empty / total >= 0.5 as is_scan, doc_id % 3 <> 0 or n_empty / total < 0.5 as has_text, confidence from sc")
def page_scan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    s = quality.scan_check(table(spark, sf_dir, "documents"), p).join(quality.extraction_confidence(p), "doc_id")
    return s.select("doc_id", "total", F.array_join(F.transform("empty_pages", lambda x: x.cast("string")), ",").alias("empty_pages"), "is_scan", quality.text_layer(F.col("doc_id") % 3 == 0, F.col("is_scan")).alias("has_text"), "confidence")


@register(f"with {_SCAN} select doc_id, n_empty / total >= 0.5 and doc_id % 5 <> 0 as held from sc")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality.scan_check(table(spark, sf_dir, "documents"), _pages(spark, sf_dir)).withColumn("user_type", F.when(F.col("doc_id") % 5 == 0, "scanned_image"))
    go, held = quality.quarantine(s)
    return go.select("doc_id", F.lit(False).alias("held")).union(held.select("doc_id", F.lit(True).alias("held")))


@register(f"with {_PAGES}, n as (select *, count(*) over (partition by doc_id) as n from pages_), k as (select * from n where page = 1 or (n > 2 and page = n // 2 + 1) or (n > 1 and page = n)) select doc_id, left(string_agg('[Page ' || page || ']' || chr(10) || left(text, 1500), chr(10) order by page), 4000) as sample from k group by doc_id")
def page_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.page_sample(_pages(spark, sf_dir))


#: Keywords that stand in for a model in the queries.
KEYWORDS = [("legal_contract", "license"), ("legal_contract", "licensed"), ("invoice_bill", "555"), ("invoice_bill", "password"), ("table_structured", " | "), ("correspondence", "@"), ("report_study", "tion")]
_KW = ", ".join(f"('{a}', '{b}')" for a, b in KEYWORDS)
_TYPES = f"kw(doc_type, keyword) as (values {_KW}), h as (select doc_id, doc_type, count(*) as n from documents, kw where contains(lower(text), keyword) group by all), r as (select *, n / sum(n) over (partition by doc_id) as conf, row_number() over (partition by doc_id order by n desc, doc_type) as rn from h), ty as (select d.doc_id, coalesce(r.doc_type, 'prose_text') as detected, coalesce(conf, 0) as conf, case when d.doc_id % 7 = 0 then 'report_study' end as user_type from documents d left join r on r.doc_id = d.doc_id and rn = 1)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.createDataFrame(KEYWORDS, "doc_type string, keyword string")
    t = quality.keyword_types(table(spark, sf_dir, "documents"), k).withColumn("user_type", F.when(F.col("doc_id") % 7 == 0, "report_study"))
    name, conf = quality.resolved(F.col("user_type"), F.col("doc_type"), F.col("confidence"))
    return t.select("doc_id", name.alias("doc_type"), conf.alias("confidence"))


@register(f"with {_TYPES} select doc_id, coalesce(user_type, detected) as doc_type, round(case when user_type is not null then 1.0 else conf end, 6) as confidence from ty")
def doc_type_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


HANDLERS = [("prose_text", "HybridChunker", "text_dense"), ("table_structured", "TableAtomic", "description_dense"), ("legal_contract", "ClauseAtomic", "text_dense"), ("correspondence", "ThreadChunker", "text_dense")]
_HANDLERS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in HANDLERS)


@register(f"with {_TYPES}, hd(t, chunker, strategy) as (values {_HANDLERS}), k as (select doc_id, coalesce(user_type, detected) as doc_type from ty) select doc_id, doc_type, coalesce(t, 'prose_text') as handled_as, coalesce(chunker, 'HybridChunker') as chunker, coalesce(strategy, 'text_dense') as strategy from k left join hd on t = doc_type")
def handler_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.createDataFrame(HANDLERS, "doc_type string, chunker string, strategy string")
    return quality.dispatched(_typed(spark, sf_dir), h).select("doc_id", "doc_type", "handled_as", "chunker", "strategy")


@register("""select event_id, case when event_id % 4 = 3 or event_id % 5 = 4 or round(least(greatest(value / 100, 0), 1), 6) < 0.8 then 'prose_text' else 'legal_contract' end as doc_type,
case when event_id % 4 = 3 or event_id % 5 = 4 then 0.0 else round(least(greatest(value / 100, 0), 1), 6) end as confidence,
case when event_id % 3 = 0 then 'q' || event_id::varchar || '|b' else 'whole' end as parts, case when event_id % 3 = 1 then 'plain' else 'A' || event_id::varchar end as answer from events""")
def typed_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    name = F.when(k % 5 == 4, "no_such_type").otherwise("legal_contract")
    body = F.concat(F.lit('{"type": "'), name, F.lit('", "confidence": '), (F.col("value") / 100).cast("string"), F.lit("}"))
    raw = F.when(k % 4 == 3, "I cannot tell").when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    subs = F.when(k % 3 == 0, F.concat(F.lit('Sure: ["q'), k.cast("string"), F.lit('", "b"] done'))).otherwise("none [here")
    said = F.when(k % 3 == 1, "<think>x</think>plain").when(k % 3 == 2, F.concat(F.lit('```json\n{"answer": "A'), k.cast("string"), F.lit('"}\n```'))).otherwise(F.concat(F.lit('Well: {"answer": "A'), k.cast("string"), F.lit('"} ok')))
    t = table(spark, sf_dir, "events").select("event_id", quality.parsed_type(raw).alias("t"), sub_questions(subs, F.lit("whole")).alias("s"), answer_text(said).alias("answer"))
    return t.select("event_id", "t.doc_type", F.round("t.confidence", 6).alias("confidence"), F.array_join("s", "|").alias("parts"), "answer")


ROLES = [(1, "pricing", "green"), (1, "pricing", "gold"), (2, "schedule", "steel"), (3, "parties", "small")]


@register("select p_partkey, case when contains(h, 'green') or contains(h, 'gold') then 'pricing' when contains(h, 'steel') then 'schedule' when contains(h, 'small') then 'parties' else 'data_table' end as role, 1::bigint as n_rows, 2::bigint as n_cols, array_to_string(list_distinct([p_name, p_type]), '|') is not null as has_headers from (select *, lower(p_name || ' ' || p_type) as h from part)")
def table_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.struct(F.col(c).alias("text"), F.lit("col_header").alias("label"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), F.lit("legal_contract").alias("doc_type"), F.array(F.array(cell("p_name"), cell("p_type"))).alias("grid"))
    rows, cols, heads = chunking.table_structure("grid")
    s = spark.createDataFrame([("legal_contract", *r) for r in ROLES], "doc_type string, priority int, role string, keyword string")
    out = quality.table_roles(p.select("table_id", "doc_type", rows.cast("long").alias("n_rows"), cols.cast("long").alias("n_cols"), heads.alias("headers")), s)
    return out.select(F.col("table_id").alias("p_partkey"), "role", "n_rows", "n_cols", (F.size("headers") > 0).alias("has_headers"))


_UNSEEN = "html"
for _name in chunking.HTML_UNSEEN.split():
    _UNSEEN = rf"regexp_replace({_UNSEEN}, '(?is)<{_name}(?:\s[^>]*)?>.*?</{_name}\s*>', ' ', 'g')"
_LAST = "coalesce(last_value(case when tag in ({}) then tag end ignore nulls) over (partition by doc_id order by seq rows unbounded preceding), '') = {}"
_HTML_SQL = rf"""ht as (select page_id as doc_id, string_split(regexp_replace(regexp_replace(regexp_replace({_UNSEEN}, '[\x01-\x03]', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(/?(?:{'|'.join(chunking.HTML_BLOCKS.split())}))(?:[\s/][^>]*)?>', chr(1) || '\1' || chr(2), 'g'), chr(1)) as l from pages),
pc as (select doc_id, unnest(range(len(l))) as seq, unnest(l) as r from ht),
tg as (select doc_id, seq, case when contains(r, chr(2)) then lower(split_part(r, chr(2), 1)) else '' end as tag, trim(regexp_replace(regexp_replace(case when contains(r, chr(2)) then split_part(r, chr(2), 2) else r end, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as text from pc),
ev as (select *, {_LAST.format("'li', '/li', 'ul', '/ul', 'ol', '/ol', 'menu', '/menu', 'dir', '/dir'", "'li'")} as item, {_LAST.format("'pre', '/pre'", "'pre'")} as code, {_LAST.format("'table', '/table'", "'table'")} as in_table, count_if(tag in ('table', '/table')) over (partition by doc_id order by seq rows unbounded preceding) as no from tg),
rw as (select doc_id, no, seq, tag, text, count_if(tag = 'tr') over (partition by doc_id, no order by seq) as line, count_if(tag in ('td', 'th')) over (partition by doc_id, no order by seq) as cell from ev where in_table and tag <> 'caption'),
ce as (select doc_id, no, line, cell, min(seq) as seq, trim(regexp_replace(string_agg(text, ' ' order by seq), ' +', ' ', 'g')) as text, bool_or(tag in ('td', 'th')) as real from rw group by all),
tl as (select doc_id, no, line, min(seq) as seq, regexp_replace(string_agg(text, ' | ' order by cell) filter (real or text <> ''), '^[\s|]+|\s+$', '', 'g') as text from ce group by all),
tb as (select doc_id, min(seq) as seq, regexp_replace(string_agg(text, chr(10) order by line) filter (text <> ''), '^[\s|]+|\s+$', '', 'g') as text from tl group by doc_id, no),
els as (select doc_id, seq, case when regexp_matches(tag, '^h[1-6]$') then 'heading' when tag in ('caption', 'figcaption') then 'caption' when code then 'code' when item then 'list_item' else 'text' end as label, case when regexp_matches(tag, '^h[1-6]$') then right(tag, 1)::int end as level, text from ev where not (in_table and tag <> 'caption') and text <> ''
 union all select doc_id, seq, 'table', null, text from tb where text <> '')"""


@register(f"with {_HTML_SQL} select * from els")
def elements_from_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.html_elements(table(spark, sf_dir, "pages"))


_MARKED = r"case when seq % 9 = 0 then '# ' when seq % 9 = 4 then '## 1.2 ' when seq % 9 in (2, 3) then '- ' when seq % 9 = 5 then '§ 7 ' when seq % 9 = 7 then 'Milestone 3: 12.05.2024 ' else '' end"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings, list items, clauses and dates put before lines by their number."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    m = F.col("seq") % 9
    mark = F.when(m == 0, "# ").when(m == 4, "## 1.2 ").when(m.isin(2, 3), "- ").when(m == 5, "§ 7 ").when(m == 7, "Milestone 3: 12.05.2024 ").otherwise("")
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(mark, "line").alias("x")))).alias("x"))
    return g.select("doc_id", F.array_join(F.transform("x", lambda r: r["x"]), "\n").alias("text"))


_TEXT_SQL = f"""ln as (select doc_id, unnest(range(len(l))) as seq, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)),
mk as (select doc_id, seq, {_MARKED} || line as t from ln),
te as (select doc_id, seq, case when seq % 9 in (0, 4) then 'heading' when regexp_matches(t, '^\\s*([-*•]|\\d+[.)])\\s') then 'list_item' when regexp_matches(t, '^\\s*\\|.*\\|\\s*$') then 'table' when regexp_matches(t, '^(Abbildung|Figure|Tabelle|Table)\\s+\\d+') then 'caption' else 'text' end as label, case seq % 9 when 0 then 1 when 4 then 2 end as level, case when seq % 9 in (0, 4) then regexp_replace(t, '^#+\\s+', '') when regexp_matches(t, '^\\s*([-*•]|\\d+[.)])\\s') then regexp_replace(t, '^\\s*([-*•]|\\d+[.)])\\s+', '') else t end as text from mk where trim(t) <> '')"""


@register(f"with {_TEXT_SQL} select doc_id, seq, label, level, sha256(text) as text_hash from te")
def elements_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.text_elements(_marked(spark, sf_dir)).select("doc_id", "seq", "label", "level", F.sha2("text", 256).alias("text_hash"))


@register(f"with {_TEXT_SQL}, h1 as (select doc_id, seq, trim(text) as a from te where level = 1), p as (select doc_id, seq, label, (select max(seq) from te h where h.doc_id = te.doc_id and h.level = 1 and h.seq <= te.seq) as s1, (select max(seq) from te h where h.doc_id = te.doc_id and h.level is not null and h.seq <= te.seq) as s2, (select max(seq) from te h where h.doc_id = te.doc_id and h.level is not null and h.seq < te.seq) as parent_seq from te) select p.doc_id, p.seq, sha256(concat_ws(' > ', (select trim(text) from te a where a.doc_id = p.doc_id and a.seq = s1), case when s2 > s1 or s1 is null then (select trim(text) from te a where a.doc_id = p.doc_id and a.seq = s2) end)) as path_hash, parent_seq from p")
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = chunking.heading_paths(chunking.text_elements(_marked(spark, sf_dir)))
    return e.select("doc_id", "seq", F.sha2(F.array_join("path", " > "), 256).alias("path_hash"), "parent_seq")


@register("""with recursive pa as (select doc_id, unnest(range(len(l))) as p, unnest(l) as para from (select doc_id, string_split(text, chr(10)) as l from documents)),
wc as (select *, len(list_filter(string_split_regex(para, '\\s+'), lambda x: x <> '')) as n from pa),
un as (select doc_id, p, 0 as k, para as t, n, false as cut from wc where n <= 40 union all
 select doc_id, p, unnest(range(len(s))) as k, unnest(s) as t, -1 as n, false as cut from (select doc_id, p, string_split(regexp_replace(para, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as s from wc where n > 40)),
u as (select doc_id, row_number() over (partition by doc_id order by p, k) as i, t, case when n < 0 then len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) else n end as n, n < 0 and k = 0 as cut from un),
s as (select doc_id, i, 0 as seg, n as tot, t from u where i = 1 union all
 select u.doc_id, u.i, case when u.cut or s.tot + u.n > 40 then seg + 1 else seg end, case when u.cut or s.tot + u.n > 40 then u.n else s.tot + u.n end, u.t from s join u on u.doc_id = s.doc_id and u.i = s.i + 1),
whole as (select doc_id, sum(n) as total from u group by doc_id),
g as (select s.doc_id, case when total <= 40 then 0 else seg end as seg, string_agg(t, chr(10) order by i) as text from s join whole using (doc_id) group by all)
select doc_id, row_number() over (partition by doc_id order by seg) - 1 as seg, sha256(text) as text_hash, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::bigint as n_tokens from g where trim(text) <> ''""".replace("\\\\", "\\"))
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.document_windows(table(spark, sf_dir, "documents"), 40).select("doc_id", "seg", F.sha2("text", 256).alias("text_hash"), "n_tokens")


def _chunks(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = chunking.html_elements(table(spark, sf_dir, "pages")) if kind in ("default", "list") else chunking.text_elements(_marked(spark, sf_dir))
        return chunking.chunk(source, kind).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", "is_leaf", "text", "context_text", F.col("parent_seq").cast("long").alias("parent_seq"))

    query.__name__ = f"chunk_{kind}"
    source = f"{_HTML_SQL}, el as (select * from els)" if kind in ("default", "list") else f"{_TEXT_SQL}, el as (select * from te)"
    return register(chunk_sql(kind, source, hashed=False))(query)


for _kind in chunking.CHUNKERS:
    _chunks(_kind)


@register(section_sql(f"{_TEXT_SQL}, el as (select * from te)", hashed=False))
def chunk_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.section_chunks(chunking.text_elements(_marked(spark, sf_dir)))
    return out.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@register("""with b as (select conv_id as doc_id, turn as seq, case when role = 'user' then 'From: user' || chr(10) || 'Subject: turn ' || turn::varchar || chr(10) || text else text end as text, role = 'user' as head from conversations),
m as (select *, sum(head::int) over (partition by doc_id order by seq rows unbounded preceding) as message from b),
g as (select doc_id, message, string_agg(text, chr(10) order by seq) as text, min(seq) filter (head) as first_turn from m group by all)
select doc_id, row_number() over (partition by doc_id order by message) - 1 as message, sha256(trim(text)) as text_hash, case when first_turn is not null then 'user' else '' end as sender, case when first_turn is not null then 'turn ' || first_turn::varchar else 'Email ' || (row_number() over (partition by doc_id order by message))::varchar end as subject from g""")
def thread_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    head = F.concat(F.lit("From: user\nSubject: turn "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    e = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", head).otherwise(F.col("text")).alias("text"))
    return chunking.thread_messages(e).select("doc_id", F.col("message").cast("long").alias("message"), F.sha2("text", 256).alias("text_hash"), F.col("from").alias("sender"), "subject")


_LEAVES = f"{_PAGES}, lv as (select doc_id, page, text from pages_ where length(trim(text)) >= 10)"


def _page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page", "text", F.lit(True).alias("is_leaf"), F.col("text").alias("context_text"))


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.quality_gate(_page_chunks(spark, sf_dir))


@register(f"with {_LEAVES} select doc_id, page, sha256(text) as text_hash from lv")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir).select("doc_id", "page", F.sha2("text", 256).alias("text_hash"))


@register(f"with {_LEAVES}, {_TYPES}, n as (select doc_id, count(*) as n_chunks from lv group by doc_id) select ty.doc_id, coalesce(n_chunks, 0) as n_chunks, coalesce(user_type, detected) as doc_type from ty left join n using (doc_id)")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _leaves(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return _typed(spark, sf_dir).join(n, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "doc_type")


@register(f"with {_LEAVES} select doc_id, page, 'prose_text' as doc_type, 'text_dense' as embed_strategy, 'prose_text' as structural_type, sha256(doc_id::varchar || '|' || page::varchar) as chunk_id from lv")
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunking.stamped(_leaves(spark, sf_dir), F.lit("prose_text"), F.lit("dt-1"), F.lit("text_dense"), F.array(F.lit("all")), F.lit("prose_text"))
    return t.select("doc_id", "page", "doc_type", "embed_strategy", "structural_type", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("page").cast("string")), 256).alias("chunk_id"))


@register(f"with {_LEAVES} select doc_id, page, sha256(case when page % 3 = 0 then 'About ' || page::varchar else text end) as context_hash from lv")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _leaves(spark, sf_dir).withColumn("chunk_id", F.concat_ws("|", F.col("doc_id").cast("string"), F.col("page").cast("string")))
    d = t.select("chunk_id", F.when(F.col("page") % 3 == 0, F.concat(F.lit("About "), F.col("page").cast("string"))).otherwise("").alias("description"))
    return chunking.enriched(t, d).select("doc_id", "page", F.sha2("context_text", 256).alias("context_hash"))


_LANG_SQL = """ch as (select doc_id, lang, lower(text) as t, string_split(lower(text), '') as l from documents where text is not null),
gr as (select doc_id, lang, unnest(case when len(l) >= 3 then list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i + 1] || l[i + 2]) else [t] end) as gram from ch),
dc as (select doc_id as id, lang as own, gram, count(*) as c from gr group by all), c as (select own as lang, gram, sum(c) as c from dc where own is not null group by all), n as (select lang, sum(c) as n, count(*) as v from c group by lang),
pr as (select c.lang, gram, ln((c + 1) / (n + v + 1)) as logp, ln(1 / (n + v + 1)) as rest from c join n using (lang)),
tot as (select id, sum(c) as t from dc group by id),
ga as (select id, pr.lang, sum(c * (logp - rest)) as gain from dc join pr using (gram) where gram <> '' group by all),
sc as (select tot.id, n.lang, t * ln(1 / (n + v + 1)) + coalesce(gain, 0) as score from tot cross join n left join ga on ga.id = tot.id and ga.lang = n.lang),
pb as (select *, exp(score - max(score) over (partition by id)) as e, row_number() over (partition by id order by round(score, 6) desc, lang) as rn from sc),
dl as (select id, lang, e / sum(e) over (partition by id) as prob, rn from pb), det as (select id, lang, prob from dl where rn = 1)"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all labelled documents, and every document scored by them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return language.detected(language.language_scores(d, language.profiles(d.where("lang is not null"))))


@register(f"with {_LANG_SQL} select id as doc_id, case when lang in ('de', 'en', 'fr', 'es') then lang else 'de' end as lang from det")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select(F.col("id").alias("doc_id"), language.chunk_language(F.col("lang")).alias("lang"))


@register(f"with {_LANG_SQL} select id as doc_id, case when lang = 'en' and prob >= 0.8 then 'en' else 'de' end as lang from det")
def lang_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select(F.col("id").alias("doc_id"), language.query_language(F.col("lang"), F.col("prob")).alias("lang"))


@register("""with q as (select conv_id, turn, text || case conv_id % 4 when 0 then ' Answer in English please' when 1 then ' bitte auf Deutsch antworten' when 2 then ' auf englisch' else '' end as q, case turn % 3 when 0 then 'en' when 1 then 'fr' else 'de' end as det from conversations),
e as (select *, case when regexp_matches(lower(q), '\\banswer in english\\b') then 'en' when regexp_matches(lower(q), '\\banswer in german\\b') then 'de' when regexp_matches(lower(q), '\\bauf englisch\\b') then 'en' when regexp_matches(lower(q), '\\bauf deutsch\\b') then 'de' when regexp_matches(lower(q), '\\bin english\\b') then 'en' end as ex from q),
a as (select *, coalesce(ex, case when det in ('de', 'en') then det end, 'de') as lang from e)
select conv_id, turn, ex as explicit, lang, case when turn % 2 = 0 then 'de,en' else 'de' end as active, case lang when 'en' then 'No answer found.' else 'Keine Antwort gefunden.' end as message from a""".replace("\\\\", "\\"))
def answer_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("conv_id") % 4, F.col("turn")
    q = F.concat("text", F.when(k == 0, " Answer in English please").when(k == 1, " bitte auf Deutsch antworten").when(k == 2, " auf englisch").otherwise(""))
    det = F.when(t % 3 == 0, "en").when(t % 3 == 1, "fr").otherwise("de")
    ticks = F.when(t % 2 == 0, F.array(F.lit("en"), F.lit("fr")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", language.explicit_language(q).alias("explicit"), det.alias("det"), F.array_join(language.active_languages(ticks), ",").alias("active"))
    c = c.withColumn("lang", language.answer_language(F.col("det"), F.col("explicit")))
    return c.select("conv_id", "turn", "explicit", "lang", "active", language.message(F.col("lang"), {"de": "Keine Antwort gefunden.", "en": "No answer found."}).alias("message"))


@register("select item_id as query_id, l as lang, case when l = 'en' then text else coalesce(case when item_id % 2 = 0 then 'DE: ' || text end, text) end as text from benchmark, (values ('de'), ('en')) v(l)")
def translation_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("en").alias("lang"), language.active_languages(F.array(F.lit("en"))).alias("active"))
    t = b.where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), F.lit("de").alias("lang"), F.concat(F.lit("DE: "), "text").alias("translated"))
    return language.translated(q, t)


@register()
def sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty random documents with a preview of one line."""
    d = table(spark, sf_dir, "documents").orderBy(F.rand(7), "doc_id").limit(20)
    flat = F.regexp_replace("text", r"[\r\n]", " ")
    return d.select("doc_id", F.concat(F.substring(flat, 1, 300), F.when(F.length(strip(flat)) > 300, "...").otherwise("")).alias("preview"))
