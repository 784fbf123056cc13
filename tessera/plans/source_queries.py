"""Readers over file contents that are made from the driver tables, and streams over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import chunking
from ..sources import files
from ..sources.scratch import shared_path
from ..streaming import events, stateful, upkeep
from .catalog import register
from .governance_queries import _HITS_SQL, _SESSION_SQL, _THROTTLE_SQL
from .search_queries import _IDF_SQL, STOP, table


def _file(df: DataFrame, path, content) -> DataFrame:
    f = df.select(path.alias("path"), content.cast("binary").alias("content"))
    return files.with_format(f.withColumn("length", F.length("content").cast("long")))


@register("select 'p' || p_partkey::varchar || '.csv' as path, 'key | name | ' || chr(10) || p_partkey::varchar || ' | ' || p_name || ', \"x\" | ' || p_type as text, 2 as rows, 3 as cols from part")
def csv_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit("key,name,\n"), F.col("p_partkey").cast("string"), F.lit(',"'), F.col("p_name"), F.lit(', ""x""",'), F.col("p_type"), F.lit("\n"))
    f = _file(p, F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".csv")), body)
    return files.read_delimited(f).select("path", "text", "rows", "cols")


@register("select 'c' || conv_id::varchar || '.mbox' as path, turn as message, role || '@example.com' as sender, 'turn ' || turn::varchar as subject, sha256(text) as body_hash from conversations")
def mail_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    one = F.concat(F.lit("From x Mon\nFrom: "), "role", F.lit("@example.com\nTo: all@example.com\nSubject: turn "), F.col("turn").cast("string"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.regexp_replace("text", "(?m)^(>*From )", ">$1"))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))), lambda m: m["x"]), "\n").alias("box"))
    m = files.read_mailbox(_file(g, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".mbox")), F.col("box")))
    return m.select("path", F.col("message").cast("long").alias("message"), F.col("from").alias("sender"), "subject", F.sha2("body", 256).alias("body_hash"))


@register("select 'd' || item_id::varchar || '.svg' as path, 'Item ' || item_id::varchar || chr(10) || replace(replace(text, '&', ''), '<', '') as text from benchmark")
def svg_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    clean = F.regexp_replace("text", "[&<]", "")
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><title>Item '), F.col("item_id").cast("string"), F.lit('</title><rect/><text x="1">'), clean, F.lit("</text></svg>"))
    return files.read_svg(_file(b, F.concat(F.lit("d"), F.col("item_id").cast("string"), F.lit(".svg")), svg)).select("path", "text")


@register("select doc_id, case when doc_id % 2 = 0 or regexp_matches(text, '[^\\x00-\\xFF]') then 'utf-8' when regexp_matches(text, '[^\\x00-\\x7F]') then 'latin-1' else 'utf-8' end as encoding, length(text) as n_chars from documents")
def encoding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    wide = F.col("text").rlike(r"[^\x00-\xFF]")  # no Latin-1 text
    f = d.select("doc_id", F.when((F.col("doc_id") % 2 == 0) | wide, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1")).alias("content"))
    text, name = files.decoded("content")
    return f.select("doc_id", name.alias("encoding"), F.length(text).cast("long").alias("n_chars"))


@register("select doc_id, unnest(range(len(l)))::bigint as position, unnest(range(1, len(l) + 1))::bigint as number, sha256(unnest(l)) as text_hash from (select doc_id, string_split(text, chr(10)) as l from documents)")
def raw_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("number"), t.alias("text"))).alias("pages"))
    return files.exploded(d, "pages").select("doc_id", F.col("position").cast("long").alias("position"), F.col("number").cast("long").alias("number"), F.sha2("text", 256).alias("text_hash"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted content as JSON lines, written and read again: tables of parts, mails and sections of conversations; every fifth has none."""
    path = shared_path(spark, "extracted")
    c = table(spark, sf_dir, "conversations")
    mail = F.struct(F.col("role").alias("from"), F.lit("all").alias("to"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("subject"), F.lit("2024-01-01").alias("date"), F.col("text").alias("body"))
    section = F.struct((F.col("turn") % 3 + 1).cast("int").alias("level"), F.col("text").alias("text"), F.col("turn").cast("int").alias("position"))
    grid = F.array(F.array("role", F.col("turn").cast("string")), F.array(F.lit(""), F.lit("")), F.array("text", F.lit("end")))
    block = F.struct(F.size(grid).alias("rows"), F.lit(2).alias("cols"), grid.alias("data"))
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("turn", x.alias("x")))), lambda r: r["x"])
    g = c.groupBy(F.col("conv_id").alias("doc_id")).agg(*(in_order(x).alias(n) for n, x in (("tables", block), ("emails", mail), ("sections", section))))
    g.select(F.to_json(F.struct("doc_id", *(F.when(F.col("doc_id") % 5 != 0, F.col(n)).alias(n) for n in ("tables", "emails", "sections")))).alias("value")).write.text(path)
    return files.extracted(spark, path)


_ITEMS_SQL = "with t as (select *, row_number() over (partition by conv_id order by turn) - 1 as position from conversations where conv_id % 5 <> 0), none_ as (select distinct conv_id as doc_id from conversations where conv_id % 5 = 0) "


@register(_ITEMS_SQL + "select conv_id as doc_id, position, 3 as n_rows, 2 as n_cols, sha256('--- Table ---' || chr(10) || role || ' | ' || turn::varchar || chr(10) || text || ' | end') as text_hash from t union all select doc_id, null, null, null, null from none_")
def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = files.exploded(_extracted(spark, sf_dir), "tables")
    return t.select("doc_id", F.col("position").cast("long").alias("position"), F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"), F.when(F.col("data").isNotNull(), F.sha2(files.table_text("data"), 256)).alias("text_hash"))


@register(_ITEMS_SQL + "select conv_id as doc_id, position, role as sender, 'turn ' || turn::varchar as subject, sha256(text) as body_hash from t union all select doc_id, null, null, null, null from none_")
def raw_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = files.exploded(_extracted(spark, sf_dir), "emails")
    return e.select("doc_id", F.col("position").cast("long").alias("position"), F.col("from").alias("sender"), "subject", F.sha2("body", 256).alias("body_hash"))


@register(_ITEMS_SQL + "select conv_id as doc_id, position, (turn % 3 + 1)::int as level, sha256(text) as text_hash from t union all select doc_id, null, null, null from none_")
def raw_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _extracted(spark, sf_dir).select("doc_id", F.transform("sections", lambda r: F.struct(r["level"].alias("level"), r["text"].alias("text"))).alias("sections"))
    return files.exploded(x, "sections").select("doc_id", F.col("position").cast("long").alias("position"), "level", F.sha2("text", 256).alias("text_hash"))


@register("select doc_id, sha256(string_agg('--- Page ' || i || ' ---' || chr(10) || t, chr(10) order by i)) as text_hash from (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as t from (select doc_id, string_split(text, chr(10)) as l from documents)) group by doc_id")
def paged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("number"), t.alias("text"))).alias("pages"))
    return d.select("doc_id", F.sha2(files.paged_text("pages"), 256).alias("text_hash"))


@register("select c_custkey, (c_custkey % 4) in (0, 1) as accepted, case when c_custkey % 5 = 0 then 'doc' else regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g') || '_v1' end as doc_id, case when c_custkey % 3 = 0 then '' else 'd1,d2' end as departments from customer")
def upload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 5 == 0, "").otherwise(F.concat("c_name", F.lit(" v1"))), F.when(k % 4 == 0, ".PDF").when(k % 4 == 1, ".txt").otherwise(".exe"))
    u = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.when(k % 3 != 0, F.lit(" d1, ,d2 ")).alias("departments"))
    return files.admitted(u, ["pdf", "txt"]).select("c_custkey", "accepted", "doc_id", F.array_join("department_ids", ",").alias("departments"))


@register("select p_partkey, case when p_partkey % 4 = 3 then 'file not found' when p_partkey % 4 = 2 then 'unsupported extension: exe' when p_partkey % 4 = 1 and length(p_name) > 30 then 'file too large' else '' end as warning from part")
def input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.when(k % 4 == 2, ".exe").otherwise(".txt")).alias("path"), F.when(k % 4 != 3, F.when(k % 4 == 1, F.col("p_name")).otherwise("x")).cast("binary").alias("content"))
    g = files.gated(files.with_format(p.withColumn("length", F.length("content"))), ["txt"], 30)
    return g.select("p_partkey", F.array_join("warnings", ",").alias("warning"))


@register("select user_id, date_trunc('hour', ts)::timestamp as window_start, least(count(*), 10) as used from events group by all")
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.run_once(events.usage_stream(events.event_stream(spark, f"{sf_dir}/events.parquet"), 10, late="3650 days"), "update")
    return out.groupBy("user_id", "window_start").agg(F.max("used").alias("used")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("select event_id, user_id, date_trunc('hour', ts)::timestamp as window_start, n, n <= 2 as allowed from (select *, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as n from events)")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    out = events.run_once(stateful.rate_limit(events.event_stream(spark, path), 2, events.span(spark.read.parquet(path))), "update")
    return events.settled(out, "event_id").select("event_id", F.col("owner").alias("user_id"), F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.col("passed").alias("allowed"))


@register(_THROTTLE_SQL)
def stream_login_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    e = events.event_stream(spark, path).select("event_id", (F.col("user_id") % 20).alias("ip"), "ts", (~F.col("event_type").isin("error", "view")).alias("ok"))
    out = events.run_once(stateful.login_throttle(e, 2, late=events.span(spark.read.parquet(path))), "update")
    return events.settled(out, "event_id").select("event_id", F.col("owner").alias("ip"), F.col("window_start").cast("timestamp_ntz").alias("window_start"), (~F.col("passed")).alias("blocked"))


@register(_SESSION_SQL.replace("ts + interval 8 hour >= (select max(ts) - interval 12 hour", "date_trunc('millisecond', ts + interval 8 hour) >= (select date_trunc('millisecond', max(ts) - interval 12 hour)"))
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of eight hours; the watermark, twelve hours behind the newest event, ends them."""
    e = events.event_stream(spark, f"{sf_dir}/events.parquet")
    out = events.run_once(stateful.sessions(e, F.col("event_type") == "signup", 8, "12 hours"), "update")
    return events.settled(out, "session_id").select("session_id", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), "live")


@register(_HITS_SQL)
def stream_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    r = events.event_stream(spark, path).select(F.col("user_id").alias("key"), "ts", "event_id")
    out = events.run_once(stateful.cache_hits(r, 36000, events.span(spark.read.parquet(path))), "update")
    return events.settled(out, "event_id").select("key", "event_id", F.col("anchor").cast("timestamp_ntz").alias("anchor"), "hit")


@register("select doc_id, count(*) as n_chunks, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::bigint as n_tokens from documents group by doc_id".replace("count(*) as n_chunks", "greatest(count(*), 1) as n_docs"))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    docs = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(events.globbed(path))
    cut = lambda b: b.select("doc_id", F.posexplode(chunking.token_windows(F.col("text"), 64)).alias("seg", "text"))
    out = events.ingest_stream(docs.select("doc_id", "text"), cut)
    return out.groupBy("doc_id").agg(F.lit(1).cast("long").alias("n_docs"), F.sum(word_count(F.col("text"))).alias("n_tokens"))


_NOW_SQL = "now_ as (select doc_id, lang, case when doc_id % 4 = 1 then left(text, length(text) // 2) else text end as text from documents where doc_id % 9 <> 5)"


@register(f"with {_NOW_SQL}, {_IDF_SQL.replace('from documents', 'from now_')} select lang, term, df, round(idf, 6) as idf from idf")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come as a stream, a quarter once more with a shorter text and a ninth withdrawn; document frequencies follow batch by batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.lit(1).alias("version"))
    short = docs.where("doc_id % 4 = 1").withColumn("text", F.expr("left(text, length(text) div 2)")).withColumn("version", F.lit(2))
    gone = docs.where("doc_id % 9 = 5").withColumn("text", F.lit(None).cast("string")).withColumn("version", F.lit(3))
    arrived = shared_path(spark, "arrived")
    path, offsets = upkeep.new_index(spark)
    for part in (docs, short, gone):
        part.write.mode("append").parquet(arrived)
        upkeep.index_stream(spark.readStream.schema(docs.schema).parquet(arrived), path, offsets, STOP)
    return upkeep.current_idf(spark, path).select("lang", "term", "df", F.round("idf", 6).alias("idf"))
