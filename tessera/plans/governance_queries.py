"""Conversations, access, administration, time rules and versions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as g
from ..operators import versions, windows
from .catalog import register
from .search_queries import table


def _convs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    k = F.col("conv_id")
    return c.select("conv_id", (k % 50).alias("owner"), F.when(k % 11 == 0, "deleted").otherwise("active").alias("status"), (k * 7919 % 1000).alias("updated_at"))


def _share_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 31 + F.col("turn")
    return t.select("conv_id", (k % 50).alias("user_id"), F.when(k % 3 == 0, "view").when(k % 3 == 1, "comment").otherwise("edit").alias("permission"), F.when(k % 4 == 0, "revoke").otherwise("grant").alias("action"), F.col("turn").alias("ts"))


_CONV_SQL = """c as (select distinct conv_id, conv_id % 50 as owner, case when conv_id % 11 = 0 then 'deleted' else 'active' end as status, conv_id * 7919 % 1000 as updated_at from conversations),
sl as (select conv_id, (conv_id * 31 + turn) % 50 as user_id, case (conv_id * 31 + turn) % 3 when 0 then 'view' when 1 then 'comment' else 'edit' end as permission, case when (conv_id * 31 + turn) % 4 = 0 then 'revoke' else 'grant' end as action, turn as ts from conversations),
sh as (select conv_id, user_id, permission, ts from (select *, row_number() over (partition by conv_id, user_id order by ts desc, action desc) as rn from sl) where rn = 1 and action = 'grant')"""


@register(f"with {_CONV_SQL} select * from sh")
def shares_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.latest_shares(_share_log(spark, sf_dir))


@register(f"with {_CONV_SQL}, a as (select conv_id, owner as user_id, true as can_view, true as can_edit from c union all select sh.conv_id, user_id, status <> 'deleted', false from sh join c using (conv_id) where user_id <> owner) select conv_id, user_id, bool_or(can_view) as can_view, bool_or(can_edit) as can_edit from a group by all")
def access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.access(_convs(spark, sf_dir), g.latest_shares(_share_log(spark, sf_dir)))


@register(f"with {_CONV_SQL}, r as (select owner as user_id, conv_id, updated_at from c where status <> 'deleted' union select user_id, conv_id, updated_at from sh join c using (conv_id) where status <> 'deleted') select user_id, conv_id, row_number() over (partition by user_id order by updated_at desc, conv_id) as position from r")
def visible_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.visible(_convs(spark, sf_dir), g.latest_shares(_share_log(spark, sf_dir)))


@register("with t as (select conv_id, turn, role, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::bigint as tokens from conversations), w as (select *, row_number() over (partition by conv_id order by turn desc) as rn, (sum(tokens) over (partition by conv_id order by turn desc rows unbounded preceding))::bigint as total from t) select conv_id, turn, role, tokens, total from w where rn = 1 or total <= 120")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.history_window(table(spark, sf_dir, "conversations"), 120).select("conv_id", "turn", "role", "tokens", "total")


@register("select conv_id, turn, sha256(text) as content_hash, sha256(text) = sha256(case when turn % 5 = 0 then text || '!' else text end) as intact from conversations")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    seen = F.when(F.col("turn") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.sha2("text", 256).alias("content_hash"), (F.sha2("text", 256) == F.sha2(seen, 256)).alias("intact"))


@register("select conv_id, turn, sha256(text) as plain_hash, (octet_length(encode(text)) + 28)::bigint as stored_bytes, conv_id % 7 = 0 as tampered from conversations")
def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a key for each conversation, read back; another key opens nothing."""
    t = table(spark, sf_dir, "conversations")
    key = F.unhex(F.sha2(F.concat(F.lit("key-"), F.col("conv_id").cast("string")), 256))
    wrong = F.unhex(F.sha2(F.lit("other"), 256))
    boxed = t.select("conv_id", "turn", key.alias("key"), F.aes_encrypt(F.col("text"), key, F.lit("GCM")).alias("box"))
    opened = boxed.withColumn("plain", F.try_aes_decrypt("box", F.when(F.col("conv_id") % 7 == 0, wrong).otherwise(F.col("key")), F.lit("GCM")))
    return opened.select("conv_id", "turn", F.sha2(F.coalesce(F.col("plain"), F.aes_decrypt("box", "key", F.lit("GCM"))), 256).alias("plain_hash"), F.length("box").cast("long").alias("stored_bytes"), F.col("plain").isNull().alias("tampered"))


_KIND = "case event_type when 'click' then 'message' when 'error' then 'archive' when 'purchase' then 'delete' when 'signup' then 'restore' else 'open' end"


def _kinds() -> F:
    return F.when(F.col("event_type") == "click", "message").when(F.col("event_type") == "error", "archive").when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "signup", "restore").otherwise("open")


@register(f"with e as (select user_id as conv_id, {_KIND} as kind, ts, event_id from events), g as (select conv_id, arg_max(kind, (ts, event_id)) filter (kind in ('archive', 'delete', 'restore')) as s, count_if(kind = 'message')::bigint as messages, max(ts) as updated_at from e group by all) select conv_id, case when s = 'archive' then 'archived' when s = 'delete' then 'deleted' when messages > 0 or s = 'restore' then 'active' else 'draft' end as status, messages, updated_at from g")
def conversation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), _kinds().alias("kind"), "ts", "event_id")
    return g.conversation_status(e)


@register("select e.event_id as id, e.ts, e.user_id, c_name as username, event_type as action from (select * from events where event_type in ('error', 'purchase') and user_id % 3 = 0 order by ts desc, event_id desc limit 50 offset 25) e left join customer on c_custkey = user_id")
def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "user_id", F.col("event_type").alias("action"))
    u = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return g.audit_page(e, u, F.col("action").isin("error", "purchase") & (F.col("user_id") % 3 == 0), 50, 25).select("id", "ts", "user_id", "username", "action")


@register("select event_id, sha256(event_id::varchar || '|' || event_type) as row_hash, case when user_id % 3 = 0 then '10.0.0.' || (user_id % 200)::varchar when user_id % 3 = 1 then 'host' || user_id::varchar else 'unknown' end as client_ip from events")
def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id")
    ip = g.client_ip(F.when(k % 3 == 0, F.concat(F.lit(" 10.0.0."), (k % 200).cast("string"), F.lit(" , 8.8.8.8"))).when(k % 3 == 1, F.lit("")), F.when(k % 3 != 2, F.concat(F.lit("host"), k.cast("string"))))
    e = table(spark, sf_dir, "events").withColumn("details", F.to_json(F.struct("event_id", "event_type")))
    back = F.from_json("details", "event_id bigint, event_type string")
    return e.select("event_id", F.sha2(F.concat_ws("|", back["event_id"].cast("string"), back["event_type"]), 256).alias("row_hash"), ip.alias("client_ip"))


@register("with e as (select user_id as job_id, case event_type when 'error' then 'error' when 'purchase' then 'done' when 'signup' then 'queued' else 'running' end as status, ts, event_id from events) select job_id, arg_max(status, (ts, event_id)) as status, count(*) as n_events, count_if(status = 'error')::bigint as n_errors, max(ts) as last_ts from e group by job_id")
def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.when(t == "error", "error").when(t == "purchase", "done").when(t == "signup", "queued").otherwise("running").alias("status"), "ts", "event_id")
    return windows.job_states(e)


@register("with a as (select n_name as role, 'doc' || (r_regionkey)::varchar || ':' || case when n_nationkey % 2 = 0 then 'read' else 'write' end as p from nation, region where (n_nationkey + r_regionkey) % 3 = 0) select role, string_agg(p, ',' order by p) as permissions from (select distinct role, p from a) group by role")
def role_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    grants = n.join(F.broadcast(r), (F.col("n_nationkey") + F.col("r_regionkey")) % 3 == 0).select(F.col("n_name").alias("role"), F.concat(F.lit("doc"), F.col("r_regionkey").cast("string")).alias("resource"), F.when(F.col("n_nationkey") % 2 == 0, "read").otherwise("write").alias("action"))
    return g.permissions(grants).select("role", F.array_join("permissions", ",").alias("permissions"))


@register("select c_custkey as user_id, c_name as name, n_name as role, case when c_custkey % 3 = 0 then null else [(c_custkey % 4)::varchar, ((c_custkey + 1) % 4)::varchar] end is null as unrestricted, r_name as region from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey")
def user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    limits = c.where("c_custkey % 3 <> 0").select("c_custkey", F.explode(F.array(F.col("c_custkey") % 4, (F.col("c_custkey") + 1) % 4)).alias("t")).groupBy("c_custkey").agg(F.collect_set("t").alias("types"))
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").join(limits, "c_custkey", "left")
    return j.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("n_name").alias("role"), F.col("types").isNull().alias("unrestricted"), F.col("r_name").alias("region"))


@register("with d as (select n_nationkey as dept_id, n_regionkey <> 2 as active from nation) select c_custkey as user_id, case when c_custkey % 10 = 0 then (select string_agg(dept_id::varchar, ',' order by dept_id) from d) when c_custkey % 3 = 0 then (select string_agg(dept_id::varchar, ',' order by dept_id) from d where active) else (select coalesce(string_agg(dept_id::varchar, ',' order by dept_id), '') from d where active and dept_id in (c_custkey % 25, (c_custkey + 7) % 25)) end as departments from customer")
def dept_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("dept_id"), (F.col("n_regionkey") != 2).alias("active"))
    k = F.col("c_custkey").cast("long")
    u = table(spark, sf_dir, "customer").select(k.alias("user_id"), F.when(k % 10 == 0, "superadmin").otherwise("user").alias("role"), F.when(k % 3 != 0, F.array(k % 25, (k + 7) % 25)).alias("allowed"))
    return g.departments_for(u, d).select("user_id", F.array_join(F.transform("departments", lambda x: x.cast("string")), ",").alias("departments"))


@register("select c_custkey as user_id, c_name as name, c_mktsegment as segment, (select count(*) from customer where c_mktsegment = 'BUILDING') as total from customer where c_mktsegment = 'BUILDING' order by c_name limit 20 offset 10")
def user_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    page = u.orderBy("c_name").offset(10).limit(20).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return page.crossJoin(u.agg(F.count("*").alias("total")))


@register("select n_nationkey as dept_id, count(c_custkey) filter (c_acctbal > 0) as active_users, count(c_custkey) filter (c_acctbal > 0) > 0 as archive_blocked, n_nationkey % 5 = 0 or count(c_custkey) > 0 as delete_blocked from nation left join customer on c_nationkey = n_nationkey group by n_nationkey")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    x = c.groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("a"), F.count("*").alias("c"))
    j = n.join(x, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    a = F.coalesce("a", F.lit(0))
    return j.select(F.col("n_nationkey").alias("dept_id"), a.alias("active_users"), (a > 0).alias("archive_blocked"), ((F.col("n_nationkey") % 5 == 0) | (F.coalesce("c", F.lit(0)) > 0)).alias("delete_blocked"))


@register("with e as (select c_nationkey::bigint as k, c_custkey::bigint % 9 as v from customer), b as (select distinct n_nationkey::bigint as k, n_nationkey::bigint % 4 as v from nation where n_nationkey % 2 = 0) select k, v from e where k not in (select k from b) union all select k, v from b")
def replace_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), (F.col("c_custkey").cast("long") % 9).alias("v"))
    b = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_nationkey").cast("long") % 4).alias("v"))
    return g.replaced(e, b, "k")


@register("select n_name as name, (select max(try_cast(p_partkey::varchar as bigint)) from part) + row_number() over (order by n_name) as code, 'dt-' || regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') as id from nation")
def next_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = g.next_codes(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("c")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "c", "name")
    return out.select("name", "code", F.concat(F.lit("dt-"), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-")).alias("id"))


@register("select c_custkey, case when c_custkey % 4 = 0 then upper(c_name) else c_name end as c_name, case when c_custkey % 6 = 0 then 'NEW' else c_mktsegment end as c_mktsegment from customer")
def patch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    p = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.upper("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 6 == 0, "NEW").alias("c_mktsegment"))
    return g.patched(c, p, "c_custkey", ["c_name", "c_mktsegment"])


@register("select event_id as session_id, user_id from events where event_type = 'signup' and (user_id % 4 <> 0 or user_id % 12 = 0 or event_id % 10 = 0)")
def session_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions left after the users divisible by 4 are deactivated; superadmins (by 12) are exempt, and sessions divisible by 10 are kept."""
    s = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("session_id"), "user_id")
    off = s.select("user_id").distinct().where("user_id % 4 = 0 and user_id % 12 <> 0")
    return s.where("session_id % 10 <> 0").join(off, "user_id", "left_anti").unionByName(s.where("session_id % 10 = 0")).select("session_id", "user_id")


@register("select count(*) as users, count_if(c_acctbal > 0)::bigint as active_users, (select count(*) from documents) as chunks from customer")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "customer").agg(F.count("*").alias("users"), F.count_if(F.col("c_acctbal") > 0).alias("active_users"))
    return u.crossJoin(table(spark, sf_dir, "documents").agg(F.count("*").alias("chunks")))


@register("select event_id, user_id, date_trunc('hour', ts) as window_start, n, n <= 2 as allowed from (select *, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as n from events)")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rate_limit(table(spark, sf_dir, "events"), 2, "hour").select("event_id", "user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "allowed")


@register("select user_id, date_trunc('day', ts)::timestamp as window_start, least(count(*), 10) as used from events group by all")
def rate_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.usage(table(spark, sf_dir, "events"), 10, "day").select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "used")


_THROTTLE_SQL = """with e as (select event_id, user_id % 20 as ip, ts, event_type <> 'error' and event_type <> 'view' as ok, time_bucket(interval '15 minutes', ts) as window_start from events),
i as (select *, sum(ok::int) over (partition by ip, window_start order by ts, event_id rows unbounded preceding) as island, row_number() over (partition by ip, window_start order by ts, event_id) as rn from e),
r as (select *, sum((not ok)::int) over (partition by ip, window_start, island order by ts, event_id rows unbounded preceding) as run from i),
f as (select ip, window_start, min(rn) as full_at from r where not ok and run = 2 group by all)
select event_id, ip, window_start, coalesce(rn > full_at, false) as blocked from r left join f using (ip, window_start)"""


@register(_THROTTLE_SQL)
def login_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("ip"), "ts", (~F.col("event_type").isin("error", "view")).alias("ok"))
    return windows.login_throttle(e, failures=2).select("event_id", "ip", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "blocked")


_SESSION_SQL = "select event_id as session_id, ts + interval 8 hour as expires_at, ts + interval 8 hour >= (select max(ts) - interval 12 hour from events) as live from events where event_type = 'signup'"


@register(_SESSION_SQL)
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.where("event_type = 'signup'").select(F.col("event_id").alias("session_id"), F.col("ts").alias("created_at"))
    now = e.agg((F.max("ts") - F.expr("interval 12 hours")).alias("as_of"))
    return windows.live_sessions(s.crossJoin(F.broadcast(now)), F.col("as_of"), 8).select("session_id", "expires_at", "live")


@register("with k as (select sha256(to_json(struct_pack(q := lower(trim(text)), c := (conv_id % 3)::varchar, u := (conv_id % 5)::varchar, l := case when turn % 2 = 0 then ['de', 'en'] else [] end, t := []::varchar[]))::varchar) as key from conversations where role = 'user') select key, count(*) as n from k group by key")
def request_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'user'").select("text", (F.col("conv_id") % 3).alias("c"), (F.col("conv_id") % 5).alias("u"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("en"), F.lit("de"))).alias("l"), F.lit(None).cast("array<string>").alias("t"))
    return t.select(windows.request_key("text", "c", "u", "l", "t").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@register("with p as (select user_id as key, ts, event_id, event_type as response, round(value / (value + 50), 6) as confidence from events) select key, min(ts) as created_at, arg_max(response, (ts, event_id)) as response, arg_max(confidence, (ts, event_id)) as confidence, max(ts) as accessed_at from p where confidence >= 0.55 group by key")
def cache_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.col("event_type").alias("response"), F.round(F.col("value") / (F.col("value") + 50), 6).alias("confidence"))
    return windows.admitted(p)


_HITS_SQL = """with recursive r as (select user_id as key, ts, event_id, floor(epoch(ts))::bigint as t from events),
a as (select key, min(t) as t from r group by key union all select a.key, (select min(r.t) from r where r.key = a.key and r.t > a.t + 36000) from a where (select min(r.t) from r where r.key = a.key and r.t > a.t + 36000) is not null),
j as (select r.*, (select max(a.t) from a where a.key = r.key and a.t <= r.t) as anchor from r)
select key, event_id, make_timestamp(anchor * 1000000) as anchor, row_number() over (partition by key, anchor order by ts, event_id) > 1 as hit from j"""


@register(_HITS_SQL)
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return windows.cache_hits(r, 36000).select("key", "event_id", F.col("anchor").cast("timestamp_ntz").alias("anchor"), "hit")


@register("with e as (select user_id as key, max(ts) as accessed_at from events group by user_id) select key, accessed_at from e where (select count(*) from e) >= 100 order by accessed_at, key limit 10")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("accessed_at"))
    return windows.evicted(e, 100)


_STORE_SQL = "store as (select doc_id, 1 as version_ts, lang, true as is_current from documents), batch as (select doc_id, 2 as version_ts, lang, true as is_current from documents where lang = 'de' and doc_id % 2 = 0), v as (select s.doc_id, s.version_ts, s.lang, s.lang <> 'de' as is_current from store s union all select * from batch)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("version_ts"), "lang", F.lit(True).alias("is_current"))
    german = d.where("lang = 'de'")
    return versions.supersede(d, german, german.where("doc_id % 2 = 0").withColumn("version_ts", F.lit(2)))


@register(f"with {_STORE_SQL} select * from v")
def version_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


@register(f"with {_STORE_SQL}, m as (select doc_id, max(version_ts) as version_ts from v group by doc_id) select v.*, sha256(doc_id::varchar || '|' || version_ts::varchar) as point_id from v join m using (doc_id, version_ts)")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest(_versions(spark, sf_dir)).withColumn("point_id", versions.chunk_id("doc_id", "version_ts"))


@register("select * from (select role, string_agg(text, '\n' order by turn) as said, conv_id from conversations where role = 'assistant' group by all)".replace("'\n'", "chr(10)"))
def ordered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    got = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.groupBy("conv_id", "role").agg(F.array_join(F.transform(got, lambda x: x["text"]), "\n").alias("said")).select("role", "said", "conv_id")
