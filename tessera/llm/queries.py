"""The operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, capjoin, chat, decontaminate, htmltext, lexindex, linededup, ngramjoin, prefixtrie, quality, suffixdedup, tokenfile, toxicity
from .docstats import fold
from .scratch import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) == 1)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) == 0)


def op10_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), said.alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    return chat.digests(chat.format_turns(chat.text_parts(turns.unionByName(extra))))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capjoin.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "ids"))


def op12_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexindex.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("visited")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie_of(table(spark, sf_dir, "conversations"))


WORDS_SQL = r"""list_filter(string_split_regex(lower(coalesce({0}, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"""
SHINGLES_SQL = "case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end"
TERMS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')"
#: crc32 of the decimal conv_id, bit by bit
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::bigint)), lambda y, z: xor(y >> 1, 3988292384::bigint * (y & 1)))), 4294967295::bigint)"


ORACLES: dict[str, str] = {
    "op3_cap_filters": """
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.93),
r as (select vec_id as a, vec_id as c from embeddings union select e.b, r.c from r join e on e.a = r.a),
m as (select a, min(c) as c from r group by a), n as (select a, count(*) as n from e group by a)
select m.a as vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, m.a = c as kept from m left join n on n.a = m.a""",
    "op4_line_dedup": f"""
with lines as (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
w as (select doc_id, line_no, {WORDS_SQL.format("line")} as w from lines),
t as (select distinct doc_id, line_no, unnest({SHINGLES_SQL}) as tok from w),
n as (select doc_id, line_no, count(*) as n from t group by all),
p as (select y.doc_id, y.line_no, x.doc_id as xd, x.line_no as xl, count(*) as c from t y join t x on y.tok = x.tok and (x.doc_id, x.line_no) < (y.doc_id, y.line_no) group by all),
gone as (select distinct p.doc_id, p.line_no from p join n a on a.doc_id = p.doc_id and a.line_no = p.line_no join n b on b.doc_id = p.xd and b.line_no = p.xl where 4 * c >= 3 * (a.n + b.n - c)),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.line_no) as text from lines l anti join gone g on l.doc_id = g.doc_id and l.line_no = g.line_no group by l.doc_id),
r as (select doc_id, count(*) as n from gone group by all)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(r.n, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join r on r.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id""",
    "op9_benchmark_containment": f"""
with i as (select item_id, {WORDS_SQL.format("text")} as w from benchmark), d as (select doc_id, {WORDS_SQL.format("text")} as w from documents),
s as (select distinct item_id, unnest({SHINGLES_SQL}) as h from i), n as (select item_id, count(*) as n from s group by all),
dh as (select distinct doc_id, unnest({SHINGLES_SQL}) as h from d),
c as (select item_id, doc_id, count(*) as c from s join dh using (h) group by all)
select item_id, doc_id, n as n_shingles, c as n_shared, round(c / n, 6) as containment from c join n using (item_id) where 100 * c >= 75 * n""",
    "op12_stratified_search": f"""
with d as (select doc_id, {TERMS_SQL} as t from documents), g as (select count(*) as n, sum(len(t))::bigint as l from d where len(t) > 0),
p as (select doc_id, term, count(*) as tf, any_value(n) as n from (select doc_id, len(t) as n, unnest(t) as term from d) group by doc_id, term),
q as (select item_id, term, count(*) as times from (select item_id, unnest({TERMS_SQL}) as term from benchmark) group by all),
f as (select term, count(*) as df from p where term in (select term from q) group by term),
w as (select term, floor(1000 * ln((2 * g.n + 2)::double / (2 * df + 1)))::bigint as w from f, g),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * g.n) // g.l))))::bigint as score from q join w using (term) join p using (term), g group by all),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10""",
    "op13_prefix_trie": rf"""
with own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from conversations),
c as (select distinct conv_id, conv_id - conv_id % 20 as base, {CRC_SQL} % 4 as h from own),
r as (select c.conv_id, 0 as own, pos, role, text from c join own on own.conv_id = base and pos <= h union all select c.conv_id, 1, pos, role, text from c join own on own.conv_id = c.conv_id and pos > h),
l as (select c.conv_id, coalesce(list(struct_pack(role, text) order by own, pos) filter (own is not null), []) as t from c left join r using (conv_id) group by c.conv_id),
p as (select conv_id, unnest(range(len(t) + 1)) as depth, t from l),
n as (select t[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id, ',' order by conv_id) filter (len(t) = depth), '') as ends, case when depth > 0 then (count(*) - 1) * len(regexp_extract_all(any_value(t[depth].text), '[^\x20\x09-\x0D]+')) else 0 end as saved from p group by path, depth),
k as (select path, depth, conv_id, n_convs, ends, saved, (select count(*) from n c where c.depth = n.depth + 1 and c.path[1:n.depth] = n.path) as n_children from n)
select k.conv_id, k.depth, (select u.conv_id from n u where u.depth = k.depth - 1 and u.path = k.path[1:k.depth - 1]) as parent_conv_id, k.n_convs, k.n_children, (select count(*) from k s where s.n_children = 0 and s.depth >= k.depth and s.path[1:k.depth] = k.path) as n_leaves, (select sum(saved) from n s where s.depth >= k.depth and s.path[1:k.depth] = k.path)::bigint as saved_tokens, sha256(k.ends) as ends_sha256 from k""",
}
QUERIES = {f.__name__: f for f in (op1_toxicity_crf, op2_html_text, op3_cap_filters, op4_line_dedup, op5_suffix_dedup, op6_jaccard_join, op7_bpe_codec, op8_quality_rff, op9_benchmark_containment, op10_chat_parts, op11_huffman_ids, op12_stratified_search, op13_prefix_trie)}
