"""Each kind of chunker over elements of all labels, with SQL that walks the elements one after the other where order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from .catalog import register
from .search_queries import table

#: Label, level and a mark put before the text, by the line's number modulo the length.
LABELS = [
    ("heading", 1, ""), ("text", None, ""), ("list_item", None, ""), ("list_item", None, ""), ("text", None, "§ 7 "), ("text", None, ""),
    ("heading", 2, "1.2 "), ("table", None, ""), ("caption", None, "Tabelle 1: "), ("text", None, ""), ("figure", None, ""), ("caption", None, " "),
    ("text", None, "WHEREAS "), ("caption", None, "Abbildung 2: "), ("formula", None, ""), ("figure", None, ""), ("list_item", None, "Milestone 3: 12.05.2024 "),
    ("code", None, ""), ("list_item", None, ""), ("footnote", None, ""), ("text", None, "1) "), ("other", None, ""), ("heading", None, ""), ("text", None, ""),
]
_N = len(LABELS)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as an element, blank ones too."""
    names = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).cast("int").alias("level"), F.lit(c).alias("mark")) for a, b, c in LABELS))
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    t = t.withColumn("x", F.get(names, F.col("seq") % _N))
    return t.select("doc_id", "seq", "x.label", "x.level", F.concat("x.mark", "line").alias("text"))


def _quoted(x: object) -> str:
    return "null" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _in(labels: tuple[str, ...]) -> str:
    return f"label in ({', '.join(map(_quoted, labels))})" if labels else "false"


_STRIP = r"regexp_replace({}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
_WORDS = r"len(list_filter(string_split_regex({}, '[\s\x0B]+'), lambda z: z <> ''))"
_END = 1 << 40

#: CTEs of the elements of this module, el (doc_id, seq, label, level, text).
LINES = f"""lb(k, label, level, mark) as (values {", ".join(f"({i}, {_quoted(a)}, {_quoted(b)}::int, {_quoted(c)})" for i, (a, b, c) in enumerate(LABELS))}),
el as (select doc_id, seq, label, level, mark || line as text from (select doc_id, unnest(range(len(l))) as seq, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)) join lb on k = seq % {_N})"""
#: Elements with the path of headings above: a heading of level n cuts the path to n - 1 entries, one without a level nothing.
_PATHS = f"""hd as (select doc_id, seq, level, {_STRIP.format("text")} as t, row_number() over (partition by doc_id order by seq) as j from el where label = 'heading'),
hp as (select doc_id, seq, j, [t] as path from hd where j = 1 union all select hd.doc_id, hd.seq, hd.j, list_append(case when hd.level is null then hp.path else hp.path[1:hd.level - 1] end, hd.t) from hp join hd on hd.doc_id = hp.doc_id and hd.j = hp.j + 1),
ep as (select el.*, coalesce(hp.path, []::varchar[]) as path, (select max(h.seq) from hd h where h.doc_id = el.doc_id and h.seq < el.seq) as parent_seq from el asof left join hp on hp.doc_id = el.doc_id and hp.seq <= el.seq)"""


def _windows(source: str, most: int) -> str:
    """CTEs from ``source`` (doc_id, pos, text) to win (doc_id, pos, seg, text): units are packed one after the other."""
    n = _WORDS
    return rf"""big as (select * from {source} where {n.format("text")} > {most}),
bp as (select doc_id, pos, unnest(range(len(l))) as p, unnest(l) as para from (select doc_id, pos, string_split(text, chr(10)) as l from big)),
bu as (select doc_id, pos, p, 0 as k, para as t, false as cut from bp where {n.format("para")} <= {most} union all select doc_id, pos, p, unnest(range(len(s))) as k, unnest(s) as t, unnest(range(len(s))) = 0 as cut from (select doc_id, pos, p, string_split(regexp_replace(para, '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)) as s from bp where {n.format("para")} > {most})),
un as (select doc_id, pos, t, cut, {n.format("t")} as n, row_number() over (partition by doc_id, pos order by p, k) as i from bu),
pk as (select doc_id, pos, i, 0 as seg, n as total, t from un where i = 1 union all select un.doc_id, un.pos, un.i, case when un.cut or pk.total + un.n > {most} then pk.seg + 1 else pk.seg end, case when un.cut or pk.total + un.n > {most} then un.n else pk.total + un.n end, un.t from pk join un on un.doc_id = pk.doc_id and un.pos = pk.pos and un.i = pk.i + 1),
win as (select doc_id, pos, seg, text from (select doc_id, pos, seg, string_agg(t, chr(10) order by i) as text from pk group by all) where {_STRIP.format("text")} <> '' union all select doc_id, pos, 0, text from {source} where {n.format("text")} <= {most})"""


def chunk_sql(kind: str, source: str = LINES, hashed: bool = True, most: int = chunking.MAX_TOKENS) -> str:
    """SQL of ``chunking.chunk`` over the elements that the CTEs ``source`` give as el."""
    c = chunking.CHUNKERS[kind]
    yes = lambda x: "true" if x else "false"
    atom = " ".join(f"when {' or '.join(f'regexp_matches(text, {_quoted(p)})' for p in patterns)} then {_quoted(name)}" for name, patterns in c.atom)
    atom = f"case when filled and (item or para) then case {atom} end end" if atom else "null::varchar"
    alone = f"when label = 'figure' then 'figure' when {_in(c.own)} and filled then label" if c.own else ""
    flush = f"(body and not item and (filled or ({yes(c.blank_text_flushes)} and para)))" if c.text_flushes_list else "false"
    later = lambda flag: f"(select min(x.seq) from g x where x.doc_id = g.doc_id and x.seq > g.seq and x.{flag})"
    first = f"case when n.seq is null then {yes(c.list_first_at_end)} else coalesce(n.text_atom, false) and {yes(c.list_first)} end"
    body = "string_agg(g.text, chr(10) order by g.seq)"
    shown = "case when kind = 'figure' then case when coalesce(carried, text) <> '' then '[Figure: ' || coalesce(carried, text) || ']' else '[Figure]' end else text end" if c.captions else "text"
    context = lambda p, t: f"case when len({p}) > 0 then {_STRIP.format(f'(array_to_string({p}, chr(32) || chr(62) || chr(32)) || chr(10) || chr(10) || {t})')} else {t} end"
    ctx = context("path", "shown")
    if c.rewrite:
        ctx = f"case when attached is not null then {context('cpath', '(shown || chr(10) || ' + _quoted('Caption: ') + ' || attached)')} else {ctx} end"
    if hashed:
        caption = ", coalesce(attached, case when kind = 'figure' then coalesce(carried, text) else carried end) as caption" if c.captions else ""
        result = f"sha256(shown) as text_hash, sha256(case when kind = 'heading' then shown else {ctx} end) as context_hash, array_to_string(path, '|') as heading_path{caption}"
    else:
        result = f"shown as text, case when kind = 'heading' then shown else {ctx} end as context_text"
    return rf"""with recursive {source}, {_PATHS},
f as (select *, {_STRIP.format("text")} <> '' as filled, {_in(("heading", "table", "figure", *c.own))} as wide, {"label = 'caption'" if c.captions else "false"} as captioned from ep),
b as (select *, not wide and not captioned as body from f),
i as (select *, body and label = 'list_item' as item, body and label <> 'list_item' and {"label = 'text'" if kind == "default" else "true"} as para from b),
a as (select *, {atom} as atom from i),
o as (select *, case when label = 'heading' then 'heading' when label = 'table' and filled then 'table' {alone} when atom is not null then atom {"when body and not item and filled then 'prose'" if c.loose else ""} end as own from a),
l as (select *, {yes(c.lists)} and item and filled and own is null as in_list, wide or atom is not null as fp, atom is not null and not item as text_atom from o),
g as (select *, body and filled and own is null and not in_list as in_prose, fp or {flush} as fl from l),
pr as (select g.doc_id, coalesce(n.seq, {_END}) as pos, case when {first} then 1 else 0 end as rank, {_STRIP.format(body) if c.stripped else body} as text, min(g.seq) as fs from (select *, {later("fp")} as np from g where in_prose) g left join g n on n.doc_id = g.doc_id and n.seq = g.np group by g.doc_id, n.seq, n.text_atom),
li as (select g.doc_id, coalesce(n.seq, {_END}) as pos, case when {first} then 0 else 1 end as rank, string_agg('• ' || {_STRIP.format("g.text")}, chr(10) order by g.seq) as text, min(g.seq) as fs from (select *, {later("fl")} as nl from g where in_list) g left join g n on n.doc_id = g.doc_id and n.seq = g.nl group by g.doc_id, n.seq, n.text_atom),
{_windows("pr", most)},
every as (select win.doc_id, win.pos, rank, seg, 'prose' as kind, win.text, fs from win join pr on pr.doc_id = win.doc_id and pr.pos = win.pos union all select doc_id, pos, rank, 0, 'list', text, fs from li union all select doc_id, seq, 2, 0, own, text, seq from g where own is not null),
nr as (select *, row_number() over (partition by doc_id order by pos, rank, seg) - 1 as idx from every),
st as (select *, row_number() over (partition by doc_id order by pos, rank, seg) as k from (select doc_id, pos, rank, seg, kind, idx, null as cap from nr union all select doc_id, seq, -1, 0, 'caption', null, {_STRIP.format("text")} from g where captioned)),
wk as (select doc_id, 0 as k, ''::varchar as last, -1 as last_idx, ''::varchar as pend, null::bigint as to_idx, null::varchar as carried, null::varchar as cap, null::bigint as pos from (select distinct doc_id from st) union all
 select st.doc_id, st.k, case when st.kind = 'caption' then wk.last else st.kind end, case when st.kind = 'caption' then wk.last_idx else st.idx end,
 case when st.kind in ('table', 'figure') then '' when st.kind <> 'caption' then wk.pend when wk.last in ('table', 'figure') then '' else st.cap end,
 case when st.kind = 'caption' and wk.last in ('table', 'figure') then wk.last_idx when st.kind in ('table', 'figure') then st.idx end,
 case when st.kind in ('table', 'figure') then nullif(wk.pend, '') end, st.cap, st.pos from wk join st on st.doc_id = wk.doc_id and st.k = wk.k + 1),
ca as (select doc_id, to_idx as idx, max(carried) filter (cap is null) as carried, arg_max(cap, pos) filter (cap is not null) as attached, max(pos) filter (cap is not null) as cap_pos from wk where to_idx is not null group by all),
fin as (select nr.*, carried, attached, e.path, e.parent_seq, k.path as cpath from nr join ep e on e.doc_id = nr.doc_id and e.seq = nr.fs left join ca on ca.doc_id = nr.doc_id and ca.idx = nr.idx left join ep k on k.doc_id = nr.doc_id and k.seq = ca.cap_pos),
sh as (select *, {shown} as shown from fin)
select doc_id, idx::bigint as chunk_index, kind as chunk_type, kind <> 'heading' as is_leaf, {result}, parent_seq::bigint as parent_seq from sh"""


def _chunked(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = chunking.chunk(elements(spark, sf_dir), kind)
        cols = ["doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", "is_leaf", F.sha2("text", 256).alias("text_hash"), F.sha2("context_text", 256).alias("context_hash"), F.col("parent_seq").cast("long").alias("parent_seq"), F.array_join("heading_path", "|").alias("heading_path")]
        return out.select(*cols, *(["caption"] if chunking.CHUNKERS[kind].captions else []))

    query.__name__ = f"chunked_{kind}"
    return register(chunk_sql(kind))(query)


for _kind in chunking.CHUNKERS:
    _chunked(_kind)


def section_sql(source: str = LINES, hashed: bool = True) -> str:
    """SQL of ``chunking.section_chunks`` over the elements that the CTEs ``source`` give as el."""
    result = "sha256(nr.text) as text_hash, array_to_string(e.path, '|') as heading_path" if hashed else "nr.text, e.path as heading_path"
    return rf"""with recursive {source}, {_PATHS},
f as (select *, {_STRIP.format("text")} <> '' as filled, {_in(("heading", "table", "figure", "formula"))} as wide, label = 'heading' and regexp_matches(text, {_quoted(chunking.NUMBERED)}) as numbered from ep),
w as (select f.*, (select max(x.seq) from f x where x.doc_id = f.doc_id and x.seq <= f.seq and x.wide) as lw, coalesce((select min(x.seq) from f x where x.doc_id = f.doc_id and x.seq > f.seq and x.wide), {_END}) as pos from f),
o as (select w.*, case when s.numbered then s.seq end as open, not w.wide and w.label <> 'caption' as body from w left join f s on s.doc_id = w.doc_id and s.seq = w.lw),
pr as (select doc_id, max(pos) as pos, string_agg(case when label = 'heading' then {_STRIP.format("text")} when label = 'list_item' then '• ' || {_STRIP.format("text")} else text end, chr(10) order by seq) as text, open as fs from o where open is not null and (label = 'heading' or (body and (filled or label = 'list_item'))) group by doc_id, open),
{_windows("pr", chunking.MAX_TOKENS)},
every as (select win.doc_id, win.pos, 0 as rank, seg, 'section' as kind, win.text, fs from win join pr on pr.doc_id = win.doc_id and pr.pos = win.pos
 union all select doc_id, pos, 1, 0, 'list', string_agg('• ' || {_STRIP.format("text")}, chr(10) order by seq), min(seq) from o where open is null and body and filled and label = 'list_item' group by doc_id, pos
 union all select doc_id, seq, 2, 0, 'prose', text, seq from o where open is null and body and filled and label <> 'list_item'
 union all select doc_id, seq, 2, 0, case when numbered then 'gap' else label end, text, seq from o where label = 'heading' or label = 'figure' or (label in ('table', 'formula') and filled)),
nr as (select *, row_number() over (partition by doc_id order by pos, rank, seg) - 1 as idx from every)
select nr.doc_id, idx::bigint as chunk_index, kind as chunk_type, {result} from nr join ep e on e.doc_id = nr.doc_id and e.seq = nr.fs where kind <> 'gap'"""


@register(section_sql())
def chunked_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.section_chunks(elements(spark, sf_dir))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", F.sha2("text", 256).alias("text_hash"), F.array_join("heading_path", "|").alias("heading_path"))
