"""Near-duplicate lines by an exact set-similarity join.

A line's tokens are its distinct five-word shingles (the whole line where it has fewer
words). A line is removed when an earlier one, in the order of doc_id, text and line number,
has a Jaccard similarity of 0.75 or more with it. DataFrame functions only.

1. Equal lines share a class; all but the class's first line go.
2. A set of n tokens has a match only if at most n/4 of them occur in no other class. Those
   whose hash falls into ``EIGHTHS`` eighths of all hashes are counted, which rules out nearly
   all classes without loss, and no other token leaves the row that it comes from.
3. The classes left get whole sets. Tokens are ordered by rarity; sets of which more than a quarter
   is unique drop out; prefixes of rare tokens are joined under the length and positional filters.
4. Pairs are verified by their sets. A line meets first the earliest ones of ``ROUNDS`` shares of each token's
   lines, and all others only where it has found no match yet, so a large group of variants is not paired
   up; the lines of a common token are dealt to blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, release, save
from .shingles import SPACE, WIDTH, line_words, shingle_rows, shingles

EIGHTHS, ROUNDS, BLOCK = 3, (4,), 64
#: Sides of so many lines at most, of one short number each, go to all executors; larger ones are shuffled.
BROADCAST_LINES = 1_000_000
LIMIT = 4095  # of the budget of unique tokens that a key has room for
_PLACES = 1 << 62


def _needed(n: Column) -> Column:
    """The tokens that a set of ``n`` must share with any set that matches it."""
    return F.ceil(n * 3 / F.lit(4))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, th, line_no, line): th tells texts of one doc_id apart. Blank lines are left out."""
    own = docs.where("doc is not null and text is not null")
    out = own.select("doc", _text_hash().alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return out.where(F.ltrim("line", F.lit(SPACE)) != "")


def _text_hash() -> Column:
    return F.xxhash64("text").bitwiseAND(0x7FFFFFFF)


def _key(line: str = "line") -> Column:
    """52 bits of a line's hash; the low 12 bits are free."""
    return F.xxhash64(line).bitwiseAND(~LIMIT)


def _place() -> Column:
    """doc, th and line_no as one number, in their order."""
    inner = F.shiftleft("th", 31) + F.col("line_no")
    return (F.col("doc").cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(19,0)") + inner.cast("decimal(19,0)")).cast("decimal(38,0)")


def _small(df: DataFrame, lines: str) -> DataFrame:
    """``df``, to be broadcast if its arrays ``lines`` hold few lines in all."""
    n = df.agg(F.sum(F.size(lines))).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_LINES else df


def _ruled_out(lines: DataFrame) -> DataFrame:
    """(k): keys of the lines of which more sampled tokens than a match can miss occur in no line of another key."""
    w = line_words(lines.select(_key().alias("k"), "line"))
    # a key carries how many tokens a match may miss, and LIMIT where that is not less
    budget = F.least(F.floor((F.greatest(F.size("w") - (WIDTH - 1), F.lit(1))) / 4), F.lit(LIMIT)).cast("long")
    rows = shingle_rows(w.select((F.col("k") + budget).alias("k"), "w")).where(F.col("h").bitwiseAND(7) < EIGHTHS)
    alone = rows.groupBy("h").agg(F.min("k").alias("k"), F.max("k").alias("b")).where("k = b")
    many = alone.groupBy("k").agg(F.count("*").alias("u"))
    rest = F.col("k").bitwiseAND(LIMIT)
    return many.where((F.col("u") > rest) & (rest < LIMIT)).select(F.col("k").bitwiseAND(~LIMIT).alias("k"))


def _sets(own: DataFrame, classes: DataFrame) -> DataFrame:
    """(at, n, t) of the first lines of ``classes``: t holds the distinct tokens. Rows repeat as those of ``own`` do."""
    inner = F.pmod("at", F.lit(_PLACES).cast("decimal(38,0)"))
    place = classes.select(inner.cast("long").alias("inner"), ((F.col("at") - inner) / F.lit(_PLACES).cast("decimal(19,0)")).cast("long").alias("doc"))
    want = place.groupBy("doc", F.shiftright("inner", 31).alias("th")).agg(F.collect_list(F.col("inner").bitwiseAND(0x7FFFFFFF).cast("int")).alias("want"))
    both = own.where("text is not null").withColumn("th", _text_hash()).join(_small(save(want), "want"), ["doc", "th"])
    picked = both.select("doc", "th", F.split("text", "\n").alias("ls"), "want").select("doc", "th", "ls", F.explode("want").alias("line_no"))
    w = line_words(picked.select(_place().alias("at"), F.get("ls", F.col("line_no")).alias("line")))
    return w.select("at", F.array_distinct(shingles(F.col("w"))).alias("t")).select("at", F.size("t").alias("n"), "t")


def _postings(sets: DataFrame) -> DataFrame:
    """(h, at, n, u, i): the prefix of each set in the order of rarity; i is a token's place, behind the u that no other set has."""
    df = sets.select(F.explode("t").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # rarity by powers of two and the hash's upper 58 bits as one number: its order is the sets' order
    key = F.shiftleft(F.floor(F.log2("df")).cast("long"), 58).bitwiseOR(F.shiftrightunsigned("h", 6)).alias("key")
    near = sets.select("at", "n", F.explode("t").alias("h")).join(df.select("h", key), "h").groupBy("at", "n").agg(F.sort_array(F.array_distinct(F.collect_list("key"))).alias("o"))
    unique = F.col("n") - F.size("o")
    length = F.col("n") - _needed(F.col("n")) + 1 - unique  # of the prefix, less its unique tokens, which come first
    near = near.where(length > 0).select("at", "n", unique.alias("u"), F.posexplode(F.slice("o", F.lit(1), length.cast("int"))).alias("i", "h"))
    return near.select("h", "at", "n", "u", (F.col("i") + F.col("u")).alias("i"))


def _meet(y: DataFrame, x: DataFrame, on: list[str]) -> DataFrame:
    """Pairs (y, x) of postings ``y`` and earlier ones (the struct x of ``x``) that length and position let match."""
    both = y.join(x, on)
    ny, nx = F.col("n"), F.col("x.n")
    least = F.ceil((nx + ny) * 3 / F.lit(7))  # common tokens that the similarity asks for
    rest = F.least(nx - F.col("x.i"), ny - F.col("i"))
    seen = F.least(F.col("x.i") - F.col("x.u"), F.col("i") - F.col("u"))  # before this token, only tokens that other sets have too
    ok = (F.col("x.at") < F.col("at")) & (nx * 4 >= ny * 3) & (ny * 4 >= nx * 3) & (rest + seen >= least)
    return both.where(ok).select(F.col("at").alias("y"), F.col("x.at").alias("x")).distinct()


def _matched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.select(F.col("at").alias("x"), F.col("t").alias("tx")), "x").join(sets.select(F.col("at").alias("y"), F.col("t").alias("ty")), "y")
    common = F.size(F.array_intersect("tx", "ty"))
    return both.where(common * 4 >= (F.size("tx") + F.size("ty") - common) * 3).select(F.col("y").alias("at")).distinct()


def _near(sets: DataFrame) -> DataFrame:
    """(at) of every set that matches one of an earlier place."""
    posts = left = save(_postings(sets))
    one = F.struct("at", "n", "u", "i")
    hit = None
    for width in (*ROUNDS, None):
        if width:
            share = F.pmod(F.xxhash64("at"), F.lit(width)).alias("b")
            x = posts.groupBy("h", share).agg(F.min(one).alias("x")).drop("b")
            found = _meet(left, x, ["h"])
        else:
            many = posts.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
            x = posts.join(many, "h").select("h", F.pmod(F.xxhash64("at"), F.col("nb")).alias("b"), one.alias("x"))
            y = left.join(many, "h").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
            found = _meet(y, x, ["h", "b"])
        old, hit = hit, save(_matched(found, sets) if hit is None else _matched(found, sets).union(hit))
        rest = save(left.join(hit, "at", "left_anti")) if width else None
        drop(old)
        if left is not posts:
            drop(left)
        left = rest
        release(sets.sparkSession)
    drop(posts)
    return hit


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, th, line_no) of every line that matches an earlier one, for ``docs`` (doc, text); th is the text's ``_text_hash``.

    Blank lines, null texts and rows without an id take no part. Rows that repeat an id and a text count as one document;
    rows of one id with different texts are documents of their own, in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    every = _lines(docs)
    lines = save(every.select("doc", "th", "line_no", _key().alias("k"), F.xxhash64(F.lit(1), "line").alias("k2")))
    out = save(_ruled_out(every))
    release(spark)
    classes = save(lines.groupBy("k", "k2").agg(F.min(_place()).alias("at"), F.max(_place()).alias("last")))
    some = save(classes.join(out, "k", "left_anti").select("k", "k2", "at"))
    drop(out)
    sets = save(_sets(docs, some))
    release(spark)
    # most of what is left drops out once the tokens that a set alone has are counted, before any token is joined
    own = F.xxhash64("at").alias("own")  # a short stand-in
    lone = sets.select(own, F.explode("t").alias("h")).groupBy("h").agg(F.min("own").alias("own"), F.max("own").alias("b")).where("own = b").groupBy("own").agg(F.count("*").alias("lone"))
    few = sets.select("*", own).join(lone, "own", "left").where(F.coalesce("lone", F.lit(0)) <= F.col("n") - _needed(F.col("n")))
    few = save(few.select("at", "n", "t"))
    drop(sets)
    release(spark)
    hit = _near(few)
    drop(few)
    near = some.join(hit, "at", "left_semi").select("k", "k2", F.lit(True).alias("near"))
    rule = classes.where("last > at").select("k", "k2", "at").join(near, ["k", "k2"], "full")
    rule = save(rule.select("k", "k2", F.when(F.col("near"), None).otherwise(F.col("at")).alias("kept")))
    gone = lines.join(rule, ["k", "k2"]).where(~F.coalesce(F.col("kept") == _place(), F.lit(False)))
    gone = save(gone.select("doc", "th", "line_no").distinct())
    for x in (hit, some, classes, lines, rule):
        drop(x)
    release(spark)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that match earlier ones, plus n_lines, n_removed and a new text.

    All columns stay, but for those named n_lines and n_removed, which are replaced; the text holds the lines kept,
    joined by newlines. Null texts stay null with no lines; rows without an id stay as they are. Repeated rows stay,
    each with the same text; for ids with several texts see ``removed_lines``.
    """
    gone = removed_lines(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")))
    gone = save(gone.groupBy("doc", "th").agg(F.collect_list("line_no").alias("gone")))
    row = docs.select(F.struct(*(c for c in docs.columns if c not in (text_col, "n_lines", "n_removed"))).alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    out = row.withColumn("th", _text_hash()).join(_small(gone, "gone"), ["doc", "th"], "left")
    n = F.size("lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "gone"), lambda i: F.get("lines", i))
    out = out.select("row", "text", "gone", F.split("text", "\n").alias("lines"))
    out = out.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.greatest(n, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return out.select(*(F.col("text").alias(text_col) if c == text_col else F.col(f"row.{c}") for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
