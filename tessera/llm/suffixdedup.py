"""Removal of long repeated byte strings by longest-previous-factor arrays.

A position of the corpus starts a repeat of length K where its longest previous or next
factor (the longest string there that also starts at an earlier or later place) has K bytes
or more. No machine holds a suffix array of the whole corpus, so suffixes are brought together
first:

1. Anchors. In each string of K bytes the k-gram of least hash, the leftmost of equal ones, is its
   anchor. Equal strings have equal anchors at equal offsets, so occurrences of a repeat meet
   at one anchor; about 2 of every K - k positions are anchors.
2. Anchors whose k-gram occurs once are dropped. The others bring the strings of K bytes whose
   anchor they are, as one piece of text; equal pieces collapse into one row with its first and
   last place before the shuffle.
3. The suffixes from the anchors of a group are sorted, the prefixes to their left likewise from right to left, and
   common lengths of neighbours are taken. For starts s bytes before the anchor, rows in the order of (what stands
   between start and anchor, suffix from the anchor) are in suffix order, and in a run of it all common lengths are K or
   more. The longest previous factor of a start has K bytes where its previous or its next smaller place in suffix
   order lies in its run, the longest next factor likewise by greater places. Nobody needs lengths
   beyond K, so the arrays hold only whether they are reached.
4. A group of very many different texts would be one task's. There the order is cut at K bytes, where all that is left of
   it is which strings are equal: these meet by a hash of 128 bits, spread over all tasks.
5. The positions found go back to their documents as ranges.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rowkeys import with_key
from .scratch import drop, release, save

LENGTH, GRAM, BLOCK, GROUP, CHUNK = 200, 88, 1 << 18, 3000, 1500
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams of ``data`` (uint8)."""
    n = len(data)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INV)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
        h = (total[k:] - total[: n - k + 1]) * back[: n - k + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    n = len(x) - w + 1
    pad = np.concatenate([x, np.full(-len(x) % w, x.max(initial=np.uint64(0)))]).reshape(-1, w)
    fore = np.minimum.accumulate(pad, 1).ravel()
    aft = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(aft[:n], fore[w - 1 : w - 1 + n])


def anchors(data: bytes, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Places, k-gram hashes, and first and last start of the strings that each anchor stands for. Texts shorter
    than ``length`` have none. Works in blocks."""
    whole, w = np.frombuffer(data, np.uint8), length - k + 1
    out = []
    for lo in range(0, len(whole) - length + 1, BLOCK):
        h = gram_hashes(whole[lo : lo + BLOCK + length - 1], k)
        key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
        at, first, n = np.unique(window_minima(key, w) & np.uint64((1 << 20) - 1), return_index=True, return_counts=True)
        at = at.astype(np.int64)
        out.append((at + lo, h[at].view(np.int64), first + lo, first + n - 1 + lo))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at, hashes, first, last = (np.concatenate(x) for x in zip(*out))
    if len(out) > 1:  # an anchor near the edge of a block may come from both sides
        keep, head, n = np.unique(at, return_index=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(n)
        at, hashes, first, last = keep, hashes[head], np.minimum.reduceat(first[order], ends - n), np.maximum.reduceat(last[order], ends - n)
    return at, hashes, first, last


def common(parts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``parts`` within their groups, and the length of what each has in common with the one before it (-1 at a group's first)."""
    order = np.array(sorted(range(len(parts)), key=lambda i: (group[i], parts[i])), np.int64)
    sizes = np.array([len(parts[i]) for i in order])
    width = max(1, int(sizes.max()))
    m = np.frombuffer(b"".join(parts[i].ljust(width, b"\0") for i in order), np.uint8).reshape(-1, width)
    other = m[1:] != m[:-1]
    lcp = np.where(other.any(1), other.argmax(1), width)
    lcp = np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))
    lcp[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], lcp])


def nearest_smaller(x: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each place the last one before it, in its run, that holds a smaller value; -1 where there is none.

    What lies between a place and its pointer is greater than its own value, so a pointer to a greater value
    may be replaced by that one's own; pointers double at each step.
    """
    at = np.arange(len(x)) - 1
    at[np.concatenate([[True], run[1:] != run[:-1]])] = -1
    while True:
        bad = np.flatnonzero((at >= 0) & (x[at] > x))
        if not len(bad):
            return at
        at[bad] = at[at[bad]]


def reached(place: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous and next factors of starts, given in suffix order, reach the length that runs stand for."""
    previous, following = ((nearest_smaller(x, run) >= 0) | (nearest_smaller(x[::-1], run[::-1])[::-1] >= 0) for x in (place, -place))
    return previous, following


def repeats(rows: list[tuple], length: int) -> list[tuple[int, list[list[int]]]]:
    """Rows (group, left, text, first_doc, first_at, last_doc, last_at) -> (row, [[low, high, first]]): starts, counted
    from the anchor, from ``low`` to before ``high`` have a match elsewhere; ``first`` tells that the row's first place has no earlier one.

    ``left`` is how many bytes of the text stand before the anchor. Texts of one group are all different.
    """
    rows_at = sorted(range(len(rows)), key=lambda i: (rows[i][3], rows[i][4]))
    rows = [rows[i] for i in rows_at]
    group = np.unique([x[0] for x in rows], return_inverse=True)[1]
    left = np.array([x[1] for x in rows])
    right = np.array([len(x[2]) for x in rows]) - left
    twice = np.array([x[3:5] != x[5:7] for x in rows])
    m = len(rows)
    fore, fore_lcp = common([x[2][x[1] :] for x in rows], group)
    back, back_lcp = common([x[2][: x[1]][::-1] for x in rows], group)

    def best(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        out = np.empty(m, np.int64)
        out[order] = np.maximum(lcp, np.append(lcp[1:], -1))
        return out

    live = twice | (np.maximum(best(fore, fore_lcp), 0) + np.maximum(best(back, back_lcp), 0) >= length)
    low = -int(left.max())
    hit = np.zeros((m, int((right - length).max()) - low + 1), bool)
    lead = np.zeros_like(hit)
    classes, rank = np.empty((2, m), np.int64), np.empty(m, np.int64)
    rank[fore] = np.arange(m)
    for s in range(low, low + hit.shape[1]):
        v = np.flatnonzero(live & (left >= -s) & (right >= length + s))
        if not len(v):
            continue
        classes[0, fore] = np.cumsum(fore_lcp < length + s)
        classes[1, back] = np.cumsum(back_lcp < -s)
        got = v[np.argsort(classes[1, v] * (m + 1) + rank[v], kind="stable")]  # in suffix order
        earlier, later = reached(got, classes[0, got] * (m + 1) + classes[1, got])  # rows come in the order of place
        hit[got, s - low] = earlier | later | twice[got]
        lead[got, s - low] = ~earlier
    out = []
    for i in np.flatnonzero(hit.any(1)):
        x = np.where(hit[i], 1 + lead[i], 0)
        cut = np.flatnonzero(np.diff(x)) + 1
        edges = [0, *cut.tolist(), len(x)]
        out.append((rows_at[i], [[a + low, b + low, bool(x[a] == 2)] for a, b in zip(edges, edges[1:]) if x[a]]))
    return out


def _large_groups(flat: DataFrame, length: int) -> DataFrame:
    """What ``repeats`` finds, for groups too large for one task: each string of ``length`` bytes is hashed (128 bits)
    and equal strings meet in an aggregation, so a group is spread over all tasks."""

    def strings(batches):
        for b in batches:
            out = []
            for h, left, c, d0, a0, d1, a1, c1, c2, _ in zip(*(b.column(i).to_pylist() for i in range(10))):
                for i in range(len(c) - length + 1):
                    x = xxhash.xxh128_digest(c[i : i + length])
                    out.append((h, i - left, x, d0, a0 + i - left, d1, a1 + i - left, c1, c2, a0))
            c = list(zip(*out)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i == 2 else pa.int64()) for i, x in enumerate(c)], names=list("abcdefghij"))

    each = flat.mapInArrow(strings, "h bigint, shift bigint, x binary, d0 bigint, s0 bigint, d1 bigint, s1 bigint, c1 bigint, c2 bigint, a0 bigint")
    low, high = F.struct("d0", "s0"), F.struct("d1", "s1")
    runs = each.groupBy("h", "shift", "x").agg(F.min(low).alias("low"), F.max(high).alias("high")).where("low <> high")
    hit = each.join(runs, ["h", "shift", "x"])
    one = F.struct(F.col("shift").cast("int").alias("lo"), (F.col("shift") + 1).cast("int").alias("hi"), (low == F.col("low")).alias("first"))
    return hit.groupBy("h", "c1", "c2", F.col("d0").alias("fd"), F.col("a0").alias("fa")).agg(F.collect_list(one).alias("spans"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM, keep_first: bool = False) -> DataFrame:
    """(id, ranges array<struct<start,end>>): bytes covered by a string of ``length`` bytes that also starts
    elsewhere (with ``keep_first``: at an earlier place, in the order of id and place). The id must tell texts apart."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc is not null")

    def find(batches):
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                got = anchors(t.as_py().encode("utf-8", "surrogatepass"), length, k)
                out.append((np.full(len(got[0]), d, np.int64), got[0].astype(np.int32), got[1], (got[0] - got[2]).astype(np.int32), (got[3] - got[0]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["doc", "at", "h", "lo", "hi"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("doc", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))

    marks = save(own.mapInArrow(find, "doc bigint, at int, h bigint, lo int, hi int"))
    often = marks.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    places = save(marks.join(often, "h", "left_semi").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "h", "lo", "hi"))).alias("places")))
    drop(marks)
    release(docs.sparkSession)

    def surround(batches):
        for b in batches:
            out = []
            for d, t, ps in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = t.as_py().encode("utf-8", "surrogatepass")
                ps = ps.values
                for p, h, lo, hi in zip(*(ps.field(i).to_pylist() for i in range(4))):
                    out.append((h, lo, data[p - lo : p + hi + length], d, p))
            c = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())], names=list("abcde"))

    around = own.join(places, "doc").select("doc", "text", "places").mapInArrow(surround, "h bigint, l int, context binary, doc bigint, at bigint")
    place = F.struct("doc", "at")
    # equal surroundings are one row; a hash stands for them in both shuffles, the bytes go along once
    around = around.withColumns({"c1": F.xxhash64("context", "l"), "c2": F.xxhash64(F.lit(1), "context")})
    spots = save(around)
    drop(places)
    release(docs.sparkSession)
    rows = save(spots.groupBy("h", "c1", "c2", "l").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("context").alias("context")))
    # written, so that both sides of the join are plain shuffles, of which a hot anchor can be split
    sizes = save(rows.groupBy("h").agg(F.count("*").alias("g"), F.max(F.col("first") != F.col("last")).alias("twice")).where("g > 1 or twice").select("h", "g"))
    release(docs.sparkSession)
    rows = rows.join(sizes, "h")

    def suffixes(batches):
        held: list[tuple] = []

        def out(rows: list[tuple]):
            for r, spans in repeats([x[:7] for x in rows], length):
                x = rows[r]
                yield (x[0], x[7], x[8], x[3], x[4], spans)

        def batch(rows):
            c = list(zip(*rows)) or [[]] * 6
            spans = [[{"lo": a, "hi": b, "first": bool(f)} for a, b, f in x] for x in c[5]]
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("first", pa.bool_())]))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:5]), pa.array(spans, kind)], names=list("abcdef"))

        for b in batches:
            for x in zip(*(b.column(i).to_pylist() for i in range(9))):
                if len(held) >= CHUNK and held[-1][0] != x[0]:
                    yield batch(list(out(held)))
                    held = []
                held.append(x)
        if held:
            yield batch(list(out(held)))

    flat = rows.select("h", "l", "context", F.col("first.doc").alias("d0"), F.col("first.at").alias("a0"), F.col("last.doc").alias("d1"), F.col("last.at").alias("a1"), "c1", "c2", "g")
    large = _large_groups(flat.where(F.col("g") > GROUP), length)
    flat = flat.where(F.col("g") <= GROUP).drop("g").repartition("h").sortWithinPartitions("h")
    kind = "h bigint, c1 bigint, c2 bigint, fd bigint, fa bigint, spans array<struct<lo:int,hi:int,first:boolean>>"
    found = flat.mapInArrow(suffixes, kind).union(large)
    hits = spots.select("h", "c1", "c2", "doc", "at").join(found, ["h", "c1", "c2"]).select("doc", "at", "fd", "fa", F.explode("spans").alias("x"))
    if keep_first:
        hits = hits.where(~(F.col("x.first") & (F.col("doc") == F.col("fd")) & (F.col("at") == F.col("fa"))))
    ranges = hits.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((F.col("at") + F.col("x.lo")).alias("start"), (F.col("at") + F.col("x.hi") - 1 + length).alias("end")))).alias("ranges"))
    return ranges.select(F.col("doc").alias(id_col), "ranges")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM, keep_first: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for every row: ``kept`` is what is left of the text's bytes.

    Null texts count as empty; texts shorter than ``length`` stay whole; rows without an id stay whole
    and match nothing. Rows that repeat an id and a text are one document and give a row each; rows of one id with different
    texts are documents of their own, for ``keep_first`` in any order. Other columns are ignored.
    """
    own = with_key(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", "text", "doc")
    ranges = save(repeated_ranges(own, "doc", "text", length, k, keep_first))
    release(docs.sparkSession)
    both = own.join(ranges, "doc", "left").select("id", "text", "ranges")

    def cut(batches):
        for b in batches:
            out = []
            for t, rs in zip(b.column(1), b.column(2)):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                kept, at, n = [], 0, 0
                if rs.is_valid:
                    end = -1
                    for s, e in zip(rs.values.field(0).to_pylist(), rs.values.field(1).to_pylist()):
                        if s > end:
                            kept.append(data[at:s])
                            n += 1
                        at = end = max(end, e)
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left))
            c = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, y) for x, y in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=list("abcdef"))

    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
