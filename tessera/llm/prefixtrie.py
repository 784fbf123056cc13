"""Prefix trie of conversations by vertical bitmaps.

Conversations go to shards, ranges of their ids. A shard indexes each (position, turn) to a bitset of its
conversations; depth first, a node's bitset is intersected with the postings of the turn that comes next, which
gives its children, and counting bits gives their members. Shards' nodes meet by the SHA-256 of their
path: members are summed, and the shard of a node's smallest member owns it. A second walk
over each shard's nodes, in the order they were found, sums over subtrees what the shard owns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, save

SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 1 << 17
WORDS = r"[^\x20\x09-\x0D]+"
ROOT = hashlib.sha256(b"").digest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, words): turns numbered from 1 in the order of turn (null first; ties by role, then text), with the SHA-256
    of role and text and the words of the text. Null roles and texts become empty; rows without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return own.select("conv_id", pos.alias("pos"), key.alias("turn_key"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))


def share_beginnings(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, own, pos, turn_key, words) of rebuilt conversations: conversation c begins with the first h turns of c - c % ``group``,
    h = crc32(c) % ``most``, and goes on with its own turns after its first h. Turns go by (own, pos); a
    conversation that is left without turns has one row without a turn_key.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    heads = turns.where(F.col("pos") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "turn_key", "words"))).alias("head"))
    base = heads.select(F.col("conv_id").alias("base"), "head")
    begun = heads.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(base, "base", "left")
    begun = begun.select("conv_id", F.explode_outer(F.filter("head", lambda x: x["pos"] <= F.col("h"))).alias("x"))
    first = begun.select("conv_id", F.lit(0).alias("own"), F.coalesce("x.pos", F.lit(0)).alias("pos"), "x.turn_key", "x.words")
    return first.union(turns.where(F.col("pos") > h).select("conv_id", F.lit(1), "pos", "turn_key", "words"))


def shard_nodes(convs: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, bytes, bytes, int, int, list[int]]]:
    """Nodes of one shard in depth-first order: depth, path key, last turn's key, members, smallest member, members that end here.

    ``convs`` (id, turn keys) are in ascending order of id.
    """
    postings: dict[tuple[int, bytes], int] = {}
    over: dict[int, int] = {}
    for i, (_, keys) in enumerate(convs):
        bit = 1 << i
        over[len(keys)] = over.get(len(keys), 0) | bit
        for at in enumerate(keys):
            postings[at] = postings.get(at, 0) | bit
    open_ = [(0, (1 << len(convs)) - 1, ROOT, b"")]
    while open_:
        depth, members, path, turn = open_.pop()
        ends = members & over.get(depth, 0)
        low = (members & -members).bit_length() - 1
        yield depth, path, turn, members.bit_count(), convs[low][0], [convs[i][0] for i in places(ends)]
        rest, below = members ^ ends, []
        while rest:
            key = convs[(rest & -rest).bit_length() - 1][1][depth]
            child = rest & postings[depth, key]
            rest ^= child
            below.append((depth + 1, child, hashlib.sha256(path + key).digest(), key))
        open_ += reversed(below)


def places(bits: int) -> np.ndarray:
    """Places of the bits that are set, from the lowest on."""
    if not bits:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() + 7 >> 3, "little"), np.uint8), bitorder="little"))


def _shards(rebuilt: DataFrame) -> DataFrame:
    """(shard, at, depth, node, words, n, low, n_ends, ends): the nodes of every shard; shards go up with their conversations' ids."""
    from pyspark import TaskContext

    names = ["shard", "at", "depth", "node", "words", "n", "low", "n_ends", "ends"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def made(convs: list, words: dict, shard: int) -> Iterator[pa.RecordBatch]:
        rows = []
        for at, (depth, node, turn, n, low, ends) in enumerate(shard_nodes(convs)):
            rows.append((shard, at, depth, node, words.get(turn, 0), n, low, len(ends), ",".join(map(str, ends)) if ends else None))
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def work(batches):
        shard = TaskContext.get().partitionId() << 32
        convs, words, turns, last = [], {}, 0, object()
        for b in batches:
            for conv, key, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if conv != last:
                    if len(convs) >= SHARD_CONVERSATIONS or turns >= SHARD_TURNS:
                        yield from made(convs, words, shard)
                        convs, words, turns, shard = [], {}, 0, shard + 1
                    last = conv
                    convs.append((conv, []))
                if key is not None:
                    convs[-1][1].append(key)
                    words[key] = n
                    turns += 1
        if convs:
            yield from made(convs, words, shard)

    dealt = rebuilt.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "own", "pos")
    return dealt.select("conv_id", "turn_key", "words").mapInArrow(work, "shard bigint, at bigint, depth bigint, node binary, words bigint, n bigint, low bigint, n_ends bigint, ends string")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """Sums over each shard's subtrees of what the shard owns: (node, conv_id, depth, n_convs, parent_conv_id, n_children, n_leaves, saved_tokens).

    Nodes come depth first, so a node's subtree is over when one of its depth or less comes; memory is one path.
    """
    names = ["node", "conv_id", "depth", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"]
    kinds = [pa.binary(), *[pa.int64()] * 7]

    def work(batches):
        path, shard, rows = [], None, []

        def close(depth: int) -> None:
            while path and path[-1][2] >= depth:
                row = path.pop()
                if path:
                    path[-1][6] += row[6]
                    path[-1][7] += row[7]
                rows.append(row)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return batch

        for b in batches:
            for s, depth, node, conv, n, leaf, mine, words in zip(*(b.column(i).to_pylist() for i in range(8))):
                close(0 if s != shard else depth)
                shard = s
                if path:
                    path[-1][5] += mine
                path.append([node, conv, depth, n, path[-1][1] if path and mine else None, 0, int(mine and leaf), (n - 1) * words if mine else 0])
            if rows:
                yield out()
        close(0)
        if rows:
            yield out()

    own = nodes.repartition("shard").sortWithinPartitions("shard", "at").select("shard", "depth", "node", "conv_id", "n_convs", "leaf", "mine", "words")
    return own.mapInArrow(work, "node binary, conv_id bigint, depth bigint, n_convs bigint, parent_conv_id bigint, n_children bigint, n_leaves bigint, saved_tokens bigint")


def _ends(nodes: DataFrame) -> DataFrame:
    """(node, ends_sha256): the members that end at a node, one list for each shard, pass in order through a hash of constant size."""

    def work(batches):
        node, sha, rows = None, None, []
        for b in batches:
            for key, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != node:
                    if sha:
                        rows.append((node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ends.encode())
                else:
                    sha.update(b"," + ends.encode())
            if rows:
                yield made(rows)
                rows = []
        if sha:
            yield made([(node, sha.hexdigest())])

    def made(rows: list) -> pa.RecordBatch:
        a, b = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.string())], names=["node", "ends_sha256"])

    own = nodes.where("ends is not null").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard")
    return own.select("node", "ends").mapInArrow(work, "node binary, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the conversations of ``share_beginnings`` (or of any such table): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; see the module for the method.

    No conversations give no rows. Turns are told apart by SHA-256, beginnings by SHA-256 over these. The turns of one shard lie in memory:
    at most ``SHARD_CONVERSATIONS`` conversations, and ``SHARD_TURNS`` turns and one conversation's.
    """
    nodes = save(_shards(rebuilt))
    met = nodes.groupBy("node").agg(F.min("low").alias("conv_id"), F.min("shard").alias("owner"), F.sum("n").alias("n_convs"), (F.sum("n") == F.sum("n_ends")).alias("leaf"))
    both = nodes.select("shard", "at", "depth", "node", "words").join(save(met), "node").withColumn("mine", F.col("shard") == F.col("owner"))
    sums = _subtrees(both).groupBy("node").agg(*(F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return sums.join(_ends(nodes), "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def trie_of(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` with shared beginnings."""
    turns = save(ordered_turns(conversations))
    rebuilt = save(share_beginnings(turns))
    drop(turns)
    return prefix_trie(rebuilt)
