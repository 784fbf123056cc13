"""Token ids on disk: canonical, length-limited Huffman codes in blocks that decode on their own.

Ids are counted over all documents, the counts give the code (package-merge, no code longer than
``limit`` bits), and documents go to shard files in ascending order of their id. A shard holds the
code's lengths, its documents (id, number of ids) and blocks of ``BLOCK`` ids. Each block notes the bit
offset of every ``CHECK``-th id, so that a reader can begin at any of them; ``decode`` begins at all of
them at once and takes one id from each at every look into the table.

A shard, all numbers little-endian: ``MAGIC``; header ``<IBQQI`` (number of codes, limit, documents, ids,
blocks); length of the packed lengths ``<I`` and these, one byte for each code, by zlib; for each document
its id ``<i8``, whether it has one ``u1``, its number of ids ``<u8``; for each block its place after
these tables ``<u8``, its bytes ``<u8`` and its number of ids ``<u4``; the checkpoints of all blocks ``<u4``; the blocks' bits, the highest
bit of a byte first.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import drop, release, save

MAGIC = b"TESSIDS1"
BLOCK, CHECK = 1 << 20, 256
SHARD_IDS = 1 << 23
#: Letters of texts whose words are looked up together, words for one call of the library, and words and bytes of words from which a worker forgets them.
GROUP, CALL, KNOWN, KNOWN_BYTES = 1 << 23, 20_000, 800_000, 1 << 24
#: Two blanks or line ends side by side, and any other white space, of ASCII and beyond it.
PAIRS = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
RARE = tuple(c for c in map(chr, range(128, 0x3001)) if c.isspace())
CUT = re.compile(r"(?<=\S)(?= )")


# ---- codes


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, 0 where the count is 0: package-merge over sorted counts.

    Equal counts go by id, and leaves before packages, so the same counts give the same lengths anywhere.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        kinds.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    lengths = np.zeros(len(leaves), np.int64)
    for leaf in reversed(kinds):
        n = int(leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes from lengths: by length, then by id, each one more than the one before."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    out = np.zeros(len(lengths), np.uint64)
    code = last = 0
    per = np.bincount(lengths[order], minlength=2)
    at = 0
    for n in range(1, len(per)):
        code <<= n - last
        out[order[at : at + per[n]]] = np.arange(code, code + per[n], dtype=np.uint64)
        code, at, last = code + int(per[n]), at + int(per[n]), n
    return out


def decode_table(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For every ``limit`` bits that may come next the id and its length, as ``id << 5 | length``."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.int64)
    out = np.repeat(order << 5 | n, 1 << (limit - n))
    return np.concatenate([out, np.zeros((1 << limit) - len(out), np.int64)])


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of one block and its checkpoints."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    bits = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(bits >> np.uint64(32), first)
    out[word[first] + 1] |= np.bitwise_or.reduceat(bits & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7) >> 3], at[::CHECK].astype("<u4")


def unpack(bits: bytes, checks: np.ndarray, n: int, table: np.ndarray, limit: int) -> np.ndarray:
    """``n`` ids from the bits that begin at the first of ``checks``; all checkpoints are followed side by side."""
    b = np.frombuffer(bits + bytes(CHECK * 4 + 8), np.uint8).astype(np.uint32)
    window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    at = checks.astype(np.int64)
    out = np.empty((CHECK, len(at)), np.uint32)
    mask, down = (1 << limit) - 1, 32 - limit
    for step in range(min(CHECK, n)):
        got = table[(window[at >> 3] >> (down - (at & 7)).astype(np.uint32)) & mask]
        out[step] = got >> 5
        at += got & 31
    return out.T.reshape(-1)[:n]


# ---- shards


class Shard:
    """Documents of one file in order; ``bytes`` gives the file."""

    def __init__(self, lengths: np.ndarray, limit: int, codes: np.ndarray):
        self.lengths, self.limit, self.codes = lengths, limit, codes
        self.docs, self.sizes, self.open, self.waiting = [], [], [], 0
        self.blocks, self.checks, self.n_ids, self.counts = [], [], 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        while len(ids):
            part = ids[: BLOCK - self.waiting]
            self.open.append(part)
            self.waiting += len(part)
            ids = ids[len(part) :]
            if self.waiting == BLOCK:
                self.close()

    def close(self) -> None:
        if self.waiting:
            bits, checks = pack(np.concatenate(self.open), self.codes, self.lengths)
            self.blocks.append(bits)
            self.checks.append(checks)
            self.counts.append(self.waiting)
            self.open, self.waiting = [], 0

    def bytes(self) -> bytes:
        self.close()
        packed = zlib.compress(self.lengths.tobytes())
        size = np.array([len(x) for x in self.blocks], "<u8")
        known = np.array([d is not None for d in self.docs], "u1")
        tables = [np.array([d or 0 for d in self.docs], "<i8"), known, np.array(self.sizes, "<u8"), (np.cumsum(size) - size).astype("<u8"), size, np.array(self.counts, "<u4"), *self.checks]
        head = struct.pack("<IBQQI", len(self.lengths), self.limit, len(self.docs), self.n_ids, len(self.blocks))
        return b"".join([MAGIC, head, struct.pack("<I", len(packed)), packed, *(t.tobytes() for t in tables), *self.blocks])


class Reader:
    """One shard: ``docs`` (None where a document has no id), ``sizes``, and ids by position."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        at = len(MAGIC)
        n_codes, self.limit, n_docs, self.n_ids, n_blocks = struct.unpack_from("<IBQQI", data, at)
        at += struct.calcsize("<IBQQI")
        (n,) = struct.unpack_from("<I", data, at)
        lengths = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + n]), np.uint8, n_codes)
        at += 4 + n

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, known = array("<i8", n_docs), array("u1", n_docs)
        self.docs = [int(d) if k else None for d, k in zip(ids, known)]
        self.sizes = array("<u8", n_docs).astype(np.int64)
        self.places, self.bytes, self.counts = array("<u8", n_blocks), array("<u8", n_blocks), array("<u4", n_blocks)
        n_checks = -(-self.counts.astype(np.int64) // CHECK)
        self.checks = np.split(array("<u4", int(n_checks.sum())), np.cumsum(n_checks)[:-1]) if n_blocks else []
        self.data, self.payload = data, at
        self.table = decode_table(lengths, self.limit)

    def block(self, i: int, first: int = 0, n: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``first + n`` of block ``i``, read from the checkpoint before them on."""
        end = int(self.counts[i]) if n is None else min(int(self.counts[i]), first + n)
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // CHECK, -(-end // CHECK)
        checks = self.checks[i]
        low = int(checks[a]) >> 3
        high = int(checks[b] + 7) >> 3 if b < len(checks) else int(self.bytes[i])
        at = self.payload + int(self.places[i])
        got = unpack(self.data[at + low : at + high], checks[a:b].astype(np.int64) - low * 8, end - a * CHECK, self.table, self.limit)
        return got[first - a * CHECK :]

    def documents(self):
        """(doc_id, ids) of all documents in order; one block is open at a time."""
        held, i = np.zeros(0, np.uint32), 0
        for doc, n in zip(self.docs, self.sizes):
            parts, have = [held[:n]], min(len(held), int(n))
            held = held[n:]
            while have < n:
                got = self.block(i)
                i += 1
                parts.append(got[: n - have])
                held = got[n - have :]
                have += len(parts[-1])
            yield doc, np.concatenate(parts)


# ---- jobs


class Encoder:
    """Whole texts to ids by the ``tokenizers`` library; one for each Python worker and model.

    A text is cut at single blanks and line ends between other characters. A byte-level pattern ends a word at each of
    these places whatever stands around it, and no added token holds such a place, so the parts encode as they do inside the text. Each
    different word of a group of texts that is not known from groups before goes to the library once, side by side with others in one
    text, and bytes of ids tell whose an id is. Texts with other white space are cut before blanks that follow a non-blank only.
    """

    def __init__(self, spec: str, wide: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = f"<u{wide}"
        added = {i: len(t.content.encode()) for i, t in self.tok.get_added_tokens_decoder().items()}
        vocab = self.tok.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.size[i] = added.get(i, len(t))
        self.line = len(self.library("\n"))
        self.forget()

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def forget(self) -> None:
        """``known`` are different words; ids, first and count tell the ids of each."""
        self.known, self.ids = pa.array([], pa.string()), np.zeros(0, self.kind)
        self.first = self.count = np.zeros(0, np.int64)

    def learn(self, words: pa.Array) -> None:
        """Ids of new words. Those behind a line end begin with it, all others stand behind a blank."""
        behind = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        found, n = [self.ids], len(self.ids)
        for kind, blank in ((behind, ""), (~behind, " ")):
            at = np.flatnonzero(kind)
            for i in range(0, len(at), CALL):
                some = words.take(pa.array(at[i : i + CALL]))
                ids = self.library(blank + blank.join(some.to_pylist()))
                ends = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64) + len(blank))
                cuts = np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 1
                size = np.diff(cuts, prepend=0)
                count[at[i : i + CALL]], first[at[i : i + CALL]] = size, n + cuts - size
                found.append(ids)
                n += len(ids)
        self.known = pa.concat_arrays([self.known, words])
        self.ids, self.first, self.count = np.concatenate(found), np.concatenate([self.first, first]), np.concatenate([self.count, count])

    def encode(self, texts: list[str]) -> list[bytes]:
        known = list(map(plain, texts))
        cut = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t, k in zip(texts, known) if k], pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        if len(self.known) > KNOWN or self.known.nbytes > KNOWN_BYTES:
            self.forget()
        new = pc.is_null(pc.index_in(coded.dictionary, self.known))
        if pc.any(new).as_py():
            self.learn(coded.dictionary.filter(new))
        word = pc.index_in(coded.dictionary, self.known).to_numpy()[coded.indices.to_numpy()]
        n = self.count[word]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.first[word] - (ends - n), n) + np.arange(n.sum())]
        # the line end before a text is no part of it
        ends = np.concatenate([[0], ends])[cut.offsets.to_numpy()]
        own = zip((ends[:-1] + self.line).tolist(), ends[1:].tolist())
        return [ids[slice(*next(own))].tobytes() if k else b"".join([self.library(p).tobytes() for p in grouped(CUT.split(t))]) for t, k in zip(texts, known)]


def plain(text: str) -> bool:
    """Whether all white space is single blanks and line ends between other characters."""
    if not text or text[0].isspace() or text[-1].isspace() or any(x in text for x in PAIRS):
        return False
    return text.isascii() or not any(x in text for x in RARE)


def grouped(parts: list[str], letters: int = 1 << 16) -> Iterator[str]:
    """Parts that follow each other, joined up to some length, so that the library holds a bounded text at a time."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p)
        if n >= letters:
            yield "".join(held)
            held, n = [], 0
    if held:
        yield "".join(held)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(spec: str, wide: int) -> Encoder:
    """This worker's encoder for a model, kept from task to task."""
    key = (hashlib.sha256(spec.encode()).hexdigest(), wide)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, wide)
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """(doc_id, part, row, ids binary): ids of every whole text by the ``tokenizers`` library, ``end_id`` behind them, as
    little-endian numbers of ``id_width`` bytes, in ascending order of (id, hash of the text); part and row number that order.

    See ``Encoder`` for how texts reach the library. Null texts count as empty. Rows without an id come first; repeated rows are documents of their own.
    """
    from pyspark import TaskContext

    wide = id_width(model_path)
    with open(model_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        from tessera.llm import tokenfile

        enc = tokenfile.encoder(spec.value, wide)
        end = b"" if end_id is None else np.array([end_id], enc.kind).tobytes()
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, size, first = [], 0, at
                while at < b.num_rows and size < GROUP:
                    texts.append(b.column(1)[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                n = len(texts)
                out = pa.array([x + end for x in enc.encode(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(row, row + n, dtype=np.int64)), out], names=list("abcd"))
                row += n

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = F.xxhash64("text")
    return own.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key).mapInArrow(work, "doc_id bigint, part bigint, row bigint, ids binary")


def id_width(model_path: str) -> int:
    """Bytes for an id of the model: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(model_path).get_vocab_size() <= 1 << 16 else 4


def id_counts(encoded: DataFrame, wide: int) -> np.ndarray:
    """How often each id occurs in all documents; as long as the largest id, so its size is that of the vocabulary."""

    def work(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids in b.column(0):
                n = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{wide}"))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    got = encoded.select("ids").mapInArrow(work, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r.id for r in got], default=-1) + 1, np.int64)
    for r in got:
        out[r.id] = r.n
    return out


def write_ids(encoded: DataFrame, path: str, wide: int = 2, limit: int | None = None) -> DataFrame:
    """Write what ``encode_texts`` gave, once it was saved, to shards below ``path``; returns their index (shard, part, row, n_docs, n_ids,
    first), which stays in ``path/index``. ``first`` is the number of ids in all shards before.

    A shard ends once it holds ``SHARD_IDS`` ids, so it is bounded by that and one document. It is written under a name that
    readers pass over and then moved, so a task that runs again puts the same bytes in the same place.
    """
    spark = encoded.sparkSession
    counts = id_counts(encoded, wide)
    limit = limit or max(16, int(max(int((counts > 0).sum()) - 1, 1)).bit_length())
    lengths = code_lengths(counts, limit)
    code = spark.sparkContext.broadcast((lengths, limit, canonical(lengths)))
    folder = f"{path}/shards"

    def work(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        shard = at = None
        rows = []

        def flush() -> None:
            name = f"{at[0]:06d}-{at[1]:012d}.ids"
            data = shard.bytes()
            new = f"{root}/_{uuid.uuid4().hex}"
            with files.open_output_stream(new) as f:
                f.write(data)
            files.move(new, f"{root}/{name}")
            rows.append((name, at[0], at[1], len(shard.docs), shard.n_ids))

        for b in batches:
            for doc, part, row, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if shard and (shard.n_ids >= SHARD_IDS or (part, row) != (at[0], at[1] + len(shard.docs))):
                    flush()
                    shard = None
                if not shard:
                    shard, at = Shard(*code.value), (part, row)
                shard.add(doc, np.frombuffer(ids.as_buffer(), f"<u{wide}"))
        if shard:
            flush()
        c = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), *(pa.array(x, pa.int64()) for x in c[1:])], names=list("abcde"))

    index = encoded.select("doc_id", "part", "row", "ids").mapInArrow(work, "shard string, part bigint, row bigint, n_docs bigint, n_ids bigint")
    index.write.parquet(f"{path}/shard-list")
    index = spark.read.parquet(f"{path}/shard-list")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("row")) - F.col("n_ids")
    index.withColumn("inner", inner).join(parts.select("part", "base"), "part").select("shard", "part", "row", "n_docs", "n_ids", (F.col("base") + F.col("inner")).alias("first")).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """Documents of all shards: doc_id, start (ids of all documents before it), n_tokens, and ids array<int>, or with ``digests`` in its
    place ids_crc32 (unsigned, of all ids as little-endian unsigned 32-bit numbers). No shards give no rows."""
    index = spark.read.parquet(f"{path}/index")
    last = "ids_crc32 bigint" if digests else "ids array<int>"
    schema = f"shard string, doc_id bigint, inner bigint, n_tokens bigint, {last}"

    def work(batches):
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                docs, sizes, out, done = [], [], [], 0

                def rows():
                    n = np.array(sizes, np.int64)
                    end = pa.array(out, pa.int64() if digests else pa.list_(pa.int32()))
                    return pa.RecordBatch.from_arrays([pa.array([name.as_py().rsplit("/", 1)[-1]] * len(docs), pa.string()), pa.array(docs, pa.int64()), pa.array(done + np.cumsum(n) - n), pa.array(n), end], names=list("abcde"))

                for doc, ids in Reader(data.as_py()).documents():
                    docs.append(doc)
                    sizes.append(len(ids))
                    out.append(zlib.crc32(ids.astype("<u4").tobytes()) if digests else ids.astype(np.int32))
                    if len(docs) == 1000:
                        yield rows()
                        done += sum(sizes)
                        docs, sizes, out = [], [], []
                if docs:
                    yield rows()

    if index.isEmpty():
        got = spark.createDataFrame([], schema)
    else:
        got = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(f"{path}/shards").select("path", "content").mapInArrow(work, schema)
    return got.join(index.select("shard", "first"), "shard").select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", last.split()[0])


def file_digests(docs: DataFrame, model_path: str, path: str) -> DataFrame:
    """Encode ``docs``, write their shards below ``path`` and read them back: doc_id, start, n_tokens, ids_crc32."""
    wide = id_width(model_path)
    encoded = save(encode_texts(docs, model_path))
    release(docs.sparkSession)
    write_ids(encoded, path, wide)
    drop(encoded)
    return read_ids(docs.sparkSession, path, digests=True)
