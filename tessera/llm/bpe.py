"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

A merge list has a *sufficient lookahead*: a number of bytes L such that what follows a
point can change no token that ends L bytes or more before it (compare Berglund and van
der Merwe, "Formalizing BPE Tokenization", 2023). ``sufficient_lookahead`` computes it from
the merges alone. The encoder holds a window, emits the tokens that end before the window's
last L bytes and goes on from the last token emitted, so a word of any length takes constant
memory. Decoding feeds bytes of tokens to an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before byte-level merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES, CACHE_BYTES = 600_000, 32
SLICE = 1 << 16


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, by the published rule."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_model(path: str) -> dict:
    """Read a byte-level BPE file into plain values that ship to executors: token bytes by id, merges, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    table = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        table[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        table[i] = token.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return {"table": table, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], "special": special, "bytes": [vocab[c] for c in sorted(letters, key=letters.get)]}


def sufficient_lookahead(merges: list[tuple[int, int, int]], table: list[bytes]) -> int:
    """Bytes before a cut that what follows the cut may still change.

    Merges apply by rank. A difference that starts at a token boundary moves left only if some merge
    (a, b) takes place there in one case alone, which moves it by len(a); the next such merge has a
    higher rank, and its right part must begin with a. The longest chain of this kind is the bound.
    """
    spine: dict[int, tuple[int, ...]] = {}
    left = {c: a for a, _, c in merges}

    def begins(t: int) -> tuple[int, ...]:
        if t not in spine:
            out, x = [t], t
            while x in left:
                x = left[x]
                out.append(x)
            spine[t] = tuple(out)
        return spine[t]

    best: dict[int, int] = {}
    most = 0
    for a, b, _ in reversed(merges):
        g = len(table[a]) + best.get(a, 0)
        most = max(most, g)
        for t in begins(b):
            if best.get(t, 0) < g:
                best[t] = g
    return most


class Codec:
    """Encoder and decoder for one model; one for each Python worker."""

    def __init__(self, model: dict):
        self.table, self.special = model["table"], model["special"]
        self.first = model["bytes"]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(model["merges"])}
        self.lookahead = sufficient_lookahead(model["merges"], self.table)
        self.window = max(1024, 4 * self.lookahead)
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.digits = [str(i) for i in range(len(self.table))]
        codec = self

        class Cache(dict):
            def __missing__(self, word: str) -> bytes:
                out = array("i", codec.word(word.encode("utf-8", "surrogatepass"))).tobytes()
                if len(word) <= CACHE_BYTES:
                    if len(self) >= CACHE_ENTRIES:
                        self.clear()
                    self[word] = out
                return out

        self.cache = Cache()

    def merged(self, ids: list[int]) -> list[int]:
        """All merges over a bounded list of ids."""
        rank = self.rank
        if len(ids) > 64:
            return self._merged_heap(ids)
        while len(ids) > 1:
            low, c, at = 1 << 60, 0, ()
            for pair in zip(ids, ids[1:]):
                got = rank.get(pair)
                if got is not None and got[0] < low:
                    low, c, at = got[0], got[1], pair
            if not at:
                break
            a, b = at
            out, i, n = [], 0, len(ids)
            while i < n:
                if ids[i] == a and i + 1 < n and ids[i + 1] == b:
                    out.append(c)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merged_heap(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        ids = list(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*got, i, ids[i], ids[i + 1]) for i in range(n - 1) if (got := rank.get((ids[i], ids[i + 1])))]
        heap = [(r, i, c, a, b) for r, c, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, c, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if got := rank.get((c, ids[nxt[i]])):
                    heapq.heappush(heap, (got[0], i, got[1], c, ids[nxt[i]]))
            if (p := prv[i]) >= 0 and (got := rank.get((ids[p], c))):
                heapq.heappush(heap, (got[0], p, got[1], ids[p], c))
        return [x for x in ids if x >= 0]

    def stream(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one word that comes in pieces; each list goes out once no later piece can change it."""
        held = b""
        for piece in pieces:
            held += piece
            while len(held) >= self.window:
                ids = self.merged([self.first[b] for b in held[: self.window]])
                end, keep, out = 0, self.window - self.lookahead, []
                for i in ids:
                    if end + len(self.table[i]) > keep:
                        break
                    end += len(self.table[i])
                    out.append(i)
                yield out
                held = held[end:]
        if held:
            yield self.merged([self.first[b] for b in held])

    def word(self, data: bytes) -> list[int]:
        if len(data) < self.window:
            return self.merged([self.first[b] for b in data])
        return [i for ids in self.stream(data[k : k + SLICE] for k in range(0, len(data), SLICE)) for i in ids]

    def encode(self, text: str) -> Iterator[array]:
        """Ids of ``text`` in blocks; special tokens that stand in the text become their ids."""
        get = self.cache.__getitem__
        for part in self.marks.splititer(text) if self.marks else (text,):
            if part in self.special:
                yield array("i", [self.special[part]])
            elif len(part) <= SLICE:
                yield array("i", b"".join(map(get, self.split.findall(part))))
            else:
                words, size = [], 0
                for m in self.split.finditer(part):
                    words.append(m[0])
                    size += len(words[-1])
                    if size > SLICE:
                        yield array("i", b"".join(map(get, words)))
                        words, size = [], 0
                yield array("i", b"".join(map(get, words)))

    def decoder(self) -> Decoder:
        return Decoder(self.table)


class Decoder:
    """Bytes of tokens to text; bytes of a character may be spread over tokens, wrong ones become U+FFFD."""

    def __init__(self, table: list[bytes]):
        self.get = table.__getitem__
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.get, ids)), final)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: (id, n_tokens, ids_sha256, decoded_sha256, round_trip).

    Null texts count as empty (0 tokens, digests of nothing). Repeated rows give a row each; other
    columns are ignored. Texts are worked off in blocks, so memory does not grow with their length.
    """
    return _mapped(docs, model_path, id_col, text_col, ids=False)


def encode_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: (id, n_tokens, ids array<int>); null texts give an empty array."""
    return _mapped(docs, model_path, id_col, text_col, ids=True)


def _mapped(docs: DataFrame, model_path: str, id_col: str, text_col: str, ids: bool) -> DataFrame:
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def work(batches):
        codec = Codec(model.value)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                if ids:
                    got = array("i")
                    for block in codec.encode(text):
                        got.extend(block)
                    rows.append((len(got), got.tolist()))
                    continue
                n, sha, back, undo, same, at = 0, hashlib.sha256(), hashlib.sha256(), codec.decoder(), True, 0
                for block in codec.encode(text):
                    if block:
                        sha.update(("," if n else "").encode() + ",".join(map(codec.digits.__getitem__, block)).encode())
                        n += len(block)
                        said = undo.feed(block)
                        back.update(said.encode())
                        same = same and text.startswith(said, at)
                        at += len(said)
                said = undo.feed((), True)
                back.update(said.encode())
                rows.append((n, sha.hexdigest(), back.hexdigest(), same and at + len(said) == len(text)))
            cols = list(zip(*rows)) or [[]] * (2 if ids else 4)
            kinds = [pa.int64(), pa.list_(pa.int32())] if ids else [pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", *(str(i) for i in range(len(kinds)))])

    kind = docs.schema[id_col].dataType.simpleString()
    names = [(id_col, kind), ("n_tokens", "bigint"), *([("ids", "array<int>")] if ids else [("ids_sha256", "string"), ("decoded_sha256", "string"), ("round_trip", "boolean")])]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in names))
