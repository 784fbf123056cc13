"""Chat formatting with typed content parts.

A visitor flattens text, image, audio and document parts into ordered placeholders, and
records what they refer to and how many tokens they expand to. Turns are marked by control
strings; the same strings inside a text are escaped, and ``unescape`` undoes it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
PART = T.StructType([T.StructField(n, k) for n, k in (("type", T.StringType()), ("text", T.StringType()), ("ref", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("seconds", T.DoubleType()), ("pages", T.IntegerType()))])
PARTS = T.ArrayType(PART)
ATTACHMENT = "struct<part:int,kind:string,ref:string,at:int,tokens:bigint>"


def escape(text: str) -> str:
    """Text in which neither ``<|`` nor ``|>`` can occur: a backslash goes before each backslash and inside each of the two."""
    return text.replace("\\", "\\\\").replace(OPEN, "<\\|").replace(CLOSE, "|\\>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class PartVisitor:
    """Flattens the parts of one message; ``visit_<type>`` handles each kind."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def flatten(self, parts: list[dict]) -> tuple[str, list[dict], int]:
        self.out, self.found, self.tokens, self.at = [], [], 0, 0
        for i, part in enumerate(parts or ()):
            part = part or {}
            kind = part.get("type") or "text"
            getattr(self, f"visit_{kind}", self.visit_other)(i, kind, part)
        return "".join(self.out), self.found, self.tokens

    def put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit_text(self, i: int, kind: str, part: dict) -> None:
        self.put(escape(part.get("text") or ""))

    def attach(self, i: int, kind: str, part: dict, tokens: int) -> None:
        self.found.append({"part": i, "kind": kind, "ref": part.get("ref"), "at": self.at, "tokens": tokens})
        self.tokens += tokens
        self.put(f"{OPEN}{kind}:{len(self.found) - 1}{CLOSE}")

    def visit_image(self, i: int, kind: str, part: dict) -> None:
        self.attach(i, kind, part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, i: int, kind: str, part: dict) -> None:
        self.attach(i, kind, part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, i: int, kind: str, part: dict) -> None:
        self.attach(i, kind, part, (part.get("pages") or 0) * self.page_tokens)
        if part.get("text"):
            self.visit_text(i, kind, part)

    def visit_other(self, i: int, kind: str, part: dict) -> None:
        self.attach(i, "other", part, 0)


def text_parts(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """Plain texts as a ``parts`` column of one text part each; a null text becomes an empty one."""
    f = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.lit(None).cast(x.dataType).alias(x.name) for x in PART.fields[2:]))
    return turns.withColumn("parts", F.array(f))


def format_turns(turns: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """One row for each row of ``turns`` (conv_id, turn, role, parts): conv_id, turn, role, piece,
    loss_start, loss_end, attachments, expanded_tokens.

    ``piece`` is the turn's share of the conversation's text; pieces joined in the order of turn give
    all of it. ``[loss_start, loss_end)`` holds code points of the piece that the loss counts: the
    content of assistant turns, empty elsewhere. Null roles and null parts count as empty, unknown
    part types become placeholders of no tokens, other columns are ignored.
    """
    visitor = visitor or PartVisitor()
    kinds = pa.list_(pa.struct([("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))

    def work(batches):
        for b in batches:
            out = []
            for role, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                head = f"{OPEN}{escape(role or '')}{CLOSE}\n"
                body, found, tokens = visitor.flatten(parts)
                start = len(head)
                for x in found:
                    x["at"] += start
                out.append((head + body + END, start, start + len(body) * (role == "assistant"), found, tokens))
            c = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], kinds), pa.array(c[4], pa.int64())], names=list("abcdefgh"))

    own = turns.select("conv_id", "turn", "role", "parts")
    kind = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(work, f"conv_id {kind['conv_id']}, turn {kind['turn']}, role {kind['role']}, piece string, loss_start int, loss_end int, attachments array<{ATTACHMENT}>, expanded_tokens bigint")


def assemble(pieces: DataFrame) -> DataFrame:
    """Whole conversations for those who want them in one row: conv_id, formatted. Ties in turn go by piece."""
    got = F.array_sort(F.collect_list(F.struct("turn", "piece")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(got, lambda x: x["piece"]), "").alias("formatted"))


def read_back(piece: str) -> tuple[str, str]:
    """Role and content of a piece, unescaped; placeholders stay as they stand."""
    mark = piece.index(CLOSE + "\n", len(OPEN))
    return unescape(piece[len(OPEN) : mark]), unescape(piece[mark + len(CLOSE) + 1 : -len(END)])


def digests(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its pieces: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.

    The pieces of a conversation pass in order through a hash of constant size, so a conversation of
    any length takes no more memory than a short one. Null conv_id counts as one conversation.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    empty = hashlib.sha256

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, seen, rows = object(), None, []
        seen = none
        n = chars = total = 0
        turns, loss = empty(), empty()
        typ = None
        for b in batches:
            typ = b.schema.field(0).type
            for conv, piece, start, end in zip(*(b.column(i).to_pylist() for i in range(4))):
                if seen is none or conv != seen:
                    if seen is not none:
                        rows.append((seen, n, turns.hexdigest(), chars, loss.hexdigest(), total))
                    seen, n, chars, total, turns, loss = conv, 0, 0, 0, empty(), empty()
                role, text = read_back(piece)
                turns.update(f"{role}\n{text}\n".encode())
                said = unescape(piece[start:end])
                loss.update(said.encode())
                n, chars, total = n + 1, chars + len(said), total + len(piece)
            if rows:
                yield made(rows, typ)
                rows = []
        if seen is not none:
            yield made([(seen, n, turns.hexdigest(), chars, loss.hexdigest(), total)], typ)

    def made(rows: list[tuple], typ: pa.DataType) -> pa.RecordBatch:
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, (typ, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=list("abcdef"))

    own = pieces.select("conv_id", "piece", "loss_start", "loss_end", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return own.drop("turn").mapInArrow(work, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
