"""Readers of files that come as rows (path, length, content), as ``binaryFile`` gives them.

Each reader returns one row for each file with the content as text and what it found; a file that
cannot be read keeps its row, is marked as corrupted and carries a warning.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

#: A body line that begins with ``From `` is quoted in a mailbox.
QUOTED = re.compile(r"(?m)^>(>*From )")
MAX_BYTES = 100 * 1024 * 1024
#: Formats and MIME types by extension.
FORMATS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "odt": "odt", "ods": "ods", "csv": "csv", "txt": "text", "md": "markdown", "html": "html", "eml": "eml", "mbox": "mbox", "svg": "svg"}
MIME = {"text": "text/plain", "markdown": "text/markdown", "html": "text/html", "csv": "text/csv", "eml": "message/rfc822", "mbox": "application/mbox", "svg": "image/svg+xml"}
SVG_TEXT = ("text", "tspan", "title", "desc")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder, with their format; unknown extensions have none."""
    return with_format(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def with_format(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("ext", ext).withColumn("format", _lookup(F.col("ext"), FORMATS)).withColumn("mime_type", _lookup(F.col("format"), MIME))


def gated(files: DataFrame, extensions: list[str], most: int = MAX_BYTES) -> DataFrame:
    """Adds is_corrupted and warnings: missing content, then a wrong extension, then too many bytes; the first one counts."""
    fault = F.when(F.col("content").isNull(), "file not found").when(~F.col("ext").isin(extensions), F.concat(F.lit("unsupported extension: "), F.col("ext"))).when(F.col("length") > most, "file too large")
    return files.withColumn("is_corrupted", fault.isNotNull()).withColumn("warnings", F.when(fault.isNotNull(), F.array(fault)).otherwise(F.array().cast("array<string>")))


def decoded(content: str) -> tuple[Column, Column]:
    """Text and the name of its encoding: UTF-8 where it is valid, else Latin-1."""
    good = F.is_valid_utf8(F.col(content).cast("string"))
    return F.when(good, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")), F.when(good, "utf-8").otherwise("latin-1")


def read_text(files: DataFrame) -> DataFrame:
    text, name = decoded("content")
    return files.select("path", "format", "mime_type", text.alias("text"), name.alias("encoding"))


def read_delimited(files: DataFrame) -> DataFrame:
    """(path, text, encoding, rows, cols, data, warnings): ragged rows and empty cells of any length stay; cells join with `` | ``.
    A file that cannot be parsed keeps its row, without data and with a warning; null content counts as such."""
    text, name = decoded("content")

    def parse(batches):
        csv.field_size_limit(1 << 31)
        for b in batches:
            out = []
            for path, t, enc in zip(b["path"], b["text"], b["encoding"]):
                try:
                    if t is None:
                        raise TypeError("no content")
                    data, faults = list(csv.reader(io.StringIO(t, newline=""))), []
                except (csv.Error, TypeError) as e:
                    data, faults = [], [f"{type(e).__name__}: {e}"]
                out.append((path, "\n".join(" | ".join(r) for r in data), enc, len(data), max(map(len, data), default=0), data, faults))
            yield pd.DataFrame(out, columns=["path", "text", "encoding", "rows", "cols", "data", "warnings"])

    return files.select("path", text.alias("text"), name.alias("encoding")).mapInPandas(parse, "path string, text string, encoding string, rows int, cols int, data array<array<string>>, warnings array<string>")


def _leaves(m: email.message.EmailMessage) -> list[tuple[str, str]]:
    """Type and text of each part that is text and no attachment; an unknown charset is read as UTF-8."""
    out = []
    for part in m.walk():
        if part.get_content_maintype() == "text" and part.get_content_disposition() != "attachment":
            raw, charset = part.get_payload(decode=True) or b"", part.get_content_charset() or "utf-8"
            try:
                out.append((part.get_content_type(), raw.decode(charset, "replace")))
            except LookupError:
                out.append((part.get_content_type(), raw.decode("utf-8", "replace")))
    return out


def _message(raw: bytes | None) -> dict:
    """Headers and plain text of a message; what cannot be parsed keeps empty fields and a warning."""
    out = {"from": "", "to": "", "subject": "", "date": "", "body": "", "attachments": 0, "warnings": []}
    try:
        m = email.message_from_bytes(bytes(raw), policy=email.policy.default)
        out |= {k: str(m[k] or "") for k in ("from", "to", "subject", "date")}
        out["body"] = "\n".join(text for kind, text in _leaves(m) if kind == "text/plain")
        out["attachments"] = sum(p.get_content_disposition() == "attachment" for p in m.walk())
    except Exception as e:  # the parser of headers raises errors of many kinds
        out["warnings"] = [f"{type(e).__name__}: {e}"]
    return out


_MAIL = "path string, message int, `from` string, `to` string, subject string, date string, body string, attachments int, warnings array<string>"
_MAIL_COLUMNS = ["path", "message", "from", "to", "subject", "date", "body", "attachments", "warnings"]


def read_mail(files: DataFrame) -> DataFrame:
    """Single messages: headers, plain text parts and the number of attachments."""

    def parse(batches):
        for b in batches:
            yield pd.DataFrame([{"path": p, "message": 0} | _message(c) for p, c in zip(b["path"], b["content"])], columns=_MAIL_COLUMNS)

    return files.select("path", "content").mapInPandas(parse, _MAIL)


def mail_leaves(files: DataFrame) -> DataFrame:
    """(path, part, content_type, text): a row for each text part of a message that holds more than white space."""

    def parse(batches):
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    got = _leaves(email.message_from_bytes(bytes(raw), policy=email.policy.default))
                except Exception:  # as in _message; read_mail has the warning
                    got = []
                out += [(path, i, *x) for i, x in enumerate(x for x in got if x[1].strip())]
            yield pd.DataFrame(out, columns=["path", "part", "content_type", "text"])

    return files.select("path", "content").mapInPandas(parse, "path string, part int, content_type string, text string")


def rendered_mail(mail: DataFrame) -> DataFrame:
    head = [F.concat(F.lit(f"{k}: "), F.col(c)) for k, c in (("From", "from"), ("To", "to"), ("Subject", "subject"), ("Date", "date"))]
    return mail.select("path", "message", F.concat(F.concat_ws("\n", *head), F.lit("\n\n"), F.col("body")).alias("text"))


def read_mailbox(files: DataFrame) -> DataFrame:
    """Mailboxes to messages: a line that begins with ``From `` starts one."""
    text, _ = decoded("content")
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), "\nFrom "), lambda x: strip(x) != "")
    each = files.select("path", F.posexplode(parts).alias("message", "raw"))

    def parse(batches):
        for b in batches:
            yield pd.DataFrame([{"path": p, "message": m} | _message(QUOTED.sub(r"\1", r.split("\n", 1)[-1]).encode()) for p, m, r in zip(b["path"], b["message"], b["raw"])], columns=_MAIL_COLUMNS)

    return each.mapInPandas(parse, _MAIL)


def mailbox_text(messages: DataFrame) -> DataFrame:
    got = F.array_sort(F.collect_list(F.struct("message", "body")))
    return messages.groupBy("path").agg(F.array_join(F.transform(got, lambda x: x["body"]), "\n\n---\n\n").alias("text"), F.count("*").alias("n"))


def read_svg(files: DataFrame) -> DataFrame:
    """(path, text, warnings): text of drawings in document order; what is no XML has none and a warning."""
    text, _ = decoded("content")

    def parse(batches):
        for b in batches:
            out = []
            for path, t in zip(b["path"], b["text"]):
                try:
                    root, faults = ET.fromstring(t or ""), []
                except (ET.ParseError, ValueError) as e:
                    root, faults = ET.Element("none"), [f"{type(e).__name__}: {e}"]
                own = [x for e in root.iter() if e.tag.rpartition("}")[2] in SVG_TEXT for x in (e.text, *(c.tail for c in e))]
                out.append((path, "\n".join(x for x in own if x and x.strip()), faults))
            yield pd.DataFrame(out, columns=["path", "text", "warnings"])

    return files.select("path", text.alias("text")).mapInPandas(parse, "path string, text string, warnings array<string>")


def table_text(data: str, title: Column | None = None) -> Column:
    """A table as lines of cells; rows of blank cells are left out."""
    rows = F.filter(data, lambda r: F.exists(r, lambda c: c != ""))
    body = F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n")
    return F.concat(F.when(title.isNull(), "--- Table ---").otherwise(F.concat(F.lit("=== Sheet: "), title, F.lit(" ==="))) if title is not None else F.lit("--- Table ---"), F.lit("\n"), body)


def paged_text(pages: str, word: str = "Page") -> Column:
    """Pages (number, text) under markers, in order."""
    return F.array_join(F.transform(F.array_sort(pages), lambda p: F.concat(F.lit(f"--- {word} "), p["number"].cast("string"), F.lit(" ---\n"), p["text"])), "\n")


#: Parts of extracted content, as decoders hand them over.
PARTS = {
    "pages": "array<struct<number:int,text:string,tables:array<array<array<string>>>,width:double,height:double>>",
    "tables": "array<struct<rows:int,cols:int,data:array<array<string>>>>",
    "emails": "array<struct<from:string,to:string,subject:string,date:string,body:string>>",
    "sections": "array<struct<level:int,text:string,position:int>>",
}


def extracted(spark: SparkSession, path: str) -> DataFrame:
    """Extracted content from JSON lines: doc_id and the parts of ``PARTS``, null where a decoder found none; a line that is no
    JSON keeps its row, with the line in ``fault``."""
    schema = "doc_id bigint, " + ", ".join(f"{k} {v}" for k, v in PARTS.items())
    rows = spark.read.text(path).select("value", F.from_json("value", schema).alias("r"))
    # a line that cannot be read gives a struct of nulls
    return rows.select("r.*", F.when(F.col("r.doc_id").isNull(), F.col("value")).alias("fault"))


def exploded(raw: DataFrame, part: str) -> DataFrame:
    """One row for each page, table, email or section of extracted content; documents without any keep a row."""
    return raw.select("doc_id", F.posexplode_outer(part).alias("position", "item")).select("doc_id", "position", "item.*")


def admitted(uploads: DataFrame, extensions: list[str]) -> DataFrame:
    """Adds accepted, a doc_id of safe characters and the list of departments."""
    safe = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), r"[^A-Za-z0-9_-]", "_")
    depts = F.filter(F.transform(F.split(F.coalesce("departments", F.lit("")), ","), lambda d: F.trim(d)), lambda d: d != "")
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return uploads.withColumns({"accepted": ext.isin(extensions), "doc_id": F.when(safe == "", "doc").otherwise(safe), "department_ids": depts})


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation file, a JSON object with a list ``cases``."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
