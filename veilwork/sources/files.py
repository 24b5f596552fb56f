"""Text, CSV, JSON, XLSX and DOCX files as one text and its blocks.

A file is read whole by Spark's `binaryFile` source and parsed in one Arrow
pass with the standard library; everything after that is built-in functions.
A file that cannot be parsed gives a row with an error, and the others go on.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import key_of, label_rules
from ..runtime import ship

#: File extensions and their formats (fixed values).
EXTENSIONS = {"txt": "txt", "log": "txt", "md": "txt", "csv": "csv", "tsv": "csv", "json": "json", "xlsx": "xlsx", "xlsm": "xlsx", "docx": "docx", "pdf": "pdf"}
#: Keys of JSON whose value gets a label before it (fixed values).
LABELLED_KEYS = (
    "name", "client_name", "client", "company_name", "legal_entity_name", "entity_name", "trading_name", "director", "directors", "ubo", "shareholder",
    "address", "registered_address", "office_address", "dob", "date_of_birth", "passport", "passport_number", "national_id", "company_no",
    "company_registration_number", "registration_number", "tax_id", "vat_number", "lei", "iban", "swift", "bic", "account_number", "email", "email_address",
    "phone", "phone_number", "url", "website", "case_id", "client_id",
)
OTHER_LABELS = {"name": "Client Name", "client": "Client Name", "email_address": "Email", "date_of_birth": "Date of Birth"}
ACRONYMS = ("ubo", "dob", "id", "vat", "lei", "iban", "swift", "bic", "url")

BLOCK = pa.struct([("block_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("sheet", pa.string()),
                   ("row", pa.int32()), ("col", pa.int32()), ("header", pa.string())])
EXTRACTED = "format string, text string, blocks array<struct<block_id:string,start:int,end:int,text:string,sheet:string,row:int,col:int,header:string>>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def format_of(path: Column, content: Column, hint: str | None = None) -> Column:
    """A known hint, else the extension, else the first bytes."""
    if hint and hint.lower() in (*EXTENSIONS.values(), "unknown"):
        return F.lit(hint.lower())
    ext = F.lower(F.regexp_extract(path, r"[^/.]\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]
    head = F.decode(F.substring(content, 1, 8), "ISO-8859-1")
    sniffed = (F.when(content.isNull(), "unknown").when(head.startswith("%PDF"), "pdf").when(head.startswith("PK\x03\x04"), "xlsx")
               .when(head.rlike(r"^\s*[\[{]"), "json").otherwise("txt"))
    return F.coalesce(known, sniffed)


def read_files(spark: SparkSession, path: str, glob: str | None = None, hint: str | None = None) -> DataFrame:
    """(path, length, content, format) of each file below a path; files of no
    bytes have no row."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    return files.select("path", "length", "content", format_of(F.col("path"), F.col("content"), hint).alias("format"))


def json_label(key: str) -> str | None:
    """The label that a key of JSON stands for."""
    key = key.lower().replace("-", "_").replace(" ", "_")
    if key not in LABELLED_KEYS:
        return None
    return OTHER_LABELS.get(key) or " ".join(w.upper() if w in ACRONYMS else w.capitalize() for w in key.split("_"))


class _Builder:
    """Blocks and the text that they stand in, a line each."""

    def __init__(self):
        self.parts, self.at, self.blocks = [], 0, []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)

    def block(self, block_id: str, text: str, prefix: str = "", sheet=None, row=None, col=None, header=None) -> None:
        self.put(prefix)
        self.blocks.append({"block_id": block_id, "start": self.at, "end": self.at + len(text), "text": text, "sheet": sheet, "row": row, "col": col, "header": header})
        self.put(text + "\n")


def json_leaves(tree) -> Iterator[tuple[tuple, str]]:
    """(path, text) of the strings in a tree, depth first, without recursion."""
    todo = [((), tree)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, str):
            yield path, node
        elif isinstance(node, dict):
            todo += [((*path, k), v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [((*path, i), v) for i, v in reversed(list(enumerate(node)))]


def path_text(path: tuple) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)


def decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _json(b: _Builder, content: bytes, path: str) -> None:
    for p, text in json_leaves(json.loads(content.decode("utf-8"))):
        label = json_label(p[-1]) if p and isinstance(p[-1], str) else None
        b.block(path_text(p), text, f"{label}: " if label else "")


def csv_rows(content: bytes, path: str) -> list[list[str]]:
    sep = "\t" if path.lower().endswith(".tsv") else ","
    return [r for r in csv.reader(io.StringIO(decoded(content).removeprefix("﻿"), newline=""), delimiter=sep) if r]


def _csv(b: _Builder, content: bytes, path: str) -> None:
    head, *rows = csv_rows(content, path)
    b.block("csv:header", ", ".join(head))
    for i, r in enumerate(rows):
        if len(r) > len(head):
            raise ValueError(f"row {i} has {len(r)} fields, the header {len(head)}")
        for j, v in enumerate(r):
            if v:
                b.block(f"csv:{i}:{j}", v, row=i, col=j, header=head[j])


def _text(b: _Builder, content: bytes, path: str) -> None:
    text = decoded(content)
    b.blocks.append({"block_id": "txt:0", "start": 0, "end": len(text), "text": text, "sheet": None, "row": None, "col": None, "header": None})
    b.put(text)


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _cell(c, shared: list[str]) -> str | None:
    kind, f, v = c.get("t"), c.find(f"{_X}f"), c.find(f"{_X}v")
    if f is not None and f.text:
        return f"={f.text}"
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_X}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return str(v.text == "1")
    if kind is None or kind == "n":
        return v.text if re.fullmatch(r"-?\d+", v.text) else str(float(v.text))
    return v.text


def _xlsx(b: _Builder, content: bytes, path: str) -> None:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in _xml(z, "xl/sharedStrings.xml").findall(f"{_X}si")]
        target = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        for s in _xml(z, "xl/workbook.xml").iter(f"{_X}sheet"):
            name, t = s.get("name"), target[s.get(f"{_R}id")]
            heads: dict[int, str] = {}
            for c in _xml(z, t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}")).iter(f"{_X}c"):
                ref, v = c.get("r"), _cell(c, shared)
                if v is None or not v.strip():
                    continue
                row, col = int(re.search(r"\d+", ref)[0]), _column(ref)
                if row == 1:
                    heads[col] = v
                b.block(f"xlsx:{name}:{ref}", v, sheet=name, row=row, col=col, header=heads.get(col) if row > 1 else None)


def _paragraph(p) -> str:
    as_text = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(e.text or "" if e.tag == f"{_W}t" else as_text.get(e.tag, "") for r in p.iter(f"{_W}r") for e in r)


def _docx(b: _Builder, content: bytes, path: str) -> None:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _xml(z, "word/document.xml").find(f"{_W}body")
    for i, p in enumerate(body.findall(f"{_W}p")):
        text = _paragraph(p)
        if text.strip():
            b.block(f"docx:body:{i}", text)
        else:
            b.put("\n")
    for t, table in enumerate(body.findall(f"{_W}tbl")):
        for r, row in enumerate(table.findall(f"{_W}tr")):
            cells = [[_paragraph(p) for p in c.findall(f"{_W}p")] for c in row.findall(f"{_W}tc")]
            label = " ".join(cells[0]).strip().rstrip(":") if cells else None
            for c, paragraphs in enumerate(cells):
                for k, text in enumerate(paragraphs):
                    if text.strip():
                        b.block(f"docx:t{t}:r{r}:c{c}:p{k}", text, sheet=f"t{t}", row=r, col=c, header=label if c else None)


PARSERS = {"txt": _text, "csv": _csv, "json": _json, "xlsx": _xlsx, "docx": _docx}


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a row a batch: a file is as large as it is, and no more is held
            row = batch.slice(i, 1)
            path, content, kind = (row.column(k)[0].as_py() for k in (1, 2, 3))
            b, error = _Builder(), None
            try:
                if kind not in PARSERS:
                    raise ValueError(f"no reader for format {kind}")
                if content is None:
                    raise ValueError("no content")
                PARSERS[kind](b, content, path or "")
            except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, csv.Error, zipfile.BadZipFile, ElementTree.ParseError) as e:
                b, error = None, f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([
                row.column(0), pa.array([kind], pa.string()), pa.array(["".join(b.parts) if b else None], pa.string()),
                pa.array([b.blocks if b else None], pa.list_(BLOCK)), pa.array([error], pa.string())], names=["id", "format", "text", "blocks", "error"])


def extract(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, format, text, blocks, error) of files (id, path, content, format)."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[id_col]
    out = files.select(F.col(id_col).alias("id"), "path", "content", "format").mapInArrow(_extractor, f"id {kind}, {EXTRACTED}")
    return out.withColumnRenamed("id", id_col)


def blocks(extracted: DataFrame, id_col: str = "path") -> DataFrame:
    """A row for each block of extracted files."""
    return extracted.select(id_col, F.explode("blocks").alias("b")).select(id_col, "b.*")


def table_detections(found: DataFrame, id_col: str = "path") -> DataFrame:
    """Cells whose header (CSV, XLSX) or row label (DOCX) is a known label."""
    rules = F.broadcast(label_rules(found.sparkSession))  # a few dozen rows
    kind = F.split("block_id", ":")[0]
    detector = F.when(kind == "docx", "table.docx_label_row").otherwise(F.concat(F.lit("table."), kind, F.lit("_header")))
    return found.where("header is not null").withColumn("alias_key", key_of(F.col("header"))).join(rules, "alias_key").select(
        id_col, "start", "end", "text", "entity_type", F.lit(0.9).alias("confidence"), detector.alias("detector"))
