"""Edited JSON and CSV files in their own format."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .files import csv_rows, decoded, json_leaves, path_text


def _patched(text: str, edits: list[dict]) -> tuple[str, int]:
    """Edits from the last start on; one that overlaps the edit before it is skipped."""
    last, n = len(text), 0
    for e in sorted(edits, key=lambda e: (-e["local_start"], e["local_end"], e["replacement"])):
        if e["local_end"] <= last:
            text, last, n = text[:e["local_start"]] + e["replacement"] + text[e["local_end"]:], e["local_start"], n + 1
    return text, n


def _json(content: bytes, path: str, edits: dict[str, list[dict]]) -> tuple[str, int]:
    tree, done = json.loads(content.decode("utf-8")), 0
    for p, text in list(json_leaves(tree)):
        if path_text(p) in edits:
            new, n = _patched(text, edits[path_text(p)])
            done += n
            if not p:
                tree = new
                continue
            at = tree
            for step in p[:-1]:
                at = at[step]
            at[p[-1]] = new
    return json.dumps(tree, ensure_ascii=False, indent=2), done


def _csv(content: bytes, path: str, edits: dict[str, list[dict]]) -> tuple[str, int]:
    (head, *rows), done, out = csv_rows(content, path), 0, io.StringIO()
    for i, r in enumerate(rows):
        for j, v in enumerate(r):
            if f"csv:{i}:{j}" in edits:
                r[j], n = _patched(v, edits[f"csv:{i}:{j}"])
                done += n
    csv.writer(out, delimiter="\t" if path.lower().endswith(".tsv") else ",", lineterminator="\n").writerows([head, *rows])
    return out.getvalue(), done


def _text(content: bytes, path: str, edits: dict[str, list[dict]]) -> tuple[str, int]:
    return _patched(decoded(content), edits.get("txt:0", []))


WRITERS = {"txt": _text, "csv": _csv, "json": _json}


def _rewriter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            path, content, kind, edits = (row.column(k)[0].as_py() for k in (1, 2, 3, 4))
            by_block: dict[str, list[dict]] = {}
            for e in edits or []:
                by_block.setdefault(e["block_id"], []).append(e)
            new, n, error = None, 0, None
            try:
                if kind not in WRITERS or content is None:
                    raise ValueError(f"no writer for format {kind}" if content is not None else "no content")
                new, n = WRITERS[kind](content, path or "", by_block)
            except (ValueError, KeyError, RecursionError, csv.Error) as e:
                error = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([row.column(0), pa.array([new], pa.string()), pa.array([n], pa.int32()), pa.array([error], pa.string())],
                                             names=["id", "content", "n_applied", "error"])


def rewrite(files: DataFrame, edits: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, content, n_applied, error) of files (id, path, content, format) after
    edits (id, block_id, local_start, local_end, replacement)."""
    ship(files.sparkSession)
    e = edits.where("replacement is not null").groupBy(id_col).agg(F.collect_list(F.struct("block_id", "local_start", "local_end", "replacement")).alias("edits"))
    kind = dict(files.dtypes)[id_col]
    rows = files.join(e, id_col, "left").select(F.col(id_col).alias("id"), "path", "content", "format", "edits")
    return rows.mapInArrow(_rewriter, f"id {kind}, content string, n_applied int, error string").withColumnRenamed("id", id_col)
