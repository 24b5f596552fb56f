"""Queries of the file readers and writers over derived files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, sinks
from .derived import RULES_SQL, parts
from .kyc import PARTS

JSON = """'{"client": {"name": "' || org || '", "age": ' || CAST(CAST(number AS BIGINT) AS STRING) || '.5, "notes": ["' || nation || '"]}}'"""
CSV = "'Client Name,Notes,Sort-Code' || chr(10) || org || ',,' || two || chr(10)"
NAME = "'in/' || number || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TSV' WHEN 2 THEN '.docx' ELSE '' END"
HEAD = "CASE doc_id % 2 WHEN 0 THEN '  {}' ELSE 'plain' END"

QUERIES, ORACLES = {}, {}


def _files(spark, d, content: str, kind: str):
    return parts(spark, d).select("doc_id", F.expr(f"'f.{kind}'").alias("path"), F.expr(content).cast("binary").alias("content"), F.lit(kind).alias("format"), "org", "two")


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f
    return add


@query("src_type", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' WHEN 2 THEN 'docx' ELSE CASE doc_id % 2 WHEN 0 THEN 'json' ELSE 'txt' END END AS format FROM ({PARTS}) p")
def _(spark, d):
    return parts(spark, d).select("doc_id", files.format_of(F.expr(NAME), F.expr(HEAD).cast("binary")).alias("format"))


@query("src_json", f"""SELECT doc_id, '$.client.name' AS block_id, 13 AS start, CAST(13 + length(org) AS INTEGER) AS "end", org AS text FROM ({PARTS}) p
UNION ALL SELECT doc_id, '$.client.notes[0]', CAST(14 + length(org) AS INTEGER), CAST(14 + length(org) + length(nation) AS INTEGER), nation FROM ({PARTS}) q""")
def _(spark, d):
    return files.blocks(files.extract(_files(spark, d, JSON, "json"), "doc_id"), "doc_id").select("doc_id", "block_id", "start", "end", "text")


@query("src_csv", f"""SELECT doc_id, 'csv:header' AS block_id, 0 AS start, 29 AS "end", 'Client Name, Notes, Sort-Code' AS text FROM ({PARTS}) p
UNION ALL SELECT doc_id, 'csv:0:0', 30, CAST(30 + length(org) AS INTEGER), org FROM ({PARTS}) q
UNION ALL SELECT doc_id, 'csv:0:2', CAST(31 + length(org) AS INTEGER), CAST(31 + length(org) + length(two) AS INTEGER), two FROM ({PARTS}) r""")
def _(spark, d):
    return files.blocks(files.extract(_files(spark, d, CSV, "csv"), "doc_id"), "doc_id").select("doc_id", "block_id", "start", "end", "text")


@query("tbl_blocks", f"""SELECT doc_id, start, "end", text, rule_type AS entity_type, CAST(0.9 AS DOUBLE) AS confidence, 'table.csv_header' AS detector FROM (
  SELECT doc_id, 30 AS start, CAST(30 + length(org) AS INTEGER) AS "end", org AS text, 'clientname' AS alias_key FROM ({PARTS}) p
  UNION ALL SELECT doc_id, CAST(31 + length(org) AS INTEGER), CAST(31 + length(org) + length(two) AS INTEGER), two, 'sortcode' FROM ({PARTS}) q) c JOIN {RULES_SQL} USING (alias_key)""")
def _(spark, d):
    return files.table_detections(files.blocks(files.extract(_files(spark, d, CSV, "csv"), "doc_id"), "doc_id"), "doc_id")


def _edits(docs, block: str):
    return docs.select("doc_id", F.lit(block).alias("block_id"), F.lit(0).alias("local_start"), F.length("org").alias("local_end"), F.concat(F.lit("Client "), "two").alias("replacement"))


@query("sink_json", f"""SELECT doc_id, replace('{{"client": {{"name": "Client ' || two || '", "age": ' || CAST(number AS BIGINT) || '.5, "notes": ["' || nation || '"]}}}}', ' ', '') AS content, 1 AS n_applied FROM ({PARTS}) p""")
def _(spark, d):
    docs = _files(spark, d, JSON, "json")
    return sinks.rewrite(docs, _edits(docs, "$.client.name"), "doc_id").select("doc_id", F.regexp_replace("content", r"\s", "").alias("content"), "n_applied")


@query("sink_csv", f"SELECT doc_id, 'Client Name,Notes,Sort-Code' || chr(10) || 'Client ' || two || ',,' || two || chr(10) AS content, 1 AS n_applied FROM ({PARTS}) p")
def _(spark, d):
    docs = _files(spark, d, CSV, "csv")
    return sinks.rewrite(docs, _edits(docs, "csv:0:0"), "doc_id").select("doc_id", "content", "n_applied")
