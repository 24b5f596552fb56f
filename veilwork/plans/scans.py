"""Scan queries: every pattern over derived text, some over documents and pages."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.spans import scan
from .kyc import TEXT, kyc


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def span_sql(source: str, regex: str, id_col: str = "doc_id") -> str:
    """(id, start, end, text) of all matches, with the same alternation."""
    r = _sql_text(regex)
    return f"""
SELECT {id_col}, CAST(s AS INTEGER) AS start, CAST(s + length(m) AS INTEGER) AS "end", m AS text FROM (
  SELECT {id_col}, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT {id_col}, ms, gs, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT {id_col}, regexp_extract_all(text, {r}) AS ms, string_split_regex(text, {r}) AS gs FROM {source}) a) b) c"""


def pattern_sql(p: P.Pattern, source: str, id_col: str = "doc_id") -> str:
    conf = repr(p.confidence)
    digits = lambda c: f"""list_aggregate(list_transform(string_split({c}, ''), lambda c: CASE WHEN c >= 'A' AND c <= 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), 'string_agg', '')"""
    if p.check:
        bare = "replace(text, ' ', '')"
        num = digits(f"(substring({bare}, 5) || substring({bare}, 1, 4))" if p.check == "iban" else bare)
        conf = f"CASE WHEN list_reduce(list_transform(string_split('0' || {num}, ''), lambda c: CAST(c AS INTEGER)), lambda a, c: (a * 10 + c) % 97) = 1 THEN {p.confidence} ELSE {p.low} END"
    stop = f" WHERE text NOT IN ({', '.join(map(_sql_text, p.stop))})" if p.stop else ""
    return f"""SELECT {id_col}, start, "end", text, '{p.entity_type}' AS entity_type, CAST({conf} AS DOUBLE) AS confidence, '{p.detector}' AS detector FROM ({span_sql(source, p.regex, id_col)}) z{stop}"""


QUERIES, ORACLES = {}, {}
for _p in (*P.A, *P.B):
    QUERIES[_p.name] = lambda spark, d, p=_p: scan(kyc(spark, d), [p])
    if _p.entity_type != "PHONE":
        ORACLES[_p.name] = pattern_sql(_p, f"({TEXT}) kyc")
QUERIES["re_all"] = lambda spark, d: scan(kyc(spark, d), P.A)
QUERIES["b_re_all"] = lambda spark, d: scan(kyc(spark, d), P.B)
QUERIES["re_email_documents"] = lambda spark, d: scan(spark.read.parquet(f"{d}/documents.parquet"), [P.A[0]])
ORACLES["re_email_documents"] = pattern_sql(P.A[0], "documents")
