"""Pattern matches as code-point spans, in built-in functions only.

The matches and the gaps between them alternate, so a match starts after the
lengths of all gaps up to it and of all matches before it.  (Spark's own match
position counts UTF-16 units.)
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import iban_ok, lei_ok
from .patterns import Pattern

#: Set around matches; a control character that texts hardly hold.
MARK = "\x01"


def matches(text: Column, regex: str | Column) -> Column:
    """array<struct<start,end,text>> of all leftmost matches.  The pattern may
    be a column, so each row can have its own.

    The text is searched once: each match is set between marks, and a split at
    the marks gives gap, match, gap and so on.  A text that holds the mark
    itself is searched once more for its gaps.
    """
    pattern = F.lit("(?U)" + regex) if isinstance(regex, str) else F.concat(F.lit("(?U)"), regex)
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    apart = F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.array(g, m)))
    pieces = F.when(text.contains(MARK), F.slice(apart, F.lit(1), 2 * F.size(found) + 1)).otherwise(marked)
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), x.alias("text"))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.coalesce(F.aggregate(pieces, zero, step, lambda acc: acc["out"]), zero["out"])


def lines_of(text: Column) -> Column:
    """array<struct<line_no,line,at>>: the lines of a text and where each starts."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<line_no:int,line:string,at:int>>").alias("out"))
    return F.aggregate(F.split(text, "\n"), zero, lambda acc, x: F.struct(
        (acc["at"] + F.length(x) + 1).alias("at"), (acc["n"] + 1).alias("n"),
        F.array_append(acc["out"], F.struct(acc["n"].alias("line_no"), x.alias("line"), acc["at"].alias("at"))).alias("out")), lambda acc: acc["out"])


def detections(text: Column, pattern: Pattern) -> Column:
    """array<struct<start,end,text,entity_type,confidence,detector>>."""
    def row(m: Column) -> Column:
        conf = F.lit(pattern.confidence)
        if pattern.check:
            ok = iban_ok(m["text"]) if pattern.check == "iban" else lei_ok(m["text"])
            conf = F.when(ok, conf).otherwise(F.lit(pattern.low))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit(pattern.entity_type).alias("entity_type"), conf.alias("confidence"), F.lit(pattern.detector).alias("detector"))
    found = matches(text, pattern.regex)
    if pattern.stop:
        found = F.filter(found, lambda m: ~m["text"].isin(*pattern.stop))
    if pattern.detector == "regex.phone_fallback":
        found = F.filter(found, lambda m: F.length(F.regexp_replace(m["text"], "[^0-9]", "")) >= 8)
    return F.transform(found, row)


def scan(docs: DataFrame, patterns: Iterable[Pattern], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match of any pattern; the text is read in one stage and a
    pattern that is left out of `patterns` costs nothing."""
    all_ = F.concat(*[detections(F.col(text_col), p) for p in patterns])
    return docs.select(F.col(id_col), F.explode(all_).alias("d")).select(id_col, "d.*")
