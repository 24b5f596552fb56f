"""Deletion of repeated runs of lines by a suffix array over line ids.

The corpus is one sequence of line ids with a break after each document.  Its
suffixes are put in order by distributed prefix doubling: a place's name at a
depth is the first place whose next lines, to that depth, are the same; the
names at twice the depth follow from two names, one that far ahead.  Places
that share a name at a depth are those of one longest-common-prefix interval,
and intervals of greater depths lie inside it.  Doubling goes on until no name
is shared, so the deepest interval of each place is known; a place that is not
the first of it begins a repeated run of that depth at least.  Overlapping and
touching runs of a document join to maximal ones, which are deleted.

Places that are alone in their interval leave after each round, so only lines
that still repeat are shuffled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch


SPACES = r"[\t\x0B\f\r ]+"


def _blank(line):
    return F.length(F.btrim(line, F.lit(" \t\r"))) == 0


def _words_over(line: str, n: int):
    """Whether a line has more than n words; a word and its space are two characters at least."""
    return (F.length(line) > 2 * n) & (F.size(F.filter(F.split(line, SPACES), lambda w: w != "")) > n)


def _named(scratch: Scratch, places: DataFrame, key: list[str]) -> DataFrame:
    """(doc, pos, d, p): the first place (d, p) with the same key; keys that
    only one place has are left out."""
    first = scratch.save(places.groupBy(*key).agg(F.min(F.struct("doc", "pos")).alias("f"), F.count("*").alias("c")).where("c > 1")
                         .select(*key, F.col("f.doc").alias("fd"), F.col("f.pos").alias("fp")))
    out = scratch.save(places.join(first, key).select("doc", "pos", F.col("fd").alias("d"), F.col("fp").alias("p")))
    scratch.drop(first)
    return out


def _ahead(names: DataFrame, step: int) -> DataFrame:
    """(doc, pos, d, p, d2, p2): with the name `step` lines further on."""
    w = Window.partitionBy("doc").orderBy("pos").rangeBetween(step, step)
    return names.select("doc", "pos", "d", "p", F.first(F.struct("d", "p")).over(w).alias("n")).where("n is not null").select(
        "doc", "pos", "d", "p", F.col("n.d").alias("d2"), F.col("n.p").alias("p2"))


def repeated_runs(lines: DataFrame, scratch: Scratch, min_lines: int) -> DataFrame:
    """(doc, pos, size): places where a run of `min_lines` lines or more starts
    that occurs earlier, with the depth of their deepest interval."""
    names, reach = _named(scratch, lines, ["l1", "l2"]), 1
    out, again = None, F.struct("doc", "pos") != F.struct(F.col("d").alias("doc"), F.col("p").alias("pos"))
    while True:
        if reach >= min_lines:
            found = names.where(again).select("doc", "pos", F.lit(reach).alias("size"))
            out = found if out is None else out.unionByName(found)
            if min_lines == 1 or names.isEmpty():
                break
        step = reach if reach >= min_lines else min(reach, min_lines - reach)
        names, reach = _named(scratch, _ahead(names, step), ["d", "p", "d2", "p2"]), reach + step
    return out.groupBy("doc", "pos").agg(F.max("size").alias("size"))


def maximal_runs(runs: DataFrame) -> DataFrame:
    """(doc, s, e): the runs of a document joined where they overlap or touch; e is behind the last line."""
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("pos") + F.col("size")
    opens = F.coalesce(F.col("pos") > F.max(end).over(before), F.lit(True))
    return runs.groupBy("doc", "pos").agg(F.max("size").alias("size")).select("doc", "pos", "size", opens.cast("int").alias("opens")).select(
        "doc", "pos", end.alias("end"), F.sum("opens").over(upto).alias("nth")).groupBy("doc", "nth").agg(F.min("pos").alias("s"), F.max("end").alias("e")).select("doc", "s", "e")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, carry: bool = False, long_words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_runs, kept (the text).

    Lines end at a newline; blank ones (only spaces, tabs and carriage
    returns) take no part and stay.  A run is `min_lines` or more successive
    lines that are not blank, within one document.  Documents are in the order
    of their ids, null first; n_runs counts maximal deleted runs.  A null text
    has no lines and stays null.  Rows with one id and one text are one
    document and lose the same lines; rows with one id and different texts are
    different documents.  With `long_words` a single line of more words than that
    is a run too: its later copies go whatever stands around them.  With `carry` the other columns come along in a struct
    `row`, whatever their names.  An empty table gives an empty result.  Other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession)
    t = F.col(text_col)
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("h")).alias("doc"), t.alias("t"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if carry else []))
    full = F.filter(F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: ~_blank(x["line"]))
    each = rows.select("doc", F.posexplode(full).alias("pos", "x")).select("doc", "pos", F.col("x.at").alias("at"), F.xxhash64("x.line").alias("l1"), F.xxhash64(F.lit(7), "x.line").alias("l2"),
                                                                                       *([_words_over("x.line", long_words).alias("long")] if long_words is not None else []))
    lines = scratch.save(each)
    places = lines.select("doc", "pos", "l1", "l2")
    runs = repeated_runs(places, scratch, min_lines)
    if long_words is not None:
        runs = runs.unionByName(repeated_runs(lines.where("long").select(places.columns), scratch, 1))
    gone = scratch.save(maximal_runs(runs).select("doc", F.explode(F.sequence("s", F.col("e") - 1)).alias("pos"), F.col("s")))
    # only documents that lose lines are put together anew
    ats = lines.join(gone, ["doc", "pos"]).groupBy("doc").agg(F.collect_set("at").alias("cut"), F.count(F.when(F.col("pos") == F.col("s"), 1)).alias("runs"))
    ats = scratch.save(ats)
    kept = F.array_join(F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains("cut", i)), "\n")
    # one way at every size: an exchange of the texts by their documents
    return rows.join(ats.hint("merge"), "doc", "left").select(
        F.col("doc.id").alias("doc_id"),
        F.size(F.filter(F.split(F.coalesce("t", F.lit("")), "\n"), lambda x: ~_blank(x))).cast("long").alias("n_lines"),
        F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("runs", F.lit(0)).cast("long").alias("n_runs"),
        F.when(F.col("cut").isNull(), F.col("t")).otherwise(kept).alias("kept"), *(["row"] if carry else []))
