"""Checks of the output and reports over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import detections
from ..functions.text import is_generic


def _originals(replacements: DataFrame) -> DataFrame:
    """(doc_id, originals): every surface of a document's entities of three letters or more."""
    every = F.array_union(F.array("representative"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in replacements.columns else F.array("representative")
    o = replacements.select("doc_id", F.explode(every).alias("original")).where((F.length("original") >= 3) & ~is_generic(F.col("original")))
    return o.groupBy("doc_id").agg(F.collect_set("original").alias("originals"))


def _held(low: Column, names: Column) -> Column:
    return F.filter(names, lambda o: low.contains(F.lower(o)))


def leaks(output: DataFrame, replacements: DataFrame) -> DataFrame:
    """Originals, aliases among them, that the output still holds."""
    j = output.select("doc_id", F.lower("text").alias("t")).join(_originals(replacements), "doc_id")
    return j.select("doc_id", F.explode(_held(F.col("t"), F.col("originals"))).alias("original")).distinct()


def missing(output: DataFrame, replacements: DataFrame) -> DataFrame:
    """Entities whose replacement does not occur in the output."""
    return output.select("doc_id", F.lower("text").alias("t")).join(replacements, "doc_id").where(~F.col("t").contains(F.lower("replacement"))).select("doc_id", "entity_id")


def not_unique(replacements: DataFrame) -> DataFrame:
    """(type, hash) with more than one replacement."""
    return replacements.groupBy("entity_type", "original_hash").agg(F.count_distinct(F.lower("replacement")).alias("n")).where("n > 1")


def _left(text: Column, floor: float, exempt_synthetic: bool) -> Column:
    found = F.concat(*[detections(text, p) for p in P.A])
    keep = lambda d: d["confidence"] >= floor
    return F.filter(found, lambda d: keep(d) & ~d["text"].contains(".example") & ~d["text"].contains("ZZ")) if exempt_synthetic else F.filter(found, keep)


def residual(output: DataFrame, floor: float = 0.85, exempt_synthetic: bool = False) -> DataFrame:
    return output.select("doc_id", F.explode(_left(F.col("text"), floor, exempt_synthetic)).alias("d")).select("doc_id", "d.*")


def layout(before: Column, after: Column) -> Column:
    return _layout(F.regexp_count(before, F.lit("\n")), F.regexp_count(after, F.lit("\n")))


def _layout(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(a - b) / F.greatest(F.lit(1), a))


def quality(n_leaks: Column, n_residual: Column, n_missing: Column, layout_score: Column) -> Column:
    """1 less bounded penalties, between 0 and 1."""
    leak = F.when(n_leaks > 0, F.least(F.lit(0.6), n_leaks * 0.1 + 0.2)).otherwise(F.lit(0.0))
    out = F.lit(1.0) - leak - F.least(F.lit(0.4), n_residual * 0.1) - F.least(F.lit(0.3), n_missing * 0.05) - (F.lit(1.0) - layout_score) * 0.2
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)), 6)


def report(docs: DataFrame, output: DataFrame, replacements: DataFrame, max_leaks: int = 0, max_residual: int = 0, floor: float = 0.8, exempt_synthetic: bool = False) -> DataFrame:
    """One row per document: counts, scores and whether it passes.  The output
    is read once; beside it go only a document's names and its number of lines."""
    new = replacements.groupBy("doc_id").agg(F.collect_list("replacement").alias("new"))
    j = output.select("doc_id", F.col("text").alias("after")).join(docs.select("doc_id", F.regexp_count("text", F.lit("\n")).alias("lines")), "doc_id")
    j = j.join(new, "doc_id", "left").join(_originals(replacements), "doc_id", "left").withColumn("t", F.lower("after"))
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("long")
    j = j.select("doc_id", size(_held(F.col("t"), F.col("originals"))).alias("n_leaks"), size(_left(F.col("after"), 0.85, exempt_synthetic)).alias("n_residual"),
                 size(F.filter("new", lambda r: ~F.col("t").contains(F.lower(r)))).alias("n_missing"), _layout(F.col("lines"), F.regexp_count("after", F.lit("\n"))).alias("layout"))
    j = j.withColumn("quality", quality(F.col("n_leaks"), F.col("n_residual"), F.col("n_missing"), F.col("layout")))
    ok = (F.col("n_leaks") <= max_leaks) & (F.col("n_residual") <= max_residual) & (F.col("quality") >= floor)
    return j.select("doc_id", "n_leaks", "n_residual", "n_missing", "layout", "quality", ok.alias("passed"))


def counts(detections: DataFrame) -> DataFrame:
    """By detector, by type and in all, in one pass.  Each document tells once
    what it has of each, so documents are counted without a set of their ids."""
    per = detections.groupBy("doc_id").agg(F.collect_list(F.struct("detector", "entity_type")).alias("ds"))
    row = lambda by, detector, kind, n: F.struct(F.lit(by).alias("by"), detector.alias("detector"), kind.alias("entity_type"), n.alias("n"))
    none, ds = F.lit(None).cast("string"), F.col("ds")
    detectors = F.transform(F.array_distinct("ds.detector"), lambda d: row(0, d, none, F.size(F.filter(ds, lambda x: x["detector"].eqNullSafe(d)))))
    kinds = F.transform(F.array_distinct("ds.entity_type"), lambda k: row(1, none, k, F.size(F.filter(ds, lambda x: x["entity_type"].eqNullSafe(k)))))
    rows = per.select("doc_id", F.explode(F.concat(detectors, kinds, F.array(row(2, none, none, F.size(ds))))).alias("r"))
    return rows.groupBy("r.by", "r.detector", "r.entity_type").agg(F.sum("r.n").alias("n"), F.count("doc_id").alias("n_docs")).drop("by")


def summary(detections: DataFrame) -> DataFrame:
    return detections.groupBy("doc_id").agg(F.count("*").alias("n_detections"), F.count_distinct("entity_type").alias("n_types"), F.array_join(F.array_sort(F.collect_set("entity_type")), "|").alias("types"))


def redaction_map(ents: DataFrame, replacements: DataFrame, show_originals: bool = False) -> DataFrame:
    r = replacements.select("doc_id", "entity_id", "replacement", "strategy")
    return ents.join(r, ["doc_id", "entity_id"], "left").select("doc_id", "entity_id", "entity_type", F.when(F.lit(show_originals), F.col("representative")).alias("original"), "replacement", "strategy", "n_mentions")


def audit(docs: DataFrame, detections: DataFrame, validation: DataFrame) -> DataFrame:
    """One JSON report per document."""
    by = detections.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("by_type"))
    j = docs.select("doc_id").join(by, "doc_id", "left").join(validation, "doc_id", "left")
    return j.select("doc_id", F.to_json(F.struct("doc_id", "by_type", F.struct(*[c for c in validation.columns if c != "doc_id"]).alias("validation"))).alias("report"))


def classify_visual(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Wide boxes near the top are logos, small ones low on the right signatures."""
    w, h = x1 - x0, y1 - y0
    return (F.when((y1 <= height * 0.15) & (w > h * 3), F.lit("logo"))
            .when((x0 >= width * 0.5) & (y0 >= height * 0.7) & (w < width * 0.4) & (h < height * 0.15), F.lit("signature")).otherwise(F.lit("image")))


def graphic_blocks(boxes: DataFrame, ratio: float = 0.3, least: int = 20) -> DataFrame:
    """Pages whose primitives together cover `ratio` of the page."""
    g = boxes.groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"), F.first("width").alias("width"), F.first("height").alias("height"))
    return g.where((F.col("n") >= least) & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= F.col("width") * F.col("height") * ratio)).select("page", "x0", "y0", "x1", "y1", "n")
