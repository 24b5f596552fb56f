"""The two whole dataflows, as one logical plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import scan
from ..operators import detect, linkage, replace, validate
from ..operators import span_algebra as S
from ..runtime import saved


def detections_a(docs: DataFrame, floor: float = 0.4) -> DataFrame:
    """Patterns, labels and next-line labels, above a confidence."""
    found = scan(docs, P.A).unionByName(detect.label_values(docs)).unionByName(detect.next_line_values(docs))
    return found.where(F.col("confidence") >= floor)


def detections_b(docs: DataFrame, seeds: list[tuple[str, str]] = (), max_chars: int = 50_000, overlap: int = 1_000) -> DataFrame:
    """Patterns over overlapping chunks, labels, seeds and board sections."""
    c = S.chunks(docs, max_chars, overlap).select(F.struct("doc_id", "start").alias("at"), "text")
    found = scan(c, P.B, "at").select(F.col("at.doc_id").alias("doc_id"), (F.col("at.start") + F.col("start")).alias("start"), (F.col("at.start") + F.col("end")).alias("end"), "text", "entity_type", "confidence", "detector").distinct()
    found = found.unionByName(detect.label_values(docs, extra=detect.B_EXTRA_RULES, most_tokens=4)).unionByName(detect.board_names(docs))
    return found.unionByName(detect.seed_hits(docs, list(seeds))) if seeds else found


def anonymise(docs: DataFrame, found: DataFrame, mode: str = "synthetic", seed: str = "s", store: DataFrame | None = None, exempt_synthetic: bool = True, variant: str = "A") -> dict[str, DataFrame]:
    """Detections to output text, replacements and validation.

    Variant A merges names by first fit, gives generic phrases to the one entity
    of their type and sweeps the text for known names; variant B groups by stem,
    abbreviation and surname.  Every mention of an entity gets its replacement.
    """
    m = saved(linkage.mentions(S.dedup(found), variant))
    if variant == "A":
        columns = [*linkage.MENTION, "key", "is_alias"]
        m = saved(linkage.resolve(m).select(*columns))
        m = saved(m.unionByName(linkage.sweep(docs, m).select(*columns)))
    else:
        m = saved(linkage.resolve_pages(m))
    ents = linkage.entities(m, aliases=True)
    plan = saved(replace.plan(ents, mode, seed, store=store))
    edits = m.join(plan.select("doc_id", "entity_type", "key", "replacement"), ["doc_id", "entity_type", "key"]).select("doc_id", "start", "end", "replacement")
    output = S.apply_edits(docs.select("doc_id", "text"), edits)
    return {"entities": ents, "plan": plan, "edits": edits, "output": output, "validation": validate.report(docs, output, plan, exempt_synthetic=exempt_synthetic)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails and phone numbers of documents, found, replaced and checked."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = saved(scan(docs, [p for p in P.A if p.name in ("re_email", "re_phone")]))
    out = anonymise(docs, found)
    n = found.groupBy("doc_id").agg(F.count("*").alias("n_detections"))
    e = out["entities"].groupBy("doc_id").agg(F.count("*").alias("n_entities"))
    v = out["validation"].select("doc_id", "n_leaks")
    return n.join(e, "doc_id").join(out["output"].select("doc_id", "n_applied"), "doc_id").join(v, "doc_id")
