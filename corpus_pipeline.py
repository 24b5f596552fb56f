"""A corpus pipeline of five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import Scratch, table
from veilwork.llm.line_dedup import dedup_lines
from veilwork.llm.near_dup import near_duplicates
from veilwork.llm.packing import pack_documents
from veilwork.llm.repeats import without_repeats
from veilwork.llm.toxicity import fit, scored


#: A column of near_dedup that no table has.
KEY = "near_dedup key"


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents from (row, kept): the new text and its length."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts stay, and so do
    repeated rows and rows without an id that are clean; further columns may have any name."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    mark = "toxicity_score" + "_" * max(map(len, docs.columns))  # longer than any column's name
    return scored(docs, model, out_col=mark).where(F.col(mark) < 0.5).drop(mark)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs and of single lines of over 50 words
    go, and documents that were nothing else."""
    out = dedup_lines(docs, carry=True, long_words=50).where("n_removed = 0 or n_removed < n_lines")
    return _with_text(out, docs.columns)


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with a column KEY, one value for each id and text: the id
    itself, so that earlier documents still lead their groups; a hash above all
    usual ids where there is no id or an id has different texts."""
    h = F.xxhash64("text")
    several = docs.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo < hi").select("doc_id", F.lit(True).alias(KEY))
    odd = F.col("doc_id").isNull() | F.col(KEY).isNotNull()
    key = F.when(odd, F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))).otherwise(F.col("doc_id").cast("long"))
    return docs.join(Scratch(spark).save(several), "doc_id", "left").select(*docs.columns, key.alias(KEY))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the
    smallest id (null last).  Rows with one id and one text are one document;
    rows with one id and different texts, or without an id, are documents of
    their own."""
    keyed = _keyed(spark, docs)
    group = near_duplicates(keyed, id_col=KEY).select(F.col("doc_id").alias(KEY), "component_id").distinct()
    first = F.min_by(KEY, F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias(KEY)
    stay = group.join(keyed.select(KEY, "doc_id").distinct(), KEY).groupBy("component_id").agg(first).select(KEY)
    return keyed.join(stay, KEY, "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, and documents that were nothing else."""
    out = without_repeats(docs, carry=True).where("n_removed = 0 or n_removed < n_bytes")
    return _with_text(out, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("best_fit_packing", packing)]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        docs = scratch.save(out)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
