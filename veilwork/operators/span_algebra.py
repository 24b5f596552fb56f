"""Span algebra: overlap, containment, greedy removal, enclosing blocks, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.spans import lines_of

#: Entity types from most to least specific (fixed order for ties).
PRIORITY = ("IBAN", "LEI", "EMAIL", "URL", "SWIFT_BIC", "NATIONAL_ID", "TAX_ID", "PASSPORT", "PHONE", "POSTCODE", "SORT_CODE", "COMPANY_REG_NO", "BANK_ACCOUNT", "ORGANISATION", "PERSON", "ADDRESS", "GENERIC_DATE")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.coalesce((a_start < b_end) & (b_start < a_end), F.lit(False))


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """a is strictly longer and encloses b."""
    return F.coalesce((a_start <= b_start) & (a_end >= b_end) & (a_end - a_start > b_end - b_start), F.lit(False))


def overlapping_pairs(spans: DataFrame, id_col: str = "doc_id", strict_containment: bool = False) -> DataFrame:
    """Pairs of spans of one document: an equi-join on the document and a range."""
    a, b = spans.alias("a"), spans.alias("b")
    test = contains if strict_containment else overlaps
    on = (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & test(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    if not strict_containment:
        on = on & (F.struct("a.start", "a.end", "a.detector") < F.struct("b.start", "b.end", "b.detector"))
    return a.join(b, on).select(F.col(f"a.{id_col}").alias(id_col), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("start", "end", "detector")])


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dedup(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Greedy removal within each document, in the order of start and falling
    end: a span inside a kept one goes, one around it takes its place, and of
    two that overlap the more confident, more specific, longer one stays."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("entity_type")), F.lit(0))
    rank = F.when(rank == 0, len(PRIORITY) + 1).otherwise(rank)
    score = F.struct(F.col("confidence").alias("c"), (-rank).alias("p"), (F.col("end") - F.col("start")).alias("l"))
    item = F.struct(F.col("start"), (-F.col("end")).alias("ne"), (-F.col("confidence")).alias("nc"), rank.alias("rank"), F.col("detector"), F.col("end"), F.col("text"), F.col("entity_type"), F.col("confidence"), score.alias("score"))
    grouped = spans.groupBy(id_col).agg(F.sort_array(F.collect_list(item)).alias("xs"))
    kind = grouped.schema["xs"].dataType.simpleString()
    zero = F.struct(F.array().cast(kind).alias("done"), F.array().cast(kind).alias("open"))

    def placed(open_: Column, hit: Column, x: Column) -> Column:
        def against(k: Column) -> Column:
            inside = contains(k["start"], k["end"], x["start"], x["end"])
            around = contains(x["start"], x["end"], k["start"], k["end"])
            swap = around | (~inside & (x["score"] > k["score"]))
            return F.when(swap, F.transform(open_, lambda y, i: F.when(i == hit - 1, x).otherwise(y))).otherwise(open_)

        return F.when(hit == 0, F.array_append(open_, x)).otherwise(_let(F.element_at(open_, hit), against))

    def step(acc: Column, x: Column) -> Column:
        # starts only rise, so a kept span that ends before this start meets no later one
        over = F.filter(acc["open"], lambda k: k["end"] <= x["start"])
        done = F.when(F.exists(acc["open"], lambda k: k["end"] <= x["start"]), F.concat(acc["done"], over)).otherwise(acc["done"])
        first = lambda o: F.array_position(F.transform(o, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), F.lit(True)).cast("int")
        still = _let(F.filter(acc["open"], lambda k: ~F.coalesce(k["end"] <= x["start"], F.lit(False))), lambda o: _let(first(o), lambda hit: placed(o, hit, x)))
        return F.struct(done.alias("done"), still.alias("open"))

    folded = F.aggregate("xs", zero, step, lambda a: F.concat(a["done"], a["open"]))
    return grouped.select(id_col, F.explode(folded).alias("d")).select(id_col, "d.start", "d.end", "d.text", "d.entity_type", "d.confidence", "d.detector")


def enclosing_block(spans: DataFrame, blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The last block that starts at or before each span, if it holds the span:
    an as-of join by one sort of both sides."""
    b = blocks.select(id_col, F.col("start").alias("at"), F.lit(0).alias("side"), F.struct(F.col("block_id"), F.col("start").alias("bs"), F.col("end").alias("be")).alias("block"), F.lit(None).cast("int").alias("s_end"), F.lit(None).cast("string").alias("s_text"))
    s = spans.select(id_col, F.col("start").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<block_id:string,bs:int,be:int>").alias("block"), F.col("end").alias("s_end"), F.col("text").alias("s_text"))
    w = Window.partitionBy(id_col).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    j = b.unionByName(s).withColumn("block", F.last("block", ignorenulls=True).over(w)).where("side = 1 and block is not null and s_end <= block.be")
    return j.select(id_col, F.col("at").alias("start"), F.col("s_end").alias("end"), F.col("s_text").alias("text"), "block.block_id", (F.col("at") - F.col("block.bs")).alias("local_start"))


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block_id, start, end, text): one block per line."""
    end = F.col("x.at") + F.length("x.line")
    return docs.select(id_col, F.explode(lines_of(F.col(text_col))).alias("x")).select(
        id_col, F.concat(F.lit("line:"), F.col("x.line_no").cast("string")).alias("block_id"), F.col("x.at").alias("start"), end.alias("end"), F.col("x.line").alias("text"))


def chunks(pages: DataFrame, max_chars: int = 50_000, overlap: int = 1_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Overlapping windows of a text; a short text is one chunk."""
    if overlap >= max_chars:
        raise ValueError("overlap must be smaller than max_chars")
    n, step = F.length(text_col), max_chars - overlap
    last = F.greatest(F.lit(0), F.ceil((n - max_chars) / step).cast("int"))
    return pages.select(id_col, F.explode(F.sequence(F.lit(0), last)).alias("chunk"), F.col(text_col).alias("t")).select(
        id_col, "chunk", (F.col("chunk") * step).alias("start"), F.least(F.length("t"), F.col("chunk") * step + max_chars).alias("end"),
        F.substring("t", F.col("chunk") * step + 1, F.lit(max_chars)).alias("text"))


def apply_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_applied): edits (start, end, replacement) from the last
    start on; one that overlaps the edit applied before it is skipped."""
    e = edits.where("start is not null and replacement is not null").groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("start")).alias("ns"), F.col("end"), F.col("replacement")))).alias("es"))
    t = F.col(text_col)
    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(2147483647).alias("last"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        behind = F.substring(t, x["end"] + 1, a["last"] - x["end"])
        done = F.struct(F.array_append(F.array_append(a["parts"], behind), x["replacement"]).alias("parts"), (-x["ns"]).alias("last"), (a["n"] + 1).alias("n"))
        return F.when(x["end"] > a["last"], a).otherwise(done)

    # pieces from the last on, put together once
    whole = lambda a: F.struct(F.concat(F.substring(t, F.lit(1), a["last"]), F.array_join(F.reverse(a["parts"]), "")).alias("t"), a["n"].alias("n"))
    j = docs.join(e, id_col, "left")
    out = F.when(F.col("es").isNull(), F.struct(t.alias("t"), F.lit(0).alias("n"))).otherwise(F.aggregate("es", zero, step, whole))
    return j.select(id_col, out.alias("o")).select(id_col, F.col("o.t").alias("text"), F.col("o.n").alias("n_applied"))
