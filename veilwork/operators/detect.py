"""Context detectors: labels, tables, seed lists, board sections, quality scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.spans import lines_of, matches

#: Label aliases, entity type and length bounds of the value (fixed values).
LABEL_RULES = (
    (("client name", "client", "customer name"), "ORGANISATION", 2, 120), (("company name", "legal name"), "ORGANISATION", 2, 120),
    (("director", "name", "full name", "contact"), "PERSON", 2, 80), (("email", "e-mail"), "EMAIL", 5, 120),
    (("company number", "company no", "registration number"), "COMPANY_REG_NO", 4, 20), (("account number", "account no"), "BANK_ACCOUNT", 4, 34),
    (("sort code",), "SORT_CODE", 6, 10), (("iban",), "IBAN", 15, 42), (("lei",), "LEI", 20, 20), (("swift", "bic"), "SWIFT_BIC", 8, 11),
    (("address", "registered address"), "ADDRESS", 5, 200), (("vat", "tax id"), "TAX_ID", 4, 20), (("phone", "telephone"), "PHONE", 6, 30), (("website",), "URL", 4, 200),
    (("national insurance",), "NATIONAL_ID", 4, 20),
)
B_EXTRA_RULES = ((("chair", "secretary", "signed by"), "PERSON", 2, 80), (("board", "committee"), "ORGANISATION", 2, 120))
LEGAL_LAST = ("limited", "ltd", "plc", "llp", "llc", "inc", "gmbh", "ag", "sa", "nv", "bv")
AMBIGUOUS = ("client name", "client", "customer name", "name")


def label_rules(spark, extra=()) -> DataFrame:
    rows = [(F_key(a), kind, lo, hi) for names, kind, lo, hi in (*LABEL_RULES, *extra) for a in names]
    return spark.createDataFrame(rows, "alias_key string, entity_type string, min_len int, max_len int")


def F_key(alias: str) -> str:
    return "".join(c for c in alias.lower() if c not in " ./-_")


def key_of(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), r"[ ./_-]", "")


def refined(kind: Column, label: Column, value: Column, most_tokens: int = 3) -> Column:
    """Ambiguous labels decide by the value: a legal suffix makes it an
    organisation, one to three words of letters a person."""
    words = F.split(F.trim(value), r"\s+")
    legal = F.lower(F.regexp_replace(F.element_at(words, -1), r"\.", "")).isin(*LEGAL_LAST)
    name = (F.size(words) <= most_tokens) & F.forall(words, lambda w: w.rlike(r"^[\p{L}'.-]+$"))
    return F.when(~F.lower(F.trim(label)).isin(*AMBIGUOUS), kind).when(legal, F.lit("ORGANISATION")).when(name, F.lit("PERSON")).otherwise(kind)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.explode(lines_of(F.col(text_col))).alias("x")).select(id_col, "x.*")


INLINE = r"^\s*([^:\-\n]{2,61}?)\s*[:-]\s*(\S.*?)[\s.,;]*$"


def label_values(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra=(), most_tokens: int = 3) -> DataFrame:
    """`Label: value` on one line (confidence .95)."""
    rules = F.broadcast(label_rules(docs.sparkSession, extra))  # a few dozen rows
    parsed = _lines(docs, id_col, text_col).select(id_col, "at", "line", F.regexp_extract("line", INLINE, 1).alias("label"), F.regexp_extract("line", INLINE, 2).alias("text")).where("text <> ''")
    j = parsed.withColumn("alias_key", key_of(F.col("label"))).join(rules, "alias_key").where("length(text) between min_len and max_len")
    colon = F.length(F.regexp_extract("line", r"^(\s*[^:\-\n]{2,61}?\s*[:-]\s*)\S", 1))
    return j.select(id_col, (F.col("at") + colon).alias("start"), (F.col("at") + colon + F.length("text")).alias("end"), "text",
                    refined(F.col("entity_type"), F.col("label"), F.col("text"), most_tokens).alias("entity_type"), F.lit(0.95).alias("confidence"), F.lit("label.inline").alias("detector"))


def next_line_values(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A bare label whose value is the next line that is not blank (.9)."""
    rules = F.broadcast(label_rules(docs.sparkSession))
    lines = _lines(docs, id_col, text_col)
    full = F.when(F.trim("line") != "", F.struct("line", "at"))
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    nxt = lines.withColumn("nx", F.first(full, ignorenulls=True).over(w)).where("nx is not null")
    bare = nxt.withColumn("alias_key", key_of(F.regexp_replace(F.trim("line"), r"\s*:$", ""))).where(~F.substring("nx.line", 1, 40).contains(":"))
    j = bare.join(rules, "alias_key").withColumn("text", F.trim("nx.line")).where("length(text) between min_len and max_len")
    s = F.col("nx.at") + F.length("nx.line") - F.length(F.ltrim(F.col("nx.line")))
    return j.select(id_col, s.alias("start"), (s + F.length("text")).alias("end"), "text", "entity_type", F.lit(0.9).alias("confidence"), F.lit("label.next_line").alias("detector"))


def table_values(cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every cell below a header that is a label.  cells: (id, row, header, value)."""
    rules = F.broadcast(label_rules(cells.sparkSession))
    return cells.withColumn("alias_key", key_of(F.col("header"))).join(rules, "alias_key").where("value is not null and trim(value) <> ''").select(
        id_col, "row", "header", F.col("value").alias("text"), "entity_type", F.lit(0.9).alias("confidence"), F.lit("table.header").alias("detector"))


def _as_detections(found: Column, kind: str, confidence: float, detector: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit(kind).alias("entity_type"), F.lit(confidence).alias("confidence"), F.lit(detector).alias("detector")))


def seed_hits(docs: DataFrame, seeds: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences of seed values, longest first, in one alternation for each
    kind.  seeds: (kind, value); organisations also match without their suffix."""
    import re

    names: dict[str, set[str]] = {}
    for kind, value in seeds:
        forms = {value}
        if kind == "ORGANISATION":
            parts = value.split()
            while len(parts) > 1 and parts[-1].lower().strip(".") in LEGAL_LAST:
                parts = parts[:-1]
            if len(parts) > 1:
                forms.add(" ".join(parts))
        if kind == "PERSON":
            parts = value.split()
            if len(parts) > 1:
                forms |= {f"{parts[0][0]}. {parts[-1]}"} | ({parts[-1]} if len(parts[-1]) >= 4 else set())
        names.setdefault(kind, set()).update(forms)
    rows = []
    for kind in sorted(names):
        words = sorted(names[kind], key=lambda w: (-len(w), w))
        flag = "(?i)" if kind != "PERSON" else ""
        found = matches(F.col(text_col), flag + r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b")
        rows.append(_as_detections(found, kind, 0.99, "seed"))
    return docs.select(id_col, F.explode(F.concat(*rows)).alias("d")).select(id_col, "d.*")


def board_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 4000) -> DataFrame:
    """Capitalised names from a section header to the next one or `window` characters."""
    header = r"(?im)^\s*(?:board of directors|directors|board members|committee members|attendees|present|in attendance|trustees|officers|signatories)\s*:?\s*$"
    heads = docs.select(id_col, text_col, F.explode(matches(F.col(text_col), header)).alias("h"))
    nxt = F.lead("h.start").over(Window.partitionBy(id_col).orderBy("h.start"))
    body = heads.select(id_col, F.col("h.end").alias("at"), F.substring(text_col, F.col("h.end") + 1, F.least(F.lit(window), F.coalesce(nxt, F.length(text_col)) - F.col("h.end"))).alias("body"))
    found = body.select(id_col, "at", F.explode(matches(F.col("body"), P.NAME)).alias("m")).where(~F.split(F.col("m.text"), " ")[0].isin(*P.NAME_BLOCK))
    return found.select(id_col, (F.col("at") + F.col("m.start")).alias("start"), (F.col("at") + F.col("m.end")).alias("end"), "m.text", F.lit("PERSON").alias("entity_type"), F.lit(0.85).alias("confidence"), F.lit("board").alias("detector"))


def qa_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    f = docs.select(id_col, F.explode(matches(F.col(text_col), P.NAME)).alias("m")).where(~F.split(F.col("m.text"), " ")[0].isin(*P.NAME_BLOCK))
    return f.select(id_col, F.col("m.start").alias("start"), F.col("m.text").alias("text"), F.lit("medium").alias("severity"), F.lit(0.6).alias("confidence"))


def qa_orgs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A legal suffix and up to five capitalised words in the 80 characters before."""
    f = docs.select(id_col, F.col(text_col).alias("t"), F.explode(matches(F.col(text_col), P.LEGAL)).alias("m"))
    before = F.substring("t", F.greatest(F.lit(1), F.col("m.start") - 79), F.least(F.lit(80), F.col("m.start")))
    words = F.trim(F.regexp_extract(before, r"((?:[A-Z][\w&'-]* ){1,5})$", 1))
    return f.select(id_col, F.col("m.start").alias("start"), F.when(words == "", F.col("m.text")).otherwise(F.concat(words, F.lit(" "), F.col("m.text"))).alias("text"), F.lit("high").alias("severity"), F.lit(0.75).alias("confidence"))


def qa_abbreviations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    f = F.array_distinct(F.transform(matches(F.col(text_col), P.ABBREVIATION), lambda m: m["text"]))
    return docs.select(id_col, F.explode(f).alias("text")).where(~F.col("text").isin(*P.ABBREVIATION_BLOCK)).select(id_col, "text", F.lit("low").alias("severity"), F.lit(0.4).alias("confidence"))


def qa_residual(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    from ..functions.spans import scan

    return scan(docs, P.B, id_col, text_col).where(~F.col("text").contains("example") & ~F.col("text").contains(".test"))
