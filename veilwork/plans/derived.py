"""Queries over derived text and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..functions import patterns as P
from ..functions import text as T
from ..functions.spans import scan
from ..operators import detect, linkage, replace, validate
from ..operators import span_algebra as S
from ..runtime import saved
from . import flow
from .kyc import PARTS, TEXT, kyc, views
from .scans import _sql_text, pattern_sql, span_sql

QUERIES, ORACLES = {}, {}
BY_NAME = {p.name: p for p in (*P.A, *P.B)}
KYC = f"({TEXT}) kyc"
SUFFIX_SQL = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SUFFIX_A.items()) + " ELSE w END"
PUNCT = r"[^\p{L}\p{N}\s&-]"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def parts(spark, d):
    views(spark, d, "customer", "nation")
    return spark.sql(PARTS)


def sha_pick(key: str, n: int) -> str:
    return f"CAST(('0x' || substring(sha256({key}), 1, 16))::UBIGINT % {n} AS INTEGER)"


def pool(names: tuple[str, ...], key: str) -> str:
    return f"(['{"', '".join(names)}'])[{sha_pick(key, len(names))} + 1]"


def sha_digits(key: str, n: int) -> str:
    return f"substring(translate(sha256({key}), 'abcdef', '012345'), 1, {n})"


def org_norm(c: str) -> str:
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace({c}, '{PUNCT}', ' ', 'g')), '\\s+'), lambda w: w <> ''), lambda w: {SUFFIX_SQL}), ' ')"


STEM_END = "( (" + "|".join(sorted(set(T.SUFFIX_A.values()))) + "))+$"


def org_stem_sql(c: str) -> str:
    return f"regexp_replace({org_norm(c)}, '{STEM_END}', '')"


def mod97_sql(c: str) -> str:
    return f"list_reduce(list_transform(string_split('0' || {c}, ''), lambda c: CAST(c AS INTEGER)), lambda a, c: (a * 10 + c) % 97)"


# scalar functions

for _name, _spark, _sql in (
    ("fn_normalise_org", lambda p: T.normalise(F.col("org"), F.lit("ORGANISATION")), org_norm("org")),
    ("fn_normalise_person", lambda p: T.normalise(F.concat(F.lit("Dr. "), "first_name", F.lit("  "), "last_name"), F.lit("PERSON")), "lower(first_name) || ' ' || lower(last_name)"),
    ("fn_normalise_id", lambda p: T.normalise(F.concat("two", F.lit("-34 56/"), "number"), F.lit("SORT_CODE")), "two || '3456' || number"),
    ("fn_normalise_b_location", lambda p: T.normalise(F.col("nation"), F.lit("LOCATION"), "B"), "lower(nation)"),
    ("fn_canonicalise", lambda p: T.canonicalise(F.concat("org", F.lit(", "), "nation"), F.lit("ORGANISATION")), "regexp_replace(regexp_replace(lower(org || ', ' || nation), '[.,]', '', 'g'), '\\s+', ' ', 'g')"),
    ("fn_org_stem", lambda p: T.org_stem(F.col("org")), org_stem_sql("org")),
    ("fn_acronym", lambda p: T.acronym(F.col("org")), "upper(array_to_string(list_transform(string_split(stem, ' '), lambda w: substring(w, 1, 1)), ''))"),
    ("fn_initial_form", lambda p: T.initial_form(F.concat_ws(" ", "first_name", "last_name")), "lower(substring(first_name, 1, 1)) || ' ' || lower(last_name)"),
    ("fn_first_name", lambda p: T.first_name(F.concat_ws(" ", "first_name", "last_name")), "first_name"),
    ("fn_last_name", lambda p: T.last_name(F.concat_ws(" ", "first_name", "last_name")), "last_name"),
    ("fn_url_domain", lambda p: T.url_domain(F.concat(F.lit("https://www."), T.slug(F.col("stem")), F.lit(".com/about?x=1"))), "regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g') || '.com'"),
    ("fn_slug", lambda p: T.slug(F.concat(F.lit(" "), "org", F.lit("!"))), "trim(regexp_replace(lower(org), '[^a-z0-9]+', '-', 'g'), '-')"),
    ("fn_split_suffix", lambda p: F.concat_ws("|", *T.split_suffix(F.col("org"))), "stem || '|' || substring(org, length(stem) + 2)"),
    ("fn_casing", lambda p: T.like_case(F.col("org"), F.upper("nation")), "upper(org)"),
    ("fn_bank_like", lambda p: T.bank_like(F.col("org")).cast("string"), "CASE WHEN regexp_matches(org, '(?i)\\b(bank|banking|financial|capital|credit)\\b') THEN 'true' ELSE 'false' END"),
    ("fn_pick", lambda p: T.pick(F.col("org"), 12).cast("string"), f"CAST({sha_pick('org', 12)} AS VARCHAR)"),
    ("fn_hash", lambda p: T.keyed_hash(b"veilwork", "project", F.col("org")), None),
    ("fn_entity_id", lambda p: T.entity_id(F.lit("ORG"), (F.col("doc_id") % 50), F.col("org")), "'ORG_' || lpad(CAST(doc_id % 50 AS VARCHAR), 3, '0') || '_' || substring(sha1(org), 1, 8)"),
    ("fn_mod97", lambda p: checks.mod97(F.concat("number", "two", F.lit("3456789012345678901234567890"))).cast("string"), f"CAST({mod97_sql("number || two || '3456789012345678901234567890'")} AS VARCHAR)"),
    ("fn_check_digits", lambda p: checks.check_digits(F.concat(F.lit("5299"), "number")), f"lpad(CAST(98 - {mod97_sql("'5299' || number || '00'")} AS VARCHAR), 2, '0')"),
    ("fn_is_abbrev", lambda p: T.is_abbreviation(F.upper(F.substring("stem", 1, 1)), F.col("org")).cast("string"), "'true'"),
    ("fn_person_score", lambda p: T.person_score(F.concat_ws(" ", "first_name", "last_name"), F.concat(F.substring("first_name", 1, 1), F.lit(" "), F.col("last_name"))).cast("string"), "'95'"),
    ("fn_org_score", lambda p: T.org_score(F.col("org"), F.col("stem")).cast("string"), "'100'"),
):
    QUERIES[_name] = lambda spark, d, f=_spark: parts(spark, d).select("doc_id", f(None).alias("value"))
    if _sql:
        ORACLES[_name] = f"SELECT doc_id, {_sql} AS value FROM ({PARTS}) p"
# the keyed hash by its definition: inner and outer pads of the 64-byte key block
_pad = lambda x: "".join(f"\\x{b ^ x:02X}" for b in b"veilwork".ljust(64, b"\0"))
ORACLES["fn_hash"] = f"SELECT doc_id, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || 'project\\x01'::BLOB || org::BLOB))) AS value FROM ({PARTS}) p"


@query("fn_email_parts", f"SELECT doc_id, split_part(email, '@', 1) AS local, split_part(email, '@', 2) AS domain FROM {KYC}")
def _(spark, d):
    return kyc(spark, d).select("doc_id", T.email_local(F.col("email")).alias("local"), T.email_domain(F.col("email")).alias("domain"))


@query("fn_unicode_form")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(T.unicode_form(F.col("text")).cast("binary"), 256).alias("value"))


# labels, tables, seeds, board sections

LABELS = [(detect.F_key(a), kind, lo, hi) for names, kind, lo, hi in detect.LABEL_RULES for a in names]
RULES_SQL = "(VALUES " + ", ".join(f"('{a}', '{k}', {lo}, {hi})" for a, k, lo, hi in LABELS) + ") r(alias_key, rule_type, min_len, max_len)"
LINES_SQL = f"""(SELECT doc_id, line, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {KYC}) l0)"""
_INLINE = detect.INLINE.replace("'", "''")
_AMB = ", ".join(f"'{a}'" for a in detect.AMBIGUOUS)
_LEGAL = ", ".join(f"'{a}'" for a in detect.LEGAL_LAST)
REFINE_SQL = rf"""CASE WHEN lower(trim(label)) NOT IN ({_AMB}) THEN rule_type WHEN replace(lower(list_last(string_split(trim(text), ' '))), '.', '') IN ({_LEGAL}) THEN 'ORGANISATION'
  WHEN len(string_split(trim(text), ' ')) <= 3 AND len(list_filter(string_split(trim(text), ' '), lambda w: NOT regexp_full_match(w, '[\p{{L}}''.-]+'))) = 0 THEN 'PERSON' ELSE rule_type END"""
LV_SQL = rf"""SELECT doc_id, CAST(place + head AS INTEGER) AS start, CAST(place + head + length(text) AS INTEGER) AS "end", text, {REFINE_SQL} AS entity_type, CAST(0.95 AS DOUBLE) AS confidence, 'label.inline' AS detector
FROM (SELECT *, length(regexp_extract(line, '^(\s*[^:\-\n]{{2,61}}?\s*[:-]\s*)\S', 1)) AS head, regexp_replace(lower(label), '[ ./_-]', '', 'g') AS alias_key
  FROM (SELECT *, regexp_extract(line, '{_INLINE}', 1) AS label, regexp_extract(line, '{_INLINE}', 2) AS text FROM {LINES_SQL} l1) l2 WHERE text <> '') l3
JOIN {RULES_SQL} USING (alias_key) WHERE length(text) BETWEEN min_len AND max_len"""


@query("lv_inline", LV_SQL)
def _(spark, d):
    return detect.label_values(kyc(spark, d))


@query("lv_next", f"""SELECT doc_id, CAST(p2 AS INTEGER) AS start, CAST(p2 + length(l2) AS INTEGER) AS "end", l2 AS text, rule_type AS entity_type, CAST(0.9 AS DOUBLE) AS confidence, 'label.next_line' AS detector
FROM (SELECT *, lead(line) OVER w AS l2, lead(place) OVER w AS p2, regexp_replace(lower(regexp_replace(trim(line), ':$', '')), '[ ./_-]', '', 'g') AS alias_key FROM {LINES_SQL} l1 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) x
JOIN {RULES_SQL} USING (alias_key) WHERE length(l2) BETWEEN min_len AND max_len AND NOT contains(substring(l2, 1, 40), ':')""")
def _(spark, d):
    return detect.next_line_values(kyc(spark, d))


@query("b_lv")
def _(spark, d):
    return detect.label_values(kyc(spark, d), extra=detect.B_EXTRA_RULES, most_tokens=4)


@query("tbl_csv", f"""SELECT doc_id, CAST(doc_id AS INTEGER) AS row, header, text, rule_type AS entity_type, CAST(0.9 AS DOUBLE) AS confidence, 'table.header' AS detector FROM (
  SELECT doc_id, 'Client Name' AS header, org AS text, 'clientname' AS alias_key FROM ({PARTS}) p UNION ALL SELECT doc_id, 'Sort-Code', two, 'sortcode' FROM ({PARTS}) p UNION ALL SELECT doc_id, 'Notes', nation, 'notes' FROM ({PARTS}) p) c JOIN {RULES_SQL} USING (alias_key)""")
def _(spark, d):
    cells = parts(spark, d).select("doc_id", F.col("doc_id").cast("int").alias("row"), F.expr("stack(3, 'Client Name', org, 'Sort-Code', two, 'Notes', nation) as (header, value)"))
    return detect.table_values(cells)


BOARD = "'Board of Directors' || chr(10) || first_name || ' ' || last_name || chr(10) || 'Agenda item ' || two"


@query("board", f"""SELECT doc_id, 19 AS start, CAST(19 + length(first_name || ' ' || last_name) AS INTEGER) AS "end", first_name || ' ' || last_name AS text, 'PERSON' AS entity_type, CAST(0.85 AS DOUBLE) AS confidence, 'board' AS detector FROM ({PARTS}) p""")
def _(spark, d):
    return detect.board_names(parts(spark, d).select("doc_id", F.expr(BOARD).alias("text")))


SEEDS = [("ORGANISATION", "Northgate Trading Limited"), ("LOCATION", "London")]


@query("seed", f"""SELECT doc_id, start, "end", text, 'ORGANISATION' AS entity_type, CAST(0.99 AS DOUBLE) AS confidence, 'seed' AS detector FROM ({span_sql(KYC, r'(?i)\b(?:Northgate Trading Limited|Northgate Trading)\b')}) a
UNION ALL SELECT doc_id, start, "end", text, 'LOCATION', 0.99, 'seed' FROM ({span_sql(KYC, r'(?i)\b(?:London)\b')}) b""")
def _(spark, d):
    return detect.seed_hits(kyc(spark, d), SEEDS)


# span algebra

SOME = ("re_company", "re_account", "re_vat", "re_company_prefixed", "re_sort")
SOME_SQL = " UNION ALL ".join(f"SELECT * FROM ({pattern_sql(BY_NAME[n], KYC)}) u{i}" for i, n in enumerate(SOME))


def some(spark, d):
    return scan(kyc(spark, d), [BY_NAME[n] for n in SOME])


@query("span_overlap", f"""WITH s AS ({SOME_SQL}) SELECT a.doc_id, a.start AS a_start, a."end" AS a_end, a.detector AS a_detector, b.start AS b_start, b."end" AS b_end, b.detector AS b_detector
FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end" AND (a.start, a."end", a.detector) < (b.start, b."end", b.detector)""")
def _(spark, d):
    return S.overlapping_pairs(some(spark, d))


CONTAIN = ("re_email", "re_url", "re_iban", "re_bic", "re_date")
CONTAIN_SQL = " UNION ALL ".join(f"SELECT * FROM ({pattern_sql(BY_NAME[n], KYC)}) u{i}" for i, n in enumerate(CONTAIN)) + f" UNION ALL ({LV_SQL})"


@query("span_contains", f"""WITH s AS ({CONTAIN_SQL}) SELECT a.doc_id, a.start AS a_start, a."end" AS a_end, a.detector AS a_detector, b.start AS b_start, b."end" AS b_end, b.detector AS b_detector
FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.start <= b.start AND a."end" >= b."end" AND a."end" - a.start > b."end" - b.start""")
def _(spark, d):
    t = kyc(spark, d)
    return S.overlapping_pairs(scan(t, [BY_NAME[n] for n in CONTAIN]).unionByName(detect.label_values(t)), strict_containment=True)


@query("span_dedup")
def _(spark, d):
    return S.dedup(flow.detections_a(kyc(spark, d)))


@query("span_block", f"""WITH s AS ({pattern_sql(BY_NAME['re_date'], KYC)})
SELECT s.doc_id, s.start, s."end", s.text, 'line:' || CAST(l.line_no - 1 AS VARCHAR) AS block_id, CAST(s.start - l.place AS INTEGER) AS local_start
FROM s JOIN {LINES_SQL} l ON s.doc_id = l.doc_id AND l.place <= s.start AND s."end" <= l.place + length(l.line)""")
def _(spark, d):
    t = kyc(spark, d)
    return S.enclosing_block(scan(t, [BY_NAME["re_date"]]), S.line_blocks(t))


@query("chunk", """SELECT doc_id, CAST(c AS INTEGER) AS chunk, CAST(c * 900 AS INTEGER) AS start, CAST(least(length(text), c * 900 + 1000) AS INTEGER) AS "end", md5(substring(text, CAST(c * 900 + 1 AS BIGINT), 1000)) AS h
FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1000) / 900.0)) AS BIGINT) + 1)) AS c FROM documents) x""")
def _(spark, d):
    c = S.chunks(spark.read.parquet(f"{d}/documents.parquet"), 1000, 100)
    return c.select("doc_id", "chunk", "start", "end", F.md5(F.col("text").cast("binary")).alias("h"))


# linkage

EMAIL_SQL = pattern_sql(BY_NAME["re_email"], KYC)


@query("cl_exact", f"""SELECT doc_id, entity_type, lower(text) AS key, text AS representative, count(*) AS n_mentions, min(start) AS first_start, max(confidence) AS confidence, text AS surfaces FROM ({EMAIL_SQL}) e GROUP BY ALL""")
def _(spark, d):
    return linkage.exact_clusters(linkage.mentions(scan(kyc(spark, d), [BY_NAME["re_email"]])))


def made_entities(spark, d):
    """Persons, organisations and a generic phrase of each customer."""
    p = parts(spark, d)
    rows = F.array(*[F.struct(F.lit(i).alias("start"), F.lit(i + 5).alias("end"), t.alias("text"), F.lit(k).alias("entity_type"), F.lit(0.9).alias("confidence"), F.lit("made").alias("detector")) for i, (t, k) in enumerate((
        (F.concat_ws(" ", "first_name", "last_name"), "PERSON"), (F.col("last_name"), "PERSON"), (F.col("org"), "ORGANISATION"), (T.acronym(F.col("stem")), "ORGANISATION"), (F.lit("the Client"), "ORGANISATION"),
        (F.concat("first_name", F.lit("@"), F.lower(F.substring_index("stem", " ", 1)), F.lit(".com")), "EMAIL")))])
    rows = F.when(F.col("doc_id") % 3 == 0, F.slice(rows, 1, 3)).otherwise(rows)
    return p.select("doc_id", F.explode(rows).alias("m")).select("doc_id", "m.*")


@query("cl_alias", f"SELECT doc_id, 4 AS start, 'the Client' AS text, 'ambiguous' AS outcome, NULL AS entity_id FROM ({PARTS}) p WHERE doc_id % 3 <> 0")
def _(spark, d):
    m = linkage.mentions(made_entities(spark, d))
    return linkage.generic_aliases(m, linkage.entities(m))


@query("b_link_surname", f"SELECT doc_id, lower(last_name) AS key, lower(first_name || ' ' || last_name) AS owner FROM ({PARTS}) p")
def _(spark, d):
    return linkage.surname_links(linkage.entities(linkage.mentions(made_entities(spark, d))))


@query("b_link_abbrev", f"SELECT doc_id, upper(array_to_string(list_transform(string_split(stem, ' '), lambda w: substring(w, 1, 1)), '')) AS abbreviation, {org_norm('org')} AS owner FROM ({PARTS}) p WHERE doc_id % 3 <> 0")
def _(spark, d):
    return linkage.abbreviation_links(linkage.entities(linkage.mentions(made_entities(spark, d))))


@query("cl_link", f"SELECT doc_id, lower(first_name) || '@' || lower(split_part(stem, ' ', 1)) || '.com' AS email, {org_norm('org')} AS org FROM ({PARTS}) p WHERE doc_id % 3 <> 0")
def _(spark, d):
    return linkage.email_owner_links(linkage.entities(linkage.mentions(made_entities(spark, d))))


def linked(spark, d):
    """The organisation and person of each customer with an address and a page of theirs."""
    rows = F.array(*[F.struct(F.lit(i * 100).alias("start"), F.lit(i * 100 + 9).alias("end"), t.alias("text"), F.lit(k).alias("entity_type"), F.lit(0.9).alias("confidence"), F.lit("made").alias("detector")) for i, (t, k) in enumerate((
        (F.concat_ws(" ", "first_name", "last_name"), "PERSON"), (F.col("org"), "ORGANISATION"), (F.concat("last_name", F.lit("."), "two", F.lit("@mail.example")), "EMAIL"),
        (F.concat(F.lit("https://www."), F.lower(F.substring_index("stem", " ", 1)), "two", F.lit(".com/")), "URL")))])
    return linkage.entities(linkage.mentions(parts(spark, d).select("doc_id", F.explode(rows).alias("m")).select("doc_id", "m.*")))


@query("cl_link_url", f"SELECT doc_id, lower(split_part(stem, ' ', 1)) || two || '.com' AS url, {org_norm('org')} AS org FROM ({PARTS}) p")
def _(spark, d):
    return linkage.url_owner_links(linked(spark, d))


@query("cl_link_person", f"SELECT doc_id, lower(last_name) || '.' || two || '@mail.example' AS email, lower(first_name || ' ' || last_name) AS person FROM ({PARTS}) p")
def _(spark, d):
    return linkage.email_person_links(linked(spark, d))


_EID = "'EMAIL_001_' || substring(sha1(lower(last_name) || '.' || two || '@mail.example'), 1, 8)"
_PID = "'PERSON_001_' || substring(sha1(lower(first_name || ' ' || last_name)), 1, 8)"


@query("cl_related", f"SELECT doc_id, {_EID} AS entity_id, {_PID} AS related FROM ({PARTS}) p UNION ALL SELECT doc_id, {_PID}, {_EID} FROM ({PARTS}) q")
def _(spark, d):
    return linkage.related(linked(spark, d))


def variants(spark, d):
    """Written forms of one organisation and one person, the surname alone, and the generic phrase."""
    rows = F.array(*[F.struct(F.lit(i * 100).alias("start"), F.lit(i * 100 + 9).alias("end"), t.alias("text"), F.lit(k).alias("entity_type"), F.lit(0.9).alias("confidence"), F.lit("made").alias("detector")) for i, (t, k) in enumerate((
        (F.col("org"), "ORGANISATION"), (F.concat(F.upper("stem"), F.lit(" LTD.")), "ORGANISATION"), (F.concat_ws(" ", "first_name", "last_name"), "PERSON"), (F.concat(F.lit("Mr "), F.substring("first_name", 1, 1), F.lit(". "), F.col("last_name")), "PERSON"),
        (F.col("last_name"), "PERSON"), (F.lit("the  Company"), "ORGANISATION"), (F.concat(F.lit("Q"), F.col("two"), F.lit(" Bakers PLC")), "ORGANISATION")))])
    return parts(spark, d).select("doc_id", F.explode(F.when(F.col("doc_id") % 2 == 0, F.slice(rows, 1, 6)).otherwise(rows)).alias("m")).select("doc_id", "m.*")


@query("cl_resolve", f"""SELECT doc_id, entity_type, start, CASE WHEN start = 500 AND doc_id % 2 = 1 THEN NULL WHEN entity_type = 'PERSON' THEN lower(first_name || ' ' || last_name) WHEN start = 600 THEN 'q' || two || ' bakers plc' ELSE lower(stem) || ' limited' END AS key
FROM (SELECT *, unnest([0, 100, 200, 300, 400, 500, 600]) AS start FROM ({PARTS}) p) x, (VALUES (0, 'ORGANISATION'), (100, 'ORGANISATION'), (200, 'PERSON'), (300, 'PERSON'), (400, 'PERSON'), (500, 'ORGANISATION'), (600, 'ORGANISATION')) k(place, entity_type)
WHERE place = start AND (start < 600 OR doc_id % 2 = 1)""")
def _(spark, d):
    return linkage.resolve(linkage.mentions(variants(spark, d))).select("doc_id", "entity_type", "start", "key")


@query("cl_entities")
def _(spark, d):
    return linkage.entities(linkage.mentions(made_entities(spark, d)))


@query("cl_fuzzy")
def _(spark, d):
    return linkage.fuzzy_clusters(linkage.mentions(made_entities(spark, d)))


@query("cl_fuzzy_substring")
def _(spark, d):
    return linkage.fuzzy_clusters(linkage.mentions(made_entities(spark, d)), scorer="substring")


@query("fn_abbrev_pairs", f"SELECT doc_id, stem AS name, upper(array_to_string(list_transform(string_split(stem, ' '), lambda w: substring(w, 1, 1)), '')) AS abbreviation FROM ({PARTS}) p")
def _(spark, d):
    p = parts(spark, d)
    return linkage.abbreviation_pairs(p.select("doc_id", F.concat(F.lit("by "), "stem", F.lit(" ("), T.acronym(F.col("stem")), F.lit(") and (XX)")).alias("text")))


@query("sweep")
def _(spark, d):
    t = kyc(spark, d)
    return linkage.sweep(t.select("doc_id", "text"), saved(linkage.resolve(saved(linkage.mentions(S.dedup(flow.detections_a(t)))))))


# replacements

_K = "lower(first_name || ' ' || last_name)"
_S = lambda kind, key: f"'s|{kind}|' || {key}"
for _name, _spark, _sql in (
    ("gen_person", lambda: replace.person(F.lower(F.concat_ws(" ", "first_name", "last_name")), F.concat_ws(" ", "first_name", "last_name")), f"{pool(replace.FIRST, _S('first', _K))} || ' ' || {pool(replace.LAST, _S('last', _K))}"),
    ("gen_org", lambda: replace.organisation(F.col("org"), F.col("org")), f"CASE WHEN regexp_matches(org, '\\bCapital\\b') THEN {pool(replace.BANKS, _S('bank', 'org'))} ELSE {pool(replace.ORGS, _S('org', 'org'))} END || substring(org, length(stem) + 1)"),
    ("gen_address", lambda: replace.address(F.col("org"), F.concat(F.col("two"), F.lit(" Mill Lane, UK"))), f"two || ' ' || {pool(replace.STREETS, _S('street', 'org'))} || ', ' || {pool(replace.TOWNS, _S('town', 'org'))} || ' ZZ' || substring({sha_digits(_S('postcode', 'org'), 2)}, 1, 1) || ' ' || substring({sha_digits(_S('postcode', 'org'), 2)}, 2, 1) || 'ZZ, UK'"),
    ("gen_postcode", lambda: replace.postcode(F.col("org")), f"'ZZ' || substring({sha_digits(_S('postcode', 'org'), 2)}, 1, 1) || ' ' || substring({sha_digits(_S('postcode', 'org'), 2)}, 2, 1) || 'ZZ'"),
    ("gen_lei", lambda: replace.lei(F.col("org")), f"{sha_digits(_S('lei', 'org'), 18)} || lpad(CAST(98 - {mod97_sql(sha_digits(_S('lei', 'org'), 18) + " || '00'")} AS VARCHAR), 2, '0')"),
    ("gen_iban", lambda: replace.iban(F.col("org"), F.concat(F.lit("GB12ABCD"), F.col("two"), F.lit("3456"), F.col("number"))), f"'GB' || lpad(CAST(98 - {mod97_sql(sha_digits(_S('iban', 'org'), 18) + " || '161100'")} AS VARCHAR), 2, '0') || {sha_digits(_S('iban', 'org'), 18)}"),
    ("gen_bic", lambda: replace.bic(F.col("org"), F.lit("ABCDGB22XXX")), f"translate({sha_digits(_S('bic', 'org'), 4)}, '0123456789', 'QRSTUVWXYZ') || 'GB2LXXX'"),
    ("gen_sort", lambda: replace.like_digits(F.col("org"), F.concat("two", F.lit("-34-56")), "SORT_CODE"), f"substring({sha_digits(_S('SORT_CODE', 'org'), 6)}, 1, 2) || '-' || substring({sha_digits(_S('SORT_CODE', 'org'), 6)}, 3, 2) || '-' || substring({sha_digits(_S('SORT_CODE', 'org'), 6)}, 5, 2)"),
    ("gen_account", lambda: replace.like_digits(F.col("org"), F.col("number"), "BANK_ACCOUNT"), sha_digits(_S("BANK_ACCOUNT", "org"), 8)),
    ("gen_company", lambda: replace.like_digits(F.col("org"), F.concat(F.lit("SC"), F.substring("number", 3, 6)), "COMPANY_REG_NO"), f"'SC' || {sha_digits(_S('COMPANY_REG_NO', 'org'), 6)}"),
    ("gen_tax", lambda: replace.like_digits(F.col("org"), F.concat(F.lit("GB9"), F.col("number")), "TAX_ID"), f"'GB' || {sha_digits(_S('TAX_ID', 'org'), 9)}"),
    ("gen_email", lambda: replace.email(F.col("org"), F.concat_ws(" ", "first_name", "last_name"), F.col("stem")), "lower(first_name) || '.' || lower(last_name) || '@' || replace(lower(stem), ' ', '-') || '.example'"),
    ("gen_url", lambda: replace.url(F.col("org"), F.col("stem")), "'www.' || replace(lower(stem), ' ', '-') || '.example'"),
    ("gen_phone", lambda: replace.phone(F.col("org"), F.lit("+44 20")), f"'+44 20 7946 ' || {sha_digits(_S('phone', 'org'), 4)}"),
    ("gen_date", lambda: replace.date(F.col("org"), F.lit("2019-03-04")), f"CAST(2000 + CAST({sha_digits(_S('date', 'org'), 9)} AS INTEGER) % 25 AS VARCHAR) || '-' || lpad(CAST(CAST({sha_digits(_S('date', 'org'), 9)} AS INTEGER) % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(CAST({sha_digits(_S('date', 'org'), 9)} AS INTEGER) % 28 + 1 AS VARCHAR), 2, '0')"),
    ("gen_mask", lambda: replace.mask(F.lit("PERSON"), F.col("doc_id") % 7), "'[PERSON_' || lpad(CAST(doc_id % 7 AS VARCHAR), 3, '0') || ']'"),
    ("b_mint_location", lambda: replace._from(replace.LOCATIONS, F.concat(F.lit("s|loc|"), F.lower("nation"))), pool(replace.LOCATIONS, _S("loc", "lower(nation)"))),
):
    QUERIES[_name] = lambda spark, d, f=_spark: parts(spark, d).select("doc_id", f().alias("value"))
    ORACLES[_name] = f"SELECT doc_id, {_sql} AS value FROM ({PARTS}) p"


def dataflow(spark, d, mode="synthetic"):
    t = kyc(spark, d).select("doc_id", "text")
    return flow.anonymise(t, flow.detections_a(t), mode)


for _mode in ("synthetic", "mask", "hybrid"):
    QUERIES[f"gen_plan_{_mode}"] = lambda spark, d, m=_mode: dataflow(spark, d, m)["plan"]
QUERIES["pipeline_a"] = lambda spark, d: dataflow(spark, d)["output"]
QUERIES["val_report"] = lambda spark, d: dataflow(spark, d)["validation"]


@query("pipeline_b")
def _(spark, d):
    t = kyc(spark, d).select("doc_id", "text")
    return flow.anonymise(t, flow.detections_b(t, SEEDS), variant="B")["output"]


@query("flagship")
def _(spark, d):
    return flow.flagship(spark, d)


@query("apply_text", f"SELECT doc_id, replace(text, email, 'x@mail.example') AS text, 1 AS n_applied FROM {KYC}")
def _(spark, d):
    t = kyc(spark, d).select("doc_id", "text")
    return S.apply_edits(t, scan(t, [BY_NAME["re_email"]]).select("doc_id", "start", "end", F.lit("x@mail.example").alias("replacement")))


# stores

def _hashed(spark, d, where):
    return parts(spark, d).where(where).select(F.lit("ORG").alias("entity_type"), T.keyed_hash(b"veilwork", "project", F.col("org")).alias("original_hash"), F.col("nation").alias("replacement"))


@query("store_put", f"SELECT 'ORG' AS entity_type, org AS original, min(nation) AS replacement FROM ({PARTS}) p WHERE doc_id % 2 = 1 AND org NOT IN (SELECT org FROM ({PARTS}) q WHERE doc_id % 10 = 0) GROUP BY org")
def _(spark, d):
    names = parts(spark, d).select(F.col("org").alias("original"), T.keyed_hash(b"veilwork", "project", F.col("org")).alias("original_hash")).distinct()
    fresh = replace.new_rows(_hashed(spark, d, "doc_id % 10 = 0"), _hashed(spark, d, "doc_id % 2 = 1"))
    return fresh.join(names, "original_hash").select("entity_type", "original", "replacement")


# validation and reports

@query("val_leak", f"SELECT DISTINCT doc_id, stem AS original FROM {KYC} WHERE length(stem) >= 3 AND contains(lower(text), lower(stem))")
def _(spark, d):
    t = kyc(spark, d)
    return validate.leaks(t, t.select("doc_id", F.col("stem").alias("representative")))


@query("val_consistency", f"SELECT doc_id, 'e' AS entity_id FROM {KYC} WHERE NOT contains(lower(text), lower(nation))")
def _(spark, d):
    t = kyc(spark, d)
    return validate.missing(t, t.select("doc_id", F.lit("e").alias("entity_id"), F.col("nation").alias("replacement")))


@query("val_unique", f"SELECT 'ORG' AS entity_type, org AS original_hash, count(DISTINCT lower(nation)) AS n FROM ({PARTS}) p GROUP BY org HAVING count(DISTINCT lower(nation)) > 1")
def _(spark, d):
    return validate.not_unique(parts(spark, d).select(F.lit("ORG").alias("entity_type"), F.col("org").alias("original_hash"), F.col("nation").alias("replacement")))


@query("val_layout", f"SELECT doc_id, CAST(1 - 1.0 / (length(text) - length(replace(text, chr(10), ''))) AS DOUBLE) AS value FROM {KYC}")
def _(spark, d):
    return kyc(spark, d).select("doc_id", validate.layout(F.col("text"), F.regexp_replace("text", r"\n(?=LEI)", " ")).alias("value"))


@query("val_quality", f"SELECT doc_id, round(CAST(greatest(0, least(1, 1 - CASE WHEN doc_id % 5 > 0 THEN least(0.6, (doc_id % 5) * 0.1 + 0.2) ELSE 0 END - least(0.4, (doc_id % 3) * 0.1) - least(0.3, (doc_id % 4) * 0.05) - (1 - 0.5) * 0.2)) AS DOUBLE), 6) AS value FROM ({PARTS}) p")
def _(spark, d):
    return parts(spark, d).select("doc_id", validate.quality(F.col("doc_id") % 5, F.col("doc_id") % 3, F.col("doc_id") % 4, F.lit(0.5)).alias("value"))


@query("agg_all", f"WITH s AS ({SOME_SQL}) SELECT detector, entity_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM s GROUP BY GROUPING SETS ((detector), (entity_type), ())")
def _(spark, d):
    return validate.counts(some(spark, d))


@query("agg_summary", f"WITH s AS ({SOME_SQL}) SELECT doc_id, count(*) AS n_detections, count(DISTINCT entity_type) AS n_types, string_agg(DISTINCT entity_type, '|' ORDER BY entity_type) AS types FROM s GROUP BY doc_id")
def _(spark, d):
    return validate.summary(some(spark, d))


@query("agg_detector", f"WITH s AS ({SOME_SQL}) SELECT detector, count(*) AS n FROM s GROUP BY detector")
def _(spark, d):
    return some(spark, d).groupBy("detector").agg(F.count("*").alias("n"))


@query("rep_redaction")
def _(spark, d):
    out = dataflow(spark, d)
    return validate.redaction_map(out["entities"], out["plan"])


@query("rep_audit")
def _(spark, d):
    t = kyc(spark, d).select("doc_id", "text")
    found = saved(flow.detections_a(t))
    return validate.audit(t, found, flow.anonymise(t, found)["validation"])


# quality scans

_BLOCK = ", ".join(map(_sql_text, P.NAME_BLOCK))


@query("qa_person", f"SELECT doc_id, start, text, 'medium' AS severity, CAST(0.6 AS DOUBLE) AS confidence FROM ({span_sql(KYC, P.NAME)}) x WHERE split_part(text, ' ', 1) NOT IN ({_BLOCK})")
def _(spark, d):
    return detect.qa_names(kyc(spark, d))


@query("qa_org", f"SELECT doc_id, CAST(length('Client Name: ' || stem) + 1 AS INTEGER) AS start, 'Name: ' || org AS text, 'high' AS severity, CAST(0.75 AS DOUBLE) AS confidence FROM {KYC} WHERE false UNION ALL SELECT doc_id, CAST(length('Client Name: ' || stem) + 1 AS INTEGER), org, 'high', 0.75 FROM {KYC}")
def _(spark, d):
    return detect.qa_orgs(kyc(spark, d))


_ABB = ", ".join(map(_sql_text, P.ABBREVIATION_BLOCK))


@query("qa_abbrev", f"SELECT DISTINCT doc_id, text, 'low' AS severity, CAST(0.4 AS DOUBLE) AS confidence FROM ({span_sql(KYC, P.ABBREVIATION)}) x WHERE text NOT IN ({_ABB})")
def _(spark, d):
    return detect.qa_abbreviations(kyc(spark, d))


@query("qa_residual")
def _(spark, d):
    return detect.qa_residual(dataflow(spark, d)["output"])


# visuals: boxes made from order lines on a page of 600 by 800

BOXES = "SELECT l_orderkey AS page, CAST(l_quantity * 10 AS DOUBLE) AS x0, CAST(l_linenumber * 100 AS DOUBLE) AS y0, CAST(l_quantity * 10 + l_discount * 1000 + 5 AS DOUBLE) AS x1, CAST(l_linenumber * 100 + l_tax * 500 + 5 AS DOUBLE) AS y1 FROM lineitem"


def boxes(spark, d):
    views(spark, d, "lineitem")
    return spark.sql(BOXES).withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))


@query("vis_classify", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN y1 <= 120 AND x1 - x0 > (y1 - y0) * 3 THEN 'logo' WHEN x0 >= 300 AND y0 >= 560 AND x1 - x0 < 240 AND y1 - y0 < 120 THEN 'signature' ELSE 'image' END AS kind FROM ({BOXES}) b) c GROUP BY kind")
def _(spark, d):
    k = validate.classify_visual(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")])
    return boxes(spark, d).select(k.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("vis_block", f"SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM ({BOXES}) b GROUP BY page HAVING count(*) >= 5 AND (max(x1) - min(x0)) * (max(y1) - min(y0)) >= 600.0 * 800.0 * 0.3")
def _(spark, d):
    return validate.graphic_blocks(boxes(spark, d), least=5)
