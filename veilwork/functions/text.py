"""Scalar functions: normal forms, name and organisation parts, keyed hashes.

Two variants of the normal form exist: A (document anonymisation) and B (page
cleaning), as their entity types and suffix maps differ.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes and their canonical spelling (fixed values).
SUFFIX_A = {
    "ltd": "limited", "limited": "limited", "co": "company", "company": "company", "corp": "corporation", "corporation": "corporation",
    "inc": "incorporated", "incorporated": "incorporated", "plc": "plc", "llp": "llp", "lp": "lp", "llc": "llc",
    "gmbh": "gmbh", "ag": "ag", "sarl": "sarl", "sa": "sa", "nv": "nv", "bv": "bv",
}
SUFFIX_B = SUFFIX_A | {"bank": "bank", "group": "group", "holdings": "holdings"}
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "dame", "lord", "lady")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")


def _mapped(t: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, t), t)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s&-]", " ")), r"\s+"), lambda t: t != "")


def normalise(c: Column, kind: Column, variant: str = "A") -> Column:
    """Comparison key of a value.  NFC/NFKC is left to `unicode_form`, which
    only non-ASCII values need."""
    c = F.trim(c)
    person = F.array_join(F.filter(_words(c), lambda t: ~t.isin(*TITLES)), " ")
    org = F.array_join(F.transform(_words(c), lambda t: _mapped(t, SUFFIX_A if variant == "A" else SUFFIX_B)), " ")
    out = (F.when(kind == "PERSON", person).when(kind.isin("ORGANISATION", "ORG"), org).when(kind == "EMAIL", F.lower(c))
           .when(kind == "PHONE", F.regexp_replace(c, r"[^0-9+]", "")).when(kind.isin("GENERIC_DATE", "DATE_OF_BIRTH"), F.regexp_replace(c, r"[/. ]", "-")))
    if variant == "A":
        out = out.when(kind == "URL", F.regexp_replace(F.regexp_replace(F.lower(c), r"^(https?://)?(www\.)?", ""), r"/+$", "")).when(kind == "ADDRESS", F.array_join(_words(c), " "))
    else:
        out = out.when(kind == "LOCATION", F.lower(c))
    return out.otherwise(F.lower(F.regexp_replace(c, r"[ \-./]", "")))


def canonicalise(c: Column, kind: Column) -> Column:
    """The older key: lower case, without punctuation for everything but names."""
    low = F.lower(F.trim(c))
    return F.when(kind.isin("PERSON", "ORGANISATION", "ADDRESS"), F.regexp_replace(F.regexp_replace(low, r"[.,]", ""), r"\s+", " ")).otherwise(F.regexp_replace(low, r"[ .\-/]", ""))


def org_stem(c: Column, variant: str = "A") -> Column:
    """Normal form without its run of legal suffixes at the end."""
    names = "|".join(sorted(set((SUFFIX_A if variant == "A" else SUFFIX_B).values())))
    key = normalise(c, F.lit("ORG"), variant)
    return F.regexp_replace(key, rf"( ({names}))+$", "")


def acronym(c: Column) -> Column:
    """Upper-case initials of the words that are no legal suffix."""
    keep = F.filter(_words(c), lambda t: ~t.isin(*SUFFIX_A))
    return F.upper(F.array_join(F.transform(keep, lambda t: F.substring(t, 1, 1)), ""))


def initial_form(c: Column) -> Column:
    """Initials of all words but the last, which stays whole."""
    t = tokens(F.lower(c))
    heads = F.transform(F.slice(t, F.lit(1), F.greatest(F.lit(0), F.size(t) - 1)), lambda w: F.substring(w, 1, 1))
    return F.when(F.size(t) >= 2, F.array_join(F.array_append(heads, F.try_element_at(t, F.lit(-1))), " "))


def first_name(c: Column) -> Column:
    return F.try_element_at(tokens(c), F.lit(1))


def last_name(c: Column) -> Column:
    return F.try_element_at(tokens(c), F.lit(-1))


def email_local(c: Column) -> Column:
    return F.lower(F.split_part(c, F.lit("@"), F.lit(1)))


def email_domain(c: Column) -> Column:
    return F.lower(F.split_part(c, F.lit("@"), F.lit(2)))


def url_domain(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"^(?:https?://)?(?:www\.)?([^/:?#]+)", 1)


def slug(c: Column) -> Column:
    out = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(out == "", F.lit("user")).otherwise(out)


def like_case(value: Column, original: Column) -> Column:
    """The value in the original's case if that is all upper or all lower."""
    letter = original.rlike(r"\p{L}")
    return F.when(letter & (original == F.upper(original)), F.upper(value)).when(letter & (original == F.lower(original)), F.lower(value)).otherwise(value)


#: Phrases that stand for a party without naming it (fixed values).
GENERIC_ORG = ("the client", "the company", "the firm", "the entity", "the corporation", "the borrower", "the issuer", "client", "company")
GENERIC_PERSON = ("the director", "the signatory", "the customer", "the contact", "the applicant", "the beneficiary")


def is_generic(c: Column, kind: Column | None = None) -> Column:
    """Whether a phrase of the kind only stands for a party; of either kind where none is given."""
    phrase = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    if kind is None:
        return phrase.isin(*GENERIC_ORG, *GENERIC_PERSON)
    org = kind.isin("ORGANISATION", "ORG") & phrase.isin(*GENERIC_ORG)
    return org | ((kind == "PERSON") & phrase.isin(*GENERIC_PERSON))


def keyed_hash(key: bytes, scope: str, value: Column) -> Column:
    """HMAC-SHA256 of scope, a 1 byte and the value, in hexadecimal."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    message = F.concat(F.lit(scope.encode() + b"\x01"), value.cast("binary"))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def pick(c: Column, n: int) -> Column:
    """A whole number below n from the value's SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int")


def entity_id(kind: Column, number: Column, key: Column) -> Column:
    """TYPE_nnn_ and eight digits of the key's hash."""
    return F.concat(kind, F.lit("_"), F.lpad(number.cast("string"), 3, "0"), F.lit("_"), F.substring(F.sha1(key.cast("binary")), 1, 8))


def split_suffix(c: Column) -> tuple[Column, Column]:
    """(stem, legal suffix as written, else empty)."""
    names = "|".join(["Limited", "Ltd", "PLC", "LLP", "LLC", "Incorporated", "Inc", "GmbH", "AG", "SA", "NV", "BV"])
    pattern = rf"(?i)^(.*?)[ ,]+({names})\.?$"
    suffix = F.regexp_extract(c, pattern, 2)
    return F.when(suffix == "", c).otherwise(F.regexp_extract(c, pattern, 1)), suffix


def bank_like(c: Column) -> Column:
    return c.rlike(r"(?i)\b(bank|banking|financial|capital|credit)\b")


def is_abbreviation(short: Column, name: Column) -> Column:
    """The initials of a name, without small words, start with it."""
    words = F.filter(_words(name), lambda t: ~t.isin("of", "the", "and", "for", "&"))
    return F.upper(F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")).startswith(F.upper(short))


def org_score(a: Column, b: Column) -> Column:
    """100 for equal stems, 92 if one holds the other, 90 for an acronym, else 0."""
    x, y = org_stem(a), org_stem(b)
    inside = (F.length(x) > 0) & (F.length(y) > 0) & (x.contains(y) | y.contains(x))
    short = ((F.length(acronym(b)) >= 3) & (F.upper(F.trim(a)) == acronym(b))) | ((F.length(acronym(a)) >= 3) & (F.upper(F.trim(b)) == acronym(a)))
    return F.when(x == y, 100).when(inside, 92).when(short, 90).otherwise(0)


def person_score(a: Column, b: Column) -> Column:
    """95 for one initial form, 90 for a subset of tokens, 80 for a surname, else 0."""
    x, y = tokens(F.lower(a)), tokens(F.lower(b))
    same = F.coalesce(initial_form(a) == initial_form(b), F.lit(False))
    subset = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    filled = (F.size(x) > 0) & (F.size(y) > 0)
    alone = (F.size(x) == 1) & (F.try_element_at(x, F.lit(1)) == F.try_element_at(y, F.lit(-1)))
    return F.when(~filled, 0).when(alone, 80).when(same, 95).when(subset, 90).otherwise(0)


def unicode_form(c: Column, form: str = "NFKC") -> Column:
    """Unicode normal form of non-ASCII values, by the ICU library that Spark
    brings along: no value leaves the JVM and memory holds one at a time."""
    method = {"NFC": ("compose", False), "NFKC": ("compose", True), "NFD": ("decompose", False), "NFKD": ("decompose", True)}[form]
    norm = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method[0]), c, F.lit(method[1]))
    return F.when(c.rlike(r"[^\x00-\x7F]"), norm).otherwise(c)
