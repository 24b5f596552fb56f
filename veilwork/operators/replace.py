"""Deterministic, format-preserving replacements.

Every replacement is a pure function of seed, type and key, so no order and no
shared state decides it: the same entity gets the same value in every document
and on every executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.checks import check_digits

FIRST = ("Alva", "Bram", "Cleo", "Dane", "Edda", "Finn", "Greta", "Hugo", "Ines", "Jorn", "Kaia", "Levi")
LAST = ("Ashdown", "Birk", "Corvin", "Dale", "Elmore", "Fenwick", "Garth", "Holm", "Ives", "Jarrow", "Kestrel", "Lorne")
ORGS = ("Amberfall", "Brightwater", "Coldharbour", "Dunmore", "Eastvale", "Fernhill", "Greyfriars", "Hollowell", "Ironbridge", "Juniper")
BANKS = ("Arden Bank", "Beacon Bank", "Crown Vale Bank", "Delta Trust Bank")
STREETS, TOWNS = ("Alder Road", "Birch Street", "Cedar Avenue", "Elm Close"), ("Ashford", "Brinton", "Carwell", "Denby")
LOCATIONS = ("Norvale", "Eastmarch", "Westholm", "Sundale")
MASK_TYPES = ("PERSON", "ORGANISATION", "ADDRESS")


def _seeded(seed: str, kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{seed}|{kind}|"), key)


def _from(pool: tuple[str, ...], s: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), T.pick(s, len(pool)) + 1)


def digits(s: Column, n: int) -> Column:
    """n digits from the hash (n up to 60)."""
    h = F.sha2(s.cast("binary"), 256)
    return F.substring(F.translate(h, "abcdef", "012345"), 1, n)


def person(key: Column, original: Column, seed: str = "s") -> Column:
    last = _from(LAST, _seeded(seed, "last", key))
    return F.when(F.size(T.tokens(original)) >= 2, F.concat(_from(FIRST, _seeded(seed, "first", key)), F.lit(" "), last)).otherwise(last)


def organisation(key: Column, original: Column, seed: str = "s") -> Column:
    """A stem of our own with the original's legal suffix; banks stay banks."""
    _, suffix = T.split_suffix(original)
    stem = F.when(T.bank_like(original), _from(BANKS, _seeded(seed, "bank", key))).otherwise(_from(ORGS, _seeded(seed, "org", key)))
    return F.when(suffix == "", stem).otherwise(F.concat(stem, F.lit(" "), suffix))


def postcode(key: Column, seed: str = "s") -> Column:
    n = digits(_seeded(seed, "postcode", key), 2)
    return F.concat(F.lit("ZZ"), F.substring(n, 1, 1), F.lit(" "), F.substring(n, 2, 1), F.lit("ZZ"))


def address(key: Column, original: Column, seed: str = "s") -> Column:
    """Keeps a leading house number."""
    house = F.regexp_extract(original, r"^\s*(\d+[A-Za-z]?)\b", 1)
    rest = F.concat(_from(STREETS, _seeded(seed, "street", key)), F.lit(", "), _from(TOWNS, _seeded(seed, "town", key)), F.lit(" "), postcode(key, seed))
    out = F.when(house == "", rest).otherwise(F.concat(house, F.lit(" "), rest))
    return F.when(original.rlike(r"(?i)\b(UK|United Kingdom)\b"), F.concat(out, F.lit(", UK"))).otherwise(out)


def iban(key: Column, original: Column, seed: str = "s") -> Column:
    """Country and length kept, check digits valid."""
    bare = F.regexp_replace(original, " ", "")
    country, n = F.upper(F.substring(bare, 1, 2)), F.length(bare)
    body = F.substring(digits(_seeded(seed, "iban", key), 60), F.lit(1), n - 4)
    return F.concat(country, check_digits(F.concat(body, country)), body)


def lei(key: Column, seed: str = "s") -> Column:
    body = digits(_seeded(seed, "lei", key), 18)
    return F.concat(body, check_digits(body))


def bic(key: Column, original: Column, seed: str = "s") -> Column:
    letters = F.translate(digits(_seeded(seed, "bic", key), 4), "0123456789", "QRSTUVWXYZ")
    return F.concat(letters, F.lit("GB2L"), F.when(F.length(original) >= 11, F.lit("XXX")).otherwise(F.lit("")))


def like_digits(key: Column, original: Column, kind: str, seed: str = "s") -> Column:
    """Every digit replaced, all else kept, so lengths and separators stay."""
    d = digits(_seeded(seed, kind, key), 60)
    chars = F.split(original, "")
    return F.aggregate(chars, F.struct(F.lit("").alias("o"), F.lit(0).alias("i")), lambda a, c: F.when(
        c.between("0", "9"), F.struct(F.concat(a["o"], F.substring(d, a["i"] % 60 + 1, F.lit(1))).alias("o"), (a["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(a["o"], c).alias("o"), a["i"].alias("i"))), lambda a: a["o"])


def email(key: Column, owner: Column, org: Column, seed: str = "s") -> Column:
    """At a reserved domain; coupled to a person and an organisation if given."""
    local = F.when(owner.isNotNull(), F.regexp_replace(T.slug(owner), "-", ".")).otherwise(F.concat(F.lit("user"), digits(_seeded(seed, "email", key), 6)))
    return F.concat(local, F.lit("@"), F.coalesce(F.concat(T.slug(org), F.lit(".example")), F.lit("mail.example")))


def url(key: Column, org: Column, seed: str = "s") -> Column:
    return F.concat(F.lit("www."), F.coalesce(T.slug(org), F.concat(F.lit("site"), digits(_seeded(seed, "url", key), 4))), F.lit(".example"))


def phone(key: Column, original: Column, seed: str = "s") -> Column:
    n = digits(_seeded(seed, "phone", key), 4)
    return F.when(original.startswith("+"), F.concat(F.lit("+44 20 7946 "), n)).otherwise(F.concat(F.lit("020 7946 "), n))


def date(key: Column, original: Column, birth: bool = False, seed: str = "s") -> Column:
    """Another day in the surface format of the original."""
    d = digits(_seeded(seed, "date", key), 9).cast("int")
    y = (F.lit(1955) + d % 41 if birth else F.lit(2000) + d % 25).cast("string")
    m, day = F.lpad((d % 12 + 1).cast("string"), 2, "0"), F.lpad((d % 28 + 1).cast("string"), 2, "0")
    sep = F.coalesce(F.nullif(F.regexp_extract(original, r"\d([/.-])\d", 1), F.lit("")), F.lit("/"))
    month = F.element_at(F.array(*[F.lit(x) for x in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")]), d % 12 + 1)
    return (F.when(original.rlike(r"^\d{4}"), F.concat(y, sep, m, sep, day)).when(original.rlike("[A-Za-z]"), F.concat_ws(" ", (d % 28 + 1).cast("string"), month, y))
            .otherwise(F.concat(day, sep, m, sep, y)))


def mask(kind: Column, number: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("_"), F.lpad(number.cast("string"), 3, "0"), F.lit("]"))


def synthetic(kind: Column, key: Column, original: Column, owner: Column, org: Column, seed: str = "s") -> Column:
    out = F.when(kind == "PERSON", person(key, original, seed)).when(kind == "ORGANISATION", organisation(key, original, seed)).when(kind == "ADDRESS", address(key, original, seed))
    out = out.when(kind == "POSTCODE", postcode(key, seed)).when(kind == "IBAN", iban(key, original, seed)).when(kind == "LEI", lei(key, seed)).when(kind == "SWIFT_BIC", bic(key, original, seed))
    out = out.when(kind == "EMAIL", email(key, owner, org, seed)).when(kind == "URL", url(key, org, seed)).when(kind == "PHONE", phone(key, original, seed)).when(kind == "GENERIC_DATE", date(key, original, seed=seed))
    for k in ("SORT_CODE", "BANK_ACCOUNT", "COMPANY_REG_NO", "TAX_ID", "NATIONAL_ID", "PASSPORT"):
        out = out.when(kind == k, like_digits(key, original, k, seed))
    return out


def plan(ents: DataFrame, mode: str = "synthetic", seed: str = "s", key: bytes = b"veilwork", store: DataFrame | None = None) -> DataFrame:
    """One replacement per entity.  mode: mask, hybrid (masks names, makes up
    identifiers) or synthetic.  A row of `store` (entity_type, original_hash,
    replacement) wins over a new value."""
    # the first person and organisation of each document, by one window instead of two joins
    first = lambda kind: F.min(F.when(F.col("entity_type") == kind, F.struct("first_start", "key", "representative"))).over(Window.partitionBy("doc_id"))
    e = ents.withColumns({"p": first("PERSON"), "o": first("ORGANISATION")})
    owner, org = person(F.col("p.key"), F.col("p.representative"), seed), T.split_suffix(organisation(F.col("o.key"), F.col("o.representative"), seed))[0]
    coupled = F.col("entity_type").isin("EMAIL", "URL") & F.col("doc_id").isNotNull()
    e = e.withColumns({"owner": F.when(coupled & F.col("p").isNotNull(), owner), "org": F.when(coupled & F.col("o").isNotNull(), org)}).withColumn("original_hash", T.keyed_hash(key, "project", F.concat_ws("|", "entity_type", "key")))
    kind, masked = F.col("entity_type"), mask(F.col("entity_type"), F.col("number"))
    made = F.coalesce(synthetic(kind, F.col("key"), F.col("representative"), F.col("owner"), F.col("org"), seed), masked)
    value = {"mask": masked, "hybrid": F.when(kind.isin(*MASK_TYPES), masked).otherwise(made), "synthetic": made}[mode]
    if store is not None:
        e = e.join(store.select("entity_type", "original_hash", F.col("replacement").alias("stored")), ["entity_type", "original_hash"], "left")
        value = F.coalesce(F.col("stored"), value)
    aliases = [c for c in ("aliases",) if c in ents.columns]
    e = e.withColumn("made", value)  # a column, as its case is looked at several times
    return e.select("doc_id", "entity_id", "entity_type", "key", "representative", *aliases, "n_mentions", "original_hash", T.like_case(F.col("made"), F.col("representative")).alias("replacement"), F.lit(mode).alias("strategy"))


def new_rows(store: DataFrame, replacements: DataFrame) -> DataFrame:
    """What a store has to append: hashes it does not hold, one row each."""
    fresh = replacements.join(store, ["entity_type", "original_hash"], "left_anti")
    return fresh.groupBy("entity_type", "original_hash").agg(F.min("replacement").alias("replacement"))
