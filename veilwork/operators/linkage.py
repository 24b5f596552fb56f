"""Record linkage of mentions within a document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.spans import matches
from ..runtime import ship

MENTION = ["doc_id", "start", "end", "text", "entity_type", "confidence", "detector"]


def mentions(detections: DataFrame, variant: str = "A") -> DataFrame:
    """Detections with their key, and whether they only stand for a party."""
    return detections.withColumn("key", T.normalise(F.col("text"), F.col("entity_type"), variant)).withColumn("is_alias", T.is_generic(F.col("text"), F.col("entity_type")))


def exact_clusters(m: DataFrame, aliases: bool = False) -> DataFrame:
    """One row per (document, type, key): representative, mentions, span of
    offsets.  With `aliases` the mentions that only stand for a party count too
    (they represent it where nothing else does) and all surfaces come as an array."""
    best = F.struct((~F.col("is_alias")).alias("named"), F.col("confidence"), F.length("text").alias("n"), -F.col("start"))
    surfaces = F.array_sort(F.collect_set("text"))
    return m.where("key <> ''" if aliases else "not is_alias and key <> ''").groupBy("doc_id", "entity_type", "key").agg(
        F.max_by("text", best).alias("representative"), F.count("*").alias("n_mentions"), F.min("start").alias("first_start"), F.max("confidence").alias("confidence"),
        F.array_join(surfaces, "|").alias("surfaces"), *([surfaces.alias("aliases")] if aliases else []))


def entities(m: DataFrame, aliases: bool = False) -> DataFrame:
    """Clusters numbered within document and type by their first mention."""
    n = F.row_number().over(Window.partitionBy("doc_id", "entity_type").orderBy("first_start", "key"))
    return exact_clusters(m, aliases).withColumn("number", n).withColumn("entity_id", T.entity_id(F.col("entity_type"), F.col("number"), F.col("key")))


def generic_aliases(m: DataFrame, ents: DataFrame, kind: str = "ORGANISATION") -> DataFrame:
    """Generic phrases: merged where one entity of the kind exists, ambiguous
    where several do, new where none does."""
    per = ents.where(F.col("entity_type") == kind).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("only"))
    return m.where("is_alias").join(per, "doc_id", "left").select("doc_id", "start", "text", F.when(F.col("n") == 1, F.lit("merged")).when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit("new")).alias("outcome"), F.when(F.col("n") == 1, F.col("only")).alias("entity_id"))


def surname_links(ents: DataFrame) -> DataFrame:
    """Single-word persons that exactly one longer name of the document ends with."""
    p = ents.where("entity_type = 'PERSON'").select("doc_id", "key")
    single = p.where(~F.col("key").contains(" "))
    full = p.where(F.col("key").contains(" ")).select("doc_id", F.col("key").alias("owner"), F.substring_index("key", " ", -1).alias("key"))
    owners = full.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n = 1")
    return single.join(owners, ["doc_id", "key"]).select("doc_id", "key", "owner")


def abbreviation_links(ents: DataFrame) -> DataFrame:
    """Organisations that are the initials of exactly one other of the document."""
    o = ents.where("entity_type = 'ORGANISATION'").select("doc_id", "key", "representative")
    short = o.where(F.col("representative").rlike("^[A-Z]{2,6}$")).select("doc_id", F.col("representative").alias("abbreviation"))
    full = o.where(F.col("key").contains(" ")).select("doc_id", F.col("key").alias("owner"), F.col("representative").alias("name"))
    j = short.join(full, "doc_id").where(T.is_abbreviation(F.col("abbreviation"), F.col("name")))
    return j.groupBy("doc_id", "abbreviation").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n = 1").drop("n")


def abbreviation_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`Full Name (ABBR)` where the initials agree."""
    r = r"((?:[A-Z][\w&'-]+ ){1,6})\(([A-Z]{2,6})\)"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text_col), F.lit(r), F.lit(1)).alias("name"), F.regexp_extract_all(F.col(text_col), F.lit(r), F.lit(2)).alias("abbreviation"))
    e = docs.select(id_col, F.explode(pairs).alias("p")).select(id_col, F.trim("p.name").alias("name"), "p.abbreviation")
    return e.where(T.is_abbreviation(F.col("abbreviation"), F.col("name")))


def _domain_links(ents: DataFrame, kind: str, domain, name: str) -> DataFrame:
    site = ents.where(F.col("entity_type") == kind).select("doc_id", F.col("key").alias(name), domain.alias("domain"))
    org = ents.where("entity_type = 'ORGANISATION'").select("doc_id", F.col("key").alias("org"), F.explode(F.split(T.org_stem(F.col("key")), " ")).alias("word")).where(F.length("word") > 2)
    # the last label of a domain is no part of a name
    held = F.regexp_replace("domain", r"\.[a-z]{2,}$", "").contains(F.col("word"))
    return site.join(org, "doc_id").where(held).select("doc_id", name, "org").distinct()


def email_owner_links(ents: DataFrame) -> DataFrame:
    """E-mail addresses whose domain holds a word of an organisation's stem."""
    return _domain_links(ents, "EMAIL", T.email_domain(F.col("key")), "email")


def url_owner_links(ents: DataFrame) -> DataFrame:
    """URLs whose domain holds a word of an organisation's stem."""
    return _domain_links(ents, "URL", T.url_domain(F.col("key")), "url")


def email_person_links(ents: DataFrame) -> DataFrame:
    """E-mail addresses whose local part holds a person's last name."""
    mail = ents.where("entity_type = 'EMAIL'").select("doc_id", F.col("key").alias("email"), F.translate(T.email_local(F.col("key")), "._-", "   ").alias("local"))
    person = ents.where("entity_type = 'PERSON'").select("doc_id", F.col("key").alias("person"), T.last_name(F.col("key")).alias("last"))
    return mail.join(person, "doc_id").where((F.length("last") > 0) & F.col("local").contains(F.col("last"))).select("doc_id", "email", "person").distinct()


def related(ents: DataFrame) -> DataFrame:
    """Per entity the sorted ids of the entities it is linked with: e-mail
    addresses and the persons whose last name they hold, both ways."""
    ids = ents.select("doc_id", "entity_type", "key", "entity_id")
    of = lambda kind, name, as_: ids.where(F.col("entity_type") == kind).select("doc_id", F.col("key").alias(name), F.col("entity_id").alias(as_))
    pairs = email_person_links(ents).join(of("EMAIL", "email", "e"), ["doc_id", "email"]).join(of("PERSON", "person", "p"), ["doc_id", "person"])
    both = pairs.select("doc_id", F.explode(F.array(F.struct(F.col("e").alias("entity_id"), F.col("p").alias("other")), F.struct(F.col("p").alias("entity_id"), F.col("e").alias("other")))).alias("x"))
    return both.groupBy("doc_id", "x.entity_id").agg(F.array_join(F.array_sort(F.collect_set("x.other")), "|").alias("related"))


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best indel ratio of the common words with either side's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, dx, dy = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not dx or not dy):
        return 100.0
    s1, s2 = f"{both} {dx}".strip(), f"{both} {dy}".strip()
    return max(_indel(s1, s2), _indel(both, s1) if both else 0.0, _indel(both, s2) if both else 0.0)


def _indel(a: str, b: str) -> float:
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
    total = len(a) + len(b)
    return 100.0 * 2 * row[-1] / total if total else 100.0


def substring_score(a: str, b: str) -> float:
    return 100.0 if a == b else 90.0 if a and b and (a in b or b in a) else 0.0


SCORERS = {"token_set": token_set_ratio, "substring": substring_score}


def _stem(key: str) -> str:
    words = key.split()
    while words and words[-1] in LEGAL:
        words.pop()
    return " ".join(words)


def _org_rule(a: str, b: str) -> int:
    """100 for one stem, 92 for a stem inside the other, 90 for the known name's initials."""
    x, y = _stem(a), _stem(b)
    if not x or not y:
        return 0
    if x == y:
        return 100
    if x in y or y in x:
        return 92
    initials = "".join(w[0] for w in b.split() if w not in LEGAL).upper()
    return 90 if len(initials) >= 3 and a.upper() == initials else 0


def _person_rule(a: str, b: str) -> int:
    """80 for the bare last name, 95 for one form with initials, 90 for a subset of the words."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0
    if x == y[-1:]:
        return 80
    if [w[0] for w in x[:-1]] + x[-1:] == [w[0] for w in y[:-1]] + y[-1:]:
        return 95
    return 90 if set(x) <= set(y) or set(y) <= set(x) else 0


LEGAL = frozenset(T.SUFFIX_A.values())
RULES = {"ORGANISATION": _org_rule, "PERSON": _person_rule}
FUZZY = ("PERSON", "ORGANISATION", "ADDRESS")


def match_score(kind: str, a: str, b: str, scorer: str = "token_set") -> int:
    """How well a new key fits a known one, 0 to 100."""
    rule = RULES[kind](a, b) if kind in RULES else 0
    return rule if rule == 100 else max(rule, int(SCORERS[scorer](a, b)))


def first_fit(kind: str, keys: list[str], threshold: int = 88, scorer: str = "token_set") -> list[tuple[int, bool]]:
    """(cluster, ambiguous) of each of a document's different keys, in the order
    of their first mentions.  A key joins the one cluster that reaches the
    threshold; where several do it is ambiguous and opens its own."""
    clusters: list[list[str]] = []
    out = []
    for key in keys:
        fits = [i for i, c in enumerate(clusters) if any(match_score(kind, key, k, scorer) >= threshold for k in c)]
        if len(fits) != 1:
            out.append((len(clusters), len(fits) > 1))
            clusters.append([key])
        else:
            out.append((fits[0], False))
            clusters[fits[0]].append(key)
    return out


def merged_keys(m: DataFrame, threshold: int = 88, scorer: str = "token_set", kinds=FUZZY) -> DataFrame:
    """(doc_id, entity_type, key, owner, cluster, ambiguous): the different keys
    of a document, each with its cluster's longest key.  Only lists of two or
    more keys leave the JVM, and never a text."""
    ship(m.sparkSession)
    names = m.where(F.col("entity_type").isin(*kinds) & ~F.col("is_alias") & (F.col("key") != "")).groupBy("doc_id", "entity_type", "key").agg(F.min(F.struct("start", -F.col("end"))).alias("at"))
    lists = names.groupBy("doc_id", "entity_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("ks"))
    schema = f"doc_id {m.schema['doc_id'].dataType.simpleString()}, entity_type string, key string, owner string, cluster int, ambiguous boolean"

    def run(batches):
        for pdf in batches:
            rows = []
            for d, kind, ks in zip(pdf["doc_id"], pdf["entity_type"], pdf["ks"], strict=True):
                keys = list(ks)
                got = first_fit(kind, keys, threshold, scorer)
                owner: dict[int, str] = {}
                for key, (c, _) in zip(keys, got, strict=True):
                    owner[c] = min(owner.get(c, key), key, key=lambda k: (-len(k), k))
                rows += [(d, kind, key, owner[c], c + 1, doubt) for key, (c, doubt) in zip(keys, got, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "entity_type", "key", "owner", "cluster", "ambiguous"])

    alone = lists.where(F.size("ks") == 1).select("doc_id", "entity_type", F.col("ks")[0].alias("key"), F.col("ks")[0].alias("owner"), F.lit(1).alias("cluster"), F.lit(False).alias("ambiguous"))
    return lists.where(F.size("ks") > 1).mapInPandas(run, schema).unionByName(alone)


def fuzzy_clusters(m: DataFrame, threshold: int = 88, scorer: str = "token_set", kinds=FUZZY) -> DataFrame:
    """Every mention with its cluster by first fit (numbers per document and type)."""
    keys = merged_keys(m, threshold, scorer, kinds).drop("owner")
    return m.join(keys, ["doc_id", "entity_type", "key"]).select("doc_id", "entity_type", "start", "text", "cluster", "ambiguous")


def resolve(m: DataFrame, threshold: int = 88, scorer: str = "token_set", merge_aliases: bool = True) -> DataFrame:
    """Mentions with the key of their entity: names merged by first fit, generic
    phrases given to the one entity of their type.  The key is null where a
    phrase could stand for several; without `merge_aliases` phrases keep their own."""
    owners = merged_keys(m, threshold, scorer).select("doc_id", "entity_type", "key", "owner")
    named = m.join(owners, ["doc_id", "entity_type", "key"], "left").withColumn("key", F.coalesce("owner", "key")).drop("owner")
    if not merge_aliases:
        return named
    # the only key of a type is its least and its greatest; rows without a document or a type have no company
    known = F.when(~F.col("is_alias") & (F.col("key") != "") & F.col("doc_id").isNotNull() & F.col("entity_type").isNotNull(), F.col("key"))
    w = Window.partitionBy("doc_id", "entity_type")
    j = named.withColumns({"lo": F.min(known).over(w), "hi": F.max(known).over(w)})
    return j.withColumn("key", F.when(~F.col("is_alias") | F.col("lo").isNull(), F.col("key")).when(F.col("lo") == F.col("hi"), F.col("lo"))).drop("lo", "hi")


def resolve_pages(m: DataFrame) -> DataFrame:
    """Mentions with the key of their entity by the page cleaner's rules:
    organisations of one stem, abbreviations and bare surnames go to the one
    longer name they fit."""
    org = (F.col("entity_type") == "ORGANISATION") & ~F.col("text").rlike(r"^[A-Z.]{2,8}$") & (F.col("key") != "")
    stem = F.when(org, T.org_stem(F.col("key"), "B"))
    longest = m.where(org).groupBy("doc_id", stem.alias("stem")).agg(F.max_by("key", F.struct(F.length("key"), F.col("key"))).alias("longest"))
    one = m.withColumn("stem", stem).join(longest, ["doc_id", "stem"], "left").withColumn("key", F.coalesce("longest", "key")).drop("stem", "longest")
    names = exact_clusters(one)
    short = surname_links(names).withColumn("entity_type", F.lit("PERSON")).unionByName(
        abbreviation_links(names).select("doc_id", F.lower("abbreviation").alias("key"), "owner", F.lit("ORGANISATION").alias("entity_type")))
    return one.join(short, ["doc_id", "entity_type", "key"], "left").withColumn("key", F.coalesce("owner", "key")).drop("owner")


def sweep(docs: DataFrame, m: DataFrame, kinds=FUZZY) -> DataFrame:
    """Occurrences, in any case, of names that resolved mentions carry and of
    organisations' stems (with or without a legal suffix) where nothing was
    found: mentions of the same entities (.85).

    Names have four letters or more, persons two words or more.  Each document
    searches its text once for its own names, longest first."""
    text, org = F.trim("text"), F.col("entity_type") == "ORGANISATION"
    named = m.where(F.col("entity_type").isin(*kinds) & ~F.col("is_alias") & (F.col("key") != "")).where((F.col("entity_type") != "PERSON") | text.rlike(r"\S\s+\S"))
    legal = r"\s+(?:" + "|".join(sorted(T.SUFFIX_A, key=lambda w: (-len(w), w))) + r")\b\.?"
    bare = lambda c: F.regexp_replace(c, f"(?:{legal})+$", "")
    forms = F.when(org, F.array(F.lower(text), bare(F.lower(text)))).otherwise(F.array(F.lower(text)))
    forms = named.select("doc_id", F.explode(forms).alias("form"), F.struct("entity_type", "key").alias("of")).where(F.length("form") >= 4)
    one = forms.groupBy("doc_id", "form").agg(F.min("of").alias("of"))
    quoted = F.concat(F.regexp_replace("form", r"([^\p{L}\p{N}\s])", r"\\$1"), F.when(F.col("of.entity_type") == "ORGANISATION", F.lit(f"(?:{legal})?")).otherwise(F.lit("")))
    item = F.struct((-F.length("form")).alias("n"), F.col("form"), quoted.alias("quoted"), F.col("of"))
    per = one.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("xs")).select(
        "doc_id", F.map_from_entries(F.transform("xs", lambda x: F.struct(x["form"], x["of"]))).alias("owner"),
        F.concat(F.lit(r"(?i)(?<!\w)(?:"), F.array_join(F.transform("xs", lambda x: x["quoted"]), "|"), F.lit(r")(?!\w)")).alias("pattern"))
    hits = docs.select("doc_id", F.col("text").alias("t")).join(per, "doc_id").select("doc_id", "owner", F.explode(matches(F.col("t"), F.col("pattern"))).alias("h"))
    low = F.lower("h.text")
    whose = F.coalesce(F.try_element_at("owner", low), F.try_element_at("owner", bare(low)))
    new = hits.withColumn("of", whose).where("of is not null").select("doc_id", F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.text").alias("text"), "of.entity_type", F.lit(0.85).alias("confidence"), F.lit("registry.text_sweep").alias("detector"), "of.key", F.lit(True).alias("is_alias"))
    # a hit is new where no known span meets it: the furthest end of spans that start before it and the next start
    both = m.select(*new.columns).withColumn("known", F.lit(True)).unionByName(new.withColumn("known", F.lit(False)))
    before = Window.partitionBy("doc_id").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("doc_id").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    free = both.withColumn("reach", F.max(F.when(F.col("known"), F.col("end"))).over(before)).withColumn("next", F.min(F.when(F.col("known"), F.col("start"))).over(after))
    return free.where(~F.col("known") & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))).select(*new.columns)
