import re

import pytest
from pyspark.sql import functions as F

from veilwork.functions import patterns as P
from veilwork.functions import text as T
from veilwork.functions.spans import scan
from veilwork.operators import detect, linkage, replace
from veilwork.operators import span_algebra as S

BY = {p.name: p for p in (*P.A, *P.B)}
CASES = [
    ("re_email", "mail a.b@c.example now", ["a.b@c.example"]), ("re_postcode", "at EC1A 1BB and sw1a2aa", ["EC1A 1BB", "sw1a2aa"]),
    ("re_bic", "DEUTDEFF DEUTDEFF500", ["DEUTDEFF", "DEUTDEFF500"]), ("re_url", "see https://x.example/a?b=1 ok", ["https://x.example/a?b=1"]),
    ("re_company_prefixed", "SC123456", ["SC123456"]), ("re_ssn", "123-45-6789", ["123-45-6789"]), ("re_phone", "Tel: +44 20 7946 0123, 12", ["+44 20 7946 0123"]),
    ("re_date", "on 1/2/2001, 2019-03-04 and 5 March 2020", ["1/2/2001", "2019-03-04", "5 March 2020"]), ("re_nin", "AB123456C", ["AB123456C"]),
    ("re_vat", "GB123456789", ["GB123456789"]), ("re_email", None, []), ("re_email", "", []), ("re_email", "😀é a@b.example", ["a@b.example"]),
]


@pytest.mark.parametrize("name,text,want", CASES)
def test_pattern(spark, name, text, want):
    rows = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), [BY[name]]).collect()
    assert [r.text for r in rows] == want
    assert all(text[r.start:r.end] == r.text for r in rows)


def test_checksums(spark):
    text = "GB82WEST12345698765432 GB00WEST12345698765432 5493001KJTIIGC8Y1R12 5493001KJTIIGC8Y1R13"
    rows = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), [BY["re_iban"], BY["re_lei"]]).collect()
    got = {r.text: r.confidence for r in rows if len(r.text) in (20, 22)}
    assert got["GB82WEST12345698765432"] == 0.99 and got["GB00WEST12345698765432"] == 0.5
    assert got["5493001KJTIIGC8Y1R12"] == 0.99 and got["5493001KJTIIGC8Y1R13"] == 0.55


def test_labels(spark):
    docs = spark.createDataFrame([(1, "Client Name: Oakfield Foods Limited.\nName: Anna Keller\nSort Code\n\n12-34-56")], "doc_id long, text string")
    got = {(r.text, r.entity_type) for r in detect.label_values(docs).collect()}
    assert got == {("Oakfield Foods Limited", "ORGANISATION"), ("Anna Keller", "PERSON")}
    nxt = detect.next_line_values(docs).collect()
    assert [(r.text, r.entity_type) for r in nxt] == [("12-34-56", "SORT_CODE")]


def test_dedup_keeps_the_enclosing_and_the_more_confident(spark):
    rows = [(1, 0, 5, "abcde", "PERSON", 0.5, "a"), (1, 0, 9, "abcdefghi", "ORGANISATION", 0.4, "b"), (1, 7, 12, "hijkl", "EMAIL", 0.9, "c"), (1, 20, 22, "xx", "PERSON", 0.1, "d")]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, text string, entity_type string, confidence double, detector string")
    assert sorted(r.detector for r in S.dedup(df).collect()) == ["c", "d"]


def test_edits(spark):
    docs = spark.createDataFrame([(1, "é one two three"), (2, "none")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 5, "1"), (1, 10, 15, "33"), (1, 4, 9, "x")], "doc_id long, start int, end int, replacement string")
    got = {r.doc_id: (r.text, r.n_applied) for r in S.apply_edits(docs, edits).collect()}
    assert got == {1: ("é onx 33", 2), 2: ("none", 0)}


def test_chunks_reject_overlap(spark):
    with pytest.raises(ValueError):
        S.chunks(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 10, 10)


def test_replacements_are_valid_and_stable(spark):
    df = spark.createDataFrame([("k1", "GB82 WEST 1234 5698 7654 32", "Oakfield Foods PLC")], "key string, iban string, org string")
    one = df.select(replace.iban(F.col("key"), F.col("iban")).alias("iban"), replace.lei(F.col("key")).alias("lei"), replace.organisation(F.col("key"), F.col("org")).alias("org"))
    a, b = one.first(), one.first()
    assert a == b and a.org.endswith(" PLC") and len(a.iban) == 22 and a.iban.startswith("GB")
    num = lambda s: int("".join(str(int(c, 36)) for c in s))
    assert num(a.iban[4:] + a.iban[:4]) % 97 == 1 and num(a.lei) % 97 == 1


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("v",)], "v string").select(T.keyed_hash(b"k", "doc", F.col("v")).alias("h")).first().h
    assert got == hmac.new(b"k", b"doc\x01v", hashlib.sha256).hexdigest()


def test_token_set_ratio():
    assert linkage.token_set_ratio("a b", "b a") == 100 and linkage.token_set_ratio("a b", "a b c") == 100
    assert linkage.token_set_ratio("", "a") == 0 and 0 < linkage.token_set_ratio("anna keller", "anne keller") < 100


def test_no_surprises_in_patterns():
    for p in (*P.A, *P.B):
        re.compile(p.regex.replace(r"\p{L}", "a"))
