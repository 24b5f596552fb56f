"""Expected matches written by hand, and work that grows with the number of matches."""

import time

import pytest

from veilwork.functions import patterns as P
from veilwork.functions.spans import scan
from veilwork.operators import span_algebra as S
from veilwork.operators.detect import label_values

CASES = [
    ("re_email", "Email: john.smith@acme.com please. a@b.co", [("john.smith@acme.com", 0.99), ("a@b.co", 0.99)]),
    ("re_email", "foo at bar dot com", []),
    ("re_postcode", "SW1A 1AA, EC1A 1BB, m1 1ae, GIR 0AA, QV1 1AA, SW1A 1CA", [("SW1A 1AA", 0.95), ("EC1A 1BB", 0.95), ("m1 1ae", 0.95), ("GIR 0AA", 0.95)]),
    ("re_lei", "LEI: 529900T8BM49AURSDO55 or 5493001KJTIIGC8Y1R99", [("529900T8BM49AURSDO55", 0.99), ("5493001KJTIIGC8Y1R99", 0.55)]),
    ("re_iban", "IBAN: GB82WEST12345698765432; GB82 WEST 1234 5698 7654 32.", [("GB82WEST12345698765432", 0.99), ("GB82 WEST 1234 5698 7654 32", 0.99)]),
    ("re_bic", "BARCGB22XXX, BARCGB22 and COMPANYX", [("BARCGB22XXX", 0.85), ("BARCGB22", 0.85), ("COMPANYX", 0.85)]),
    ("re_url", "see https://www.example.com/p?x=1, WWW.a.org/(b) end", [("https://www.example.com/p?x=1,", 0.95), ("WWW.a.org/(b)", 0.95)]),
    ("re_company_prefixed", "SC123456 and 12345678", [("SC123456", 0.85)]),
    ("re_sort", "12-34-56 12 34 56 123456", [("12-34-56", 0.75), ("12 34 56", 0.75), ("123456", 0.75)]),
    ("re_date", "01/02/2020 2020-01-02 1 january 20, 3  Feb 1999 4 Febr 1999", [("01/02/2020", 0.7), ("2020-01-02", 0.7), ("1 january 20", 0.7), ("3  Feb 1999", 0.7)]),
    ("re_ssn", "SSN: 123-45-6789 1234-45-6789", [("123-45-6789", 0.95)]),
    ("re_nin", "AB 12 34 56 C; ab123456d; DA123456A; QQ123456C", [("AB 12 34 56 C", 0.92), ("ab123456d", 0.92)]),
    ("re_vat", "VAT gb 123456789, DE12345678", [("gb 123456789", 0.9), ("DE12345678", 0.9)]),
    ("re_phone", "call +44 20 7946 0958, (020) 7946 0958 or 12-345", [("+44 20 7946 0958", 0.7), ("7946 0958", 0.7)]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_fixed_values(spark, case):
    name, text, want = CASES[case]
    pattern = next(p for p in (*P.A, *P.B) if p.name == name)
    got = scan(spark.createDataFrame([(1, "é😀 " + text)], "doc_id long, text string"), [pattern]).orderBy("start").collect()
    assert [(r.text, r.confidence) for r in got] == want
    assert all(("é😀 " + text)[r.start:r.end] == r.text for r in got)


def test_many_matches_and_lines_take_linear_time(spark):
    n = 10_000
    mails = spark.createDataFrame([(1, " ".join(f"a{i}@b.co" for i in range(n)))], "doc_id long, text string")
    lines = spark.createDataFrame([(1, "\n".join(f"Client Name: Ann Lee {i}" for i in range(n)))], "doc_id long, text string")
    t = time.time()
    assert scan(mails, [P.A[0]]).count() == n
    assert S.line_blocks(lines).count() == n
    label_values(lines).count()
    edits = spark.range(n).selectExpr("1L AS doc_id", "cast(id * 20 AS int) AS start", "cast(id * 20 + 1 AS int) AS end", "'X' AS replacement")
    assert S.apply_edits(lines, edits).first().n_applied == n
    assert time.time() - t < 60
