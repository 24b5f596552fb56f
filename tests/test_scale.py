"""Work that grows with the tables is dealt out and stays bounded."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilwork.functions import text as T
from veilwork.functions.spans import MARK, matches
from veilwork.operators import linkage, replace, validate
from veilwork.operators import span_algebra as S
from veilwork.plans.kyc import kyc


@pytest.fixture
def one_row_group(tmp_path):
    n = 12_001
    pq.write_table(pa.table({"c_custkey": range(n), "c_name": ["x"] * n, "c_nationkey": [0] * n, "c_acctbal": [1.0] * n, "c_mktsegment": ["s"] * n}), tmp_path / "customer.parquet")
    pq.write_table(pa.table({"n_nationkey": [0], "n_name": ["FRANCE"], "n_regionkey": [0]}), tmp_path / "nation.parquet")
    return str(tmp_path)


def test_texts_of_one_row_group_are_dealt_out(spark, one_row_group):
    t = kyc(spark, one_row_group)
    sizes = [r["count"] for r in t.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 12_001 and len(sizes) == 4 and max(sizes) < 4_000
    assert t.where("text is null").count() == 0 and t.select("doc_id").distinct().count() == 12_001


@pytest.mark.parametrize("text", ["ab1c22é333", "11", "", "abc", f"1{MARK}{MARK}22a{MARK}3", f"{MARK}", None])
def test_matches_of_texts_with_the_mark(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), "[0-9]+").alias("m")).first().m
    import re

    assert [(m.start, m.end, m.text) for m in got] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text or "")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


SPANS = "doc_id long, start int, end int, text string, entity_type string, confidence double, detector string"


def test_dedup_equals_the_fold_over_all_kept_spans(spark):
    import random

    rng = random.Random(5)
    rows = [(d, a, a + rng.choice((0, 1, 2, 3, 8, 20)), "t", rng.choice(S.PRIORITY), rng.choice((0.5, 0.7, 0.9)), rng.choice("abc")) for d in range(40) for a in (rng.randrange(60) for _ in range(25))]
    want = set()
    for d in range(40):
        kept = []
        for x in sorted({r for r in rows if r[0] == d}, key=lambda r: (r[1], -r[2], -r[5], S.PRIORITY.index(r[4]), r[6])):
            hit = next((i for i, k in enumerate(kept) if k[1] < x[2] and x[1] < k[2]), None)
            if hit is None:
                kept.append(x)
                continue
            k = kept[hit]
            holds = lambda a, b: a[1] <= b[1] and a[2] >= b[2] and a[2] - a[1] > b[2] - b[1]
            score = lambda r: (r[5], -S.PRIORITY.index(r[4]), r[2] - r[1])
            if holds(x, k) or (not holds(k, x) and score(x) > score(k)):
                kept[hit] = x
        want |= set(kept)
    out = S.dedup(spark.createDataFrame(sorted(set(rows)), SPANS))
    assert {tuple(r) for r in out.collect()} == want
    assert _plan(out).count("array_position(transform") <= 2  # the span that is met is looked for once


def test_a_plan_couples_by_one_window(spark):
    m = spark.createDataFrame([(1, 0, 9, "Ida Stone", "PERSON", 0.9, "a"), (1, 20, 30, "Elm Ltd", "ORGANISATION", 0.9, "a"), (1, 40, 50, "a@b.com", "EMAIL", 0.9, "a"), (2, 0, 9, "c@d.com", "EMAIL", 0.9, "a")], SPANS)
    plan = replace.plan(linkage.entities(linkage.mentions(m)))
    assert _plan(plan).count("Join") == 0
    got = {r.representative: r.replacement for r in plan.collect()}
    assert got["a@b.com"] == f"{got['Ida Stone'].lower().replace(' ', '.')}@{got['Elm Ltd'].split(' Ltd')[0].lower()}.example" and got["c@d.com"].endswith("@mail.example")


def test_generic_phrases_are_given_out_without_a_join_of_counts(spark):
    m = linkage.mentions(spark.createDataFrame([(1, 0, 9, "Elm Ltd", "ORGANISATION", 0.9, "a"), (1, 20, 30, "the Client", "ORGANISATION", 0.9, "a"), (None, 0, 9, "Elm Ltd", "ORGANISATION", 0.9, "a"), (None, 20, 30, "the Client", "ORGANISATION", 0.9, "a")], SPANS))
    out = linkage.resolve(m)
    assert _plan(out).count("Join") == 1
    assert sorted((str(r.doc_id), r.start, r.key) for r in out.collect()) == [("1", 0, "elm limited"), ("1", 20, "elm limited"), ("None", 0, "elm limited"), ("None", 20, "the client")]


@pytest.mark.parametrize("form", ["NFC", "NFKC", "NFD", "NFKD"])
def test_normal_forms_stay_in_the_jvm(spark, form):
    import unicodedata

    cat = unicodedata.category
    texts = ["".join(chr(p) for p in range(a, a + 256) if cat(chr(p)) not in ("Cs", "Cn")) for a in range(0, 0x30000, 256)] + ["é ﬁ Å", "plain", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = df.select("n", T.unicode_form(F.col("t"), form).alias("u"))
    assert {r.n: r.u for r in got.collect()} == {n: t and unicodedata.normalize(form, t) for n, t in enumerate(texts)}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_counts_hold_no_set_of_documents(spark):
    rows = [(1, "a", "X"), (1, "a", "Y"), (1, "b", "X"), (2, "a", "X"), (2, None, None), (None, "b", "Y")]
    got = validate.counts(spark.createDataFrame(rows, "doc_id long, detector string, entity_type string"))
    want = {("a", None, 3, 2), ("b", None, 2, 1), (None, "X", 3, 2), (None, "Y", 2, 1), (None, None, 1, 1), (None, None, 6, 2)}
    out = [tuple(r) for r in got.collect()]
    assert set(out) == want and len(out) == len(want) + 1  # the group of no detector and that of no type are alike
    assert "Expand" not in _plan(got)
