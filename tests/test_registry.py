import pytest
from pyspark.sql import functions as F

from veilwork.operators import linkage, validate
from veilwork.plans import flow

SPANS = "doc_id long, start int, end int, text string, entity_type string, confidence double, detector string"
ORG, PERSON = "ORGANISATION", "PERSON"


def keys(spark, rows, **options):
    """Key of each mention; rows: (text, type), 50 places apart."""
    df = spark.createDataFrame([(1, i * 50, i * 50 + len(t), t, k, 0.9, "made") for i, (t, k) in enumerate(rows)], SPANS)
    got = linkage.resolve(linkage.mentions(df), **options).collect()
    return [r.key for r in sorted(got, key=lambda r: r.start)]


def test_forms_of_one_organisation_are_one_entity(spark):
    got = keys(spark, [("Elmwood Holdings Limited", ORG), ("ELMWOOD HOLDINGS LTD", ORG), ("Elmwood Holdings", ORG)])
    assert got == ["elmwood holdings limited"] * 3


def test_initials_join_the_full_name(spark):
    assert keys(spark, [("Ida Maria Stone", PERSON), ("I. M. Stone", PERSON)]) == ["ida maria stone"] * 2


def test_a_name_that_fits_two_persons_stays_alone(spark):
    got = keys(spark, [("Ida Stone", PERSON), ("Otto Stone", PERSON), ("Mr Stone", PERSON)])
    assert got == ["ida stone", "otto stone", "stone"]


@pytest.mark.parametrize("others,want", [([], "the client"), (["Elmwood Ltd"], "elmwood limited"), (["Elmwood Ltd", "Quarry Foods PLC"], None)])
def test_generic_phrases(spark, others, want):
    assert keys(spark, [*((o, ORG) for o in others), ("the Client", ORG)])[-1] == want


def test_generic_phrases_can_stay_apart(spark):
    assert keys(spark, [("Elmwood Ltd", ORG), ("the Client", ORG)], merge_aliases=False) == ["elmwood limited", "the client"]


def test_scores():
    assert linkage.match_score(ORG, "elmwood", "elmwood limited") == 100
    assert linkage.match_score(ORG, "nrf", "northern river foods limited", "substring") == 90
    assert linkage.match_score(PERSON, "stone", "ida stone", "substring") == 90  # the substring rule beats the 80 of a bare last name
    assert linkage.match_score(PERSON, "i stone", "ida stone", "substring") == 95
    assert linkage.match_score("ADDRESS", "1 mill lane", "9 oak road", "substring") == 0


def test_sweep_finds_names_that_no_detector_marked(spark):
    text = "Elmwood (UK) Ltd met Ida Stone.  elmwood (uk) limited paid; ELMWOOD (UK) won. Stone and ida stone left Elmwood (UK)x."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = [("Elmwood (UK) Ltd", ORG), ("Ida Stone", PERSON)]
    df = spark.createDataFrame([(1, text.index(t), text.index(t) + len(t), t, k, 0.9, "made") for t, k in found], SPANS)
    m = linkage.mentions(df)
    got = sorted((r.start, r.text, r.key) for r in linkage.sweep(docs, m).collect())
    assert [g[1:] for g in got] == [("elmwood (uk) limited", "elmwood uk limited"), ("ELMWOOD (UK)", "elmwood uk limited"), ("ida stone", "ida stone")]
    assert all(text[s:s + len(t)] == t for s, t, _ in got)


def test_sweep_leaves_known_spans_alone(spark):
    text = "1 Elmwood Foods Road, Elmwood Foods PLC"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    df = spark.createDataFrame([(1, 0, 20, text[:20], "ADDRESS", 0.9, "made"), (1, 22, 39, text[22:], ORG, 0.9, "made")], SPANS)
    assert linkage.sweep(docs, linkage.mentions(df)).count() == 0


def test_leaks_look_for_every_alias(spark):
    out = spark.createDataFrame([(1, "here ELMWOOD stays"), (2, "clean")], "doc_id long, text string")
    plan = spark.createDataFrame([(1, "Elmwood Foods PLC", ["Elmwood", "Elmwood Foods PLC", "the client"]), (2, "Ida Stone", None)], "doc_id long, representative string, aliases array<string>")
    assert [(r.doc_id, r.original) for r in validate.leaks(out, plan).collect()] == [(1, "Elmwood")]


def test_flow_replaces_every_form_by_one_value(spark):
    text = "Client Name: Elmwood Foods Limited\nDirector: Ida Stone\nNotes: ELMWOOD FOODS and Elmwood Foods Ltd hired ida stone."
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = flow.anonymise(docs, flow.detections_a(docs))
    out = {r.doc_id: r.text for r in got["output"].collect()}
    assert "elmwood" not in out[1].lower() and "stone" not in out[1].lower()
    assert out[2] == "nothing here" and out[3] is None
    new = {r.entity_type: r.replacement for r in got["plan"].collect()}
    assert out[1].count(new[ORG]) == 3 and out[1].count(new[PERSON]) == 2
    assert {r.doc_id: r.n_leaks for r in got["validation"].collect()}[1] == 0


def test_page_rules_link_surnames_stems_and_abbreviations(spark):
    rows = [("Northern River Foods PLC", ORG), ("Northern River Foods", ORG), ("NRF", ORG), ("Ida Stone", PERSON), ("Stone", PERSON), ("Otto Berg", PERSON)]
    df = spark.createDataFrame([(1, i * 50, i * 50 + len(t), t, k, 0.9, "made") for i, (t, k) in enumerate(rows)], SPANS)
    got = [r.key for r in linkage.resolve_pages(linkage.mentions(df, "B")).orderBy("start").collect()]
    assert got == ["northern river foods plc"] * 3 + ["ida stone"] * 2 + ["otto berg"]


def test_links_between_fields(spark):
    rows = [("Ida Stone", PERSON), ("Elmwood Foods PLC", ORG), ("i.stone@elmwood.example", "EMAIL"), ("https://www.elmwood.example/", "URL")]
    df = spark.createDataFrame([(1, i * 50, i * 50 + len(t), t, k, 0.9, "made") for i, (t, k) in enumerate(rows)], SPANS)
    e = linkage.entities(linkage.mentions(df))
    assert [r.person for r in linkage.email_person_links(e).collect()] == ["ida stone"]
    assert [r.org for r in linkage.email_owner_links(e).collect()] == ["elmwood foods plc"] == [r.org for r in linkage.url_owner_links(e).collect()]
    assert linkage.related(e).count() == 2
    assert linkage.related(e.where(F.lit(False))).count() == 0
