"""The scan and the record do costly work only where it is needed, with the same results."""

import pytest

from folioflow.functions import text as t
from folioflow.operators import classify, pii
from folioflow.plans.queries import QUERIES
from folioflow.rules import PROFILES, SIGNALS, TEMPLATES
from test_dealing import tables  # noqa: F401
from test_queries import plan

TEXTS = [
    "", None, "4532 7718 0946 2356", "x 4532-7718-0946-2356-", "-123456780 then 314077266", "314077266 314077266", "417-38-6120 46-7041966 (628) 555-0147",
    "DOB 417-38-6120 or dob: 4-5-88", "dob 12 34 5678 417-38-6120", "4173861200@example.com 314077266", "+1 (628) 555-0147 +1.628.555.0147", "(628)555-0147",
    "1 2 3 4 5 6 7 8 9", "12345678\n9 123456789", "9 (1) 314077266 900-12-3456", "date of birth 1/2/1990 417-38-6120 a.b@c.de 46-7041966",
]
LONG = " ".join(f"417-38-{i:04d} u{i}@example.com dob 1/2/19{i % 90 + 10}" for i in range(1, 60))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate([*TEXTS, LONG, LONG[:400]])], "id int, v string").repartition(2)


def test_shapes_and_pairs_change_no_result(spark, texts, monkeypatch):
    from dataclasses import replace

    plain = tuple(replace(d, shape="") for d in pii.DETECTORS)
    assert sum(bool(d.shape) for d in pii.DETECTORS) == 5
    few = pii.scan(texts, "v").select("id", "pii").collect()
    places = pii.candidates(texts, "v", ["id"]).collect()
    monkeypatch.setattr(pii, "_FEW_SPANS", -1)
    assert sorted(few) == sorted(pii.scan(texts, "v", plain).select("id", "pii").collect())
    assert sorted(places) == sorted(pii.candidates(texts, "v", ["id"], plain).collect())
    found = {(r.id, r.category): r for r in places}
    for r in found.values():
        v = [*TEXTS, LONG, LONG[:400]][r.id]
        assert v[r.start : r.stop].strip(" ") and r.stop <= len(v)


def test_fold_and_normalize_equal_their_plain_forms(spark):
    values = ["", None, "ABC", "İK ÀB", "a\r\nb", "a\r\n\r\n\r\n\r\nb \n", "a\rb", " x \t\ny"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    dotted, kelvin, nul = t.lit(chr(0x130)), t.lit(chr(0x212A)), t.lit(chr(0))
    plain = f"lower(replace(replace(v, {dotted}, {nul}), {kelvin}, {nul}))"
    unix = "replace(v, chr(13) || chr(10), chr(10))"
    for r in rows.selectExpr(f"{t.fold('v')} as x", f"{t.fold('concat(v)')} as y", f"{plain} as z", f"{t.normalize('v')} as n", f"{t.normalize(unix)} as m").collect():
        assert r.x == r.y == r.z and r.n == r.m
    assert "octet_length" in t.fold("v")


def test_profile_words_are_searched_only_without_a_template():
    words = classify.keyword_patterns(TEMPLATES, SIGNALS)
    assert "governing law" in {p for x in PROFILES for p in x.patterns} and "governing law" not in words


def test_class_profile_extracts_no_fields(spark, tables):  # noqa: F811
    assert "invoiceNumber" in plan(QUERIES["document_intelligence"](spark, tables))
    assert "invoiceNumber" not in plan(QUERIES["class_profile"](spark, tables))
    assert {r.template for r in QUERIES["class_profile"](spark, tables).collect()} >= {"Invoice", "IRS W-9", None}
