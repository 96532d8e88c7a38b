"""Templates, fields, classification and text helpers on stated cases."""

import pytest

from folioflow.functions import text as t
from folioflow.functions import validators as v
from folioflow.operators import classify, templates
from folioflow.rules import TEMPLATES, FieldRule, Template

# Form labels are what the templates look for; everything filled in is invented.
W9 = "Form W-9\nRequest for Taxpayer Identification Number and Certification\nFederal tax classification\nName (as shown on your income tax return)"
W9_FILLED = "Form W-9\nRequest for Taxpayer Identification Number and Certification\nTaxpayer Identification Number: 46-7041966\n"
F1040 = "Form 1040\nU.S. Individual Income Tax Return\nStandard deduction\nFiling status: Married filing separately\nYour social security number"
I9 = (
    "Form I-9\nEmployment Eligibility Verification\nDate of Birth (mm/dd/yyyy): 09/27/1961\n"
    "Employee's E-mail Address: l.okafor@post.example\nFirst Name (Given Name): Lena"
)
CMS = "CMS-1500\nHealth Insurance Claim Form\nDiagnosis or Nature of Illness or Injury: J45.20\nTotal Charge: $318.75\nInsured's I.D. Number: KT7-2201"
INVOICE = (
    "INVOICE\nBill To: Tallow & Reed Joinery\nInvoice Number: TR/77-b\nInvoice Date: July 19, 2025\n"
    "Payment Terms: Net 45\nAmount Due: $1,906.40\nSubtotal: $1,780.00"
)
I9_BAD = "Form I-9\nEmployment Eligibility Verification\nDate of Birth (mm/dd/yyyy): 18/40/1961\n"

# source, template, {field: (value, status, validation)}
TEMPLATE_CASES = [
    (W9, "IRS W-9", {"name": ("", "Detected label", "Not checked")}),
    (W9_FILLED, "IRS W-9", {"tinNumber": ("46-7041966", "Extracted", "Valid")}),
    (F1040, "IRS 1040", {"filingStatus": ("Married filing separately", "Extracted", "Valid")}),
    (I9, "USCIS I-9", {"dateOfBirth": ("09/27/1961", "Extracted", "Valid"), "email": ("l.okafor@post.example", "Extracted", "Valid")}),
    (CMS, "CMS-1500", {"totalCharge": ("318.75", "Extracted", "Valid"), "diagnosisCode": ("J45.20", "Extracted", "Valid")}),
    (
        INVOICE,
        "Invoice",
        {
            "invoiceNumber": ("TR/77-b", "Extracted", "Not checked"),
            "amountDue": ("1,906.40", "Extracted", "Valid"),
            "paymentTerms": ("Net 45", "Extracted", "Valid"),
        },
    ),
    (I9_BAD, "USCIS I-9", {"dateOfBirth": ("18/40/1961", "Extracted", "Suspect")}),
    ("A poem about a harbour at night, in four short lines.", None, {}),
    ("Seed catalogue: beans, chard, two kinds of kale.", None, {}),
    # amounts without separators stop after three digits; a note is read as a number
    (INVOICE.replace("1,906.40", "54321.00"), "Invoice", {"amountDue": ("543", "Extracted", "Valid")}),
]


def test_templates(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(TEMPLATE_CASES)], "id int, body string")
    got = {r.id: r.extraction for r in templates.extract(df, "body").collect()}
    for i, (source, template, fields) in enumerate(TEMPLATE_CASES):
        assert got[i].template == template, source
        found = {f.key: f for f in got[i].fields}
        for key, expected in fields.items():
            assert (found[key].value, found[key].status, found[key].validation) == expected
    assert {f.key for f in got[0].fields} >= {"tinNumber"}
    assert [f.confidence for f in got[6].fields if f.key == "dateOfBirth"] == [40]


VALIDATOR_CASES = [
    ("tin", "417-38-6120", True), ("tin", "46-7041966", True), ("tin", "12345", False),
    ("currency", "$1,906.40", True), ("currency", "1240", True), ("currency", "12,40.0", False),
    ("date", "09/27/1961", True), ("date", "July 19, 2025", True), ("date", "18/40/1961", False), ("date", "3 Sept 2026", True),
    ("date", "31 feb 2026", True), ("zip", "12345-6789", True), ("zip", "1234", False), ("phone", "+1 (628) 555-0147", True),
    ("phone", "555-12", False), ("email", "a@b.co", True), ("email", "a@b@c.co", False), ("tax_year", "2024", True),
    ("tax_year", "1901", False), ("tax_year", "2024.5", False), ("tax_year", "soon", False), ("filing_status", "Single filer", True),
    ("filing_status", "Singleton", False), ("icd10", "J45.20", True), ("icd10", "U07.1", False), ("payment_terms", "net 30 days", True),
    ("payment_terms", "Due upon receipt", True), ("payment_terms", "prompt", False),
]


def test_validators(spark):
    df = spark.createDataFrame(VALIDATOR_CASES, "name string, value string, expected boolean")
    case = " ".join(f"when name = '{n}' then {check('value')}" for n, check in v.VALIDATORS.items())
    wrong = df.selectExpr("*", f"case {case} end as ok").filter("not (ok <=> expected)").collect()
    assert wrong == []


# extension, text, class, sensitivity, template, risk
RECORD_CASES = [
    ("PDF", W9, "Tax form", "Restricted", "IRS W-9", "None"),
    ("DOCX", "Welcome folder for new colleagues", "Unparsed file", "Unknown", None, "None"),
    ("PNG", W9, "Tax form", "Restricted", "IRS W-9", "None"),
    ("PDF", "", "Unclassified PDF", "Standard", None, "None"),
    ("PNG", "", "Unclassified scanned document", "Unknown", None, "None"),
    ("PDF", INVOICE, "Invoice or billing document", "Internal", "Invoice", "None"),
    ("PDF", "Reimbursement request\nEmployee number 417-38-6120\nask r.lindt@post.example", "Employment verification form", "Restricted", None, "High"),
    ("PDF", "A short account of last year's harvest.", "General PDF", "Standard", None, "None"),
    ("TIFF", "Nothing to see", "General document", "Standard", None, "None"),
    # keywords are unanchored, and letters with accents do not hide word edges
    ("PDF", "Adobe", "General PDF", "Restricted", None, "None"),
    ("PDF", "\u00e9irs x", "Tax form", "Standard", None, "None"),
]


def test_records(spark):
    df = spark.createDataFrame([(i, c[0], c[1], "", "") for i, c in enumerate(RECORD_CASES)], "id int, extension string, text string, title string, subject string")
    got = {r.id: r for r in classify.with_intelligence(df).collect()}
    for i, (_, text, doc_class, level, template, risk) in enumerate(RECORD_CASES):
        r = got[i]
        assert (r.analysis.document_class, r.analysis.sensitivity, r.extraction.template, r.pii.risk_level) == (doc_class, level, template, risk), text
    assert got[5].analysis.confidence >= 60
    assert got[6].analysis.signals[0].startswith("Local PII scan flagged: ")
    assert "No structured template" in got[3].extraction.summary


def test_custom_template(spark):
    pass_form = Template("pass", "Visitor pass", "Pass", (r"visitor pass",), (), 3, (FieldRule("host", "Host", (r"host: ([^\n]+)",), (r"host",), check=lambda x: f"{x} = 'Lena'"),))
    df = spark.createDataFrame([("Visitor pass\nHost: Lena",)], "body string")
    got = templates.extract(df, "body", (*TEMPLATES, pass_form)).first().extraction
    assert (got.template, got.fields[0].value, got.fields[0].validation) == ("Visitor pass", "Lena", "Valid")


def one(spark, expression):
    return spark.range(1).selectExpr(f"{expression} as x").first().x


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("a \t\r\nb\n\n\n\nc\u00a0", "a\nb\n\nc"), ("\ufeff x \n", "x"), ("", "")],
)
def test_normalize(spark, raw, expected):
    assert one(spark, t.normalize(t.lit(raw))) == expected


@pytest.mark.parametrize(
    ("path", "expected"),
    [("/a/b.pdf", "PDF"), ("/a/.hidden", "FILE"), ("/a/b.", "FILE"), ("/a/b", "FILE"), ("/a.x/b", "FILE"), ("/a/b.tar.Gz/", "GZ")],
)
def test_extension(spark, path, expected):
    assert one(spark, t.extension(t.lit(path))) == expected


def test_ocr_gate(spark):
    strong = "The quick survey of the northern pier lists every plank, nail and rope by age. " * 2
    assert [one(spark, t.needs_ocr(t.lit(x))) for x in (" \n \n ", "a b c 1 2 3", strong)] == [True, True, False]


def test_labels(spark):
    assert [one(spark, t.size_label(f"{n}L")) for n in (0, 1023, 1280, 1048576, 15728640)] == ["0 B", "1023 B", "1.3 KB", "1.00 MB", "15.00 MB"]
    assert [one(spark, t.duration_label(f"cast({n} as bigint)")) for n in ("null", 999, 1125, 39675)] == ["Not available", "999 ms", "1.13 s", "39.67 s"]


def test_required_word():
    assert t.required_word(r"\bi-9\b") == "i-9"
    assert t.required_word(r"insured'?s i\.?d\.? number") == "insured"
    assert t.required_word(r"[^\n]{2,80}ab+c") == "ab"
    assert t.required_word(r"ab|cd") == ""


HOSTILE = [
    "x@a" + ".bb" * 30000 + "1 end",
    "Invoice Number: A1\nAmount Due: $1" + ",123" * 30000 + ".00\nBill to: x\npayment terms: net 3",
    "1 " * 100000, "a." * 100000 + "@", "a@" * 30000, "dob " * 30000,
    "form w-9\n" + "taxpayer identification number " * 5000,
    "form 1040 u.s. individual income tax return\nyour social security number" + " " * 20000 + "x",
    "form i-9 employment eligibility verification\nemployee's email address" + " " * 20000 + "x",
]


def test_hostile_texts_neither_crash_nor_hang(spark):
    df = spark.createDataFrame([(i, "PDF", text, "", "") for i, text in enumerate(HOSTILE)], "id int, extension string, text string, title string, subject string")
    got = {r.id: r for r in classify.with_intelligence(df).collect()}
    assert len(got) == len(HOSTILE)
    assert got[0].pii.total_matches == 1
    amount = [f.value for f in got[1].extraction.fields if f.key == "amountDue"]
    assert amount[0].startswith("1,123,123") and len(amount[0]) == 120_004


def test_validators_are_sql_functions(spark):
    v.register(spark)
    assert set(v.FUNCTIONS) >= {"is_tin", "is_date", "is_card", "is_routing", "is_ssn", "passes_luhn"}
    got = spark.sql("select is_tin('12-3456789') a, is_date('13/01/2024') b, is_zip(' 12345-6789 ') c, is_card('4532771809462356') d, is_tax_year(null) e").first()
    assert tuple(got) == (True, False, True, True, False)
    for name, check in v.FUNCTIONS.items():
        for value in ("12-3456789", "417-38-6120", "01/02/2024", "(628) 555-0147", "2024", "314077266", "net 30", "a@b.co", "J45.1", "Single"):
            assert spark.sql(f"select {name}('{value}') as x").first().x == spark.range(1).selectExpr(f"{check(t.lit(value))} as x").first().x
