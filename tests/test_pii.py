"""Detectors, masks, claims and risk: stated cases and a brute-force model."""

import random
import re
import time

import pytest

from folioflow.functions import validators as v
from folioflow.operators import pii
from folioflow.rules import UNASSIGNED_EIN_PREFIXES

SSN, CARD, ABA = "Social Security number", "Credit card number", "Bank routing number"
EIN, PHONE, MAIL, BORN = "Employer identification number", "Phone number", "Email address", "Date of birth"

GOOD_CARD, BAD_CARD = "4532 7718 0946 2356", "4532 7718 0946 2357"
GOOD_ROUTE, BAD_ROUTE = "314077266", "314077267"

# text, expected findings (category, count, examples), risk
CASES = [
    ("Payroll keeps 417-38-6120 for this hire", [(SSN, 1, ["***-**-6120"])], "High"),
    # areas, groups and serials that are never issued
    *[(f"number {n} in the ledger", [], "None") for n in ("000-41-7793", "666-41-7793", "912-41-7793", "417-00-7793", "417-41-0000")],
    (f"paid with {GOOD_CARD} in June", [(CARD, 1, ["**** 2356"])], "High"),
    (f"paid with {BAD_CARD} in June", [], "None"),
    (f"wire goes over {GOOD_ROUTE} tonight", [(ABA, 1, ["*****7266"])], "High"),
    (f"wire goes over {BAD_ROUTE} tonight", [], "None"),
    (
        "Write to ruth.lindt@post.example or ring (628) 555-0147",
        [(PHONE, 1, ["(***) ***-0147"]), (MAIL, 1, ["r***@post.example"])],
        "Low",
    ),
    ("Birth date 9-27-61 as stated", [(BORN, 1, ["**/**/****"])], "High"),
    ("employer 46-7041966 withheld", [(EIN, 1, ["**-***1966"])], "Low"),
    ("employer 78-7041966 withheld", [], "None"),
    ("The reading group meets after lunch and brings its own chairs", [], "None"),
    (
        "Household: 417-38-6120; 417-38-7719; 417-38-9052; 417-38-5083; again 417-38-6120",
        [(SSN, 5, ["***-**-6120", "***-**-7719", "***-**-9052", "***-**-5083"])],
        "High",
    ),
    # an address that starts with nine digits: the stronger detector takes the digits
    (f"{GOOD_ROUTE}@post.example", [(ABA, 1, ["*****7266"])], "High"),
    ("\n\n   \t", [], "None"),
    ("0" * 9, [(ABA, 1, ["*****0000"])], "High"),
    # the label belongs to the span, so the taken number silences the birth date
    ("dob 417-38-6120, later DOB: 2-3-71", [(SSN, 1, ["***-**-6120"]), (BORN, 1, ["**/**/****"])], "High"),
    # a failing candidate uses up its text for its own detector, but claims nothing
    ("12 4532771809462356", [], "None"),
    (f"{BAD_CARD} {GOOD_ROUTE}", [(ABA, 1, ["*****7266"])], "High"),
]


def rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    out = pii.scan(df, "body").collect()
    return {r.id: r.pii for r in out}


def test_stated_cases(spark):
    got = rows(spark, [c[0] for c in CASES])
    for i, (text, findings, risk) in enumerate(CASES):
        assert [(f["category"], f["count"], f["examples"]) for f in got[i].findings] == findings, text
        assert got[i].risk_level == risk, text
        assert got[i].total_matches == sum(f[1] for f in findings), text


@pytest.mark.parametrize(
    ("check", "value", "expected"),
    [
        (v.passes_luhn, "4532771809462356", True),
        (v.passes_luhn, "4532771809462357", False),
        (v.is_routing, GOOD_ROUTE, True),
        (v.is_routing, BAD_ROUTE, False),
        (v.is_routing, "96" + GOOD_ROUTE[2:], False),
    ],
)
def test_checksums(spark, check, value, expected):
    assert spark.range(1).selectExpr(f"{check(repr(value))} as ok").first().ok is expected


# --- brute-force model: every start position, Python's engine, quadratic claims

EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


ADDRESS = r"\b[a-z0-9][a-z0-9._%+-]*@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z]{2,})+\b"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(rank, m):
    d = re.sub("[^0-9]", "", m)
    if rank == 0:
        return 13 <= len(d) <= 19 and d[0] != "0" and luhn(d)
    if rank == 1:
        p = int(d[:2])
        return (p <= 12 or 21 <= p <= 32 or 61 <= p <= 72 or p == 80) and sum(int(c) * (3, 7, 1)[i % 3] for i, c in enumerate(d)) % 10 == 0
    if rank == 2:
        return m[:3] not in ("000", "666") and m[:3] < "900" and m[4:6] != "00" and m[-4:] != "0000"
    if rank == 3:
        return m[:2] not in UNASSIGNED_EIN_PREFIXES
    return True


def model(text):
    taken, out = [], []
    for rank, d in enumerate(pii.DETECTORS):
        flags = re.ASCII | (re.IGNORECASE if d.ignore_case else 0)
        pattern = ADDRESS if d.category == MAIL else d.pattern
        for m in re.finditer(pattern.replace(r"\b", EDGE), text, flags):
            if valid(rank, m.group()) and not any(m.start() < e and m.end() > s for s, e in taken):
                taken.append(m.span())
                out.append((rank, m.start(), m.group()))
    counts = {}
    for rank, _, _ in out:
        counts[rank] = counts.get(rank, 0) + 1
    return [(pii.DETECTORS[r].category, n) for r, n in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))]


def test_random_texts_match_model(spark):
    rng = random.Random(7)
    bits = [
        GOOD_CARD, BAD_CARD.replace(" ", ""), GOOD_ROUTE, "417-38-6120", "417 38 6120", "46-7041966", "(628) 555-0147",
        "+1 628.555.0147", "a.b@example.com", "x@y.co", "_m@n.org", ".com", ".c", "@b.net", "+k", "DOB", "d.o.b.", "date of birth", "birth date", "4/5/88", "04-12-1988",
        " ", " ", "-", ".", "\n", ":", "é", "ß", "7", "90", "555", "_", "@", "born on ", "12 34 5678",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(3, 14))) for _ in range(6000)]
    got = rows(spark, texts)
    bad = [
        (texts[i], [(f["category"], f["count"]) for f in got[i].findings], model(texts[i]))
        for i in range(len(texts))
        if [(f["category"], f["count"]) for f in got[i].findings] != model(texts[i])
    ]
    assert not bad, bad[:3]
    assert sum(bool(p.findings) for p in got.values()) > 500


def test_many_matches_in_one_text(spark):
    text = " ".join(f"417-38-{i:04d} u{i}@example.com" for i in range(1, 1500))
    got = rows(spark, [text])[0]
    assert [(f["category"], f["count"]) for f in got.findings] == [(SSN, 1499), (MAIL, 1499)]


def test_custom_detector(spark):
    badge = pii.Detector("Badge", r"\bB-\d{4}\b", lambda m: "'B-****'", False, lambda t, f: f"contains({t}, 'B-')")
    df = spark.createDataFrame([("see B-1234",)], "body string")
    found = pii.scan(df, "body", (*pii.DETECTORS, badge)).first().pii.findings
    assert [(f["category"], f["examples"]) for f in found] == [("Badge", ["B-****"])]


def test_interleaved_matches_take_linear_time(spark):
    unit = f"call (628) 555-0147 or r.lindt@post.example.com ssn 417-38-6120 ein 46-7041966 card 4532 7718 0946 2356 route {GOOD_ROUTE} born DOB 09/27/1961. "
    seconds = {}
    for n in (70, 700, 14_000):
        start = time.time()
        got = rows(spark, [unit * n])[0]
        seconds[n] = time.time() - start
        assert [(f["category"], f["count"]) for f in got.findings] == [(d.category, n) for d in pii.DETECTORS]
    # twenty times the text, a quadratic scan would take four hundred times as long
    assert seconds[14_000] < 60 * max(seconds[700], 0.2)
