"""Rule registry: plain data, compiled to literal-pattern columns by the operators.

Add a template, field, profile or signal by adding an entry and passing the
extended tuple to the operator. Patterns are lower case and matched without
regard to ASCII case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass



@dataclass(frozen=True)
class FieldRule:
    key: str
    label: str
    values: tuple[str, ...]
    labels: tuple[str, ...]
    guard: str | None = None
    check: str | Callable[[str], str] | None = None


@dataclass(frozen=True)
class Template:
    id: str
    name: str
    document_class: str
    anchors: tuple[str, ...]
    supports: tuple[str, ...]
    min_score: int
    fields: tuple[FieldRule, ...]


@dataclass(frozen=True)
class Profile:
    label: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class Signal:
    pattern: str
    sentence: str


# ---------------------------------------------------------------------------
# Fixed values. Everything below is prescribed: labels, patterns, thresholds.
# ---------------------------------------------------------------------------

ANCHOR_WEIGHT = 3

SUPPORTED_EXTENSIONS = ("PDF", "DOC", "DOCX", "XLS", "XLSX", "CSV", "PNG", "JPG", "JPEG", "TIF", "TIFF")
TEXT_EXTENSIONS = ("PDF", "PNG", "JPG", "JPEG", "TIF", "TIFF")
IMAGE_EXTENSIONS = ("PNG", "JPG", "JPEG")
REVIEW_STATUSES = ("Pending", "Approved", "Needs review", "Rejected")

PREVIEW_PAGES = 2

PDF_PARSER = "pdf-parse 2.4.5"
OCR_ENGINE = "tesseract.js 7.0.0"

UNASSIGNED_EIN_PREFIXES = (
    "00", "07", "08", "09", "17", "18", "19", "28", "29",
    "49", "69", "70", "78", "79", "89", "96", "97",
)

W9 = Template(
    id="irs-w9",
    name="IRS W-9",
    document_class="Tax form",
    anchors=(r"form w-9", r"request for taxpayer identification number and certification"),
    supports=(
        r"federal tax classification",
        r"backup withholding",
        r"exempt payee",
        r"taxpayer identification number",
    ),
    min_score=3,
    fields=(
        FieldRule(
            "name", "Name",
            (r"name \(as shown on your income tax return\)\s*[:\-]?\s*([^\n]{2,80})",),
            (r"name \(as shown on your income tax return\)",),
            guard=r"business name|federal tax classification|address",
        ),
        FieldRule(
            "businessName", "Business name / disregarded entity name",
            (r"business name(?:/disregarded entity name)?(?:, if different from above)?\s*[:\-]?\s*([^\n]{2,80})",),
            (r"business name(?:/disregarded entity name)?",),
            guard=r"federal tax classification|exemptions|address",
        ),
        FieldRule(
            "federalTaxClassification", "Federal tax classification",
            (r"federal tax classification\s*[:\-]?\s*([^\n]{2,80})",),
            (r"federal tax classification",),
            guard=r"llc|other|exemptions|address",
        ),
        FieldRule(
            "address", "Address",
            (r"address \(number, street, and apt\. or suite no\.\)\s*[:\-]?\s*([^\n]{2,80})",),
            (r"address \(number, street, and apt\. or suite no\.\)",),
            guard=r"city, state|requester",
        ),
        FieldRule(
            "cityStateZip", "City, state, and ZIP code",
            (r"city, state, and zip code\s*[:\-]?\s*([^\n]{2,80})",),
            (r"city, state, and zip code",),
            guard=r"list account|requester",
        ),
        FieldRule(
            "tinNumber", "Taxpayer identification number",
            (r"taxpayer identification number[^\n]*?[:\-]?\s*(\d{3}-\d{2}-\d{4}|\d{2}-\d{7}|\d{9})",),
            (r"taxpayer identification number|social security number|employer identification number",),
            check="tin",
        ),
    ),
)

FORM_1040 = Template(
    id="irs-1040",
    name="IRS 1040",
    document_class="Tax form",
    anchors=(r"form 1040\b", r"u\.?s\.? individual income tax return"),
    supports=(
        r"filing status",
        r"standard deduction",
        r"adjusted gross income",
        r"taxable income",
        r"dependents",
        r"internal revenue service",
    ),
    min_score=4,
    fields=(
        FieldRule(
            "taxYear", "Tax year",
            (
                r"(?:tax year|for the year)\s*[:\-]?\s*((?:19|20)\d{2})",
                r"form 1040[^\n]{0,40}?\b((?:19|20)\d{2})\b",
            ),
            (r"tax year|form 1040",),
            check="tax_year",
        ),
        FieldRule(
            "filingStatus", "Filing status",
            (
                r"filing status\s*[:.\-]?\s*((?:single|married filing jointly|married filing separately"
                r"|head of household|qualifying (?:surviving spouse|widow(?:er)?))[^\n]{0,30})",
            ),
            (r"filing status",),
            check="filing_status",
        ),
        FieldRule(
            "firstName", "First name and middle initial",
            (r"your first name and middle initial\s*[:\-]?\s*([^\n]{2,60})",),
            (r"your first name and middle initial",),
            guard=r"last name",
        ),
        FieldRule(
            "lastName", "Last name",
            (r"last name\s*[:\-]?\s*([^\n]{2,40})",),
            (r"last name",),
            guard=r"your social security number",
        ),
        FieldRule(
            "ssn", "Social Security number",
            (r"your social security number\s*[:\-]?\s*(\d{3}-?\d{2}-?\d{4})",),
            (r"your social security number",),
            check="tin",
        ),
        FieldRule(
            "homeAddress", "Home address",
            (r"home address \(number and street\)[^\n]*?[:\-]?\s*([^\n]{2,80})",),
            (r"home address \(number and street\)",),
            guard=r"city, town|apt\. no",
        ),
    ),
)

I9 = Template(
    id="uscis-i9",
    name="USCIS I-9",
    document_class="Employment verification form",
    anchors=(r"form i-9", r"employment eligibility verification"),
    supports=(
        r"department of homeland security",
        r"u\.?s\.? citizenship and immigration services",
        r"citizen of the united states",
        r"alien registration number",
        r"employee information and attestation",
    ),
    min_score=4,
    fields=(
        FieldRule(
            "lastName", "Last name (family name)",
            (r"last name \(family name\)\s*[:\-]?\s*([^\n]{2,40})",),
            (r"last name \(family name\)",),
            guard=r"first name",
        ),
        FieldRule(
            "firstName", "First name (given name)",
            (r"first name \(given name\)\s*[:\-]?\s*([^\n]{2,40})",),
            (r"first name \(given name\)",),
            guard=r"middle initial",
        ),
        FieldRule(
            "address", "Address (street number and name)",
            (r"address \(street number and name\)\s*[:\-]?\s*([^\n]{2,80})",),
            (r"address \(street number and name\)",),
            guard=r"apt\. number|city or town",
        ),
        FieldRule(
            "dateOfBirth", "Date of birth",
            (r"date of birth \(mm/dd/yyyy\)\s*[:\-]?\s*(\d{1,2}/\d{1,2}/\d{2,4})",),
            (r"date of birth \(mm/dd/yyyy\)",),
            check="date",
        ),
        FieldRule(
            "ssn", "U.S. Social Security number",
            (r"(?:u\.s\. )?social security number\s*[:\-]?\s*(\d{3}-?\d{2}-?\d{4})",),
            (r"social security number",),
            check="tin",
        ),
        FieldRule(
            "email", "Employee's email address",
            (r"employee'?s e-?mail address\s*[:\-]?\s*([^\s@]+@[^\s@]+\.[a-z]{2,})",),
            (r"employee'?s e-?mail address",),
            check="email",
        ),
        FieldRule(
            "phone", "Employee's telephone number",
            (r"employee'?s telephone number\s*[:\-]?\s*(\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4})",),
            (r"employee'?s telephone number",),
            check="phone",
        ),
    ),
)

CMS_1500 = Template(
    id="cms-1500",
    name="CMS-1500",
    document_class="Healthcare claim or intake form",
    anchors=(r"cms-1500", r"health insurance claim form"),
    supports=(
        r"medicare",
        r"medicaid",
        r"insured'?s i\.?d\.? number",
        r"diagnosis or nature of illness",
        r"federal tax i\.?d\.? number",
        r"total charge",
    ),
    min_score=4,
    fields=(
        FieldRule(
            "patientName", "Patient's name",
            (r"patient'?s name \(last name, first name, middle initial\)\s*[:\-]?\s*([^\n]{2,80})",),
            (r"patient'?s name",),
            guard=r"birth date|insured",
        ),
        FieldRule(
            "patientBirthDate", "Patient's birth date",
            (r"patient'?s birth date\s*[:\-]?\s*(\d{1,2}[ /\-]\d{1,2}[ /\-]\d{2,4})",),
            (r"patient'?s birth date",),
            check="date",
        ),
        FieldRule(
            "insuredName", "Insured's name",
            (r"insured'?s name \(last name, first name, middle initial\)\s*[:\-]?\s*([^\n]{2,80})",),
            (r"insured'?s name",),
            guard=r"patient|address",
        ),
        FieldRule(
            "insuredId", "Insured's ID number",
            (r"insured'?s i\.?d\.? number\s*[:\-]?\s*([a-z0-9][a-z0-9\-]{3,19})",),
            (r"insured'?s i\.?d\.? number",),
        ),
        FieldRule(
            "diagnosisCode", "Diagnosis code",
            (r"diagnosis[^\n]*?\b([a-tv-z]\d{2}(?:\.\d{1,4})?)\b",),
            (r"diagnosis or nature of illness",),
            check="icd10",
        ),
        FieldRule(
            "totalCharge", "Total charge",
            (r"total charge\s*[:$]?\s*\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\d+(?:\.\d{2})?)",),
            (r"total charge",),
            check="currency",
        ),
    ),
)

INVOICE = Template(
    id="generic-invoice",
    name="Invoice",
    document_class="Invoice or billing document",
    anchors=(r"invoice (?:number|no\.?|#)", r"tax invoice"),
    supports=(
        r"\binvoice\b",
        r"amount due",
        r"bill to",
        r"remit to",
        r"payment terms",
        r"due date",
        r"subtotal",
        r"purchase order",
    ),
    min_score=5,
    fields=(
        FieldRule(
            "invoiceNumber", "Invoice number",
            (r"invoice (?:number|no\.?|#)\s*[:#]?\s*([a-z0-9][a-z0-9\-/]{1,24})",),
            (r"invoice (?:number|no\.?|#)",),
        ),
        FieldRule(
            "invoiceDate", "Invoice date",
            (r"invoice date\s*[:\-]?\s*([^\n]{4,24})",),
            (r"invoice date",),
            check="date",
        ),
        FieldRule(
            "dueDate", "Due date",
            (r"due date\s*[:\-]?\s*([^\n]{4,24})",),
            (r"due date",),
            check="date",
        ),
        FieldRule(
            "paymentTerms", "Payment terms",
            (r"payment terms\s*[:\-]?\s*([^\n]{2,40})",),
            (r"payment terms",),
            check="payment_terms",
        ),
        FieldRule(
            "billTo", "Bill to",
            (r"bill to\s*[:\-]?\s*([^\n]{2,80})",),
            (r"bill to",),
            guard=r"ship to|remit to",
        ),
        FieldRule(
            "amountDue", "Amount due",
            (
                r"(?:amount due|balance due|total due)\s*[:\-]?\s*\$?\s*"
                r"(\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\d+(?:\.\d{2})?)",
            ),
            (r"amount due|balance due|total due",),
            check="currency",
        ),
    ),
)

TEMPLATES = (W9, FORM_1040, I9, CMS_1500, INVOICE)

PROFILES = (
    Profile(
        "Tax form",
        (r"irs\b", r"\bw-9\b", r"\b1040\b", r"\b1099\b", r"taxpayer", r"withholding", r"internal revenue"),
    ),
    Profile(
        "Employment verification form",
        (r"\bi-9\b", r"employment eligibility", r"employer", r"employee", r"citizenship", r"alien"),
    ),
    Profile(
        "Healthcare claim or intake form",
        (r"\bcms-1500\b", r"patient", r"provider", r"diagnosis", r"insurance", r"subscriber", r"treatment"),
    ),
    Profile(
        "Invoice or billing document",
        (r"invoice", r"amount due", r"bill to", r"subtotal", r"payment terms", r"purchase order"),
    ),
    Profile(
        "Contract or legal agreement",
        (r"agreement", r"party", r"effective date", r"terms and conditions", r"governing law", r"signature"),
    ),
    Profile("General form", (r"form", r"signature", r"name", r"address", r"date")),
)

SIGNALS = (
    Signal(r"social security|ssn|taxpayer identification|tin\b", "National identifier language detected"),
    Signal(r"patient|diagnosis|insurance|provider|treatment", "Healthcare-related language detected"),
    Signal(
        r"bank account|routing number|payment terms|amount due|invoice",
        "Financial or billing language detected",
    ),
    Signal(
        r"employee|employer|citizenship|employment eligibility|passport",
        "Employment verification language detected",
    ),
    Signal(r"signature|sign here|authorized signature", "Signature fields detected"),
    Signal(r"address|phone|email|contact", "Contact information fields detected"),
)

RESTRICTED_WORDS = (
    r"social security|ssn|taxpayer identification|patient|diagnosis|insurance|passport|date of birth|dob"
)
BUSINESS_WORDS = r"invoice|payment|employee|vendor|purchase order|contract"

NO_TEMPLATE_SUMMARY = "No structured template was detected from the available text."
