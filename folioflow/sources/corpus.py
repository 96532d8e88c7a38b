"""Corpora derived from the given tables.

``documents`` holds text that was extracted upstream. Business forms are rendered
from the keys of ``orders`` and ``customer``; the rendering is plain SQL on
integers, so any engine renders the same bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import basename, extension, let, normalize, struct
from folioflow.operators.classify import PARTS
from folioflow.operators.routing import inspect
from folioflow.session import dealt, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_custkey as c"), "k", "c")


def _customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_name as n"), "k", "n")


def _lines(*lines: str) -> str:
    return "concat(" + ", chr(10), ".join(lines) + ")"


_CENTS = "concat(1 + k % 9, ',', lpad(concat('', k % 1000), 3, '0'), '.', lpad(concat('', k % 100), 2, '0'))"
_MD = "concat(lpad(concat('', 1 + k % 12), 2, '0'), '/', lpad(concat('', 1 + k % 28), 2, '0'))"

INVOICE_SQL = _lines(
    "'INVOICE'",
    "concat('Invoice Number: INV-', k)",
    f"concat('Invoice Date: ', case when k % 7 = 0 then '44/05' else {_MD} end, '/2026')",
    "case when k % 19 = 0 then 'Ship promptly'"
    f" when k % 29 = 0 then 'Due Date: April 2, 2026' else concat('Due Date: ', {_MD}, '/2026') end",
    "case when k % 13 = 0 then 'Payment Terms: Prompt payment'"
    " when k % 17 = 0 then 'Payment Terms: due on receipt'"
    " else concat('Payment Terms: Net ', 15 + 15 * (k % 3)) end",
    "case when k % 31 = 0 then concat('Bill To:', chr(10), 'Remit To: Lockbox ', k) else concat('Bill To: Customer ', c) end",
    "concat('Subtotal: $', 100 + k % 9000, '.00')",
    "case when k % 23 = 0 then concat('Questions: billing', k % 50, '@example.com or (628) 555-',"
    " lpad(concat('', k % 10000), 4, '0')) else 'Thank you' end",
    f"case when k % 11 = 0 then 'Amount Due:' else concat('Amount Due: $', {_CENTS}) end",
)

W9_SQL = _lines(
    "'Form W-9'",
    "'Request for Taxpayer Identification Number and Certification'",
    "case when k % 3 = 0 then 'Name (as shown on your income tax return)'"
    " else concat('Name (as shown on your income tax return): ', n) end",
    "concat('Business name/disregarded entity name, if different from above: Acme ', k, ' Ltd')",
    "case when k % 4 = 0 then 'Federal tax classification: LLC' else 'Federal tax classification: C Corporation' end",
    "concat('Address (number, street, and apt. or suite no.): ', k, ' Main Street')",
    "concat('City, state, and ZIP code: Springfield, IL ', 62700 + k % 100)",
    "case when k % 7 = 1 then 'Taxpayer Identification Number'"
    " else concat('Taxpayer Identification Number: ', case when k % 7 = 0 then '07' else '12' end, '-',"
    " lpad(concat('', 3000000 + k % 1000000), 7, '0')) end",
)

FORM_1040_SQL = _lines(
    "'Form 1040'",
    "'U.S. Individual Income Tax Return'",
    "'Internal Revenue Service'",
    "case when k % 4 = 0 then 'Tax year: 1901' when k % 4 = 1 then 'For the year 2024' else 'Taxable income' end",
    "concat('Filing status: ', case when k % 3 = 0 then 'Married filing jointly'"
    " when k % 3 = 1 then 'Single' else 'Undecided' end)",
    "concat('Your first name and middle initial: Robin ', case when k % 2 = 0 then 'A' else 'B' end)",
    "concat('Last name: Person ', k)",
    "concat('Your social security number: ', case when k % 6 = 0 then '123-456789'"
    " else concat('417-38-', lpad(concat('', k % 10000), 4, '0')) end)",
    "concat('Home address (number and street): ', k, ' Quarry Lane')",
    "'Standard deduction'",
    "'Adjusted gross income'",
)

I9_SQL = _lines(
    "'Form I-9'",
    "'Employment Eligibility Verification'",
    "'Department of Homeland Security'",
    "'U.S. Citizenship and Immigration Services'",
    "concat('Last Name (Family Name): Okafor', k)",
    "case when k % 3 = 0 then 'First Name (Given Name)' else 'First Name (Given Name): Lena' end",
    "case when k % 4 = 1 then 'Date of birth unknown' else concat('Date of Birth (mm/dd/yyyy): ',"
    f" case when k % 4 = 0 then '04/99' else {_MD} end, '/1961') end",
    "concat('U.S. Social Security Number: 417-', lpad(concat('', k % 100), 2, '0'), '-', lpad(concat('', k % 10000), 4, '0'))",
    "concat('Employee''s E-mail Address: lena.okafor', k, '@example.com')",
    "case when k % 7 = 0 then 'Employee''s Telephone Number: 555-12' else"
    " concat('Employee''s Telephone Number: (628) 555-', lpad(concat('', k % 10000), 4, '0')) end",
)

CMS_SQL = _lines(
    "'Health Insurance Claim Form'",
    "'CMS-1500'",
    "'Medicare Medicaid Tricare'",
    "concat('Patient''s Name (Last Name, First Name, Middle Initial): Brandt', k, ', Milo, R')",
    f"concat('Patient''s Birth Date: ', case when k % 5 = 3 and k % 4 = 0 then '13 45' else {_MD} end, ' 1975')",
    "concat('Insured''s Name (Last Name, First Name, Middle Initial): Brandt', k, ', Ilse')",
    "concat('Insured''s I.D. Number: KT7-', 310000 + k % 9999)",
    "case when k % 6 = 0 then 'Diagnosis or Nature of Illness or Injury: U07.1'"
    " else concat('Diagnosis or Nature of Illness or Injury: J45.', k % 100) end",
    f"case when k % 9 = 0 then 'Total Charge:' else concat('Total Charge: $', {_CENTS}) end",
)

MEMO_SQL = _lines(
    "concat('Internal memo ', k)",
    "concat('Card on file: 4532 7718 0946 235', case when k % 2 = 0 then '6' else '7' end,"
    " case when k % 3 = 0 then ' 314077266' else '' end)",
    "concat('Routing number ', case when k % 3 = 0 then '314077267' else '314077266' end, ' for the account')",
    "concat('Identifiers ', case when k % 4 = 0 then '900-12-3456' else '417-38-6120' end,"
    " case when k % 7 = 0 then ' 417-38-7719 417 38 9052 417-38-5083 417-38-5083' else '' end)",
    "concat('EIN: ', case when k % 5 = 4 and k % 2 = 1 then '07' else '46' end, '-7041966')",
    "case when k % 9 = 4 then 'D.O.B. is 09/27/1961' when k % 9 = 5 then 'DOB 417-38-6120 or dob: 4-5-88' else 'No date given' end",
    "case when k % 11 = 4 then 'Reach r.lindt+x@post.example.co.uk, +1 (628) 555-0147' else"
    " concat('Agreement of the party, governing law', chr(13), chr(10)) end",
)

CUSTOMER_SQL = (
    f"case k % 5 when 0 then {W9_SQL} when 1 then {FORM_1040_SQL} when 2 then {I9_SQL}"
    f" when 3 then {CMS_SQL} else {MEMO_SQL} end"
)
FORM_TITLE_SQL = "case when k % 37 = 0 then 'SSN on request' when k % 41 = 0 then 'Passport copy' else '' end"


def _documents(raw: DataFrame) -> DataFrame:
    """Path, name, extension, size, fingerprint and normalised text of raw text rows."""
    return raw.selectExpr(
        "path", f"{basename('path')} as name", f"{extension('path')} as extension", f"{normalize('raw')} as text",
        "title", "subject", "bigint(octet_length(raw)) as size_bytes", "sha2(raw, 256) as sha256",
    )


def _raw_text(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(
        "concat('/corpus/', source, '/', doc_id, '.pdf') as path", "text as raw", "'' as title", "'' as subject"
    )


def describe_documents(docs: DataFrame) -> DataFrame:
    """Corpus columns of rows shaped like ``documents``, batch or streaming."""
    return _documents(_raw_text(docs))


def _raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_raw_text(table(spark, sf_dir, "documents")), "path")


def _raw_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _order_keys(spark, sf_dir), _customer_keys(spark, sf_dir)
    invoices = orders.selectExpr(
        "concat('/forms/invoice/', k, '.pdf') as path", f"{INVOICE_SQL} as raw", f"{FORM_TITLE_SQL} as title", "'' as subject"
    )
    staff = customers.selectExpr(
        "concat('/forms/customer/', k, '.pdf') as path", f"{CUSTOMER_SQL} as raw", f"{FORM_TITLE_SQL} as title", "'' as subject"
    )
    return invoices.unionByName(staff)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(_raw_documents(spark, sf_dir))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(_raw_forms(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every rendered form, whole text."""
    return _documents(_raw_documents(spark, sf_dir).unionByName(_raw_forms(spark, sf_dir)))


# What upstream text and OCR steps delivered, derived from the keys. ``k`` is the
# row key, ``raw`` its text; every inspection route occurs.
FILE_TYPE_SQL = "case k % 16 when 0 then 'png' when 1 then 'jpg' when 2 then 'tif' when 3 then 'docx' when 4 then 'csv' else 'pdf' end"
DELIVERED_SQL = {
    "is_file": "k % 41 <> 9",
    "extra_bytes": "case when k % 29 = 3 then 16777216 else 0 end",
    "total_pages": "1 + k % 7",
    "parse_error": "case when k % 37 = 5 then 'Invalid PDF structure' end",
    "parsed_text": "case when k % 37 = 5 then null when k % 23 = 3 then concat('Scan ', k) else raw end",
    "ocr_status": "case when k % 4 = 1 then 'Failed' else 'Completed' end",
    "ocr_text": "case when k % 4 = 1 or k % 8 = 2 then '' else raw end",
    "ocr_pages": "case when k % 4 = 1 then 0 when k % 7 < 2 then 1 + k % 7 else 3 end",
    "ocr_confidence": "case when k % 4 = 1 then null else 40 + k % 70 end",
    "ocr_note": "case when k % 4 = 1 then 'Local OCR failed: engine error' else '' end",
}
REVIEW_SQL = {
    "status": "case k % 5 when 0 then 'Approved' when 1 then 'Needs review' when 2 then 'Rejected' else 'Pending' end",
    "notes": "case when k % 6 = 0 then concat('checked by desk ', k % 9) else '' end",
    "reviewed_at": "case when k % 5 < 3 then cast(concat('2026-01-', lpad(concat('', 1 + k % 28), 2, '0'), ' 08:30:00') as timestamp) end",
}


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, k, raw, title, subject of every document, order form and customer form."""
    docs = spread(table(spark, sf_dir, "documents").selectExpr("0L as kind", "doc_id as k", "text as raw", "'' as title"), "k")
    orders, staff = _order_keys(spark, sf_dir), _customer_keys(spark, sf_dir)
    return docs.unionByName(
        orders.selectExpr("1L as kind", "k", f"{INVOICE_SQL} as raw", f"{FORM_TITLE_SQL} as title")
    ).unionByName(staff.selectExpr("2L as kind", "k", f"{CUSTOMER_SQL} as raw", f"{FORM_TITLE_SQL} as title"))


INBOX_SQL = f"concat('/inbox/', kind, '/', k, '.', {FILE_TYPE_SQL})"


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and content of the documents that lie in the inbox as files."""
    docs = _keyed(spark, sf_dir).filter(f"kind = 0 and {DELIVERED_SQL['is_file']}")
    return docs.selectExpr(f"{INBOX_SQL} as path", "raw as content")


def delivered(spark: SparkSession, sf_dir: str, *kinds: int) -> DataFrame:
    """Input of the inspection: one row per requested file, of these kinds or all."""
    rows = _keyed(spark, sf_dir).withColumn("path", F.expr(INBOX_SQL))
    rows = rows.filter(F.col("kind").isin(*kinds)) if kinds else rows
    d = DELIVERED_SQL
    return rows.selectExpr(
        "kind", "k", "k * 3 + kind as seq", "path", f"{d['is_file']} as is_file",
        f"bigint(octet_length(raw) + {d['extra_bytes']}) as size_bytes",
        "cast('2026-01-02 03:04:05' as timestamp) as modified_at", "sha2(raw, 256) as sha256",
        f"int({d['total_pages']}) as total_pages", f"{d['parsed_text']} as parsed_text", f"{d['parse_error']} as parse_error",
        "title", "'' as author", "'' as creator", "'' as producer", "'' as subject",
        f"{d['ocr_status']} as ocr_status", f"{d['ocr_text']} as ocr_text", f"int({d['ocr_pages']}) as ocr_pages",
        f"double({d['ocr_confidence']}) as ocr_confidence", "cast(null as bigint) as ocr_duration_ms", f"{d['ocr_note']} as ocr_note",
    )


def queue(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Inspected documents with their review: the working queue."""
    records = inspect(delivered(spark, sf_dir), keep=("kind", "k", "seq"), parts=parts)
    review = ", ".join(f"'{name}', {value}" for name, value in REVIEW_SQL.items())
    return records.withColumn("review", F.expr(f"named_struct({review})"))


# Requests, payloads, pages and saved records derived from the keys, in SQL both
# the jobs and their checks read.
REQUEST_SQL = (
    "case event_id % 9 when 0 then concat('  /in/u', user_id, '.pdf ') when 1 then concat('in/u', user_id, '.pdf')"
    " when 2 then '   ' when 3 then concat('/in/u', user_id, '.exe') when 4 then '/in/.hidden'"
    " when 5 then concat('/in/u', user_id, '.') when 6 then concat('/in/v', event_id, '.JPeG')"
    " else concat('/in/u', user_id, '.docx') end"
)
PAYLOAD_SQL = (
    "concat('# list ', page_id, chr(13), chr(10), url, chr(10), 'file:///inbox/', page_id % 50, '%20a+b.pdf', chr(13), chr(10),"
    " '  file://localhost/C:/scans/', page_id, '.tif?x=1 ', chr(10), chr(10), 'FILE:/r%C3%A9sum%C3%A9s/', page_id % 7, '.doc#p2')"
)
PAGE_STATUS_SQL = "case when (doc_id * 7 + page_no) % 11 = 0 then 'Failed' else 'Completed' end"
PAGE_TEXT_SQL = "case when (doc_id + page_no) % 6 = 0 then '' else line end"
PAGE_SCORE_SQL = (
    "case when (doc_id * 31 + page_no * 17) % 13 = 0 then null"
    " else cast((doc_id * 31 + page_no * 17) % 108 as double) + cast(doc_id % 2 as double) / 2 end"
)
SAVED_SQL = (
    "case when k % 17 = 0 then '{\"path\":' when k % 19 = 0 then '[1,2]' else concat("
    "'{\"path\":\"', case when k % 11 = 0 then 'relative/x.pdf' when k % 13 = 0 then concat('/w/', k, '.exe')"
    " when k % 23 = 0 then concat('/w/', k, '/') else concat('/w/', k, '.pdf') end,"
    " '\",\"name\":', case when k % 5 = 0 then '5' when k % 5 = 1 then 'null' else concat('\"Doc ', k, '\"') end,"
    " ',\"fileSizeBytes\":', case k % 4 when 0 then '-3' when 1 then '\"12\"' when 2 then '7.5' else concat('', k * 10) end,"
    " ',\"status\":\"', case k % 3 when 0 then 'Parsed locally' when 1 then 'Error' else 'Odd' end,"
    " '\",\"pageCount\":', case when k % 6 = 0 then 'null' else concat('', k % 9) end,"
    " ',\"review\":', case when k % 7 = 0 then '[]' else concat('{\"status\":\"', case k % 4 when 0 then 'Approved'"
    " when 1 then 'Rejected' when 2 then 'Bogus' else 'Needs review' end, '\",\"notes\":',"
    " case when k % 8 = 0 then '7' else '\"ok\"' end, ',\"reviewedAt\":', case when k % 9 = 0 then '12' else '\"2026-01-01T00:00:00.000Z\"' end, '}') end,"
    " ',\"analysis\":', case when k % 10 = 0 then '\"x\"' else concat('{\"documentClass\":\"Tax form\",\"sensitivity\":\"', case k % 3 when 0 then 'Internal'"
    " when 1 then 'Secret' else 'Restricted' end, '\",\"confidence\":', case k % 3 when 0 then '140' when 1 then '-3' else '55.5' end,"
    " ',\"signals\":[\"a\",5,\"b\",null]}') end,"
    " ',\"extraction\":{\"template\":', case when k % 2 = 0 then 'null' else '\"Invoice\"' end, ',\"fields\":[{\"key\":\"k1\",\"confidence\":200,"
    "\"status\":\"Extracted\",\"validation\":\"Valid\",\"value\":\"v', k, '\"},7,{\"label\":\"L\",\"status\":\"Odd\"}]}',"
    " ',\"pii\":{\"riskLevel\":\"High\",\"totalMatches\":2.5,\"findings\":[{\"category\":\"Phone number\",\"count\":3,"
    "\"examples\":[\"a\",\"b\",\"c\",\"d\"]},{\"category\":\"Unknown\"},null]}',"
    " ',\"ocr\":', case when k % 3 = 0 then '{}' else '{\"status\":\"Completed\",\"confidence\":88.5,\"pagesProcessed\":-1,\"preprocessing\":\"Scan cleanup\"}' end, '}') end"
)
STATE_SQL = (
    "case when k % 13 = 0 then 'not json' when k % 14 = 0 then '5' else concat('{\"filterValue\":', case when k % 3 = 0 then '9'"
    " else concat('\"needle ', k % 10, '\"') end, ',\"documents\":[{\"path\":\"/s/', k, '.pdf\"},3,{\"path\":\"bad\"},{\"path\":\"/s/', k, '.png\",\"name\":\"scan\"}]}') end"
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(f"{REQUEST_SQL} as path", "event_id as seq")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(f"{PAYLOAD_SQL} as uri_list", "page_id as seq")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as one page of an OCR table."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    # The page count travels inside the exploded element, so no row drags the whole text along.
    every = let(
        "split(text, '\\n')",
        lambda ls: f"transform({ls}, (line, at) -> {struct(page_no='at + 1', line='line', total_pages=f'size({ls})')})",
    )
    pages = docs.select("doc_id", F.explode(F.expr(every)).alias("p")).select("doc_id", "p.*")
    return pages.selectExpr(
        "doc_id", "total_pages", "page_no", f"{PAGE_STATUS_SQL} as status", f"{PAGE_TEXT_SQL} as text",
        f"{PAGE_SCORE_SQL} as confidence", "line",
    )


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review log: status changes, and notes left by viewers."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('/in/u', user_id, '.pdf') as path", "cast(ts as timestamp) as ts", "event_id",
        "case when event_type <> 'view' then case event_id % 4 when 0 then 'Pending' when 1 then 'Approved'"
        " when 2 then 'Needs review' else 'Rejected' end end as status",
        "case when event_type = 'view' then concat('note ', event_id) end as notes",
    )


def light_queue(spark: SparkSession, sf_dir: str, *kinds: int) -> DataFrame:
    """Queue rows without text: documents (0), order forms (1), customer forms (2)."""
    review = ", ".join(f"'{name}', {value}" for name, value in REVIEW_SQL.items())
    sources = {
        0: table(spark, sf_dir, "documents").selectExpr("0L as kind", "doc_id as k", "bigint(octet_length(text)) as size_bytes"),
        1: table(spark, sf_dir, "orders").selectExpr("1L as kind", "o_orderkey as k", "500 + o_orderkey % 977 as size_bytes"),
        2: table(spark, sf_dir, "customer").selectExpr("2L as kind", "c_custkey as k", "300 + c_custkey % 311 as size_bytes"),
    }
    rows = None
    for kind in kinds:
        rows = sources[kind] if rows is None else rows.unionByName(sources[kind])
    return rows.selectExpr(
        "k * 3 + kind as seq", f"concat('/inbox/', kind, '/', k, '.', {FILE_TYPE_SQL}) as path",
        f"concat(case when k % 2 = 0 then 'Doc' else 'doc' end, k % 100, '_', kind) as name", "size_bytes",
        "case when k % 6 = 0 then null else int(k % 40) end as page_count", f"named_struct({review}) as review",
    )


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved JSON record per customer, some malformed."""
    return _customer_keys(spark, sf_dir).selectExpr("k", f"{SAVED_SQL} as raw")


def saved_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved workspace (JSON text) per order, some malformed."""
    return _order_keys(spark, sf_dir).selectExpr("k", f"{STATE_SQL} as raw")
