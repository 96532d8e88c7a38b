"""Field and identifier validators: SQL predicate text over a value expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from folioflow.functions.text import Sql, regex, trim

# Prescribed shapes.
TIN_SHAPE = r"^(?:\d{3}-\d{2}-\d{4}|\d{2}-\d{7}|\d{9})$"
CURRENCY_SHAPE = r"^\$?\s?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d{2})?$"
NUMERIC_DATE = r"^(\d{1,2})[/\- ](\d{1,2})[/\- ](?:\d{2}|\d{4})$"
MONTH_NAMES = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?"
    r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
MONTH_FIRST = rf"^{MONTH_NAMES}\.? \d{{1,2}},? (?:19|20)\d{{2}}$"
DAY_FIRST = rf"^\d{{1,2}} {MONTH_NAMES},? (?:19|20)\d{{2}}$"
ZIP_SHAPE = r"^\d{5}(?:-\d{4})?$"
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[a-z]{2,}$"
FILING_STATUS = (
    r"^(?:single|married filing jointly|married filing separately|head of household"
    r"|qualifying (?:surviving spouse|widow(?:er)?))\b"
)
ICD10_SHAPE = r"^[a-tv-z]\d{2}(?:\.\d{1,4})?$"
PAYMENT_TERMS = r"net\s*\d{1,3}|due (?:on|upon) receipt"
NUMBER_SHAPE = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _shaped(pattern: str, ignore_case: bool = False) -> Callable[[Sql], Sql]:
    compiled = regex(pattern, ignore_case)
    return lambda value: f"({trim(value)} rlike {compiled})"


is_tin = _shaped(TIN_SHAPE)
is_currency = _shaped(CURRENCY_SHAPE)
is_zip = _shaped(ZIP_SHAPE)
is_email = _shaped(EMAIL_SHAPE, True)
is_filing_status = _shaped(FILING_STATUS, True)
is_icd10 = _shaped(ICD10_SHAPE, True)


def is_date(value: Sql) -> Sql:
    """Numeric month/day/year within range (no month-length check), or a named-month form."""
    text, numeric = trim(value), regex(NUMERIC_DATE)

    def part(group: int) -> Sql:
        return f"try_cast(regexp_extract({text}, {numeric}, {group}) as int)"

    named = f"{text} rlike {regex(MONTH_FIRST, True)} or {text} rlike {regex(DAY_FIRST, True)}"
    return (
        f"(case when {text} rlike {numeric} then {part(1)} between 1 and 12 and {part(2)} between 1 and 31"
        f" else {named} end)"
    )


def is_phone(value: Sql) -> Sql:
    return f"(regexp_replace({value}, '[^0-9]', '') rlike '^1?[0-9]{{10}}$')"


def is_tax_year(value: Sql) -> Sql:
    """A whole number from 1990 to 2100, however it is spelled (``2024.0`` counts)."""
    text = trim(value)
    number = f"try_cast({text} as double)"
    return f"coalesce({text} rlike {regex(NUMBER_SHAPE)} and {number} = floor({number}) and {number} between 1990 and 2100, false)"


def is_payment_terms(value: Sql) -> Sql:
    return f"({value} rlike {regex(PAYMENT_TERMS, True)})"


VALIDATORS: dict[str, Callable[[Sql], Sql]] = {
    "tin": is_tin,
    "currency": is_currency,
    "date": is_date,
    "zip": is_zip,
    "phone": is_phone,
    "email": is_email,
    "tax_year": is_tax_year,
    "filing_status": is_filing_status,
    "icd10": is_icd10,
    "payment_terms": is_payment_terms,
}


def passes_luhn(digits: Sql) -> Sql:
    return f"(case when {digits} rlike {regex('^[0-9]{12,19}$')} then luhn_check({digits}) else false end)"


def is_card(digits: Sql) -> Sql:
    """13-19 digits, no leading zero, Luhn checksum."""
    return f"(case when {digits} rlike {regex('^[1-9][0-9]{12,18}$')} then luhn_check({digits}) else false end)"


def is_routing(digits: Sql) -> Sql:
    """Nine digits, an issued prefix range and the 3-7-1 checksum."""
    weighted = " + ".join(f"{w} * try_cast(substring({digits}, {i + 1}, 1) as int)" for i, w in enumerate((3, 7, 1) * 3))
    prefix = f"try_cast(left({digits}, 2) as int)"
    issued = f"({prefix} <= 12 or {prefix} between 21 and 32 or {prefix} between 61 and 72 or {prefix} = 80)"
    return f"(case when {digits} rlike {regex('^[0-9]{9}$')} then {issued} and ({weighted}) % 10 = 0 else false end)"


def is_ssn(text: Sql) -> Sql:
    """``ddd?dd?dddd`` with a plausible area, group and serial."""
    return (
        f"(left({text}, 3) not in ('000', '666') and left({text}, 3) < '900'"
        f" and substring({text}, 5, 2) <> '00' and right({text}, 4) <> '0000')"
    )


#: Validators and checksums by the name that SQL text calls.
FUNCTIONS: dict[str, Callable[[Sql], Sql]] = {f"is_{name}": check for name, check in VALIDATORS.items()} | {
    "passes_luhn": passes_luhn,
    "is_card": is_card,
    "is_routing": is_routing,
    "is_ssn": is_ssn,
}


def register(spark: SparkSession) -> None:
    """Make every entry of ``FUNCTIONS`` a temporary SQL function of one string; the optimizer inlines them."""
    for name, check in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(value string) returns boolean return {check('value')}")
