"""Check SQL: for each registered query, an independent statement for DuckDB.

Only prescribed values (patterns, labels, formats) and the SQL that derives the
inputs from the tables are shared with the jobs. Matching, claims, scoring and
roll-ups are written separately here, relationally where the jobs use per-row
expressions. DuckDB's regex engine has no lookaround, so numeric detectors match
with their boundary characters and positions are corrected afterwards.
"""

from __future__ import annotations

from folioflow.functions import validators as v
from folioflow.functions.text import MIN_SIGNAL_CHARS, PREVIEW_CHARS, SPACE_CHARS, expand
from folioflow.operators.classify import FALLBACKS
from folioflow.operators.routing import NOTES
from folioflow.rules import (
    ANCHOR_WEIGHT,
    BUSINESS_WORDS,
    NO_TEMPLATE_SUMMARY,
    OCR_ENGINE,
    PDF_PARSER,
    PROFILES,
    RESTRICTED_WORDS,
    SIGNALS,
    SUPPORTED_EXTENSIONS,
    TEMPLATES,
    TEXT_EXTENSIONS,
    UNASSIGNED_EIN_PREFIXES,
)
from folioflow.sources import corpus as src


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(pattern: str, ignore_case: bool = True) -> str:
    body = expand(pattern, SPACE_CHARS, r"\b", "$")
    return q(f"(?i){body}" if ignore_case else body)


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {rx(pattern)})"


def count_hits(text: str, patterns: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"{has(text, p)}::int" for p in patterns) + ")"


def any_of(options: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(q, options)) + ")"


def norm(text: str) -> str:
    unix = f"replace({text}, chr(13) || chr(10), chr(10))"
    tails = f"regexp_replace({unix}, '[ \\t]+\\n', chr(10), 'g')"
    return f"trim(regexp_replace({tails}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {q(SPACE_CHARS)})"


def ext(path: str) -> str:
    base = f"regexp_extract({path}, '[^/]*$')"
    return f"coalesce(nullif(upper(regexp_extract({base}, '^.+\\.([^.]+)$', 1)), ''), 'FILE')"


def base(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


RAW_DOCS = "select '/corpus/' || source || '/' || doc_id || '.pdf' as path, text as raw, '' as title from documents"
RAW_FORMS = (
    f"select concat('/forms/invoice/', k, '.pdf'), {src.INVOICE_SQL}, {src.FORM_TITLE_SQL}"
    " from (select o_orderkey as k, o_custkey as c from orders)"
    f" union all select concat('/forms/customer/', k, '.pdf'), {src.CUSTOMER_SQL}, {src.FORM_TITLE_SQL}"
    " from (select c_custkey as k, c_name as n from customer)"
)


def texts(raw: str) -> str:
    return (
        f"raws as ({raw}), docs as materialized (select path, {ext('path')} as extension, raw, title, {norm('raw')} as body from raws),"
        " src as materialized (select path, extension, body, body || chr(10) || title || chr(10) as t from docs)"
    )


DOCS = texts(RAW_DOCS)
CORPUS = texts(f"{RAW_DOCS} union all {RAW_FORMS}")

# --- personal data ----------------------------------------------------------

# rank, category, pattern (group 1 = match plus an optional forbidden next
# character), condition that no such character was taken
_BOUNDED = (
    (1, "Bank routing number", r"[^\d.-](\d{9}[\d.-]?)", "length(m) = 9"),
    (2, "Social Security number", r"[^\d-](\d{3}[- ]\d{2}[- ]\d{4}[\d-]?)", "length(m) = 11"),
    (3, "Employer identification number", r"[^\d-](\d{2}-\d{7}[\d-]?)", "length(m) = 10"),
    (4, "Phone number", r"[^\d-]((?:\+1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}[\d-]?)", r"regexp_matches(m, '[ .-]\d{4}$')"),
)
_FREE = (
    (5, "Email address", r"\b[a-z0-9][a-z0-9._%+-]*@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z]{2,})+\b"),
    (6, "Date of birth", r"(?:date of birth|birth ?date|\bd\.?o\.?b\.?\b)[^\n\d]{0,40}\d{1,2}[/\- ]\d{1,2}[/\- ]\d{2,4}"),
)
_CARD_RUN = r"[\d -]{13,}"


def _located(name: str, pattern: str, text: str) -> str:
    """CTE of full matches with 0-based starts: lengths of gaps and matches before."""
    return (
        f"{name}_l as (select path, regexp_extract_all({text}, {pattern}) as ms, string_split_regex({text}, {pattern}) as gs"
        f" from src where regexp_matches({text}, {pattern})),"
        f" {name} as (select path, i, ms[i] as f, (coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)"
        f" + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::bigint as pos"
        f" from (select *, unnest(range(1, len(ms) + 1)) as i from {name}_l))"
    )


def luhn(d: str) -> str:
    digit = f"(substr({d}, length({d}) - i, 1))::int"
    doubled = f"case when i % 2 = 0 then {digit} when 2 * {digit} > 9 then 2 * {digit} - 9 else 2 * {digit} end"
    return f"(list_sum(list_transform(range(length({d})), lambda i: {doubled})) % 10 = 0)"


def aba(d: str) -> str:
    total = " + ".join(f"{w} * try_cast(substr({d}, {i + 1}, 1) as int)" for i, w in enumerate((3, 7, 1, 3, 7, 1, 3, 7, 1)))
    two = f"try_cast(left({d}, 2) as int)"
    return f"(({two} <= 12 or {two} between 21 and 32 or {two} between 61 and 72 or {two} = 80) and ({total}) % 10 = 0)"


def _pii() -> str:
    only = "regexp_replace(m, '[^0-9]', '', 'g')"
    parts = [_located("c0", q(_CARD_RUN), "t")]
    parts.append(
        "cards as (select path, pos, list_filter(list_transform(list_filter(range(1, length(f) + 1),"
        " lambda p: substr(f, p, 1) between '0' and '9' and (p = 1 or substr(f, p - 1, 1) = ' ')),"
        " lambda p: {'s': p, 'e': 0::bigint, 'm': regexp_extract(substr(f, p), '^((?:\\d[ -]?){12,18}\\d)(?: |$)', 1),"
        " 'ms': []::struct(s bigint, m varchar)[]}), lambda c: c.m <> '') as cs from c0)"
    )
    parts.append(
        "swept as (select path, pos, unnest(list_reduce(list_prepend({'s': 0::bigint, 'e': 0::bigint, 'm': '', 'ms': []::struct(s bigint, m varchar)[]}, cs),"
        " lambda a, c: case when c.s >= a.e then {'s': c.s, 'e': c.s + length(c.m), 'm': c.m,"
        " 'ms': list_append(a.ms, {'s': c.s, 'm': c.m})} else a end).ms) as x from cards where len(cs) > 0)"
    )
    unions = ["select path, 0 as rank, 'Credit card number' as category, pos + x.s - 1 as start_at, x.m as m from swept"]
    for rank, category, pattern, keep in _BOUNDED:
        parts.append(_located(f"c{rank}", q(pattern), "(' ' || t)"))
        # One blank was put in front of the text and one boundary character is in the match: they cancel.
        unions.append(
            f"select path, {rank}, {q(category)}, pos + length(f) - length(m) - 1, m from"
            f" (select path, pos, f, regexp_extract(f, {q(pattern)}, 1) as m from c{rank}) where {keep}"
        )
    for rank, category, pattern in _FREE:
        parts.append(_located(f"c{rank}", rx(pattern), "t"))
        unions.append(f"select path, {rank}, {q(category)}, pos, f from c{rank}")
    parts.append("cand0 as (" + " union all ".join(unions) + ")")
    parts.append(
        "cand as materialized (select path, rank, category, start_at, start_at + length(m) as stop_at, case rank"
        f" when 0 then length({only}) between 13 and 19 and {only}[1] <> '0' and {luhn(only)}"
        f" when 1 then {aba('m')}"
        " when 2 then left(m, 3) not in ('000', '666') and left(m, 3) < '900' and m[5:6] <> '00' and right(m, 4) <> '0000'"
        f" when 3 then left(m, 2) not in {any_of(UNASSIGNED_EIN_PREFIXES)} else true end as valid,"
        f" case rank when 0 then '**** ' || right({only}, 4) when 1 then '*****' || right(m, 4) when 2 then '***-**-' || right(m, 4)"
        " when 3 then '**-***' || right(m, 4) when 4 then '(***) ***-' || right(m, 4)"
        " when 5 then left(m, 1) || '***@' || split_part(m, '@', 2) else '**/**/****' end as masked from cand0)"
    )
    parts.append("a0 as materialized (select * from cand where valid and rank = 0)")
    for rank in range(1, 7):
        parts.append(
            f"a{rank} as materialized (select * from a{rank - 1} union all select c.* from cand c where valid and rank = {rank}"
            f" and not exists (select 1 from a{rank - 1} a where a.path = c.path and c.start_at < a.stop_at and c.stop_at > a.start_at))"
        )
    parts.append(
        "ex as (select path, rank, list(masked order by first_at) as examples from (select path, rank, masked, min(start_at) as first_at"
        " from a6 group by all) group by all),"
        " found as materialized (select path, rank, category, n, examples, row_number() over (partition by path order by n desc, rank) - 1 as position"
        f" from (select a.path, a.rank, category, count(*) as n, any_value(e.examples) as examples"
        " from a6 a join ex e on a.path = e.path and a.rank = e.rank group by all)),"
        " pii as materialized (select s.path, case when bool_or(rank in (0, 1, 2, 6)) then 'High' when count(rank) > 0 then 'Low' else 'None' end as risk_level,"
        " coalesce(sum(n), 0)::bigint as total_matches, coalesce(string_agg(category || ' x' || n || ': ' || array_to_string(examples, '; '), ' | ' order by position), '') as findings,"
        " coalesce(string_agg(category || ' (' || n || ')', ', ' order by position), '') as described"
        " from src s left join found f on f.path = s.path group by s.path)"
    )
    return ", ".join(parts)


PII = _pii()

# --- templates and classification -------------------------------------------


def _score(t) -> str:
    return f"({ANCHOR_WEIGHT} * {count_hits('t', t.anchors)} + {count_hits('t', t.supports)})"


SCORES = "scores as materialized (select path, extension, t, " + ", ".join(
    f"{_score(t)} as s{i}" for i, t in enumerate(TEMPLATES)
) + " from src)"
_QUALIFIED = [f"case when s{i} >= {t.min_score} then s{i} else -1 end" for i, t in enumerate(TEMPLATES)]
CHOICE = (
    f"tops as (select *, greatest({', '.join(_QUALIFIED)}) as top from scores),"
    " choice as materialized (select path, extension, t, case when top >= 0 then top end as score, case "
    + " ".join(f"when top >= 0 and s{i} = top and s{i} >= {t.min_score} then {i}" for i, t in enumerate(TEMPLATES))
    + " end as pick from tops)"
)


def check(name: str, value: str) -> str:
    """Validator ``name`` in DuckDB, over a trimmed value."""
    x = f"trim({value}, {q(SPACE_CHARS)})"
    shapes = {
        "tin": (v.TIN_SHAPE, False), "currency": (v.CURRENCY_SHAPE, False), "zip": (v.ZIP_SHAPE, False),
        "email": (v.EMAIL_SHAPE, True), "filing_status": (v.FILING_STATUS, True), "icd10": (v.ICD10_SHAPE, True),
    }
    if name in shapes:
        pattern, ignore = shapes[name]
        return f"regexp_matches({x}, {rx(pattern, ignore)})"
    if name == "date":
        numeric = rx(v.NUMERIC_DATE, False)
        month, day = (f"try_cast(regexp_extract({x}, {numeric}, {g}) as int)" for g in (1, 2))
        return (
            f"(case when regexp_matches({x}, {numeric}) then {month} between 1 and 12 and {day} between 1 and 31"
            f" else regexp_matches({x}, {rx(v.MONTH_FIRST)}) or regexp_matches({x}, {rx(v.DAY_FIRST)}) end)"
        )
    if name == "phone":
        d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
        return f"(length({d}) = 10 or (length({d}) = 11 and {d}[1] = '1'))"
    if name == "tax_year":
        n = f"try_cast({x} as double)"
        return f"coalesce(regexp_matches({x}, {rx(v.NUMBER_SHAPE, False)}) and {n} = floor({n}) and {n} between 1990 and 2100, false)"
    return f"regexp_matches({value}, {rx(v.PAYMENT_TERMS)})"


def _fields() -> str:
    selects = []
    for i, t in enumerate(TEMPLATES):
        for j, f in enumerate(t.fields):
            options = []
            for pattern in f.values:
                raw = f"regexp_extract(t, {rx(pattern)}, 1)"
                clean = f"trim(regexp_replace({raw}, {q('[' + SPACE_CHARS + ']+')}, ' ', 'g'), {q(SPACE_CHARS)})"
                guard = f" and not {has(clean, f.guard)}" if f.guard else ""
                options.append(f"case when {clean} <> ''{guard} then {clean} end")
            labelled = " or ".join(has("t", p) for p in f.labels)
            ok = check(f.check, "value") if f.check else "null"
            selects.append(
                f"select path, {i} as pick, {j} as ord, {q(f.key)} as key, {q(f.label)} as label, value, {ok} as ok, labelled"
                f" from (select path, coalesce({', '.join(options)}) as value, ({labelled}) as labelled from choice where pick = {i})"
            )
    names = " ".join(f"when {i} then {q(t.name)}" for i, t in enumerate(TEMPLATES))
    return (
        "fields0 as (" + " union all ".join(selects) + "),"
        f" fields as materialized (select path, pick, case pick {names} end as template, ord, key, label, coalesce(value, '') as value,"
        " (case when value is null then case when labelled then 36 else 0 end when ok then 84 when not ok then 40 else 68 end)::bigint as confidence,"
        " case when value is not null then 'Extracted' when labelled then 'Detected label' else 'Missing' end as status,"
        " case when value is null or ok is null then 'Not checked' when ok then 'Valid' else 'Suspect' end as validation from fields0),"
        " tallies as (select path, pick, any_value(template) as template, count(*) as n, count_if(status = 'Extracted') as e,"
        " count_if(validation = 'Valid') as ok, count_if(status = 'Detected label') as l from fields group by path, pick),"
        " extraction as materialized (select c.path, template, coalesce(n, 0) as n, case when template is null then " + q(NO_TEMPLATE_SUMMARY) +
        " when e > 0 then concat(template, ' template detected. ', e, ' of ', n, ' field value(s) extracted locally, ', ok,"
        " ' validated, and ', l, ' additional schema marker(s) confirmed.')"
        " else concat(template, ' template detected. ', l, ' schema marker(s) confirmed locally; value extraction stays conservative"
        " when field values are not clearly present.') end as summary from choice c left join tallies using (path))"
    )


FIELDS = _fields()
_CLASS = " ".join(f"when {i} then {q(t.document_class)}" for i, t in enumerate(TEMPLATES))
_PROFILE_HITS = ", ".join(f"{count_hits('t', p.patterns)} as h{i}" for i, p in enumerate(PROFILES))
_MOST = f"greatest({', '.join(f'h{i}' for i in range(len(PROFILES)))})"
_PROFILE = " ".join(f"when h{i} = most then {q(p.label)}" for i, p in enumerate(PROFILES))
KINDS = (
    f"profiled as (select *, {_MOST} as most from (select path, extension, score, pick, {_PROFILE_HITS} from choice)),"
    f" kinds as materialized (select path, case when pick is not null then case pick {_CLASS} end when most > 0 then case {_PROFILE} end"
    " when extension = 'PDF' then 'General PDF' else 'General document' end as document_class,"
    " (case when pick is not null then least(96, 60 + 6 * score) when most > 0 then least(96, 54 + 9 * most) else 42 end)::bigint as confidence from profiled)"
)
_SENTENCES = ", ".join(f"case when {has('t', s.pattern)} then {q(s.sentence)} end" for s in SIGNALS)
_FLAG = "'Local PII scan flagged: ' || p.described"
RECORDS = (
    f"words as (select s.path, risk_level, total_matches, findings, list_filter([case when risk_level = 'High' then {_FLAG} end,"
    f" {_SENTENCES}, case when risk_level = 'Low' then {_FLAG} end], lambda x: x is not null) as signals,"
    f" case when risk_level = 'High' or {has('t', RESTRICTED_WORDS)} then 'Restricted'"
    f" when risk_level = 'Low' or {has('t', BUSINESS_WORDS)} then 'Internal' else 'Standard' end as sensitivity"
    " from src s join pii p using (path)),"
    " records as materialized (select w.path, document_class, sensitivity, confidence, 'Likely ' || lower(document_class) || '. ' || sensitivity"
    " || ' handling recommended.' || case when len(signals) > 0 then ' ' || signals[1] || '.' else '' end as summary,"
    " array_to_string(signals, ' | ') as signals, e.template, e.summary as extraction_summary, e.n as fields, risk_level, total_matches, findings"
    " from words w join kinds k using (path) join extraction e using (path))"
)
ALL = ", ".join([PII, SCORES, CHOICE, FIELDS, KINDS, RECORDS])

# --- inspection -------------------------------------------------------------

_D = src.DELIVERED_SQL
_R = src.REVIEW_SQL
KEYED = (
    "keyed as (select 0::bigint as kind, doc_id as k, text as raw, '' as title from documents"
    f" union all select 1, k, {src.INVOICE_SQL}, {src.FORM_TITLE_SQL} from (select o_orderkey as k, o_custkey as c from orders)"
    f" union all select 2, k, {src.CUSTOMER_SQL}, {src.FORM_TITLE_SQL} from (select c_custkey as k, c_name as n from customer))"
)
_SIGNAL = "length(regexp_replace(body, '[^A-Za-z0-9]', '', 'g'))"
DELIVERED = (
    f"{KEYED}, got0 as (select k, k * 3 + kind as seq, concat('/inbox/', kind, '/', k, '.', {src.FILE_TYPE_SQL}) as path, {_D['is_file']} as is_file,"
    f" strlen(raw) + {_D['extra_bytes']} as size_bytes, sha256(raw) as sha256, {_D['total_pages']} as total_pages, {_D['parsed_text']} as parsed_text,"
    f" {_D['parse_error']} as parse_error, title, {_D['ocr_status']} as ocr_status, {_D['ocr_text']} as ocr_text, {_D['ocr_pages']} as ocr_pages,"
    f" ({_D['ocr_confidence']})::double as ocr_confidence, {_D['ocr_note']} as ocr_note,"
    f" {_R['status']} as review_status, {_R['notes']} as notes, {_R['reviewed_at']} as reviewed_at from keyed),"
    f" got1 as (select *, {ext('path')} as extension, {norm('coalesce(parsed_text, ' + q('') + ')')} as body, {norm('ocr_text')} as ocr_body from got0),"
    " got as materialized (select *, case when not is_file then 'l' when extension in ('PNG', 'JPG', 'JPEG') then"
    " case when ocr_status = 'Completed' then 'a' when ocr_status = 'Failed' then 'c' else 'b' end"
    " when extension in ('TIF', 'TIFF') then 'd' when extension <> 'PDF' then 'e'"
    " when parse_error is not null then case when ocr_body <> '' then 'j' else 'k' end"
    f" when {_SIGNAL} >= {MIN_SIGNAL_CHARS} then 'g' when ocr_body <> '' then 'h' else 'i' end as route from got1),"
    " docs as materialized (select path, extension, case when route in ('a', 'h', 'j') then ocr_body when route in ('g', 'i') then body else '' end as body,"
    " case when route in ('g', 'h', 'i') then title else '' end as title from got),"
    " src as materialized (select path, extension, body, body || chr(10) || title || chr(10) as t from docs where body <> '')"
)


def _fixed(index: int) -> str:
    """Column ``index`` of the fallback records by extension."""
    def one(kind: str) -> str:
        value = FALLBACKS[kind][index]
        return q(value) if isinstance(value, str) else str(value)

    return f"case when g.extension = 'PDF' then {one('pdf')} when g.extension in {any_of(TEXT_EXTENSIONS)} then {one('scan')} else {one('other')} end"


_BASE_EXTRACTION = q("Structured extraction is available only when local text inspection succeeds.")
_MISSING = q(NOTES["not_file"])
_FAILED = "concat('Local PDF parse failed: ', parse_error)"
_OCR_NOTE = (
    "case when ocr_status = 'Completed' then concat('OCR fallback completed locally on ', ocr_pages, ' page(s) out of ', total_pages,"
    " '. Scan cleanup was applied before recognition.') else ocr_note end"
)
_FIRST = "concat('Parsed locally. Preview generated from the first ', least(total_pages, 2), ' page(s).')"
_IMG = f"{q(NOTES['image_done'])} || case when ocr_body = '' then {q(NOTES['no_text'])} else '' end"
INSPECTED = (
    f"{DELIVERED}, {ALL}, inspected as materialized (select g.path, {base('g.path')} as name, g.seq, g.extension, route, review_status, notes, reviewed_at, title,"
    " case when route = 'l' then 0 else size_bytes end::bigint as size_bytes, case when route = 'l' then '' else sha256 end as sha256,"
    " case when route in ('a','g','h','i','j') then 'Parsed locally' when route in ('c','k','l') then 'Error' else 'Metadata only' end as status,"
    f" case when route in ('a','b','c','j') then {q(OCR_ENGINE)} when route = 'g' or (route = 'i' and ocr_status = 'Failed') then {q(PDF_PARSER)}"
    f" when route in ('h','i','k') then {q(PDF_PARSER + ' + ' + OCR_ENGINE)} else 'Filesystem only' end as parser,"
    f" case route when 'a' then {_IMG} when 'b' then coalesce(ocr_note, 'OCR not run.') when 'c' then ocr_note when 'd' then {q(NOTES['tiff'])}"
    f" when 'e' then {q(NOTES['default'])} when 'f' then 'PDF exceeds the local parse limit of 15.00 MB. Metadata only was captured.'"
    f" when 'g' then {_FIRST} when 'j' then concat('Primary PDF text parsing failed, but OCR fallback recovered text from ', ocr_pages,"
    " ' page(s). Original parser error: ', parse_error)"
    f" when 'k' then {_FAILED} || ' ' || {_OCR_NOTE} when 'l' then {_MISSING} else case when ocr_status = 'Completed'"
    " then concat('Parsed locally. PDF text extraction was weak, so OCR fallback was run on ', ocr_pages, ' page(s) out of ', total_pages, '.')"
    f" else {_FIRST} end end as note,"
    " case when route = 'a' then 1 when route in ('g','h','i','j') then total_pages end::bigint as page_count,"
    " case when route = 'a' then 1 when route = 'g' or (route = 'i' and ocr_status = 'Failed') then least(total_pages, 2)"
    " when route in ('h','i','j') then greatest(1, ocr_pages) else 0 end::bigint as preview_pages,"
    " case when route in ('a','j') then length(ocr_body) when route in ('g','i') then length(parsed_text)"
    " when route = 'h' then greatest(length(parsed_text), length(ocr_body)) else 0 end::bigint as extracted_characters,"
    " case when route in ('a','c','h','i','j','k') then ocr_status when route in ('b','f','g') then 'Skipped' else 'Not run' end as ocr_status,"
    " case when route in ('a','b','c') then 'Image OCR' when route in ('f','g','h','i','j','k') then 'PDF OCR fallback' end as ocr_source,"
    f" case route when 'a' then {_IMG} when 'b' then coalesce(ocr_note, 'OCR not run.') when 'c' then ocr_note when 'f' then {q(NOTES['too_large_ocr'])}"
    f" when 'g' then {q(NOTES['not_required'])} when 'd' then 'OCR not run.' when 'e' then 'OCR not run.' when 'l' then 'OCR not run.' else {_OCR_NOTE} end as ocr_note,"
    " case when route in ('a','h','i','j','k') and ocr_confidence is not null then least(greatest(floor(ocr_confidence + 0.5), 0), 100) end::bigint as ocr_confidence,"
    " case when route = 'a' then 1 when route in ('c','h','i','j','k') then ocr_pages else 0 end::bigint as ocr_pages,"
    " case when route in ('a','b','c') then 1 when route in ('h','i','j','k') then greatest(1, total_pages) end::bigint as ocr_page_limit,"
    " case when route in ('a','h','j') then ocr_body when route in ('g','i') then body else '' end as content,"
    " case when route in ('a','h','i','j') then left(ocr_body, " + str(PREVIEW_CHARS) + ") else '' end as ocr_preview,"
    f" coalesce(r.document_class, case route when 'c' then 'Image OCR failure' when 'f' then 'PDF over parse limit' when 'k' then 'PDF parse failure'"
    f" when 'l' then 'Unavailable' when 'd' then 'Unparsed file' when 'e' then 'Unparsed file' else {_fixed(0)} end) as document_class,"
    f" coalesce(r.sensitivity, case when route in ('a','b','g','h','i','j') then {_fixed(1)} else 'Unknown' end) as sensitivity,"
    f" coalesce(r.confidence, case when route in ('a','b','g','h','i','j') then {_fixed(2)} else 0 end)::bigint as confidence,"
    f" coalesce(r.summary, case route when 'c' then ocr_note when 'f' then 'The file is too large for safe local parsing in the current desktop flow.'"
    f" when 'k' then {_FAILED} when 'l' then {_MISSING} when 'd' then {q(FALLBACKS['other'][3])} when 'e' then {q(FALLBACKS['other'][3])} else {_fixed(3)} end) as summary,"
    " coalesce(r.signals, case when route = 'f' then 'File size exceeded local parse limit' else '' end) as signals, r.template,"
    f" coalesce(r.extraction_summary, case route when 'f' then 'Structured extraction is skipped when a file exceeds the local parse limit.'"
    f" when 'k' then 'Structured extraction was skipped because the PDF could not be parsed locally.' when 'l' then {_MISSING}"
    f" when 'c' then {_BASE_EXTRACTION} when 'd' then {_BASE_EXTRACTION} when 'e' then {_BASE_EXTRACTION} else {_fixed(4)} end) as extraction_summary,"
    " coalesce(r.risk_level, 'None') as risk_level, coalesce(r.total_matches, 0)::bigint as total_matches"
    " from got g left join records r on r.path = g.path)"
)
COPIES = "copies as (select sha256, count(*) as copies from inspected group by sha256)"


def light(*kinds: int) -> str:
    tables = {
        0: "select 0::bigint as kind, doc_id as k, strlen(text) as size_bytes from documents",
        1: "select 1, o_orderkey, 500 + o_orderkey % 977 from orders",
        2: "select 2, c_custkey, 300 + c_custkey % 311 from customer",
    }
    rows = " union all ".join(tables[kind] for kind in kinds)
    return (
        f"(select k * 3 + kind as seq, concat('/inbox/', kind, '/', k, '.', {src.FILE_TYPE_SQL}) as path,"
        " concat(case when k % 2 = 0 then 'Doc' else 'doc' end, k % 100, '_', kind) as name, size_bytes::bigint as size_bytes,"
        f" case when k % 6 = 0 then null else k % 40 end::bigint as page_count, {_R['status']} as review_status, {_R['notes']} as notes,"
        f" {_R['reviewed_at']} as reviewed_at from ({rows}) as r(kind, k, size_bytes))"
    )


_FLAT = f"path, name, seq, size_bytes, page_count, review_status, notes, {iso('reviewed_at')} as reviewed_at"
PAGES = (
    "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as page_no,"
    " len(string_split(text, chr(10))) as total_pages from documents),"
    f" pages_in as (select doc_id, page_no, total_pages, line, {src.PAGE_STATUS_SQL} as status, {norm(src.PAGE_TEXT_SQL)} as text,"
    f" case when ({src.PAGE_SCORE_SQL}) is not null then least(greatest(floor({src.PAGE_SCORE_SQL} + 0.5), 0), 100) end as score from lines)"
)


def _json_text(doc: str, path: str, default: str) -> str:
    return f"case when json_type({doc}, '$.{path}') = 'VARCHAR' then json_extract_string({doc}, '$.{path}') else {default} end"


def _json_number(doc: str, path: str, default: str = "0") -> str:
    kinds = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
    return f"case when json_type({doc}, '$.{path}') in {kinds} then json_extract_string({doc}, '$.{path}')::double else {default} end"


def _json_choice(doc: str, path: str, options: tuple[str, ...], default: str) -> str:
    found = _json_text(doc, path, q(default))
    return f"case when {found} in {any_of(options)} then {found} else {q(default)} end"


def _percent(x: str) -> str:
    return f"least(greatest({x}, 0), 100)::double"


def _workspace() -> str:
    t, n, c = _json_text, _json_number, _json_choice
    field = "concat_ws('/', " + ", ".join([
        t("f", "key", "'field'"), t("f", "label", "'Field'"), t("f", "value", "''"), f"{_percent(n('f', 'confidence'))}::varchar",
        c("f", "status", ("Extracted", "Detected label", "Missing"), "Missing"), c("f", "validation", ("Valid", "Suspect"), "Not checked"),
    ]) + ")"
    items = "coalesce(json_extract(d, '$.{}')::json[], []::json[])"
    fields = f"list_transform(list_filter({items.format('extraction.fields')}, lambda f: json_type(f) = 'OBJECT'), lambda f: {field})"
    examples = "list_transform(list_filter(json_extract(f, '$.examples')::json[], lambda e: json_type(e) = 'VARCHAR'), lambda e: e->>'$')"
    known = any_of(("Credit card number", "Bank routing number", "Social Security number", "Employer identification number", "Phone number", "Email address", "Date of birth"))
    finding = f"concat({t('f', 'category', q(''))}, ' x', greatest(0, floor({n('f', 'count')} + 0.5))::double::varchar, ': ', array_to_string({examples}, '; '))"
    findings = (
        f"list_transform(list_filter({items.format('pii.findings')}, lambda f: json_type(f) = 'OBJECT' and {t('f', 'category', q(''))} in {known}),"
        f" lambda f: {finding})"
    )
    signals = f"list_transform(list_filter(case when json_type(d, '$.analysis.signals') = 'ARRAY' then {items.format('analysis.signals')} else []::json[] end, lambda e: json_type(e) = 'VARCHAR'), lambda e: e->>'$')"
    return (
        f"with j as (select k, try_cast(raw as json) as d from (select k, {src.SAVED_SQL} as raw from (select c_custkey as k from customer)) where json_valid(raw)),"
        f" o as (select k, d, {t('d', 'path', q(''))} as path from j where json_type(d) = 'OBJECT'),"
        f" p as (select k, d, path, regexp_extract(rtrim(path, '/'), '[^/]*$') as b, {ext('rtrim(path, ' + q('/') + ')')} as extension from o where path[1] = '/')"
        f" select k, {t('d', 'id', 'path')} as id, path, {t('d', 'name', 'b')} as name, extension, greatest(0, {n('d', 'fileSizeBytes')})::double as size_bytes,"
        f" ({n('d', 'pageCount', 'null')})::double as page_count, {c('d', 'status', ('Parsed locally', 'Metadata only', 'Error'), 'Metadata only')} as status,"
        f" {t('d', 'parser', q('Filesystem only'))} as parser, {c('d', 'review.status', ('Approved', 'Needs review', 'Rejected'), 'Pending')} as review_status,"
        f" {t('d', 'review.notes', q(''))} as notes, {t('d', 'review.reviewedAt', 'null')} as reviewed_at,"
        f" {t('d', 'analysis.documentClass', q('Unavailable'))} as document_class,"
        f" {c('d', 'analysis.sensitivity', ('Restricted', 'Internal', 'Standard'), 'Unknown')} as sensitivity, {_percent(n('d', 'analysis.confidence'))} as confidence,"
        f" {t('d', 'analysis.summary', q('No local analysis was available for this document.'))} as summary, array_to_string({signals}, ',') as signals,"
        f" {t('d', 'extraction.template', 'null')} as template, array_to_string({fields}, ' | ') as fields,"
        f" {c('d', 'pii.riskLevel', ('High', 'Low'), 'None')} as risk_level, greatest(0, floor({n('d', 'pii.totalMatches')} + 0.5))::double as total_matches,"
        f" array_to_string({findings}, ' | ') as findings, {c('d', 'ocr.status', ('Completed', 'Skipped', 'Failed', 'Not run'), 'Not run')} as ocr_status,"
        f" case when json_type(d, '$.ocr.confidence') is null then null else {_percent('floor(' + n('d', 'ocr.confidence') + ' + 0.5)')} end as ocr_confidence,"
        f" greatest(0, {n('d', 'ocr.pagesProcessed')})::double as ocr_pages, {c('d', 'ocr.preprocessing', ('Scan cleanup',), 'None')} as preprocessing"
        f" from p where extension in {any_of(SUPPORTED_EXTENSIONS)}"
    )


def _rolled() -> str:
    bad = f"(select doc_id, min(page_no) as stop from pages_in where status <> 'Completed' and page_no <= greatest(total_pages, 1) group by doc_id)"
    return (
        f"with {PAGES}, budget as (select p.*, b.stop from pages_in p left join {bad} b using (doc_id)),"
        " rolled as (select doc_id, max(total_pages) as total_pages, any_value(stop) as stop, count_if(stop is null or page_no < stop) as done,"
        " string_agg(case when (stop is null or page_no < stop) and text <> '' then concat('Page ', page_no, chr(10), text) end, chr(10) || chr(10) order by page_no) as joined,"
        " avg(case when stop is null or page_no < stop then score end) as mean from budget group by doc_id),"
        " final as (select *, stop is not null and joined is null as failed from rolled)"
        f" select doc_id, total_pages::bigint as total_pages, greatest(total_pages, 1)::bigint as page_limit, done as pages_processed,"
        " case when failed then 'Failed' else 'Completed' end as status, case when failed then '' else trim(coalesce(joined, ''), " + q(SPACE_CHARS) + ") end as text,"
        " case when not failed then floor(mean + 0.5) end::bigint as confidence,"
        " length(case when failed then '' else trim(coalesce(joined, ''), " + q(SPACE_CHARS) + ") end)::bigint as extracted_characters from final"
    )


def _gray() -> str:
    byte = "('0x' || b[3 * i + {}])::int"
    lum = f"({byte.format(3)} * 0.299::double + {byte.format(2)} * 0.587::double + {byte.format(1)} * 0.114::double)"
    sharp = f"least(greatest(({lum} - 128) * 1.45::double + 128, 0), 255)"
    cut = "case when x <= 92 then 0 when x >= 188 then 255 else round_even(x, 0) end::int"
    return (
        "with h as (select doc_id, regexp_extract_all(hex(encode(text)) || '0000', '..') as b, (strlen(text) + 2) // 3 as n from documents),"
        f" g as (select doc_id, n, list_transform(list_transform(range(n), lambda i: {sharp}), lambda x: {cut}) as px from h)"
        " select doc_id, n as pixels, sha256(array_to_string(list_transform(px, lambda p: printf('%02X', p)), '')) as gray_sha256 from g"
    )


def _csv_cell(value: str) -> str:
    text = f"coalesce(({value})::varchar, '')"
    safe = f"(case when regexp_matches({text}, '^[=+@\\t-]') then '''' || {text} else {text} end)"
    return f"case when regexp_matches({safe}, '[\",\\n\\r]') then '\"' || replace({safe}, '\"', '\"\"') || '\"' else {safe} end"


_CSV = " || ',' || ".join(
    _csv_cell(x) for x in (
        "name", "extension", "size_bytes", "page_count", "status", "document_class", "sensitivity", "confidence", "risk_level", "total_matches",
        "template", "review_status", iso("reviewed_at"), "ocr_status", "case when copies > 1 then 'Yes' else 'No' end", "i.sha256", "path",
    )
)
_PIECES = ", ".join(
    f"coalesce({x}, '')" for x in (
        "i.name", "extension", "i.path", "parser", "note", "ocr_status", "ocr_source",
        f"case when route in ('a','b','c','h','i','j','k') then {q(OCR_ENGINE)} end", "ocr_note", "ocr_preview", "content",
        "case when route in ('g','h','i') then title else '' end", "''", "''", "''", "''", "document_class", "sensitivity", "summary",
        "replace(signals, ' | ', ' ')", "template", "extraction_summary", "ftext", "risk_level", "ctext", "review_status", "notes",
    )
)
_MERGE = f"with q as {light(0, 1)}, n as (select * replace (size_bytes + 1 as size_bytes) from {light(0, 2)})"
_STAGED = (
    "select n.path, n.name, n.seq, n.size_bytes, coalesce(q.review_status, 'Pending') as review_status, coalesce(q.notes, '') as notes, q.reviewed_at as reviewed_at, 1::bigint as batch_rank"
    " from n left join q using (path) union all select path, name, seq, size_bytes, review_status, notes, reviewed_at, 0 from q where path not in (select path from n)"
)
_EVENTS = (
    "select concat('/in/u', user_id, '.pdf') as path, ts, event_id, case when event_type <> 'view' then case event_id % 4 when 0 then 'Pending' when 1 then 'Approved'"
    " when 2 then 'Needs review' else 'Rejected' end end as status, case when event_type = 'view' then concat('note ', event_id) end as notes from events"
)
_SIZE = "case when n < 1024 then n || ' B' when n < 1048576 then round(n::decimal(18,4) / 1024, 1)::decimal(18,1) || ' KB' else round(n::decimal(18,4) / 1048576, 2)::decimal(18,2) || ' MB' end"

ORACLES: dict[str, str] = {
    "text_normalize": f"with {DOCS} select path, length(body) as chars, sha256(body) as text_sha256, sha256(left(body, {PREVIEW_CHARS})) as preview_sha256 from docs",
    "fingerprints": f"with {CORPUS} select path, extension, strlen(raw) as size_bytes, sha256(raw) as sha256 from docs",
    "ocr_gate": f"with {DOCS} select path, {_SIGNAL} as signal_chars, {_SIGNAL} < {MIN_SIGNAL_CHARS} as needs_ocr from docs",
    "intake_paths": (
        f"with r as (select trim({src.REQUEST_SQL}, {q(SPACE_CHARS)}) as path, event_id from events)"
        f" select path, min(event_id) as seq, {ext('path')} as extension from r where path[1] = '/' and {ext('path')} in {any_of(SUPPORTED_EXTENSIONS)} group by path"
    ),
    "uri_list_paths": (
        f"with p as (select page_id as payload, string_split({src.PAYLOAD_SQL}, chr(10)) as ls from pages),"
        f" l as (select payload, unnest(range(len(ls))) as line, trim(unnest(ls), {q(SPACE_CHARS)}) as e from p),"
        " d as (select payload, line, url_decode('/' || regexp_extract(e, '(?i)^file:(?://[^/?#]*)?/?([^?#]*)', 1)) as path from l where lower(left(e, 5)) = 'file:'),"
        " c as (select payload, line, case when regexp_matches(path, '^/[A-Za-z]:') then path[2:] else path end as path from d)"
        " select path, arg_min(payload, (payload, line)) as payload, arg_min(line, (payload, line))::int as line from c group by path"
    ),
    "missing_files": (
        "with a as (select distinct concat('/store/', event_id, '.pdf') as path from events),"
        " s as (select concat('/store/', doc_id, '.pdf') as path, text from documents)"
        " select path, text is not null as is_file, coalesce(strlen(text), 0) as size_bytes, coalesce(sha256(text), '') as sha256,"
        " case when text is null then 'Error' else 'Metadata only' end as status,"
        " case when text is null then 'Inspection failed: path is not a regular file.' else '' end as note from a left join s using (path)"
    ),
    "file_scan": "select doc_id || '.pdf' as name, 'PDF' as extension, strlen(text) as size_bytes, sha256(text) as sha256, cast(null as varchar) as error from documents",
    "file_inspection": (
        f"with {INSPECTED} select path, split_part(split_part(path, '/', 4), '.', 1)::bigint * 3 as seq, route, status,"
        " case when route = 'l' then 'Inspection failed: No such file or directory' else note end as note,"
        " case when route = 'l' then 0 else strlen(text) end as size_bytes, sha256, document_class, sensitivity,"
        " case when route = 'l' then 'Inspection failed: No such file or directory' else summary end as summary,"
        " case when route = 'l' then 'Inspection failed: No such file or directory' else extraction_summary end as extraction_summary, total_matches"
        " from inspected join documents on path like '/inbox/0/%' and split_part(split_part(path, '/', 4), '.', 1)::bigint = doc_id"
    ),
    "page_preview": (
        f"select doc_id, left({norm('array_to_string(string_split(text, chr(10))[1:2], chr(10))')}, {PREVIEW_CHARS}) as preview_text from documents"
    ),
    "labels_and_units": (
        "with o as (select o_orderkey as k, o_orderkey * o_orderkey * 3 as n, o_orderdate as d from orders),"
        " x as (select *, case when k % 10 = 0 then null else n % 90000 end as ms, case when k % 3 = 0 then null else k % 3 end as page from o)"
        f" select k, {_SIZE} as size_label, case when ms is null then 'Not available' when ms < 1000 then ms || ' ms'"
        " when ms % 125 = 0 then concat(ms // 1000, '.', lpad(concat('', (ms % 1000 + 5) // 10), 2, '0'), ' s')"
        " else printf('%.2f s', ms::double / 1000) end as duration_label,"
        " case k % 4 when 0 then 'Not available' when 1 then 'soon' else strftime(d, '%Y-%m-%d') || ' 00:00:00' end as date_label,"
        " concat('File ', k, ' of ', n, case when page is null then '' else concat('  ', chr(8226), '  OCR page ', page, ' of 3') end) as progress_label from x"
    ),
    "pii_candidates": f"with {CORPUS}, {PII} select path, category, start_at, stop_at, valid, masked from cand",
    "pii_scan": f"with {CORPUS}, {PII} select path, risk_level, total_matches, findings from pii",
    "pii_findings": f"with {CORPUS}, {PII} select path, position, category, n as matches, array_to_string(examples, '; ') as examples from found",
    "pii_risk": f"with {CORPUS}, {PII} select risk_level, count(*) as documents, sum(total_matches)::bigint as matches from pii group by 1",
    "pii_examples": f"with {CORPUS}, {PII} select category, masked, count(*) as documents from (select category, unnest(examples) as masked from found) group by all",
    "pii_cards": (
        "with o as (select o_orderkey, concat(o_orderkey % 10, lpad(concat('', o_orderkey * 7919 % 1000000007), (11 + o_orderkey % 9)::int, '4')) as digits from orders)"
        f" select o_orderkey, digits, length(digits) between 12 and 19 and {luhn('digits')} as luhn,"
        f" length(digits) between 13 and 19 and digits[1] <> '0' and {luhn('digits')} as card from o"
    ),
    "pii_routing": (
        "with o as (select o_orderkey, lpad(concat('', o_orderkey * 104729 % 1000000007), 8 + (o_orderkey % 3 > 0)::int, '0') as digits from orders)"
        f" select o_orderkey, digits, length(digits) = 9 and {aba('digits')} as routing from o"
    ),
    "template_scores": f"with {CORPUS}, {SCORES} select path, " + ", ".join(f"s{i}::bigint as {t.id.replace('-', '_')}" for i, t in enumerate(TEMPLATES)) + " from scores",
    "template_match": f"with {CORPUS}, {SCORES}, {CHOICE} select path, case pick " + " ".join(f"when {i} then {q(t.name)}" for i, t in enumerate(TEMPLATES)) + " end as template, score::bigint as score from choice",
    "extraction_fields": f"with {CORPUS}, {SCORES}, {CHOICE}, {FIELDS} select path, template, key, label, value, confidence, status, validation from fields",
    "extraction_summary": f"with {CORPUS}, {SCORES}, {CHOICE}, {FIELDS} select path, template, summary from extraction",
    "field_quality": (
        f"with {CORPUS}, {SCORES}, {CHOICE}, {FIELDS} select template, key, count(*) as documents, count_if(status = 'Extracted')::bigint as extracted,"
        " count_if(status = 'Detected label')::bigint as label_only, count_if(status = 'Missing')::bigint as missing,"
        " count_if(validation = 'Valid')::bigint as valid, count_if(validation = 'Suspect')::bigint as suspect from fields group by template, key"
    ),
    "field_validation": f"with {CORPUS}, {SCORES}, {CHOICE}, {FIELDS} select path, key, value, " + ", ".join(f"{check(n, 'value')} as is_{n}" for n in v.VALIDATORS) + " from fields where value <> ''",
    "doc_class": f"with {CORPUS}, {SCORES}, {CHOICE}, {KINDS} select path, document_class, confidence from kinds",
    "doc_signals": f"with {CORPUS}, {ALL} select path, signals from records",
    "doc_sensitivity": f"with {CORPUS}, {ALL} select path, risk_level, sensitivity from records",
    "doc_summary": f"with {CORPUS}, {ALL} select path, summary from records",
    "document_intelligence": f"with {CORPUS}, {ALL} select * from records",
    "fallback_class": (
        f"with g as (select path, {ext('path')} as extension from {light(0, 1, 2)}) select path, {_fixed(0)} as document_class, {_fixed(1)} as sensitivity,"
        f" ({_fixed(2)})::bigint as confidence, {_fixed(3)} as summary, {_fixed(4)} as extraction_summary, 'None' as risk_level from g"
    ),
    "inspection_routing": (
        f"with {INSPECTED} select path, route, status, parser, note, page_count, preview_pages, extracted_characters, size_bytes, sha256, ocr_status, ocr_source, ocr_note,"
        " ocr_confidence, ocr_pages, ocr_page_limit, document_class, sensitivity, confidence, summary, extraction_summary, total_matches from inspected"
    ),
    "queue_merge": f"{_MERGE} select * replace ({iso('reviewed_at')} as reviewed_at) from ({_STAGED})",
    "merge_summary": (
        f"{_MERGE}, c as (select count_if(q.path is null)::bigint as added, count_if(q.path is not null)::bigint as updated from n left join q using (path))"
        " select added, updated, case when added > 0 and updated > 0 then concat('Added ', added, ' document(s) from drag and drop and refreshed ', updated, ' existing item(s).')"
        " when added > 0 then concat('Added ', added, ' document(s) from drag and drop.') when updated > 0 then concat('Refreshed ', updated, ' existing document(s) from drag and drop.')"
        " else '' end as message from c"
    ),
    "queue_reinspect": f"select * replace ({iso('reviewed_at')} as reviewed_at, size_bytes + 5 as size_bytes) from {light(0, 1)}",
    "queue_review_filter": f"select {_FLAT} from {light(0, 1, 2)} where review_status = 'Needs review'",
    "queue_remove": f"select {_FLAT} from {light(1)}",
    "queue_sorted": f"{_MERGE} select path, seq, row_number() over (order by batch_rank desc, seq) as position from ({_STAGED})",
    # locale order: punctuation before digits, lower case before upper case
    "queue_sort_name": f"select name, path, row_number() over (order by replace(lower(name), '_', ' '), name desc, seq) as position from {light(0, 1, 2)}",
    "queue_sort_size": f"select {_FLAT}, row_number() over (order by size_bytes desc, seq) as position from {light(0, 1, 2)}",
    "queue_sort_pages": f"select {_FLAT}, row_number() over (order by coalesce(page_count, 0) desc, seq) as position from {light(0, 1, 2)}",
    "queue_search": (
        f"with {INSPECTED}, ft as (select path, string_agg(concat(label, ' ', value, ' ', status, ' ', validation), ' ' order by ord) as ftext from fields group by path),"
        " ct as (select path, string_agg(category, ' ' order by position) as ctext from found group by path)"
        " select i.path, i.status, review_status from inspected i left join ft using (path) left join ct using (path)"
        f" where contains(lower(concat_ws(' ', {_PIECES})), 'net 30')"
    ),
    "review_state": (
        f"with e as ({_EVENTS}), s as (select path, arg_max(status, (ts, event_id)) filter (status is not null) as status,"
        " arg_max(ts, (ts, event_id)) filter (status is not null) as changed, arg_max(notes, (ts, event_id)) filter (notes is not null) as notes from e group by path)"
        f" select path, coalesce(status, 'Pending') as status, coalesce(notes, '') as notes, case when status <> 'Pending' then {iso('changed')} end as reviewed_at from s"
    ),
    "duplicates": f"with {CORPUS} select path, sha256(raw) as sha256, count(*) over (partition by sha256(raw)) as copies, count(*) over (partition by sha256(raw)) > 1 as duplicate from docs",
    "fingerprint_counts": f"with {CORPUS} select sha256(raw) as sha256, count(*) as copies from docs group by 1",
    "report_summary": (
        f"with {INSPECTED}, {COPIES} select count(*) as documents_selected, count_if(copies > 1)::bigint as duplicates, coalesce(sum(page_count), 0)::bigint as total_pages,"
        " count_if(status = 'Parsed locally')::bigint as parsed_locally, count_if(ocr_status = 'Completed')::bigint as ocr_completed, count_if(confidence >= 60)::bigint as classified,"
        " count_if(status = 'Metadata only')::bigint as metadata_only, count_if(status = 'Error')::bigint as issues, count_if(sensitivity = 'Restricted')::bigint as restricted,"
        " count_if(review_status = 'Pending')::bigint as pending_review, count_if(review_status = 'Approved')::bigint as approved, count_if(review_status = 'Needs review')::bigint as needs_review,"
        " count_if(review_status = 'Rejected')::bigint as rejected, count_if(total_matches > 0)::bigint as documents_with_pii, count_if(risk_level = 'High')::bigint as high_pii_risk,"
        " 'net 30' as active_filter from inspected join copies using (sha256)"
    ),
    "review_counts": f"with l as {light(0, 1, 2)} select review_status as status, count(*) as documents from l group by 1 union all select 'All', count(*) from l",
    "class_profile": (
        f"with {CORPUS}, {ALL} select document_class, sensitivity, risk_level, template, count(*) as documents, sum(total_matches)::bigint as matches,"
        " sum(confidence)::bigint as confidence_sum from records group by 1, 2, 3, 4"
    ),
    "queue_csv": f"with {INSPECTED}, {COPIES} select path, {_CSV} as line from inspected i join copies c on i.sha256 = c.sha256",
    "report_docs": (
        f"with {INSPECTED}, {COPIES} select path, name, status, i.sha256 as sha256, copies > 1 as duplicate, copies as duplicate_count,"
        " case when route <> 'l' then '2026-01-02T03:04:05.000Z' end as modified_at, document_class, sensitivity, total_matches, review_status"
        " from inspected i join copies c on i.sha256 = c.sha256"
    ),
    "csv_sheet": (
        f"with {INSPECTED}, {COPIES} select path, name, coalesce(page_count::varchar, '') as pages, document_class, coalesce({iso('reviewed_at')}, '') as reviewed_at,"
        " case when copies > 1 then 'Yes' else 'No' end as duplicate, i.sha256 as sha256 from inspected i join copies c on i.sha256 = c.sha256"
    ),
    "workspace_sanitize": _workspace(),
    "workspace_load": (
        f"with j as (select k, try_cast(raw as json) as s from (select k, {src.STATE_SQL} as raw from (select o_orderkey as k from orders)) where json_valid(raw)),"
        f" o as (select k, {_json_text('s', 'filterValue', q(''))} as filter_value, json_extract(s, '$.documents')::json[] as ds from j where json_type(s) = 'OBJECT'),"
        f" d as (select k, filter_value, unnest(ds) as d, generate_subscripts(ds, 1) - 1 as position from o),"
        f" p as (select *, {_json_text('d', 'path', q(''))} as path from d where json_type(d) = 'OBJECT')"
        f" select k, filter_value, position, path, {_json_text('d', 'name', base('path'))} as name, {ext('path')} as extension, 'Metadata only' as status from p where path[1] = '/'"
    ),
    "workspace_roundtrip": f"select {_FLAT} from {light(0, 1, 2)}",
    "ocr_rollup": _rolled(),
    "scan_cleanup": _gray(),
    "stream_intake": f"with {DOCS} select path, extension, strlen(raw) as size_bytes, sha256(raw) as sha256 from docs",
    "stream_pii": f"with {DOCS}, {PII} select path, risk_level, total_matches, findings from pii",
    "stream_queue_merge": (
        f"select path, n_chars + 1 as n_chars, review_status from (select concat('/inbox/0/', k, '.', {src.FILE_TYPE_SQL}) as path, n_chars,"
        f" {_R['status']} as review_status from (select doc_id as k, n_chars from documents))"
    ),
    "stream_duplicates": "select sha256(text) as sha256, count(*) as copies from documents group by 1",
}
