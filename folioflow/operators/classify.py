"""Document class, signals, sensitivity, fallbacks and the whole intelligence record."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folioflow.functions.text import Sql, array, each, fold, hit, hits, let, lit, source_text, struct, with_words
from folioflow.operators import bind
from folioflow.operators import pii as pii_ops
from folioflow.operators import templates as template_ops
from folioflow.operators.pii import DETECTORS, Detector
from folioflow.operators.templates import no_extraction
from folioflow.rules import (
    BUSINESS_WORDS,
    PROFILES,
    RESTRICTED_WORDS,
    SIGNALS,
    TEMPLATES,
    TEXT_EXTENSIONS,
    Profile,
    Signal,
    Template,
)

# Records used when there is no text to analyse.
# kind: class, sensitivity, confidence, summary, extraction summary
FALLBACKS = {
    "pdf": (
        "Unclassified PDF", "Standard", 24,
        "PDF parsed locally, but there was not enough extracted text to classify it with confidence.",
        "No structured template was detected from the available text.",
    ),
    "scan": (
        "Unclassified scanned document", "Unknown", 18,
        "The file was inspected locally, but OCR did not recover enough text to classify it with confidence.",
        "No structured template was detected from the available OCR text.",
    ),
    "other": (
        "Unparsed file", "Unknown", 0,
        "No content analysis is available for this file type yet.",
        "Structured extraction is available only for locally parsed PDFs.",
    ),
}


#: Parts of an intelligence record. What is left out is not planned and costs nothing.
PARTS = ("analysis", "extraction", "pii")
#: Asked for by name only: the template's name without the fields.
TEMPLATE = "template"


def chosen_parts(parts: tuple[str, ...], **made: Sql) -> Sql:
    """Struct of the parts asked for."""
    return struct(**{name: made[name] for name in (*PARTS, TEMPLATE) if name in parts})


def in_list(value: Sql, options: tuple[str, ...]) -> Sql:
    return f"{value} in ({', '.join(map(lit, options))})"


def analysis_struct(doc_class: Sql, sensitivity: Sql, confidence: Sql, summary: Sql, signals: Sql = "cast(array() as array<string>)") -> Sql:
    return struct(
        document_class=doc_class, sensitivity=sensitivity, confidence=f"int({confidence})", summary=summary, signals=signals
    )


def no_pii() -> Sql:
    return struct(
        risk_level="'None'", total_matches="0L",
        findings="cast(array() as array<struct<category:string,count:bigint,examples:array<string>>>)",
    )


def best_profile(folded: Sql, profiles: tuple[Profile, ...] = PROFILES) -> Sql:
    """struct<hits, order> of the profile with most hits; null when nothing hits."""
    counted = array([struct(hits=hits(folded, p.patterns), order=str(-i)) for i, p in enumerate(profiles)])
    return f"array_max({each('filter', counted, lambda c: f'{c}.hits > 0')})"


def classify(
    ext: Sql,
    choice: Sql,
    profile: Sql,
    templates: tuple[Template, ...] = TEMPLATES,
    profiles: tuple[Profile, ...] = PROFILES,
) -> Sql:
    """struct<document_class, confidence> from the chosen template or, failing that, the profile."""
    label = [f"when {choice}.order = {-i} then {lit(t.document_class)}" for i, t in enumerate(templates)]
    label += [f"when {profile}.order = {-i} then {lit(p.label)}" for i, p in enumerate(profiles)]
    general = f"case when {ext} = 'PDF' then 'General PDF' else 'General document' end"
    confidence = (
        f"case when {choice} is not null then least(96, 60 + 6 * {choice}.score)"
        f" when {profile} is not null then least(96, 54 + 9 * {profile}.hits) else 42 end"
    )
    return struct(document_class=f"case {' '.join(label)} else {general} end", confidence=confidence)


def keyword_patterns(templates: tuple[Template, ...], rules: tuple[Signal, ...]) -> list[str]:
    """Every keyword pattern the record tests against any text; those of profiles count only where no template is found."""
    return [
        *(p for t in templates for p in (*t.anchors, *t.supports)),
        *(r.pattern for r in rules),
        RESTRICTED_WORDS,
        BUSINESS_WORDS,
        # gate of the labelled birth date
        "birth|dob",
    ]


def classify_text(ext: Sql, folded: Sql, templates: tuple[Template, ...] = TEMPLATES, profiles: tuple[Profile, ...] = PROFILES) -> Sql:
    def by_choice(choice: Sql) -> Sql:
        profile = f"case when {choice} is null then {best_profile(folded, profiles)} end"
        return let(profile, lambda p: classify(ext, choice, p, templates, profiles))

    return let(template_ops.choose(folded, templates), by_choice)


def signals(folded: Sql, pii: Sql, rules: tuple[Signal, ...] = SIGNALS) -> Sql:
    """Sentences of the keyword groups that hit; the scan result first if High, last if Low."""
    words = f"array_compact({array([f'case when {hit(folded, r.pattern)} then {lit(r.sentence)} end' for r in rules])})"
    flagged = f"array(concat('Local PII scan flagged: ', {pii_ops.describe(f'{pii}.findings')}))"
    return let(
        words,
        lambda w: f"case {pii}.risk_level when 'High' then concat({flagged}, {w})"
        f" when 'Low' then concat({w}, {flagged}) else {w} end",
    )


def sensitivity(folded: Sql, pii: Sql) -> Sql:
    return (
        f"case when {pii}.risk_level = 'High' or {hit(folded, RESTRICTED_WORDS)} then 'Restricted'"
        f" when {pii}.risk_level = 'Low' or {hit(folded, BUSINESS_WORDS)} then 'Internal' else 'Standard' end"
    )


def summary(doc_class: Sql, level: Sql, found: Sql) -> Sql:
    first = f"case when size({found}) > 0 then concat(' ', {found}[0], '.') else '' end"
    return f"concat('Likely ', lower({doc_class}), '. ', {level}, ' handling recommended.', {first})"


def fallback(ext: Sql, parts: tuple[str, ...] = PARTS) -> Sql:
    """Intelligence record of a file without analysable text."""
    def record(kind: str) -> Sql:
        doc_class, level, confidence, text, extraction_text = FALLBACKS[kind]
        return chosen_parts(
            parts,
            analysis=analysis_struct(lit(doc_class), lit(level), str(confidence), lit(text)),
            extraction=no_extraction(lit(extraction_text)),
            pii=no_pii(),
            template="cast(null as string)",
        )

    return (
        f"case when {ext} = 'PDF' then {record('pdf')} when {in_list(ext, TEXT_EXTENSIONS)} then {record('scan')}"
        f" else {record('other')} end"
    )


def intelligence(
    ext: Sql,
    text: Sql,
    title: Sql,
    subject: Sql,
    detectors: tuple[Detector, ...] = DETECTORS,
    templates: tuple[Template, ...] = TEMPLATES,
    profiles: tuple[Profile, ...] = PROFILES,
    rules: tuple[Signal, ...] = SIGNALS,
    parts: tuple[str, ...] = PARTS,
) -> Sql:
    """struct<analysis, extraction, pii> of one document, over its whole text, or the ``parts`` asked for.

    Extraction needs the chosen template only, the scan neither template nor keywords; the analysis needs both, but no fields.
    """

    def assemble(source: Sql, low: Sql, found: Sql) -> Sql:
        made = {"pii": f"{found}.pii"}
        if "extraction" in parts:
            made["extraction"] = template_ops.extraction(source, low, f"{found}.choice", templates)
        if TEMPLATE in parts:
            made[TEMPLATE] = template_ops.name_of(f"{found}.choice", templates)
        if "analysis" not in parts:
            return chosen_parts(parts, **made)

        def finish(more: Sql) -> Sql:
            doc_class = f"{more}.kind.document_class"
            analysis = analysis_struct(
                doc_class, f"{more}.level", f"{more}.kind.confidence",
                summary(doc_class, f"{more}.level", f"{more}.signals"), f"{more}.signals",
            )
            return chosen_parts(parts, analysis=analysis, **made)

        profile = f"case when {found}.choice is null then {best_profile(low, profiles)} end"
        derived = struct(
            kind=let(profile, lambda p: classify(ext, f"{found}.choice", p, templates, profiles)),
            signals=signals(low, f"{found}.pii", rules),
            level=sensitivity(low, f"{found}.pii"),
        )
        return let(derived, finish)

    def analysed(source: Sql) -> Sql:
        def folded(low: Sql) -> Sql:
            return with_words(low, keyword_patterns(templates, rules), known) if set(parts) != {"pii"} else known(low)

        def known(low: Sql) -> Sql:
            found = {}
            if {"pii", "analysis"} & set(parts):
                found["pii"] = pii_ops.scan_of(source, low, detectors)
            if {"extraction", "analysis", TEMPLATE} & set(parts):
                found["choice"] = template_ops.choose(low, templates)
            return let(struct(**found), lambda p: assemble(source, low, p))

        return let(fold(source), folded)

    readable = f"coalesce({text}, '') <> '' and {in_list(ext, TEXT_EXTENSIONS)}"
    return f"case when {readable} then {let(source_text(text, title, subject), analysed)} else {fallback(ext, parts)} end"


def with_intelligence(
    df: DataFrame, ext: str = "extension", text: str = "text", title: str = "title", subject: str = "subject", parts: tuple[str, ...] = PARTS
) -> DataFrame:
    """Append ``analysis``, ``extraction`` and ``pii`` to documents, or the ``parts`` of them that are needed."""
    bound = bind(df, "_record", intelligence(ext, text, title, subject, parts=parts))
    return bound.select(*df.columns, *[f"_record.{part}" for part in (*PARTS, TEMPLATE) if part in parts])
