"""Form templates: scoring, choice, field extraction and validation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import Sql, any_hit, array, collapse_spaces, each, fold, hit, hits, let, lit, regex, struct, with_words
from folioflow.functions.validators import VALIDATORS
from folioflow.operators import bind
from folioflow.rules import ANCHOR_WEIGHT, NO_TEMPLATE_SUMMARY, TEMPLATES, FieldRule, Template

FIELD_TYPE = "struct<key:string,label:string,value:string,confidence:int,status:string,validation:string>"


def score(template: Template, folded: Sql) -> Sql:
    return f"({ANCHOR_WEIGHT} * {hits(folded, template.anchors)} + {hits(folded, template.supports)})"


def choose(folded: Sql, templates: tuple[Template, ...] = TEMPLATES) -> Sql:
    """struct<score, order> of the best qualifying template, null when none qualifies.

    ``order`` is minus the registry position, so a plain maximum prefers the
    earlier template on equal scores.
    """
    scored = array([struct(score=score(t, folded), order=str(-i), floor=str(t.min_score)) for i, t in enumerate(templates)])
    qualified = each("filter", scored, lambda c: f"{c}.score >= {c}.floor")
    return f"array_max({each('transform', qualified, lambda c: struct(score=f'{c}.score', order=f'{c}.order'))})"


_FILLER = re.compile(r"((?:\\s\*|\[[^\]]*\]\?|\\\$\?)+)(?=\((?:\\d|\\\(\?\\d|\(\?:19|\(\?:single|\[a-z0-9\]))")
_REST_OF_LINE = r"[^\n]*?"


def linear(pattern: str) -> str:
    """The same value pattern, searched in linear time in texts of any length.

    White space and separators in front of a value that starts with a digit or a
    fixed word cannot belong to it, so they are taken without backtracking. Where
    a value may follow anywhere in the line, the first label of the line covers
    what later labels could reach, so only that one is tried.
    """
    greedy = _FILLER.sub(lambda m: re.sub(r"(\\s\*|\]\?|\\\$\?)", r"\1+", m.group(1)), pattern)
    greedy = greedy.replace(r"\s*[:\-]?\s*([^\s@]", r"\s*+[:\-]?\s*+([^\s@]")
    if _REST_OF_LINE not in greedy:
        return greedy
    label, rest = greedy.split(_REST_OF_LINE, 1)
    return rf"(?:(?<=\n)|\A)(?>{_REST_OF_LINE}{label}){_REST_OF_LINE}{rest}"


def _usable(rule: FieldRule, pattern: str, source: Sql) -> Sql:
    """First match of one value pattern, or null when it is empty or guarded."""
    found = collapse_spaces(f'regexp_extract({source}, {regex(linear(pattern), True)}, 1)')
    guard = (lambda v: f" and not {hit(fold(v), rule.guard)}") if rule.guard else (lambda v: "")
    return let(found, lambda v: f"case when {v} <> ''{guard(v)} then {v} end")


def field(rule: FieldRule, source: Sql, folded: Sql) -> Sql:
    """One extracted field: value, status, validation and confidence."""
    check = VALIDATORS[rule.check] if isinstance(rule.check, str) else rule.check

    def entry(value: Sql, validation: Sql, status: str, confidence: Sql) -> Sql:
        return struct(
            key=lit(rule.key), label=lit(rule.label), value=value, confidence=confidence,
            status=lit(status), validation=validation,
        )

    def present(value: Sql) -> Sql:
        if check is None:
            return entry(value, "'Not checked'", "Extracted", "68")
        return (
            f"case when {check(value)} then {entry(value, lit('Valid'), 'Extracted', '84')}"
            f" else {entry(value, lit('Suspect'), 'Extracted', '40')} end"
        )

    labelled = entry("''", "'Not checked'", "Detected label", "36")
    missing = entry("''", "'Not checked'", "Missing", "0")
    first = f"coalesce({', '.join(_usable(rule, p, source) for p in rule.values)})"
    return let(
        first,
        lambda v: f"case when {v} is not null then {present(v)}"
        f" when {any_hit(folded, rule.labels)} then {labelled} else {missing} end",
    )


def summary(template: Template, fields: Sql) -> Sql:
    """Sentence with the extraction tallies."""
    def tally(name: str, value: str) -> Sql:
        return f"size({each('filter', fields, lambda f: f'{f}.{name} = {lit(value)}')})"

    extracted, valid, labelled = tally("status", "Extracted"), tally("validation", "Valid"), tally("status", "Detected label")
    # Sentence formats.
    lead = lit(f"{template.name} template detected. ")
    some = (
        f"concat({lead}, {extracted}, ' of {len(template.fields)} field value(s) extracted locally, ',"
        f" {valid}, ' validated, and ', {labelled}, ' additional schema marker(s) confirmed.')"
    )
    none = (
        f"concat({lead}, {labelled}, ' schema marker(s) confirmed locally;"
        " value extraction stays conservative when field values are not clearly present.')"
    )
    return f"case when {extracted} > 0 then {some} else {none} end"


def no_extraction(sentence: Sql) -> Sql:
    return struct(template="cast(null as string)", summary=sentence, fields=f"cast(array() as array<{FIELD_TYPE}>)")


def extraction(source: Sql, folded: Sql, choice: Sql, templates: tuple[Template, ...] = TEMPLATES) -> Sql:
    """struct<template, summary, fields>; only the chosen template's patterns run."""
    def filled(t: Template) -> Sql:
        fields = array([field(rule, source, folded) for rule in t.fields])
        return let(fields, lambda f: struct(template=lit(t.name), summary=summary(t, f), fields=f))

    arms = " ".join(f"when {choice}.order = {-i} then {filled(t)}" for i, t in enumerate(templates))
    return f"case {arms} else {no_extraction(lit(NO_TEMPLATE_SUMMARY))} end"


def name_of(choice: Sql, templates: tuple[Template, ...] = TEMPLATES) -> Sql:
    """Name of the chosen template, null if there is none."""
    return f"case {' '.join(f'when {choice}.order = {-i} then {lit(t.name)}' for i, t in enumerate(templates))} end"


def extract(df: DataFrame, text: str, templates: tuple[Template, ...] = TEMPLATES, out: str = "extraction") -> DataFrame:
    """Append the structured extraction of column ``text`` as ``out``."""
    def of(source: Sql) -> Sql:
        anchors = [p for t in templates for p in (*t.anchors, *t.supports)]

        def chosen(low: Sql) -> Sql:
            return let(choose(low, templates), lambda c: extraction(source, low, c, templates))

        return let(fold(source), lambda low: with_words(low, anchors, chosen))

    return bind(df, out, let(text, of))


def fields_table(extracted: DataFrame, key: str, out: str = "extraction") -> DataFrame:
    """One row per document and field of its template."""
    return extracted.select(key, F.col(f"{out}.template").alias("template"), F.explode(f"{out}.fields").alias("f")).select(
        key, "template", "f.*"
    )


def field_quality(fields: DataFrame) -> DataFrame:
    """How often each field of each template is found, suspect or missing."""
    return fields.groupBy("template", "key").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "Extracted").alias("extracted"),
        F.count_if(F.col("status") == "Detected label").alias("label_only"),
        F.count_if(F.col("status") == "Missing").alias("missing"),
        F.count_if(F.col("validation") == "Valid").alias("valid"),
        F.count_if(F.col("validation") == "Suspect").alias("suspect"),
    )
