"""Typed reads of untrusted JSON held as VARIANT: wrong type means default, never a cast."""

from __future__ import annotations

from folioflow.functions.text import Sql, each, lit


def at(value: Sql, key: str) -> Sql:
    return f"variant_get({value}, '$.{key}', 'variant')"


def kind(value: Sql) -> Sql:
    return f"schema_of_variant({value})"


def is_object(value: Sql) -> Sql:
    return f"coalesce({kind(value)} like 'OBJECT<%', false)"


def is_string(value: Sql) -> Sql:
    return f"coalesce({kind(value)} = 'STRING', false)"


def is_number(value: Sql) -> Sql:
    return f"coalesce({kind(value)} rlike '^(BIGINT|DOUBLE|DECIMAL)', false)"


def text(value: Sql, key: str, default: Sql = "''") -> Sql:
    field = at(value, key)
    return f"case when {is_string(field)} then variant_get({value}, '$.{key}', 'string') else {default} end"


def number(value: Sql, key: str, default: Sql = "0D") -> Sql:
    field = at(value, key)
    return f"case when {is_number(field)} then try_variant_get({value}, '$.{key}', 'double') else {default} end"


def choice(value: Sql, key: str, options: tuple[str, ...], default: str) -> Sql:
    found = text(value, key, lit(default))
    allowed = ", ".join(map(lit, options))
    return f"case when {found} in ({allowed}) then {found} else {lit(default)} end"


def elements(value: Sql, key: str) -> Sql:
    """Array of VARIANT; anything but an array is empty."""
    return f"coalesce(try_variant_get({value}, '$.{key}', 'array<variant>'), cast(array() as array<variant>))"


def texts(value: Sql, key: str) -> Sql:
    strings = each("filter", elements(value, key), is_string)
    return each("transform", strings, lambda v: f"variant_get({v}, '$', 'string')")
