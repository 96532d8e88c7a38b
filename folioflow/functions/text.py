"""Text primitives, written as Spark SQL expression text.

Every builder takes and returns SQL text (``normalize("raw")``); hand the result
to ``F.expr`` or ``selectExpr``. A whole intelligence record is some thousand
expression nodes, and one parsed string reaches the JVM in one call.

Patterns in :mod:`folioflow.rules` are written once in a small portable dialect
(ASCII ``\\b``, Unicode-space ``\\s``, ``$`` = very end of text) and become literal
Java patterns here, so Spark compiles each one once per task.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

Sql = str

# Code points counted as white space when trimming and in ``\s``.
_SPACE_POINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
SPACE_CHARS = "".join(map(chr, _SPACE_POINTS))
_WORD_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_META = set("\\.^$*+?()[]{}")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")

# Display length and text-layer threshold.
PREVIEW_CHARS = 5000
MIN_SIGNAL_CHARS = 120

#: Parts that several keywords share and most texts lack: where one is absent, none of its keywords is searched.
SHARED_PARTS = ("tax", "employ", "insur", "citizen", "medica", "sign", "form", "income", "alien", "internal revenue", "withholding")

_names = itertools.count()


def lit(value: str) -> Sql:
    """SQL string literal."""
    body = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0")
    return f"'{body}'"


def expand(pattern: str, space: str, edge: str, end: str) -> str:
    """Rewrite ``\\s``, ``\\b`` and ``$`` of a portable pattern for one regex dialect."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(space if in_class else f"[{space}]")
            elif pair == r"\b":
                out.append(edge)
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(end if ch == "$" and not in_class else ch)
        i += 1
    return "".join(out)


def regex(pattern: str, ignore_case: bool = False) -> Sql:
    """Portable pattern -> literal Java pattern."""
    body = expand(pattern, SPACE_CHARS, _WORD_EDGE, r"\z")
    return lit(f"(?i){body}" if ignore_case else body)


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Bind ``value`` once inside an expression, so ``body`` may use it repeatedly.

    An aggregate over no elements is ``finish(zero)``. (Indexing into a transformed
    array would do too, but re-derives its type for every row.)
    """
    name = f"v{next(_names)}"
    return f"aggregate(cast(array() as array<int>), {value}, (a, e) -> a, {name} -> {body(name)})"


def each(function: str, array: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """``transform``, ``filter`` or ``exists`` with a fresh variable name."""
    name = f"x{next(_names)}"
    return f"{function}({array}, {name} -> {body(name)})"


def struct(**fields: Sql) -> Sql:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def array(items: list[Sql]) -> Sql:
    return f"array({', '.join(items)})"


def fold(text: Sql) -> Sql:
    """Lower-case for keyword tests.

    U+0130 and U+212A are the only non-ASCII characters whose lower case holds an
    ASCII letter; blanking them first keeps the tests ASCII-case-insensitive.
    ASCII texts, which take as many bytes as characters, are not searched for them.
    """
    dotted, kelvin, nul = lit(chr(0x130)), lit(chr(0x212A)), lit(chr(0))

    def lowered(t: Sql) -> Sql:
        plain = f"replace(replace({t}, {dotted}, {nul}), {kelvin}, {nul})"
        return f"lower(case when octet_length({t}) = length({t}) then {t} else {plain} end)"

    return lowered(text) if _NAME.fullmatch(text) else let(text, lowered)


def required_word(pattern: str) -> str:
    """Longest literal run every match of ``pattern`` must contain ('' if unknown)."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        ch, step = pattern[i], 1
        if ch == "{":
            step = pattern.index("}", i) - i + 1
        if ch == "\\":
            ch, step = pattern[i + 1], 2
            plain = not ch.isalnum()
        else:
            plain = ch not in _META and ch != "|"
        follow = pattern[i + step : i + step + 1]
        if ch in "([" and step == 1:
            depth += 1
        if ch == "|" and step == 1 and depth == 0:
            return ""
        if plain and depth == 0 and follow not in ("?", "*", "{"):
            run += ch
        else:
            runs.append(run)
            run = ""
        if follow == "+":
            runs.append(run)
            run = ""
        if ch in ")]" and step == 1:
            depth -= 1
        i += step
    return max([*runs, run], key=len)


class Folded(str):
    """SQL text of a folded text whose keyword tests are already bound to flags."""

    words: dict[str, Sql]

    def __new__(cls, text: Sql, words: dict[str, Sql]):
        self = super().__new__(cls, text)
        self.words = words
        return self


def _branches(pattern: str) -> list[tuple[str, bool]]:
    """Top-level alternatives with whether each is a plain word."""
    parts = [pattern] if "(" in pattern or "[" in pattern else pattern.split("|")
    return [(part, not _META & set(part) and "|" not in part) for part in parts]


def _contains(folded: Sql, word: str) -> Sql:
    known = folded.words.get(word) if isinstance(folded, Folded) else None
    return known or f"contains({folded}, {lit(word)})"


def hit(folded: Sql, pattern: str) -> Sql:
    """Does a lower-case ``pattern`` occur in folded text?

    Plain words become ``contains`` (no regex engine). Other alternatives use
    ``rlike``, tried only where the words they cannot do without are present.
    """
    tests = []
    for branch, plain in _branches(pattern):
        if plain:
            tests.append(_contains(folded, branch))
            continue
        word = required_word(branch)
        gate = f"{_contains(folded, word)} and " if word else ""
        tests.append(f"({gate}{folded} rlike {regex(branch)})")
    return f"({' or '.join(tests)})"


def with_words(folded: Sql, patterns: list[str], body: Callable[[Sql], Sql]) -> Sql:
    """Search each distinct word of ``patterns`` once and bind the answers for ``body``.

    A word that contains a shorter one ("invoice number", "invoice"), or one of ``SHARED_PARTS``,
    is searched only where that was found.
    """
    words = {b if plain else required_word(b) for p in patterns for b, plain in _branches(p)} - {""}
    words |= {part for part in SHARED_PARTS if sum(part in w for w in words) > 1}
    words = sorted(words, key=lambda w: (len(w), w))
    stems: list[str] = []
    longer: dict[str, str] = {}
    for word in words:
        stem = next((s for s in stems if s in word), None)
        if stem is None:
            stems.append(word)
        else:
            longer[word] = stem

    def second(first: Sql) -> Sql:
        flags = {stem: f"{first}.w{i}" for i, stem in enumerate(stems)}
        more = struct(**{f"w{i}": f"{flags[stem]} and contains({folded}, {lit(w)})" for i, (w, stem) in enumerate(longer.items())})
        return let(more, lambda m: body(Folded(folded, flags | {w: f"{m}.w{i}" for i, w in enumerate(longer)})))

    first = struct(**{f"w{i}": f"contains({folded}, {lit(stem)})" for i, stem in enumerate(stems)})
    if not longer:
        return let(first, lambda f: body(Folded(folded, {s: f"{f}.w{i}" for i, s in enumerate(stems)})))
    return let(first, second)


def any_hit(folded: Sql, patterns: tuple[str, ...]) -> Sql:
    return f"({' or '.join(hit(folded, p) for p in patterns) or 'false'})"


def hits(folded: Sql, patterns: tuple[str, ...]) -> Sql:
    """How many of ``patterns`` occur (patterns, not occurrences)."""
    return "(" + (" + ".join(f"int({hit(folded, p)})" for p in patterns) or "0") + ")"


def trim(text: Sql) -> Sql:
    """Trim the full white-space class (plain ``trim`` strips U+0020 only).

    Trimming walks the whole text, so only texts that begin or end with white space are trimmed.
    """

    def cut(t: Sql) -> Sql:
        edges = " or ".join(f"contains({lit(SPACE_CHARS)}, {side}({t}, 1))" for side in ("left", "right"))
        return f"case when {edges} then trim(both {lit(SPACE_CHARS)} from {t}) else {t} end"

    return f"({cut(text)})" if _NAME.fullmatch(text) else let(text, cut)


def normalize(text: Sql) -> Sql:
    """CRLF to LF, no blanks before a line end, at most one empty line, trimmed."""

    def tails(t: Sql) -> Sql:
        cut = f"regexp_replace({t}, {lit(r'[ \t]+' + chr(10))}, {lit(chr(10))})"
        return f"case when contains({t}, ' \\n') or contains({t}, '\\t\\n') then {cut} else {t} end"

    def gaps(t: Sql) -> Sql:
        cut = f"regexp_replace({t}, '\\n{{3,}}', '\\n\\n')"
        return trim(f"case when contains({t}, '\\n\\n\\n') then {cut} else {t} end")

    def unix(t: Sql) -> Sql:
        return f"case when contains({t}, {lit(chr(13))}) then replace({t}, {lit(chr(13) + chr(10))}, {lit(chr(10))}) else {t} end"

    return let(let(unix(text) if _NAME.fullmatch(text) else let(text, unix), tails), gaps)


def collapse_spaces(text: Sql) -> Sql:
    """Any run of white space becomes one blank, ends trimmed."""
    return trim(f"regexp_replace({text}, {lit('[' + SPACE_CHARS + ']+')}, ' ')")


def preview(text: Sql, chars: int = PREVIEW_CHARS) -> Sql:
    """Display excerpt. Analysis never reads it: operators work on whole texts."""
    return f"left({text}, {chars})"


def signal_chars(text: Sql) -> Sql:
    return f"length(regexp_replace({text}, '[^A-Za-z0-9]+', ''))"


def needs_ocr(text: Sql, minimum: int = MIN_SIGNAL_CHARS) -> Sql:
    """Too few letters and digits to trust the text layer; mostly the beginning of a text shows that there are enough."""
    few = f"{signal_chars(f'left({text}, {2 * minimum})')} < {minimum}"
    return f"({few} and {signal_chars(text)} < {minimum})"


def source_text(text: Sql, title: Sql, subject: Sql) -> Sql:
    """Text that is analysed: body, title and subject on separate lines."""
    return f"concat(coalesce({text}, ''), '\\n', coalesce({title}, ''), '\\n', coalesce({subject}, ''))"


def basename(path: Sql) -> Sql:
    """Last component, ignoring trailing slashes."""
    return f"substring_index(trim(trailing '/' from {path}), '/', -1)"


def extension(path: Sql) -> Sql:
    """Upper-cased extension of the last path component, ``FILE`` when there is none."""
    found = f"regexp_extract({basename(path)}, {lit(r'(?s)^.+\.([^.]+)\z')}, 1)"
    return f"coalesce(nullif(upper({found}), ''), 'FILE')"


def size_label(size: Sql) -> Sql:
    """Byte count as ``B``, ``KB`` (1 digit) or ``MB`` (2 digits), exact half-up rounding."""
    def scaled(unit: int, digits: int) -> Sql:
        return f"cast(round(cast({size} as decimal(20,0)) / {unit}, {digits}) as decimal(20,{digits}))"

    return (
        f"case when {size} < 1024 then concat({size}, ' B')"
        f" when {size} < 1048576 then concat({scaled(1024, 1)}, ' KB')"
        f" else concat({scaled(1048576, 2)}, ' MB') end"
    )


def duration_label(millis: Sql) -> Sql:
    """Milliseconds, or seconds with two digits.

    Seconds round as the binary value of ``millis / 1000`` does; only multiples
    of 125 ms are exact there, and those ties go up.
    """
    up = f"string(cast(round(cast({millis} as decimal(20,0)) / 1000, 2) as decimal(20,2)))"
    return (
        f"case when {millis} is null then 'Not available' when {millis} < 1000 then concat({millis}, ' ms')"
        f" when {millis} % 125 = 0 then concat({up}, ' s')"
        f" else concat(format_number({millis} / 1000D, '0.00'), ' s') end"
    )


def iso_timestamp(ts: Sql) -> Sql:
    """ISO-8601 with milliseconds in UTC, whatever the session's time zone: the text form timestamps take at every sink."""
    return f"date_format(to_utc_timestamp({ts}, current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


def date_label(raw: Sql) -> Sql:
    """Readable date: empty -> ``Not available``; unparsable text is shown as it is."""
    return (
        f"case when coalesce({raw}, '') = '' then 'Not available'"
        f" else coalesce(date_format(try_to_timestamp({raw}), 'yyyy-MM-dd HH:mm:ss'), {raw}) end"
    )


def half_up(number: Sql) -> Sql:
    return f"floor({number} + 0.5D)"


def clamp_percent(number: Sql) -> Sql:
    """0 to 100; null stays null (``least`` and ``greatest`` skip nulls)."""
    return f"case when {number} is not null then least(greatest({number}, 0), 100) end"


def progress_label(index: Sql, total: Sql, page: Sql, page_limit: Sql) -> Sql:
    dot = chr(0x2022)
    pages = (
        f"case when {page} is not null and {page_limit} is not null"
        f" then concat('  {dot}  OCR page ', {page}, ' of ', {page_limit}) else '' end"
    )
    return f"case when {index} is null then '' else concat('File ', {index}, ' of ', {total}, {pages}) end"
