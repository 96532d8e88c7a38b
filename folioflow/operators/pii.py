"""Personal-data scan: detectors, priority claims, masked roll-up and risk.

Everything runs inside the row that holds the text: no shuffle, no Python. A
detector contributes its matches (one regex pass over the whole text, skipped by
a cheap gate). Positions matter only where two detectors fire in one text, so
only those texts pay for recovering them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import Sql, array, each, fold, hit, let, lit, regex, struct
from folioflow.functions.validators import is_card, is_routing, is_ssn
from folioflow.operators import bind
from folioflow.rules import UNASSIGNED_EIN_PREFIXES


@dataclass(frozen=True)
class Detector:
    """One identifier kind.

    ``gate`` is a cheap necessary condition on (text, folded text); ``valid`` and
    ``mask`` work on the matched string. Where a pattern also takes characters in
    front of the identifier, ``core`` gives the identifier, the end of the match.
    All are SQL text builders.
    """

    category: str
    pattern: str
    mask: Callable[[Sql], Sql]
    high_risk: bool
    gate: Callable[[Sql, Sql], Sql]
    valid: Callable[[Sql], Sql] = lambda m: "true"
    ignore_case: bool = False
    core: Callable[[Sql], Sql] | None = None
    #: Regex that some run of nine or more digits and separators must hold for a match.
    shape: str = ""

    @property
    def compiled(self) -> Sql:
        return regex(self.pattern, self.ignore_case)


def _digits(m: Sql) -> Sql:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _tail(prefix: str) -> Callable[[Sql], Sql]:
    return lambda m: f"concat({lit(prefix)}, right({_digits(m)}, 4))"


def _has_number(text: Sql, folded: Sql) -> Sql:
    """Every numeric detector needs a digit followed by eight digits or separators."""
    return f"{text} rlike '[0-9][0-9() .-]{{8}}'"


def _has_at(text: Sql, folded: Sql) -> Sql:
    return f"contains({text}, '@')"


def _has_birth_label(text: Sql, folded: Sql) -> Sql:
    return hit(folded, r"birth|dob|d\.o\.?b|do\.b")


# An address is a local part, "@" and a domain of letters-only labels. Written so
# that any text is searched in linear time and without recursion: a run of local
# characters is tried once, from its start (or where the last match ended), and
# only if a domain follows; the address begins at the first word edge in the run.
_LOCAL = "[a-z0-9._%+-]"
_DOMAIN = r"@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z]{2,}+\b)++"
_ADDRESS = rf"(?:(?<!{_LOCAL})|\G)(?={_LOCAL}*+{_DOMAIN}){_LOCAL}*?\b[a-z0-9]{_LOCAL}*+{_DOMAIN}"


def _address(m: Sql) -> Sql:
    return f"regexp_extract({m}, {regex(chr(92) + 'b[a-z0-9].*', True)}, 0)"


# Categories, patterns and masks in claim priority order.
DETECTORS = (
    Detector(
        "Credit card number",
        r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])",
        _tail("**** "),
        high_risk=True,
        gate=_has_number,
        valid=lambda m: is_card(_digits(m)),
        shape=r"(?:[0-9][ -]?){12}[0-9]",
    ),
    Detector(
        "Bank routing number",
        r"(?<![\d.-])\d{9}(?![\d.-])",
        _tail("*****"),
        high_risk=True,
        gate=_has_number,
        valid=is_routing,
        shape=r"[0-9]{9}",
    ),
    Detector(
        "Social Security number",
        r"(?<![\d-])\d{3}[- ]\d{2}[- ]\d{4}(?![\d-])",
        _tail("***-**-"),
        high_risk=True,
        gate=_has_number,
        valid=is_ssn,
        shape=r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}",
    ),
    Detector(
        "Employer identification number",
        r"(?<![\d-])\d{2}-\d{7}(?![\d-])",
        _tail("**-***"),
        high_risk=False,
        gate=_has_number,
        valid=lambda m: f"left({m}, 2) not in ({', '.join(map(lit, UNASSIGNED_EIN_PREFIXES))})",
        shape=r"[0-9]{2}-[0-9]{7}",
    ),
    Detector(
        "Phone number",
        r"(?<![\d-])(?:\+1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])",
        _tail("(***) ***-"),
        high_risk=False,
        gate=_has_number,
        shape=r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    ),
    Detector(
        "Email address",
        _ADDRESS,
        lambda m: f"concat(left({m}, 1), '***@', substring_index({m}, '@', -1))",
        high_risk=False,
        gate=_has_at,
        ignore_case=True,
        core=_address,
    ),
    Detector(
        "Date of birth",
        r"(?:date of birth|birth ?date|\bd\.?o\.?b\.?\b)[^\n\d]{0,40}\d{1,2}[/\- ]\d{1,2}[/\- ]\d{2,4}",
        lambda m: "'**/**/****'",
        high_risk=True,
        gate=_has_birth_label,
        ignore_case=True,
    ),
)

_SPAN = "struct<text:string,start:int,stop:int>"
_FINDING = "struct<category:string,count:bigint,examples:array<string>>"
_OFFSET_BLOCK = 64
#: Up to so many spans of a text are compared in pairs, without sorting.
_FEW_SPANS = 16
#: The text up to the next run of digits and separators, which is kept, or up to shorter digits or the end.
_UP_TO_RUN = r"[^0-9]*+(?:([0-9][0-9() .-]{8,})|[0-9]++|\z)"


def _none(kind: str) -> Sql:
    return f"cast(array() as array<{kind}>)"


def _total(terms: list[Sql]) -> Sql:
    return "(" + " + ".join(terms) + ")"


def _matches(detectors: tuple[Detector, ...], text: Sql, folded: Sql) -> Sql:
    """Struct of candidate-string arrays, one per detector, left to right in the text.

    Detectors that share a gate test it once. Those with a shape look for it in the text's runs of digits
    and separators, which are few and short, before they read the text.
    """
    gates = list(dict.fromkeys(d.gate for d in detectors))

    def found(opened: Sql) -> Sql:
        def listed(runs: Sql) -> Sql:
            def is_open(d: Detector) -> Sql:
                return f"{opened}.g{gates.index(d.gate)}" + (f" and {runs} rlike {regex(d.shape)}" if d.shape else "")

            return struct(
                **{
                    f"d{i}": f"case when {is_open(d)} then regexp_extract_all({text}, {d.compiled}, 0) else {_none('string')} end"
                    for i, d in enumerate(detectors)
                }
            )

        shaped = [f"{opened}.g{j}" for j, gate in enumerate(gates) if any(d.shape and d.gate is gate for d in detectors)]
        if not shaped:
            return listed("''")
        runs = f"regexp_replace({text}, {regex(_UP_TO_RUN)}, '$1|')"
        return let(f"case when {' or '.join(shaped)} then {runs} else '' end", listed)

    return let(struct(**{f"g{j}": gate(text, folded) for j, gate in enumerate(gates)}), found)


def _spans(matches: Sql, gaps: Sql) -> Sql:
    """Candidate strings with positions, from the text between them.

    Match ``i`` ends after gaps and matches ``0..i``. These sums are carried in blocks:
    an aggregate copies what it carries at every step, so blocks are short and hold numbers only.
    """
    sizes = f"zip_with({matches}, slice({gaps}, 1, size({matches})), (m, g) -> length(g) + length(m))"

    def ends(every: Sql) -> Sql:
        firsts = f"sequence(1, size({every}), {_OFFSET_BLOCK})"

        def block(first: Sql) -> Sql:
            return f"slice({every}, {first}, {_OFFSET_BLOCK})"

        def walked(totals: Sql) -> Sql:
            def walk(first: Sql) -> Sql:
                before = f"aggregate(slice({totals}, 1, ({first} - 1) div {_OFFSET_BLOCK}), 0, (n, t) -> n + t)"
                step = struct(at="s.at + n", ends="concat(s.ends, array(s.at + n))")
                return f"aggregate({block(first)}, {struct(at=before, ends=_none('int'))}, (s, n) -> {step}, s -> s.ends)"

            return f"flatten({each('transform', firsts, walk)})"

        return let(each("transform", firsts, lambda first: f"aggregate({block(first)}, 0, (n, x) -> n + x)"), walked)

    spans = f"zip_with({matches}, {let(sizes, ends)}, (m, stop) -> {struct(text='m', start='stop - length(m)', stop='stop')})"
    return f"case when size({matches}) = 0 then {_none(_SPAN)} else {spans} end"


def _placed(detector: Detector, matches: Sql, text: Sql) -> Sql:
    def single(at: Sql) -> Sql:
        return array([struct(text=f"{matches}[0]", start=at, stop=f"{at} + length({matches}[0])")])

    only = let(f"length(split({text}, {detector.compiled}, 2)[0])", single)
    every = _spans(matches, f"split({text}, {detector.compiled}, -1)")
    spans = f"case when size({matches}) = 1 then {only} else {every} end"
    if detector.core is None:
        return spans

    def trimmed(s: Sql) -> Sql:
        return let(detector.core(f"{s}.text"), lambda c: struct(text=c, start=f"{s}.stop - length({c})", stop=f"{s}.stop"))

    return each("transform", spans, trimmed)


def candidates(df: DataFrame, text: str, keep: list[str], detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """One row per candidate, before claims: category, position, validity, mask."""

    def located(body: Sql) -> Sql:
        def described(d: Detector, spans: Sql) -> Sql:
            return each(
                "transform",
                spans,
                lambda s: struct(
                    category=lit(d.category), start=f"{s}.start", stop=f"{s}.stop",
                    valid=d.valid(f"{s}.text"), masked=d.mask(f"{s}.text"),
                ),
            )

        def listed(found: Sql) -> Sql:
            parts = [described(d, _placed(d, f"{found}.d{i}", body)) for i, d in enumerate(detectors)]
            return f"concat({', '.join(parts)})"

        return let(fold(body), lambda low: let(_matches(detectors, body, low), listed))

    every = let(f"coalesce({text}, '')", located)
    return df.select(*keep, F.explode(F.expr(every)).alias("c")).select(*keep, "c.*")


def _claims(detectors: tuple[Detector, ...], spans: Sql) -> Sql:
    """Struct of accepted strings per detector.

    In priority order, a detector keeps what no stronger one has already taken.
    What is taken never overlaps, and neither do a detector's own spans, so a span is free
    if as many taken ones begin before its end as end up to its start. Both are its place in
    a sorted array: of its detector's ends among taken starts, of its starts among taken ends.
    """

    def places(mine: Sql, taken: Sql, odd: int) -> Sql:
        """Where the numbers ``mine`` (ascending) come among them and ``taken``; of equal ones mine come last if ``odd``, else first."""
        tagged = f"concat({each('transform', mine, lambda x: f'{x} * 2L + {odd}')}, {each('transform', taken, lambda x: f'{x} * 2L + {1 - odd}')})"
        at = f"transform(sort_array({tagged}), (x, i) -> case when x % 2 = {odd} then i end)"
        return each("filter", at, lambda i: f"{i} is not null")

    def free(mine: Sql, taken: Sql) -> Sql:
        ends, begins = (each("transform", mine, lambda s, f=f: f"{s}.{f}") for f in ("stop", "start"))
        both = struct(e=places(ends, f"{taken}.starts", 0), b=places(begins, f"{taken}.stops", 1))
        kept = let(both, lambda p: f"filter({mine}, (s, i) -> {p}.e[i] = {p}.b[i])")
        return f"case when size({mine}) = 0 or size({taken}.starts) = 0 then {mine} else {kept} end"

    def with_kept(k: Sql) -> Sql:
        edges = {f"{f}s": f"concat(taken.{f}s, {each('transform', k, lambda s, f=f: f'{s}.{f}')})" for f in ("start", "stop")}
        return struct(**edges, kept=f"concat(taken.kept, array({k}))")

    zero = struct(starts=_none("int"), stops=_none("int"), kept=_none(f"array<{_SPAN}>"))
    every = array([f"{spans}.d{i}" for i in range(len(detectors))])
    sorted_claims = f"aggregate({every}, {zero}, (taken, mine) -> {let(free('mine', 'taken'), with_kept)}, taken -> taken.kept)"
    clear = "not exists(flatten(kept), t -> t.start < s.stop and s.start < t.stop)"
    paired_claims = f"aggregate({every}, {_none(f'array<{_SPAN}>')}, (kept, mine) -> concat(kept, array(filter(mine, s -> {clear}))))"
    few = _total([f"size({spans}.d{i})" for i in range(len(detectors))]) + f" <= {_FEW_SPANS}"
    claimed = f"case when {few} then {paired_claims} else {sorted_claims} end"
    return let(claimed, lambda c: struct(**{f"d{i}": f"{c}[{i}].text" for i in range(len(detectors))}))


def _roll_up(detectors: tuple[Detector, ...], accepted: Sql) -> Sql:
    """Findings sorted by count, ties in detector order; the distinct masks as examples, in text order."""
    per_detector = [
        struct(
            order_by=f"-size({accepted}.d{i})",
            rank=str(i),
            category=lit(d.category),
            count=f"bigint(size({accepted}.d{i}))",
            examples=f"array_distinct({each('transform', f'{accepted}.d{i}', d.mask)})",
        )
        for i, d in enumerate(detectors)
    ]
    ranked = f"array_sort({each('filter', array(per_detector), lambda f: f'{f}.count > 0')})"
    return each(
        "transform",
        ranked,
        lambda f: struct(category=f"{f}.category", count=f"{f}.count", examples=f"{f}.examples"),
    )


def _scan_result(detectors: tuple[Detector, ...], findings: Sql) -> Sql:
    high = ", ".join(lit(d.category) for d in detectors if d.high_risk)
    is_high = each("exists", findings, lambda f: f"{f}.category in ({high})")
    return struct(
        risk_level=f"case when {is_high} then 'High' when size({findings}) > 0 then 'Low' else 'None' end",
        total_matches=f"aggregate({findings}, 0L, (n, f) -> n + f.count)",
        findings=findings,
    )


def scan_of(body: Sql, folded: Sql, detectors: tuple[Detector, ...] = DETECTORS) -> Sql:
    """struct<risk_level, total_matches, findings[category, count, examples]> of one text.

    Written as nested bindings, so each step is evaluated once however often the
    result is referenced, and the plan stays small.
    """
    n = range(len(detectors))

    def resolve(found: Sql) -> Sql:
        def identifiers(i: int, d: Detector) -> Sql:
            return each("transform", f"{found}.d{i}", d.core) if d.core else f"{found}.d{i}"

        valid = struct(**{f"d{i}": each("filter", identifiers(i, d), d.valid) for i, d in enumerate(detectors)})

        def accept(ok: Sql) -> Sql:
            firing = _total([f"int(size({ok}.d{i}) > 0)" for i in n])
            spans = struct(
                **{
                    f"d{i}": f"case when size({ok}.d{i}) > 0 then "
                    + each("filter", _placed(d, f"{found}.d{i}", body), lambda s: d.valid(f"{s}.text"))
                    + f" else {_none(_SPAN)} end"
                    for i, d in enumerate(detectors)
                }
            )
            contested = let(spans, lambda s: _claims(detectors, s))
            # One firing detector cannot conflict with itself: no positions needed.
            return f"case when {firing} > 1 then {contested} else {ok} end"

        return let(valid, accept)

    def findings(found: Sql) -> Sql:
        listed = let(resolve(found), lambda accepted: _roll_up(detectors, accepted))
        matched = _total([f"size({found}.d{i})" for i in n])
        return f"case when {matched} > 0 then {listed} else {_none(_FINDING)} end"

    return let(let(_matches(detectors, body, folded), findings), lambda f: _scan_result(detectors, f))


def scan_text(text: Sql, detectors: tuple[Detector, ...] = DETECTORS) -> Sql:
    return let(f"coalesce({text}, '')", lambda body: let(fold(body), lambda low: scan_of(body, low, detectors)))


def scan(df: DataFrame, text: str, detectors: tuple[Detector, ...] = DETECTORS, out: str = "pii") -> DataFrame:
    """Append the scan of column ``text`` as ``out``."""
    return bind(df, out, scan_text(text, detectors))


def findings_table(scanned: DataFrame, key: str, pii: str = "pii") -> DataFrame:
    """One row per document and category; only masked examples leave the job."""
    return scanned.select(key, F.posexplode(f"{pii}.findings").alias("position", "f")).select(
        key, "position", F.col("f.category").alias("category"), F.col("f.count").alias("count"),
        F.col("f.examples").alias("examples"),
    )


def describe(findings: Sql) -> Sql:
    """``category (count), ...`` in finding order."""
    parts = each("transform", findings, lambda f: f"concat({f}.category, ' (', {f}.count, ')')")
    return f"array_join({parts}, ', ')"
