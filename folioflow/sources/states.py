"""Saved states (JSON text) of any size, taken apart document by document.

A VARIANT is limited in size and so is what a parser should hold at a time: here only one element of a state's
``documents`` is decoded at a time, and handed on as the text that it is. A state counts only as a whole, so its text is
walked once before the first document leaves.
"""

from __future__ import annotations

import json
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of documents that leave in one batch (or one longer document).
BATCH = 8 << 20

_BLANK = re.compile(r"[ \t\n\r]*")


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def _skip(text: str, at: int) -> int:
    return _BLANK.match(text, at).end()


def _take(text: str, at: int, char: str) -> int:
    """The place after ``char``, which comes next."""
    at = _skip(text, at)
    if not text.startswith(char, at):
        raise ValueError(f"{char} expected")
    return at + 1


def elements(text: str, at: int) -> Generator[tuple[int, int], None, int]:
    """Begin and end of every element of the array whose bracket lies before ``at``; the place after the array."""
    at = _skip(text, at)
    if text.startswith("]", at):
        return at + 1
    while True:
        at = _skip(text, at)
        _, end = _DECODER.raw_decode(text, at)
        yield at, end
        at = _skip(text, end)
        if text.startswith("]", at):
            return at + 1
        at = _take(text, at, ",")


def _passed(steps: Generator[tuple[int, int], None, int]) -> int:
    while True:
        try:
            next(steps)
        except StopIteration as stop:
            return stop.value


def read_state(text: str) -> tuple[str, int | None] | None:
    """(filter value, where the elements of ``documents`` begin, if it is an array); None if the text is no JSON object.

    Of members of one name the last counts. A filter value that is no string is empty.
    """
    wanted, documents = "", None
    try:
        at = _skip(text, _take(text, 0, "{"))
        more = not text.startswith("}", at)
        while more:
            at = _take(text, at, '"') - 1
            name, at = _DECODER.raw_decode(text, at)
            at = _skip(text, _take(text, at, ":"))
            if name == "documents" and text.startswith("[", at):
                documents = at + 1
                at = _passed(elements(text, at + 1))
            else:
                value, at = _DECODER.raw_decode(text, at)
                if name == "documents":
                    documents = None
                if name == "filterValue":
                    wanted = value if isinstance(value, str) else ""
            at = _skip(text, at)
            more = text.startswith(",", at)
            if more:
                at += 1
        if _skip(text, _take(text, at, "}")) != len(text):
            raise ValueError("more text")
    except (ValueError, RecursionError):
        return None
    return wanted.encode("utf-8", "replace").decode("utf-8"), documents


def state_documents(df: DataFrame, raw: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, filter_value, position and doc (JSON text) of every element of ``documents`` in every readable state."""
    rows = df.select(*keep, F.col(raw).alias("_raw"))
    schema = rows.drop("_raw").withColumns({"filter_value": F.lit(""), "position": F.lit(0), "doc": F.lit("")}).schema

    def parts(text: str, at: int) -> Iterator[tuple[int, list[str]]]:
        first, part, size = 0, [], 0
        for start, end in elements(text, at):
            part.append(text[start:end])
            size += end - start
            if size >= BATCH:
                yield first, part
                first, part, size = first + len(part), [], 0
        if part:
            yield first, part

    def run(batches):
        for batch in batches:
            for n, raw_text in enumerate(batch.column(batch.num_columns - 1)):
                state = read_state(raw_text.as_py() or "")
                if state is None or state[1] is None:
                    continue
                for first, docs in parts(raw_text.as_py(), state[1]):
                    kept = [batch.column(k).take(pa.array([n] * len(docs))) for k in range(batch.num_columns - 1)]
                    columns = [*kept, pa.array([state[0]] * len(docs)), pa.array(range(first, first + len(docs)), pa.int32()), pa.array(docs, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
