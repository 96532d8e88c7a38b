"""Repeated byte windows by depth-limited most-significant-digit passes over suffixes.

Two suffixes need ordering only as deep as ``threshold`` bytes: those still equal there begin the same
window. Each pass groups what is left by one more digit of the window and drops the groups of one.

1. First digit: the window's anchor, the leftmost minimum of a hash over its ``GRAM``-byte strings. The
   anchor is determined by the window's content, so equal windows have equal anchor strings at the same offset, and
   neighbouring windows share an anchor: one row stands for a run of some 32 windows. Only runs whose
   anchor string occurs more than once go on.
2. Second digit: the whole content of the run. Of equal runs, all windows of all but the first are repeats.
3. Last digit: the first runs of groups with unequal contents are taken apart into windows; equal
   windows are exactly the repeats that are left, and all but the first go.

Contents count as equal where 128 bits of their XXH3 hashes agree (after equal anchor hashes).
Before each shuffle a task keeps one row per distinct content (the first) and settles the others at
once, so a string that a third of all documents hold costs a row per batch of documents, not per copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import keyed_documents, written

THRESHOLD = 100
#: Length of the strings that anchors are chosen among; windows hold ``threshold - GRAM + 1`` of them.
GRAM = 37
#: Bytes of texts that are hashed at a time; a longer text is worked on in overlapping blocks.
BLOCK = 1 << 18
#: Rows that a task gathers before it settles equal contents among them.
HELD = 1 << 18
#: Low bits of a comparison key that hold the position in a block (twice its size, for overlaps).
PLACE = 20
#: Fixed odd multiplier of the rolling hash and its inverse modulo 2^64, and mixing constants.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

RUNS = "anchor long, c1 long, c2 long, _key long, at int, n int"
SPANS = "_key long, at int, n int, kind int"


class Roller:
    """Hashes of all ``GRAM``-byte strings of a block, by prefix sums modulo 2^64."""

    def __init__(self, size: int):
        self.up = np.full(size + 1, BASE, np.uint64)
        self.down = np.full(size + 1, INVERSE, np.uint64)
        self.up[0] = self.down[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.__init__(len(data) * 2)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * self.down[: len(data) - GRAM + 1]
        for shift, factor in zip((30, 27), MIX, strict=True):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` neighbours, doubling the reach."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int, roller: Roller) -> tuple[np.ndarray, ...]:
    """(first window start, number of windows, anchor hash) of each run of windows that share an anchor.

    ``starts`` and ``ends`` are the texts' bounds in ``data``; no window crosses them.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < threshold:
        return none
    hashes = roller(data)
    place = np.uint64((1 << PLACE) - 1)
    keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (_window_minimum(keys, threshold - GRAM + 1) & place).astype(np.int64)
    counts = np.maximum(ends - starts - threshold + 1, 0)
    total = int(counts.sum())
    if not total:
        return none
    windows = np.arange(total) + np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    text = np.repeat(np.arange(len(counts)), counts)
    anchor = anchors[windows]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    return windows[new], np.diff(np.append(new, total)), hashes[anchor[new]]


def _blocks(batches, threshold: int, block: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, keys, offset of each piece in its text, starts, ends): about ``block`` bytes of texts at a time.

    Consecutive pieces of a long text overlap by threshold - 1 bytes, so every window is in exactly one.
    """
    for batch in batches:
        pieces, size = [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            for offset in range(0, max(1, len(raw) - threshold + 1), block):
                piece = raw[offset : offset + block + threshold - 1]
                if size and size + len(piece) > block:
                    yield _joined(pieces)
                    pieces, size = [], 0
                pieces.append((key, offset, piece))
                size += len(piece)
        if pieces:
            yield _joined(pieces)


def _joined(pieces: list[tuple]) -> tuple:
    ends = np.cumsum([len(p) for _, _, p in pieces])
    starts = ends - [len(p) for _, _, p in pieces]
    return b"".join(p for _, _, p in pieces), np.array([k for k, _, _ in pieces], np.int64), np.array([o for _, o, _ in pieces], np.int64), starts, ends


def _contents(data: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit hashes of data[at : at + size], as two columns of longs."""
    from xxhash import xxh3_128_digest

    view = memoryview(data)
    digests = b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)])
    return np.frombuffer(digests, "<i8").reshape(-1, 2)


def _settle(groups: list[np.ndarray], key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first rows of each group of equal columns, all other rows), first by (key, at)."""
    order = np.lexsort((at, key, *groups[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)
    return order[new], order[~new]


def _rows(names: list[str], columns: list, types: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema = [(c.split()[0], kinds[c.split()[1]]) for c in types.split(", ")]
    assert names == [n for n, _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, (_, t) in zip(columns, schema, strict=True)], names=names)


def _digit_rows(anchor, contents, key, at, n) -> Iterator[pa.RecordBatch]:
    """First rows of equal (anchor, contents) as they are; the others are repeats, marked by n < 0 and dealt out evenly."""
    first, other = _settle([anchor, contents[:, 0], contents[:, 1]], key, at)
    picked, signed = np.concatenate([first, other]), np.concatenate([n[first], -n[other]])
    anchor = np.concatenate([anchor[first], key[other] * 1_000_003 + at[other]])
    yield _rows(["anchor", "c1", "c2", "_key", "at", "n"], [anchor, contents[picked, 0], contents[picked, 1], key[picked], at[picked], signed], RUNS)


class _Gathered:
    """Rows of a task, settled among themselves some ``HELD`` at a time."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield from _digit_rows(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))
        self.parts, self.size = [], 0


REMOVED, OPEN = 0, 1


def _group_sorted(batches, with_open: bool) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (anchor, c1, c2, _key, at): repeats as REMOVED spans, first runs of mixed anchors as OPEN.

    An anchor group may be of any length and is never held: a first row waits until it is known whether
    its anchor has a second content.
    """
    names = ["anchor", "c1", "c2", "_key", "at", "n"]
    last = None  # (anchor, c1, c2) of the row before
    waiting = None  # first row of the anchor, while it is the only content
    for batch in batches:
        rows = {c: batch.column(c).to_numpy() for c in names}
        if not batch.num_rows:
            continue
        settled = rows["n"] < 0
        live = np.flatnonzero(~settled)
        out_key, out_at, out_n, out_kind = [rows["_key"][settled]], [rows["at"][settled]], [-rows["n"][settled]], [np.zeros(int(settled.sum()), np.int32)]
        if len(live):
            a, b, c = (rows[x][live] for x in ("anchor", "c1", "c2"))
            same_anchor = np.concatenate([[last is not None and a[0] == last[0]], a[1:] == a[:-1]])
            same = same_anchor & np.concatenate([[last is not None and (b[0], c[0]) == last[1:]], (b[1:] == b[:-1]) & (c[1:] == c[:-1])])
            last = (a[-1], b[-1], c[-1])
            first = np.flatnonzero(~same)
            take = [np.flatnonzero(same)]
            kinds = [np.zeros(len(take[0]), np.int32)]
            if with_open:
                # a content is open if the anchor's previous or next content is another
                continues = same_anchor[first]
                if len(first):
                    if waiting is not None and continues[0]:
                        out_key.append(np.array([waiting[0]]))
                        out_at.append(np.array([waiting[1]]))
                        out_n.append(np.array([waiting[2]]))
                        out_kind.append(np.array([OPEN], np.int32))
                    followed = np.append(continues[1:], False)
                    mixed = first[continues | followed]
                    take.append(mixed)
                    kinds.append(np.full(len(mixed), OPEN, np.int32))
                    end = live[first[-1]]
                    waiting = None if continues[-1] else (rows["_key"][end], rows["at"][end], rows["n"][end])
            picked = live[np.concatenate(take)]
            out_key.append(rows["_key"][picked])
            out_at.append(rows["at"][picked])
            out_n.append(rows["n"][picked])
            out_kind += kinds
        yield _rows(["_key", "at", "n", "kind"], [np.concatenate(x) for x in (out_key, out_at, out_n, out_kind)], SPANS)


def _pass(rows: DataFrame, with_open: bool, label: str) -> DataFrame:
    order = ["anchor", "c1", "c2", "_key", "at"]
    dealt = rows.repartition("anchor").sortWithinPartitions(*order)
    return written(dealt.mapInArrow(lambda b: _group_sorted(b, with_open), SPANS), label)


def repeated_spans(texts: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(_key, at, n): runs of ``n`` windows from byte ``at`` on that all also start earlier; ``texts`` is (_key, text)."""
    if threshold <= GRAM or block + threshold > 1 << PLACE:
        raise ValueError(f"threshold must be over {GRAM}, block and threshold within {1 << PLACE}")

    def runs(batches):
        roller = Roller(2 * BLOCK)
        gathered = _Gathered()
        for data, keys, offsets, starts, ends in _blocks(batches, threshold, block):
            at, n, anchor = runs_of(np.frombuffer(data, np.uint8), starts, ends, threshold, roller)
            text = np.searchsorted(ends, at, side="right")
            yield from gathered.add(anchor.view(np.int64), _contents(data, at, n + threshold - 1), keys[text], at - starts[text] + offsets[text], n)
        yield from gathered.flush()

    found = _pass(texts.mapInArrow(runs, RUNS), True, "suffix-runs")
    wanted = found.filter(F.col("kind") == OPEN).groupBy("_key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    def windows(batches):
        gathered = _Gathered()
        for batch in batches:
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                for at in _split(spans.as_py()):
                    contents = _contents(data, at, np.full(len(at), threshold))
                    yield from gathered.add(contents[:, 0], contents, np.full(len(at), key), at, np.ones(len(at), np.int64))
        yield from gathered.flush()

    opened = texts.join(wanted, "_key").select("_key", "text", "runs").mapInArrow(windows, RUNS)
    apart = _pass(opened, False, "suffix-windows")
    return found.filter(F.col("kind") == REMOVED).unionByName(apart).select("_key", "at", "n")


def _split(spans: list[dict]) -> Iterator[np.ndarray]:
    """Window starts of a text's runs, some thousands at a time."""
    part, size = [], 0
    for s in spans:
        part.append(np.arange(s["at"], s["at"] + s["n"]))
        size += s["n"]
        if size > HELD // 4:
            yield np.concatenate(part)
            part, size = [], 0
    if part:
        yield np.concatenate(part)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, with_kept: bool = True, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes, null unless ``with_kept``) per row of ``docs``.

    Removed is every byte of a ``threshold``-byte string that also starts earlier: at a smaller doc_id (nulls last; among
    equal ids by text digest, see :func:`folioflow.llm.common.keyed_documents`) or earlier in the same document.
    Strings are judged on the input. A null text is empty; texts shorter than the threshold stay; exact repeats of
    id and text are one document and get its result each; an empty table gives no rows; other columns are ignored.
    """
    texts, single = keyed_documents(docs)
    spans = repeated_spans(single.select("_key", "text"), threshold, block)
    spans = spans.groupBy("_key").agg(F.collect_list(F.struct("at", "n")).alias("runs")).withColumnRenamed("_key", "_span_key")

    def cut(batches):
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            out = []
            for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                gone = merged([(s["at"], s["at"] + s["n"] + threshold - 1) for s in runs.as_py() or []])
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)], strict=True))
                out.append((doc_id, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    joined = texts.join(spans, texts["_key"] == spans["_span_key"], "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs").mapInArrow(cut, RESULT)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out
