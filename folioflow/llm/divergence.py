"""Source divergence audit: how far the sources of a language differ in their words, and by which words.

Counting sorts pointers instead of building dictionaries. A shard's texts lie in one Arrow buffer; every word start is
a pointer into it. The pointers are ordered by a multikey quicksort whose characters are eight bytes: each pass sorts
all open slices by their next character, and slices of equal characters stay open until their words end. A run of
equal words then gives, by document and source, its document frequency and its counts. Shards send one row per
language, source and word.

Divergences are exact integers over all kept terms. A group's probability for the terms it lacks is one constant, so
the sum over all terms follows from three sparse parts: terms both groups hold, terms one of them holds (by a
histogram of its probabilities), and the number of all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import written

#: Text bytes whose pointers are sorted at a time (a longer text is a slice of its own), pairs of sources summed at a time.
SLICE, PAIRS = 16 << 20, 1 << 21
#: Probabilities are whole numbers of this unit; every term counts so many times more than it occurs.
UNIT, PRIOR = 1_000_000_000, 2

#: Letters of ASCII and all bytes of other characters make terms, A-Z in lower case; other bytes part them.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)

COUNTS = "lang string, source string, term string, count long, docs long"
SUMS = "lang string, source string, item string, value long, shared long"


def pointer_sort(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): pointers in the byte order of their words; whether each begins a run of equal words.

    ``text`` ends in eight zero bytes, and no word holds a zero byte.
    """
    characters = np.ndarray(len(text) - 7, ">u8", text, strides=(1,))

    def character(which: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(lengths[which] - 8 * depth, 0, 8)
        value = characters[np.minimum(starts[which] + 8 * depth, len(characters) - 1)].astype(np.uint64)
        cut = (8 * (8 - np.maximum(left, 1))).astype(np.uint64)
        return np.where(left > 0, value >> cut << cut, 0)

    def opened(run: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs begin; which pointers lie in a run of several whose words may go on."""
        first = np.ones(len(run), bool)
        first[1:] = (run[1:] != run[:-1]) | (value[1:] != value[:-1])
        alone = first & np.append(first[1:], True)
        return first, ~alone & (value & np.uint64(255) > 0)

    value = character(np.arange(len(starts)), 0)
    order = np.argsort(value)
    first, goes_on = opened(np.zeros(len(order), np.int8), value[order])
    at, depth = np.flatnonzero(goes_on), 1
    while len(at):
        run = np.cumsum(first)[at]
        value = character(order[at], depth)
        perm = np.lexsort((value, run))
        order[at] = order[at][perm]
        first[at], goes_on = opened(run, value[perm])
        at, depth = at[goes_on], depth + 1
    return order, first


def words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes and eight zeros, word starts, word lengths, the row of each) of an Arrow array without nulls; words never cross rows."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None else np.zeros(0, np.uint8)
    text = np.zeros(high - low + 8, np.uint8)
    np.take(FOLD, raw, out=text[: high - low])
    inside = text > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = np.unique(offsets[1:-1] - low)
    edges = edges[(edges > 0) & (edges < high - low)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    return text, starts, lengths, np.searchsorted(offsets - low, starts, side="right") - 1


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``SLICE`` text bytes, or of one row."""
    sizes = np.cumsum(np.diff(np.frombuffer(batch.column(0).cast(pa.large_binary()).buffers()[1], np.int64)[batch.column(0).offset :][: batch.num_rows + 1]))
    low = 0
    while low < batch.num_rows:
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + SLICE, side="right")))
        yield batch.slice(low, high - low)
        low = high


def term_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of ``COUNTS`` for a shard of (text, lang, source) without nulls."""
    langs, sources = (batch.column(k).dictionary_encode() for k in (1, 2))
    groups = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    by_group = np.argsort(groups, kind="stable")
    place = np.empty(len(groups), np.int64)
    place[by_group] = np.arange(len(groups))
    text, starts, lengths, row = words(batch.column(0))
    order, first = pointer_sort(text, starts, lengths)
    heads = order[first]
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(first) - 1
    # one number per (word, document in the order of groups): equal ones are a word's occurrences in a document
    seen, times = np.unique(run * len(groups) + place[row], return_counts=True)
    run, group = seen // max(len(groups), 1), groups[by_group[seen % max(len(groups), 1)]]
    new = np.ones(len(seen), bool)
    new[1:] = (run[1:] != run[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(new)
    head, group = heads[run[at]], group[at]
    size = lengths[head]
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = text[np.arange(offsets[-1]) + np.repeat(starts[head] - offsets[:-1], size)]
    terms = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    counts = np.add.reduceat(times, at) if len(at) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(group // len(sources.dictionary))),
            sources.dictionary.take(pa.array(group % len(sources.dictionary))),
            terms,
            pa.array(counts.astype(np.int64)),
            pa.array(np.diff(np.append(at, len(seen)))),
        ],
        names=["lang", "source", "term", "count", "docs"],
    )


def _shards(batches):
    for batch in batches:
        for part in _slices(batch):
            yield term_counts(part)


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _probability(count: str, total: str) -> Column:
    """In units; wide decimals, as counts of a large corpus times the unit leave 64 bits."""
    return F.expr(f"1 + (cast({count} + {PRIOR} as decimal(20, 0)) * {UNIT}) div cast({total} + {PRIOR} * kept as decimal(20, 0))")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(batches) -> Iterator[pa.RecordBatch]:
    """The rows of ``SUMS`` for (lang, term, source, p, p0) ordered by the first three, whole terms in a task.

    Of two sources, the lesser first: over the terms both hold, the divergence less what each has against the other's
    probability of a missing term; and the number of these terms. Sums are given out every ``PAIRS`` pairs.
    """
    held: list[pa.RecordBatch] = []

    def sums(rows: pa.Table):
        lang, term, source = (rows.column(k).combine_chunks().dictionary_encode() for k in range(3))
        p, p0 = (rows.column(k).to_numpy() for k in (3, 4))
        langs, terms, sources = (x.indices.to_numpy().astype(np.int64) for x in (lang, term, source))
        wide = len(source.dictionary)
        codes, values = [], []

        def given():
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            value, shared = np.zeros(len(code), np.int64), np.bincount(back, minlength=len(code))
            np.add.at(value, back, np.concatenate(values))
            names = [lang.dictionary.take(pa.array(code // wide**2)), *(source.dictionary.take(pa.array(x)) for x in (code // wide % wide, code % wide))]
            return pa.RecordBatch.from_arrays([*names, pa.array(value), pa.array(shared)], names=["lang", "source", "item", "value", "shared"])

        apart, i = 1, np.arange(len(p))
        while len(i := i[i + apart < len(p)]) and len(i := i[(terms[i] == terms[i + apart]) & (langs[i] == langs[i + apart])]):
            j = i + apart
            codes.append((langs[i] * wide + sources[i]) * wide + sources[j])
            values.append(_f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]))
            apart += 1
            if sum(map(len, codes)) > PAIRS:
                yield given()
                codes, values = [], []
        if codes:
            yield given()

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [batch.column(k).slice(batch.num_rows - 1).to_pylist() for k in (0, 1)]
        last = np.ones(batch.num_rows, bool)
        for k in (0, 1):
            last &= np.array(batch.column(k).to_pylist(), object) == ends[k][0]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield from sums(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from sums(pa.Table.from_batches(held))


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: every source against the others of its language, and its most telling terms.

    A language keeps the terms that at least ``least`` of its documents (rows) hold. Part ``pair``: every other source of
    the language and the divergence over all kept terms, widest first. Part ``term``: the ``top`` terms that the source
    has more often than its language, most divergent first. Ties go by the item's bytes.

    Null text, lang and source are empty strings; rows that repeat count as often as they occur; a source without
    terms takes part, a language without kept terms has pairs of value 0; a very long text is counted whole, by itself; an empty
    table gives no rows; other columns are ignored. Needs doc_id for nothing.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = rows.mapInArrow(_shards, COUNTS).repartition("lang", "term").groupBy("lang", "term", "source")
    counted = counted.agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    whole = W.partitionBy("lang", "term")
    counted = counted.select("lang", "term", "source", "count", F.sum("docs").over(whole).alias("docs"), F.sum("count").over(whole).alias("total"), F.min("source").over(whole).alias("_one"))
    counted = written(counted.filter(F.col("docs") >= least).select("lang", "term", "source", "count", "total", (F.col("source") == F.col("_one")).alias("one")), "divergence-counts")

    langs = counted.groupBy("lang").agg(F.count_if("one").alias("kept"), F.sum("count").alias("lang_total"))
    held = counted.groupBy("lang", "source").agg(F.sum("count").alias("group_total"), F.count("*").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(held, ["lang", "source"], "left").na.fill(0)
    groups = groups.withColumn("p0", F.when(F.col("kept") > 0, _probability("0", "group_total")))
    groups = written(groups, "divergence-groups")

    placed = counted.join(groups, ["lang", "source"])
    placed = placed.select("lang", "term", "source", _probability("count", "group_total").alias("p"), "p0", _probability("total", "lang_total").alias("q"))
    placed = written(placed, "divergence-terms")

    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    telling = placed.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence("p", "q").alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    shared = placed.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    shared = shared.mapInArrow(pair_sums, SUMS).groupBy("lang", F.col("source").alias("lo"), F.col("item").alias("hi"))
    shared = shared.agg(F.sum("value").alias("value"), F.sum("shared").alias("shared"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("item_terms"))
    spectrum = placed.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = spectrum.join(other.select("lang", "item", "q0"), "lang").filter("source <> item").groupBy("lang", "source", "item")
    alone = written(alone.agg(F.sum(F.col("times") * _divergence("p", "q0")).alias("alone")), "divergence-alone")
    pairs = groups.select("lang", "source", "kept", "p0", "terms").join(other, "lang").filter("source <> item")
    pairs = pairs.join(alone, ["lang", "source", "item"], "left")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("alone_back"))
    pairs = pairs.join(back, ["lang", "source", "item"], "left")
    pairs = pairs.withColumns({"lo": F.least("source", "item"), "hi": F.greatest("source", "item")}).join(shared, ["lang", "lo", "hi"], "left")
    pairs = pairs.na.fill(0, ["alone", "alone_back", "value", "shared"])
    neither = F.col("kept") - F.col("terms") - F.col("item_terms") + F.col("shared")
    value = F.when(F.col("kept") > 0, F.col("value") + F.col("alone") + F.col("alone_back") + neither * _divergence("p0", "q0")).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(telling)
