"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items meet the corpus in blocks of at most ``BLOCK_WORDS`` words, the bound of what is sent to the tasks. Seeds are
pairs of words with at most one word between them, on either side. A copy may keep no longer n-gram (every other word changed
or a word put in between), but it always keeps pairs: take an item of n words and an alignment of similarity s or more. It has
at least s n equal words, and what parts them costs at most 2 (equal words - s n). A step from one equal word to the next that is
no such pair costs two or more, so at least ceil(s n) - 1 steps are pairs, each from another word of the item. Of the n - 1 words
that begin a pair any n + 1 - ceil(s n) therefore hold one of the copy's: the rarest in the corpus are taken, and no copy is missed.

The corpus is read twice: for the number of documents that hold each pair, and for the copies. Seeds that occur in a document
tie it to items, and a local alignment of the item's words with the document around its seeds scores the copy. An
exact bound (shared words) spares most alignments that a common seed asks for. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import WORD_TABLE, words_of, written

#: Least similarity of a copy.
SIMILARITY = 0.5
#: Distances of the two words of a seed.
STEPS = (1, 2)
#: Alignment scores: equal words, unequal words, a word left out on either side.
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 500_000
#: Characters of texts that are worked on at a time, or one longer text.
GROUP_CHARS = 1_000_000
#: Seeds found in texts that are worked on at a time, or those of one text.
GROUP_HITS = 1_000_000

LINKS = "doc_id long, item_id long, similarity double, first_word int, last_word int"


class Items:
    """A block of test items as word numbers, and their pairs of words that stand near each other."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int64) for _, ws in items]
        self.base = len(self.number) + 1
        # an item of one word has no pair; the word itself is its seed
        self.single = np.zeros(self.base, bool)
        self.single[[int(w[0]) for w in self.words if len(w) == 1]] = True
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.pairs(w)[0] for w in self.words)]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, positions) of the pairs of known words, and of the words that are items; positions below 0 part texts."""
        codes, places = [], []
        for step in STEPS:
            here, there = numbers[:-step], numbers[step:]
            fits = (here > 0) & (there > 0)
            for between in range(1, step):
                fits &= numbers[between : len(numbers) - step + between] >= 0
            at = np.flatnonzero(fits)
            codes.append(here[at] * self.base + there[at])
            places.append(at)
        if self.single.any():
            at = np.flatnonzero(self.single[np.maximum(numbers, 0)])
            codes.append(numbers[at])  # below ``base``, as no pair is
            places.append(at)
        return np.concatenate(codes), np.concatenate(places)

    def known_pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``codes``, positions) of those pairs of a text that some item has."""
        code, at = self.pairs(numbers)
        place = np.searchsorted(self.codes, code)
        found = np.flatnonzero(place < len(self.codes))
        found = found[self.codes[place[found]] == code[found]]
        return place[found], at[found]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of some texts one after another, 0 for unknown words, -1 between texts; where each text starts, and the end."""
        data = b" \1 ".join([t.lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE) for t in texts])
        words = data.split()
        out = np.fromiter(map(self.known.get, words, repeat(0)), np.int64, len(words))
        return out, np.concatenate([[0], np.flatnonzero(out < 0) + 1, [len(out) + 1]])

    def pairs_of(self, texts: list[str]) -> np.ndarray:
        """Places in ``codes`` of the pairs in some texts, each once per text that has it."""
        numbers, bounds = self.numbers(texts)
        place, at = self.known_pairs(numbers)
        return np.unique(np.searchsorted(bounds, at, side="right") * (len(self.codes) + 1) + place) % (len(self.codes) + 1)

    @cached_property
    def known(self) -> dict[bytes, int]:
        return {**self.number, b"\1": -1}


class Matcher:
    """Finds copies of a block's items in a text; ``frequency`` is the number of documents that hold each pair of the block."""

    def __init__(self, items: Items, similarity: float, frequency: np.ndarray):
        self.items, self.similarity = items, similarity
        #: Items too short for a pair to be certain (two words at a similarity of one half) count as whole copies only.
        self.least = [similarity if _shared(len(w), similarity) > 1 else 1.0 for w in items.words]
        entries = []
        for n, (words, least) in enumerate(zip(items.words, self.least, strict=True)):
            place, at = items.known_pairs(words)
            weight = np.bincount(at, frequency[place], minlength=len(words))
            begins = np.unique(at)
            seeds = len(words) + 1 - _shared(len(words), least)
            taken = np.zeros(len(words), bool)
            taken[begins[np.argsort(weight[begins], kind="stable")][:seeds]] = True
            entries += [(c, n, p) for c, p in zip(place.tolist(), at.tolist(), strict=True) if taken[p]]
        entries.sort()
        self.present = np.zeros(items.base, bool)
        self.code, self.item, self.place = (np.array([e[k] for e in entries], np.int64) for k in range(3))

    def __call__(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """(text, item_id, similarity, first word, last word) of each item's best copy in each text."""
        numbers, bounds = self.items.numbers(texts)
        code, at = self.items.known_pairs(numbers)
        low, high = np.searchsorted(self.code, code), np.searchsorted(self.code, code, side="right")
        order = np.argsort(at, kind="stable")
        at, low, high = at[order], low[order], high[order]
        hits = np.append(0, np.cumsum(high - low))[np.searchsorted(at, bounds)]  # before each text
        out, first = [], 0
        while first < len(texts):
            stop = max(first + 1, int(np.searchsorted(hits, hits[first] + GROUP_HITS, side="right")) - 1)
            part = slice(*np.searchsorted(at, bounds[[first, min(stop, len(texts))]]))
            out += self._copies(numbers, bounds, at[part], low[part], high[part])
            first = stop
        return out

    def _copies(self, numbers: np.ndarray, bounds: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """The copies in those texts whose pairs stand ``at`` these places; the seeds equal to each are ``low`` to ``high``."""
        hit = np.repeat(np.arange(len(at)), high - low)
        if not len(hit):
            return []
        entry = np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[hit]
        text = np.searchsorted(bounds, at[hit], side="right") - 1
        item, start = self.item[entry], at[hit] - self.place[entry] - bounds[text]
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))) if len(order) else []
        out = []
        for a, b in zip(new, [*new[1:], len(order)], strict=True):
            t, n = int(text[a]), int(item[a])
            best = max(self._around(numbers[bounds[t] : bounds[t + 1] - 1], self.items.words[n], np.unique(start[a:b])), default=(0.0, 0, 0))
            if best[0] >= self.least[n]:
                out.append((t, self.items.ids[n], *best))
        return out

    def _around(self, numbers: np.ndarray, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Alignments with the text around supposed starts of the item; regions that meet are one."""
        slack = int(2 * (1 - self.similarity) * len(words)) + 1  # words that a copy can have beside the item's
        lows, highs = np.maximum(starts - slack, 0), np.minimum(starts + len(words) + slack, len(numbers))
        breaks = np.flatnonzero(lows[1:] > highs[:-1]) + 1
        for first, stop in zip(np.append(0, breaks), np.append(breaks, len(starts)), strict=True):
            low, high = int(lows[first]), int(highs[stop - 1])
            region = numbers[low:high]
            self.present[region] = True
            shared = int(self.present[words].sum())
            self.present[region] = False
            if shared < self.similarity * len(words):
                continue  # no alignment scores above its shared words
            score, a, b = align(region, words)
            yield score / (MATCH * len(words)), low + a, low + b


def _shared(size: int, similarity: float) -> int:
    """Words of an item of ``size`` words that a copy of this similarity shares at least."""
    return ceil(similarity * size - 1e-9)


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts), some ``GROUP_CHARS`` characters at a time."""
    first, size = 0, 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS:
            yield first, texts[first : n + 1]
            first, size = n + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def align(text: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last) of the best local alignment; first and last are positions in ``text``.

    A row of the matrix at a time: gaps along the text are a running maximum. Each cell carries where its alignment began.
    """
    size = len(text)
    position = np.arange(size + 1)
    score, begun = np.zeros(size + 1, np.int64), position.copy()
    best = (0, 0, 0)
    for w in words.tolist():
        straight = score[:-1] + np.where(text == w, MATCH, MISMATCH)
        skipped = score[1:] + GAP
        cell = np.maximum(straight, skipped)
        start = np.where(straight >= skipped, begun[:-1], begun[1:])
        fresh = cell <= 0
        cell = np.append(0, np.where(fresh, 0, cell))
        start = np.append(0, np.where(fresh, position[1:], start))
        level = cell - GAP * position
        reach = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == reach, position, 0))
        score = reach + GAP * position
        begun = start[source]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(begun[top]), top - 1)
    return best


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items with any word, read in order and gathered into blocks of some ``limit`` words."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        block.append((row["item_id"], words))
        size += len(words)
        if size >= limit:
            yield Items(block)
            block, size = [], 0
    if block:
        yield Items(block)


def frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """Number of documents that hold each pair of the block: counted per batch, then summed; at most a block's pairs come back."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches):
        for batch in batches:
            found = [sent.value.pairs_of(texts) for _, texts in _groups(batch.column(0).to_pylist())]
            codes, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "code long, n long")
    out = np.zeros(len(items.codes), np.int64)
    for row in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[row["code"]] = row["n"]
    sent.destroy()
    return out


def matchers(docs: DataFrame, benchmark: DataFrame, similarity: float) -> Iterator[Matcher]:
    for items in item_blocks(benchmark):
        yield Matcher(items, similarity, frequencies(docs, items))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, first_word, last_word: each document and test item it holds a copy of.

    Similarity is the best local alignment's score over that of a whole, exact copy. Items too short for that (one or two
    words at one half) are found as whole copies, items without words never. A null text is empty and very long texts are
    searched whole; repeated documents and repeated items give a row each; a null id stays null; empty tables give
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = []
    for matcher in matchers(docs, benchmark, similarity):
        sent = spark.sparkContext.broadcast(matcher)

        def scan(batches, sent=sent):
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[n + k], *link) for n, texts in _groups(batch.column(1).to_pylist()) for k, *link in sent.value(texts)]
                columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in LINKS.split(", ")]
                )

        found.append(written(rows.mapInArrow(scan, LINKS), "leaks"))
        sent.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], LINKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without a copy of any test item, with the columns of ``docs``; same rules as :func:`find_leaks`."""
    spark = docs.sparkSession
    place = docs.columns.index("text")
    for matcher in matchers(docs, benchmark, similarity):
        sent = spark.sparkContext.broadcast(matcher)

        def clean(batches, sent=sent):
            for batch in batches:
                texts = [t or "" for t in batch.column(place).to_pylist()]
                leaking = {n + k for n, part in _groups(texts) for k, *_ in sent.value(part)}
                yield batch.filter(pa.array([k not in leaking for k in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
