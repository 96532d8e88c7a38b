"""Ranked lexical search of whole collections by a dual tree.

Documents become coordinates over the items' terms: the part of a term's score that depends on the document. Within a
task, documents with the same telling terms are laid side by side and form a binary tree whose nodes hold, per term, the largest
coordinate below them. Items form a tree whose nodes hold the largest weight per term. The sum of the products of
two nodes' maxima is at least every score between their items and their documents; where it is below the weakest k-th
best score of the node's items, the whole batch of pairs is left out, and nothing that is left out can be a result.

Items are a stated query set: they meet all documents in blocks of bounded size. A block costs one scan of the texts,
whose result (coordinates over the block's terms) is written and searched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import WORD_TABLE, written

#: Items and distinct item terms per block (a single larger item is a block of its own).
ITEMS, TERMS = 20_000, 1_000_000
#: Documents per tree, documents per leaf, items per leaf.
TREE, LEAF, ITEM_LEAF = 8_192, 8, 2
#: About so many documents are searched first, for k-th best scores to start from.
FIRST = 16_384

INDEX = "doc_id long, size long, terms array<int>, times array<int>"
FOUND = "_n long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order: ASCII letters and digits and all other characters, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(WORD_TABLE).split()


def weight(holders: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The rows of ``INDEX`` for every document with a term; positions in ``vocabulary`` and occurrences, in the order of positions."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches):
        known = sent.value
        for batch in batches:
            ids, sizes, terms, times, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                held = Counter(map(known.get, found))
                held.pop(None, None)
                ids.append(doc_id)
                sizes.append(len(found))
                for term in sorted(held):
                    terms.append(term)
                    times.append(held[term])
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, times)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "size", "terms", "times"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(scan, INDEX)


@dataclass
class Node:
    """``terms`` ascending and the largest value of each below; members from ``low`` to ``high`` of the tree's order."""

    low: int
    high: int
    terms: np.ndarray
    most: np.ndarray
    children: tuple = ()


def tree(offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int) -> Node:
    """A binary tree over rows in the order given; row i has the terms and values from offsets[i] to offsets[i + 1]."""

    def merged(t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        at = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        return t[at], np.maximum.reduceat(v, at) if len(at) else v

    def build(low: int, high: int) -> Node:
        if high - low <= leaf:
            part = slice(offsets[low], offsets[high])
            return Node(low, high, *merged(terms[part], values[part]))
        middle = low + leaf * -(-(high - low) // (2 * leaf))
        children = build(low, middle), build(middle, high)
        return Node(low, high, *merged(*(np.concatenate(x) for x in zip(*((c.terms, c.most) for c in children), strict=True))), children)

    return build(0, len(offsets) - 1)


def by_telling_terms(offsets: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
    """An order of rows that puts rows with the same two largest values' terms side by side."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((terms, values, rows))
    keys = []
    for back in (1, 2):
        at = offsets[1:] - back
        held = at >= offsets[:-1]
        key = np.full(len(offsets) - 1, -1, np.int64)
        key[held] = terms[order[at[held]]]
        keys.append(key)
    return np.lexsort((keys[1], keys[0]))


def reordered(offsets: np.ndarray, order: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Offsets and columns of ragged rows in another order."""
    sizes = np.diff(offsets)[order]
    out = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(out[-1]) + np.repeat(offsets[:-1][order] - out[:-1], sizes)
    return out, *(c[take] for c in columns)


@dataclass
class Block:
    """A block of items: rows (number, positions of its terms), the terms' weights, and the collection's N and L."""

    numbers: np.ndarray
    offsets: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    documents: int
    length: int
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @cached_property
    def root(self) -> Node:
        return tree(self.offsets, self.terms, self.weights[self.terms], ITEM_LEAF)

    def coordinates(self, sizes: np.ndarray, times: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """What a term's weight is multiplied with."""
        m = 50 + 50 * sizes * self.documents // self.length
        return 1_000_000_000 * times // (1000 * times + 20 * m[rows])


class Search:
    """The k best (score, id) of every item over the trees it is given."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.heaps: list[list] = [[] for _ in block.numbers]
        self.least = block.least.copy()
        self.scratch = np.zeros(len(block.weights), np.int64)
        self.pairs = 0

    def add(self, ids: list, sizes: np.ndarray, offsets: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        """Search one tree of documents."""
        rows = np.repeat(np.arange(len(sizes)), np.diff(offsets))
        values = self.block.coordinates(sizes, times, rows)
        order = by_telling_terms(offsets, terms, values * self.block.weights[terms])
        self.ids = [ids[i] for i in order]
        self.offsets, self.terms, self.values = reordered(offsets, order, terms, values)
        self.visit(tree(self.offsets, self.terms, self.values, LEAF), [self.block.root])

    def alive(self, docs: Node, items: list[Node]) -> list[Node]:
        """Of these item nodes those that the bound doesn't rule out, opened into their children where that rules out some."""
        self.scratch[docs.terms] = docs.most
        out, stack = [], list(items)
        while stack:
            node = stack.pop()
            bound = int(self.scratch[node.terms] @ node.most)
            if bound < max(1, int(self.least[node.low : node.high].min())):
                continue
            if node.children:
                stack += node.children
            else:
                out.append(node)
        self.scratch[docs.terms] = 0
        return out

    def visit(self, docs: Node, items: list[Node]) -> None:
        items = self.alive(docs, items)
        if not items:
            return
        if not docs.children:
            self.score(docs, items)
            return
        for child in sorted(docs.children, key=lambda c: -int((c.most * self.block.weights[c.terms]).sum())):
            self.visit(child, items)

    def score(self, docs: Node, items: list[Node]) -> None:
        """Exact scores of a leaf's documents for the items of these leaves."""
        local = docs.terms
        of = np.concatenate([np.arange(n.low, n.high) for n in items])
        offsets, terms = reordered(self.block.offsets, of, self.block.terms)
        row = np.repeat(np.arange(len(of)), np.diff(offsets))
        place = np.minimum(np.searchsorted(local, terms), len(local) - 1)
        shared = local[place] == terms
        weights = self.block.weights[terms]
        # sums of at most this many coordinates of at most a million: whole numbers in doubles below 2^53
        largest = int(np.add.reduceat(weights, offsets[:-1]).max()) * 1_000_000
        kind = np.float64 if largest < 1 << 53 else np.int64
        left, right = np.zeros((len(of), len(local)), kind), np.zeros((docs.high - docs.low, len(local)), kind)
        left[row[shared], place[shared]] = weights[shared]
        part = slice(self.offsets[docs.low], self.offsets[docs.high])
        rows = np.repeat(np.arange(docs.high - docs.low), np.diff(self.offsets[docs.low : docs.high + 1]))
        right[rows, np.searchsorted(local, self.terms[part])] = self.values[part]
        scores = (left @ right.T).astype(np.int64)
        self.pairs += scores.size
        for i, j in zip(*np.nonzero((scores > 0) & (scores >= self.least[of][:, None])), strict=True):
            self.offer(int(of[i]), int(scores[i, j]), self.ids[docs.low + int(j)])

    def offer(self, item: int, score: int, doc_id: int | None) -> None:
        """Keep it if it is among the k best; equal scores by ascending id, a null one last."""
        heap = self.heaps[item]
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(heap) < self.k:
            heappush(heap, entry)
        elif entry > heap[0]:
            heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = max(self.least[item], heap[0][0])

    def found(self) -> Iterator[pa.RecordBatch]:
        rows = [(n, -i if known else None, s) for n, heap in zip(self.block.numbers.tolist(), self.heaps, strict=True) for s, known, i in heap]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_n", "doc_id", "score"])


def _ragged(batch: pa.RecordBatch) -> tuple:
    terms = batch.column(2)
    offsets = terms.offsets.to_numpy().astype(np.int64)
    low, high = offsets[0], offsets[-1]
    columns = (batch.column(k).values.to_numpy()[low:high].astype(np.int64) for k in (2, 3))
    return batch.column(0).to_pylist(), batch.column(1).to_numpy(), offsets - low, *columns


def _searched(index: DataFrame, block: Block, k: int) -> DataFrame:
    """The rows of ``FOUND``: each task's k best documents of every item, ranked over all tasks."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        search, waiting, held = Search(sent.value, k), [], 0
        for batch in batches:
            for part in (batch.slice(i, TREE) for i in range(0, batch.num_rows, TREE)):
                if held + part.num_rows > TREE:
                    search.add(*_ragged(_joined(waiting)))
                    waiting, held = [], 0
                waiting.append(part)
                held += part.num_rows
        if held:
            search.add(*_ragged(_joined(waiting)))
        yield from search.found()

    found = index.mapInArrow(scan, FOUND)
    order = W.partitionBy("_n").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    """Items in blocks: their numbers and their distinct terms."""

    def split(batches):
        for batch in batches:
            terms = pa.array([sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms], names=["_n", "terms"])

    rows, last = written(items.select("_n", "text").mapInArrow(split, "_n long, terms array<binary>").filter("size(terms) > 0"), "search-items"), -1
    while True:
        sizes = rows.filter(F.col("_n") > last).orderBy("_n").limit(ITEMS).select("_n", F.size("terms").alias("size")).collect()
        if not sizes:
            return
        fits = np.cumsum([r["size"] for r in sizes]) <= TERMS
        end = sizes[max(int(fits.sum()), 1) - 1]["_n"]
        part = rows.filter((F.col("_n") > last) & (F.col("_n") <= end)).orderBy("_n").collect()
        last = end
        yield [r["_n"] for r in part], [list(map(bytes, r["terms"])) for r in part]


def _block(index: DataFrame, numbers: list, terms: list, vocabulary: dict) -> Block:
    documents, length = index.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    holders = np.zeros(len(vocabulary), np.int64)
    for term, count in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holders[term] = count
    weights = np.array([weight(int(h), documents) for h in holders], np.int64)
    ids = [np.array([vocabulary[t] for t in of], np.int64) for of in terms]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    flat = np.concatenate(ids)
    order = by_telling_terms(offsets, flat, weights[flat])
    offsets, flat = reordered(offsets, order, flat)
    return Block(np.array(numbers, np.int64)[order], offsets, flat, weights, documents, length, np.zeros(len(numbers), np.int64))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of ``docs`` (doc_id, text) that score highest for each item (item_id, text).

    The score is the contract's whole-number BM25: every term's floor(1000 ln((2N + 2) / (2 df + 1))) times the
    document's (10^9 tf) div (1000 tf + 20 m), once per distinct term of the item. Only scores above 0 count; ties go to the smaller
    doc_id, a null one last. Null and empty texts have no terms: such items give no rows, such documents are no part
    of N. Rows that repeat are documents, and items, of their own; very long texts count whole; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    numbered = written(items.select("item_id", "text").withColumn("_n", F.monotonically_increasing_id()), "search-numbers")
    out = []
    for numbers, terms in _blocks(numbered):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*terms)))}
        index = written(_index(docs, vocabulary), "search-index")
        block = _block(index, numbers, terms, vocabulary)
        if not block.documents:
            continue
        if block.documents > 4 * FIRST:
            share = -(-block.documents // FIRST)
            first = _searched(index.filter(F.pmod(F.xxhash64("doc_id", "size"), F.lit(share)) == 0), block, k)
            place = {n: i for i, n in enumerate(block.numbers.tolist())}
            for n, score in first.filter(F.col("rank") == k).select("_n", "score").collect():
                block.least[place[n]] = score
        out.append(written(_searched(index, block, k), "search-found"))
    if not out:
        return spark.createDataFrame([], items.select("item_id").schema.add("rank", "integer").add("doc_id", "long").add("score", "long"))
    found = reduce(DataFrame.unionAll, out)
    return found.join(numbered.select("_n", "item_id"), "_n").select("item_id", "rank", "doc_id", "score")
