"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into ``max_bits // 2 + 1`` segments, so that of two fingerprints within
``max_bits`` bits at least one segment differs by at most one bit. Every segment is indexed once
for each of its bits with that bit left out; two segments that differ by at most one bit share a
variant. Rows meet by equality of (segment, position, value) and are verified by counting bits.

Nothing is paired within a large bucket. The aggregate that finds a bucket carries its size and its
smallest and largest member, so a bucket of two is one pair. For larger ones see
:func:`exact_links` (exact, at most 65 rows per fingerprint).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import keyed_documents, scanned, written
from folioflow.llm.graph import components

BITS = 64
#: Shingles hashed at a time, so that a very long text needs bounded memory.
STEP = 1 << 15


def _hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's shingles: A-Z in lower case, words joined by a blank, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
    while len(part := np.array([xxh64_intdigest(s, 42) for s in islice(shingles, STEP)], np.uint64)):
        yield part


def fingerprint(text: str, size: int = 3) -> int:
    """The fingerprint as a signed long: a bit is 1 if set in over half of the hashes; no words: zero."""
    ones, total = np.zeros(BITS, np.int64), 0
    for h in _hashes(text, size):
        total += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, value) per row; a null text is empty."""

    def scan(batches):
        for batch in batches:
            values = [fingerprint(t.as_py() or "", size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "value"])

    return scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, "doc_id long, value long")


def variants(value: Column, segments: int) -> Column:
    """The one-bit-out variants of every segment, each as one long: segment, position, remaining bits."""
    cuts = [round(BITS * s / segments) for s in range(segments + 1)]
    out = []
    for s in range(segments):
        width = cuts[s + 1] - cuts[s]
        part = F.shiftrightunsigned(value, cuts[s]).bitwiseAND(F.lit((1 << width) - 1))
        for p in range(width):
            low = part.bitwiseAND(F.lit((1 << p) - 1))
            high = F.shiftleft(F.shiftrightunsigned(part, p + 1), p)
            out.append(high.bitwiseOR(low).bitwiseOR(F.lit((s << 58) | (p << 52))))
    return F.array(*[x.cast("long") for x in out])


def _index(nodes: DataFrame, segments: int) -> DataFrame:
    """(node, variant) of ``nodes`` (node, value)."""
    return nodes.select("node", F.explode(variants(F.col("value"), segments)).alias("variant"))


def _buckets(index: DataFrame) -> DataFrame:
    counts = index.groupBy("variant").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    return written(counts.filter("size > 1"), "simhash-buckets")


def exact_links(values: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the distinct ``value``s within 2 bits of each other.

    Buckets of two are verified as they are. The members of larger buckets, once each, are grouped by
    the 65 values within one bit of them: two values are within 2 bits if and only if they share such a
    neighbour, and at most 65 can, so each group is tied to its smallest member.
    """
    nodes = values.select(F.col("value").alias("node"), "value")
    index = _index(nodes, 2)
    buckets = _buckets(index)
    pairs = buckets.filter("size = 2").select(F.col("hi").alias("a"), F.col("lo").alias("b"))
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    large = index.join(buckets.filter("size > 2").select("variant"), "variant", "left_semi").select("node").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
    around = large.select("node", F.explode(flips).alias("flip")).select("node", F.col("node").bitwiseXOR(F.col("flip")).alias("centre"))
    tied = around.groupBy("centre").agg(F.collect_list("node").alias("nodes")).filter("size(nodes) > 1")
    tied = tied.select(F.array_min("nodes").alias("b"), F.explode("nodes").alias("a")).filter("a <> b")
    return pairs.unionByName(tied.select("a", "b")).distinct()


def near_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id per row: fingerprints within 2 bits are linked.

    component_id is the smallest doc_id that links reach. Equal fingerprints are one node, so copies cost
    nothing beyond their own row. A null text is empty; texts without words share the fingerprint zero;
    a null doc_id keeps its row and never is a component id; an empty table gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, size), "simhash")
    nodes = written(prints.groupBy("value").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(exact_links(nodes))
    placed = nodes.join(roots, nodes["value"] == roots["node"], "left").select("value", "first", F.coalesce("root", "value").alias("root"))
    placed = written(placed, "simhash-roots")
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = placed.join(smallest, "root").select("value", "component_id")
    text = F.lpad(F.lower(F.hex("value")), 16, "0")
    return prints.join(placed, "value").select("doc_id", text.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """The first document (smallest doc_id, a null one last) of every group of :func:`near_fingerprints`, with the columns of ``docs``.

    Rows that repeat both id and text are one document and leave one row. Texts without words, null ones included, share a
    fingerprint like any others and leave one document. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"], docs["text"])
    single = keyed_documents(rows, "row")[1]
    groups = near_fingerprints(single.select(F.col("_key").alias("doc_id"), "text"), size)
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    return single.join(first, "_key", "left_semi").select("row.*")
