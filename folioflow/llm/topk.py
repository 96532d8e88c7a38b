"""Exact top-k by inner product with pivot-table elimination.

Vectors become integers, floor(scale * x). The index keeps, besides each vector, its distances to
a number of pivots. By the triangle inequality |d(q, p) - d(x, p)| never exceeds d(q, x), so the
largest of these differences bounds the distance from below, and
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 bounds the score from above. A task evaluates the candidates
of a block in the order of that bound and stops where it falls below the k-th best score so far.

The query set meets all rows in blocks: at most ``QUERY_BLOCK`` queries are sent out at a time
(a bounded broadcast) and every task keeps k candidates per query.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import written

PIVOTS = 32
#: Pivots are chosen, farthest first, among this many rows in the order of a hash of their id.
PIVOT_SAMPLE = 2_048
QUERY_BLOCK = 4_096
#: Vectors per stored block, candidates evaluated between two looks at the bound.
BLOCK, CHUNK = 1_024, 128

BLOCKS = "dim int, ids binary, vectors binary, squares binary, distances binary"
INTEGERS = "_n long, vec_id long, vector array<long>"


def integer_vectors(ids: pa.Array, vectors: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and integer vectors of the rows that take part.

    A row takes none if its id or vector is null, a component is null or not finite, or its integers are so
    large (beyond sqrt(2^62 / dimension)) that a score might leave 64 bits.
    """
    vectors = vectors.cast(pa.large_list(pa.float64()))
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    base = int(offsets[0]) if len(offsets) else 0
    values = np.floor(vectors.values.to_numpy(zero_copy_only=False) * scale)
    whole = ~(np.asarray(ids.is_null()) | np.asarray(vectors.is_null()))
    ids = ids.fill_null(0).to_numpy().astype(np.int64)
    out = {}
    for dim in np.unique(lengths[whole]).tolist():
        rows = np.flatnonzero(whole & (lengths == dim))
        part = values[offsets[rows][:, None] + np.arange(dim)] if base >= 0 else None
        with np.errstate(invalid="ignore"):
            good = (np.abs(part) <= np.sqrt(2.0**62 / max(dim, 1))).all(axis=1)
        out[dim] = ids[rows[good]], part[good].astype(np.int64)
    return out


def choose_pivots(vectors: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first traversal, starting at the row farthest from the mean."""
    points = np.unique(vectors, axis=0).astype(np.float64)
    if not len(points):
        return points
    nearest = ((points - points.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(nearest.argmax())]
    nearest = np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(nearest.argmax()))
    return points[chosen]


def _distances(vectors: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    points = vectors.astype(np.float64)
    if pivots is None or not len(pivots):
        return np.zeros((len(points), 0))
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def build_index(vectors: DataFrame, scale: float = 1024.0, pivots: int = PIVOTS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(stored blocks, pivots by dimension) over every row of ``vectors`` (vec_id, embedding) that takes part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sample = rows.filter("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toArrow()
    by_dim = integer_vectors(*(sample.column(c).combine_chunks() for c in ("vec_id", "embedding")), scale) if len(sample) else {}
    chosen = {dim: choose_pivots(v, pivots) for dim, (_, v) in by_dim.items()}

    def pack(batches):
        waiting: dict[int, list] = {}

        def block(dim, ids, vecs):
            points = vecs.astype(np.float64)
            values = [ids, vecs, (points**2).sum(axis=1), _distances(vecs, chosen.get(dim))]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["dim", "ids", "vectors", "squares", "distances"])

        for batch in batches:
            for dim, (ids, vecs) in integer_vectors(batch.column(0), batch.column(1), scale).items():
                old = waiting.pop(dim, None)
                if old:
                    ids, vecs = np.concatenate([old[0], ids]), np.concatenate([old[1], vecs])
                full = len(ids) // BLOCK * BLOCK
                for i in range(0, full, BLOCK):
                    yield block(dim, ids[i : i + BLOCK], vecs[i : i + BLOCK])
                if full < len(ids):
                    waiting[dim] = [ids[full:], vecs[full:]]
        for dim, (ids, vecs) in waiting.items():
            yield block(dim, ids, vecs)

    return written(rows.mapInArrow(pack, BLOCKS), "topk-index"), chosen


class _Best:
    """The k best (score, id) of one query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            keep = scores >= self.scores[-1]
            if not keep.any():
                return
            scores, ids = scores[keep], ids[keep]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_block(query: np.ndarray, query_id: int, to_pivots: np.ndarray, block: tuple, best: _Best) -> int:
    """Update ``best`` with a block's candidates; the number evaluated.

    Bounds are floating point and get a slack far above their rounding, so none is too low.
    """
    ids, vectors, squares, distances, exact = block
    own = float((query.astype(np.float64) ** 2).sum())
    below = np.abs(distances - to_pivots).max(axis=1) if distances.shape[1] else np.zeros(len(ids))
    bound = (own + squares - below**2) / 2
    bound += 1e-9 * (own + squares) + 1e-6
    order = np.flatnonzero((bound >= best.least) & (ids != query_id))
    order = order[np.argsort(-bound[order])]
    done = 0
    while done < len(order) and bound[order[done]] >= best.least:
        part = order[done : done + CHUNK]
        done += len(part)
        scores = np.rint(vectors[part] @ query.astype(np.float64)).astype(np.int64) if exact is None else exact[part] @ query
        best.add(scores, ids[part])
    return done


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query row, ties to the smaller vec_id.

    Candidates are all rows that take part (see :func:`integer_vectors`), have the query's dimension and another vec_id;
    rows that repeat a vec_id are candidates, and queries, of their own. A query without candidates, and an empty table,
    give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    index, pivots = build_index(vectors, scale)

    def integers(batches):
        for batch in batches:
            for ids, vecs in integer_vectors(batch.column(0), batch.column(1), scale).values():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(vecs), pa.list_(pa.int64()))], names=["vec_id", "vector"])

    chosen = vectors.filter(is_query).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    queries = chosen.mapInArrow(integers, "vec_id long, vector array<long>").withColumn("_n", F.monotonically_increasing_id())
    queries = written(queries, "topk-queries")
    found, last = [], -1
    while rows := queries.filter(F.col("_n") > last).orderBy("_n").limit(QUERY_BLOCK).collect():
        last = rows[-1]["_n"]
        found.append(_search(spark, index, pivots, [(r["_n"], r["vec_id"], r["vector"]) for r in rows], k))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionAll, found).select("query_id", "rank", "vec_id", "score")


def _search(spark, index: DataFrame, pivots: dict, rows: list[tuple], k: int) -> DataFrame:
    sent = spark.sparkContext.broadcast((rows, pivots))

    def scan(batches):
        rows, pivots = sent.value
        queries = [(q, query_id, np.array(v, np.int64)) for q, query_id, v in rows]
        tables = {}
        for dim in {len(v) for _, _, v in queries}:
            of = [i for i, (_, _, v) in enumerate(queries) if len(v) == dim]
            tables |= dict(zip(of, _distances(np.array([queries[i][2] for i in of], np.int64).reshape(len(of), dim), pivots.get(dim)), strict=True))
        largest = {i: int(np.abs(v).max(initial=0)) for i, (_, _, v) in enumerate(queries)}
        best = [_Best(k) for _ in queries]
        for batch in batches:
            for row in batch.to_pylist():
                ids, dim = np.frombuffer(row["ids"], np.int64), row["dim"]
                whole = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), dim)
                most = int(np.abs(whole).max(initial=0))
                block = ids, whole.astype(np.float64), np.frombuffer(row["squares"]), np.frombuffer(row["distances"]).reshape(len(ids), -1)
                for i, (_, query_id, v) in enumerate(queries):
                    if len(v) == dim:
                        exact = None if largest[i] * most * max(dim, 1) < 1 << 53 else whole
                        search_block(v, query_id, tables[i], (*block, exact), best[i])
        at = [(q, query_id, b) for (q, query_id, _), b in zip(queries, best, strict=True) if len(b.ids)]
        if at:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([q for q, _, _ in at], [len(b.ids) for _, _, b in at])),
                    pa.array(np.repeat([i for _, i, _ in at], [len(b.ids) for _, _, b in at])),
                    pa.array(np.concatenate([b.ids for _, _, b in at])),
                    pa.array(np.concatenate([b.scores for _, _, b in at])),
                ],
                names=["_n", "query_id", "vec_id", "score"],
            )

    best = index.mapInArrow(scan, "_n long, query_id long, vec_id long, score long")
    order = W.partitionBy("_n").orderBy(F.col("score").desc(), "vec_id")
    return written(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "topk-block")
