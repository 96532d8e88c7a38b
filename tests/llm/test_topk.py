"""Exact top-k against scoring every pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label string, score string"


def brute(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("k,block,chunk", [(10, 16, 4), (3, 1024, 128)])
def test_matches_all_pairs(spark, monkeypatch, k, block, chunk):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.05, size=5)).tolist(), "x", None) for i in range(420)]
    rows += [(i, rows[0][1], "copy", None) for i in range(500, 530)] + [(600, rows[0][1], "q", None)]
    rows += [(700, None, "n", None), (701, [None, 1.0, 1.0, 1.0, 1.0], "n", None), (None, rows[1][1], "n", None), (702, [float("nan")] * 5, "n", None)]
    rows += [(703, [float("inf")] * 5, "n", None), (800, [1.0, 2.0], "short", None), (801, [3.0, -1.0], "short", None), (900, [], "empty", None), (901, [], "empty", None)]
    rows += [(1000, [200000.5, -3.0, 0.1, 150000.0, 7.0], "large", None), (1001, [-200000.5, -3.0, 0.1, 170000.0, 7.0], "large", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=k).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == brute(rows, k)


def test_repeated_rows(spark):
    rows = [(0, [1.0], "", ""), (1, [2.0], "", ""), (1, [2.0], "", ""), (0, [1.0], "", "")]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id").collect())) == [(0, 1, 1), (0, 1, 1), (0, 2, 1), (0, 2, 1)]


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []


def test_bound_eliminates(spark):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(20, 4))[np.arange(1000) % 20] * 1000 + rng.normal(size=(1000, 4))).astype(np.int64)
    pivots = topk.choose_pivots(data)
    block = np.arange(1000), data.astype(float), (data.astype(float) ** 2).sum(axis=1), topk._distances(data, pivots), None
    best = topk._Best(10)
    tested = topk.search_block(data[0], 0, topk._distances(data[:1], pivots)[0], block, best)
    assert tested < 500 and len(best.ids) == 10
