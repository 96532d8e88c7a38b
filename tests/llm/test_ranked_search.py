"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import ranked_search

DOCS = "doc_id long, text string, rank string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t, *_ in docs if terms(t)]
    n_all, length = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n_all // length
            score = 0
            for t in set(terms(text)):
                df = sum(t in other for _, other in held)
                score += math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "the", "of", "and", "4x4", "2024", "naïve", "Naïve", "東京"] + [f"w{i}" for i in range(60)]
    weights = [30, 30, 20, 20] + [1] * (len(words) - 4)
    docs = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 60]))), "x", "y") for i in range(160)]
    docs += [docs[5]] * 7 + [(500 + i, docs[9][1], None, None) for i in range(12)]
    docs += [(None, docs[9][1], "", ""), (700, None, "", ""), (701, "", "", ""), (702, "?!", "", ""), (703, "w1 " * 30_000 + "w2", "", "")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 12])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere to be found"), (93, docs[9][1]), (93, docs[9][1]), (None, "w3 w4")]
    return docs, items


@pytest.mark.parametrize("seed,k,limits", [(1, 5, {}), (2, 50, {"TREE": 32, "ITEMS": 7}), (3, 3, {"TREE": 20, "FIRST": 8, "TERMS": 30, "LEAF": 2, "ITEM_LEAF": 1})])
def test_matches_all_pairs(spark, monkeypatch, seed, k, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = corpus(seed)
    got = ranked_search.ranked_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(map(tuple, got.collect())) == key(brute(docs, items, k))


def test_empty_tables(spark):
    docs, items = corpus(4)
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.ranked_search(no_docs, spark.createDataFrame(items, no_items.schema)).collect() == []
    empty = ranked_search.ranked_search(spark.createDataFrame(docs, DOCS), no_items)
    assert empty.collect() == [] and [t for _, t in empty.dtypes] == ["bigint", "int", "bigint", "bigint"]


def test_bound_is_never_below_a_score_and_prunes():
    rng = np.random.default_rng(3)
    topics = [rng.choice(300, 12, replace=False) for _ in range(30)]
    rows = [np.unique(rng.choice(topics[i % 30], 8)) for i in range(900)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = np.concatenate(rows)
    holders = np.bincount(flat, minlength=300)
    weights = np.array([ranked_search.weight(int(h), 900) for h in holders])
    item_offsets = np.arange(0, 30 * 12 + 1, 12)
    block = ranked_search.Block(np.arange(30), item_offsets, np.concatenate([np.sort(t) for t in topics]), weights, 900, len(flat), np.zeros(30, np.int64))
    search = ranked_search.Search(block, 5)
    times, sizes = np.ones(len(flat), np.int64), np.diff(offsets)
    search.add(list(range(900)), sizes, offsets, flat, times)
    assert search.pairs < 900 * 30 / 2
    values = block.coordinates(sizes, times, np.repeat(np.arange(900), sizes))
    dense = np.zeros((900, 300), np.int64)
    dense[np.repeat(np.arange(900), sizes), flat] = values
    for item, topic in enumerate(topics):
        scores = dense[:, topic] @ weights[topic]
        want = sorted((-int(s), d) for d, s in enumerate(scores))[:5]
        assert sorted((-s, -d) for s, _, d in search.heaps[item]) == want
