"""Water-filling against the plain loop, and how near the mix comes."""

import random

import pytest

from folioflow.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, order_key string"


def loop(sizes, weights, percent=150, epochs=2):
    """Share by weight, clamp what is above, share again."""
    total, clamped = sum(sizes.values()) * percent / 100, set()
    while True:
        left = total - sum(epochs * sizes[s] for s in clamped)
        open_weight = sum(weights[s] for s in sizes if s not in clamped)
        targets = {s: epochs * sizes[s] if s in clamped else left * weights[s] / open_weight if open_weight else 0.0 for s in sizes}
        above = {s for s in sizes if s not in clamped and targets[s] > epochs * sizes[s] + 1e-9}
        if not above:
            return targets
        clamped |= above


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_match_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 5, rng.randrange(10000)]) for i in range(rng.randrange(1, 30))}
    weights = {s: rng.choice([1, 2, 3, 7]) for s in sizes}
    rows = [(s, n, weights[s]) for s, n in sizes.items()]
    got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long, weight int")).collect()
    assert {r["source"]: pytest.approx(r["target"], abs=1e-6) for r in got} == loop(sizes, weights)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, "w " * rng.randrange(1, 200), f"s{min(i % 9, 3)}", "", "", "") for i in range(600)]
    return [*out, (700, None, "s1", "", "", ""), (701, "", None, "", "", ""), (702, "some words", None, "", "", ""), out[0], (None, "x y z", "s2", "", "", "")]


def test_the_mix_is_near_its_targets_and_repeats(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed_sizes(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed_sizes(df.repartition(5)).collect()), key=str)
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    for source in {r["source"] for r in got}:
        part = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= max(r["size"] for r in part)
        assert part[0]["source_size"] == sum(r["size"] for r in part)
    sizes = {}
    for r in got:
        sizes[r["source"]] = r["source_size"]
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = loop({str(s): sizes[s] for s in names}, {str(s): (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    assert all(r["target"] == pytest.approx(want[str(r["source"])]) for r in got)


def test_documents_come_as_often_as_taken(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA)
    times = {}
    for r in mixing.mixed_sizes(df).collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + r["copies"]
    for limit in (100_000, 0):  # broadcast rules, salted join
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        mixed = mixing.mixed_documents(df)
        assert mixed.columns == df.columns
        got = {}
        for r in mixed.collect():
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        assert got == {d: n for d, n in times.items() if n}


def test_given_weights_and_empty_table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("s0", 1), ("s1", 0)], "source string, weight int")
    got = {r["source"]: r["target"] for r in mixing.mixed_sizes(df, weights=weights).collect()}
    assert got["s1"] == got["s2"] == 0 and got["s0"] > 0
    assert mixing.mixed_sizes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mixed_documents(spark.createDataFrame([], SCHEMA)).collect() == []
