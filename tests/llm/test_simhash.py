"""SimHash groups against comparing every pair of fingerprints."""

import random
import re

import pytest
import xxhash

from folioflow.llm import graph, simhash

SCHEMA = "doc_id long, text string, root string, _key string, row string"


def plain_fingerprint(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(rows):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    values = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2]
    root = closure(links, values)
    ids = {}
    for (d, *_), p in zip(rows, prints, strict=True):
        if d is not None:
            ids[root[p]] = min(ids.get(root[p], d), d)
    return sorted(((d, f"{p:016x}", ids.get(root[p])) for (d, *_), p in zip(rows, prints, strict=True)), key=str)


def test_matches_all_pairs(spark):
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(400) for _ in range(250)]
    texts = ["", None, " \t\n", "one", "two words", "İ Straße ÀB", "a\x0bb\x0cc d"]
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(9)
        texts.append(" ".join(words))
    texts += [texts[10]] * 4 + [texts[11].upper()]
    rows = [(i * 7 % 997 if i % 41 else None, t, "r", "k", None) for i, t in enumerate(texts)]
    got = simhash.near_fingerprints(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_dense_values_link_exactly(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(400):
        v = centre if rng.random() < 0.5 else rng.choice(sorted(values))
        for _ in range(rng.randrange(4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = closure([(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2], signed)
    links = simhash.exact_links(spark.createDataFrame([(v,) for v in signed], "value long"))
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert {v: got.get(v, v) for v in signed} == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}}


@pytest.mark.parametrize("rows", [[], [(None, None, "", "", "")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert simhash.near_fingerprints(df).count() == len(rows)
    assert simhash.drop_near_duplicates(df).count() == len(rows)


def test_first_of_each_group_stays(spark):
    rng = random.Random(9)
    rows = []
    for g in range(30):
        text = ["w%d" % rng.randrange(5000) for _ in range(300)]
        rows.append((g * 10, " ".join(text), "r", "k", None))
        for c in range(1, 6):
            copy = list(text)
            if c > 2:
                copy[rng.randrange(300)] = "edit"
            rows.append((g * 10 + c, "\t".join(copy).upper(), "r", "k", None))
    rows += [(1001, "", "", "", ""), (1002, None, "", "", ""), (1003, "short text", "", "", "")]
    rows += [(1004, "word " * 200_000, "", "", ""), (1005, "WORD " * 199_000, "", "", "")]
    want = [d for d, _, component in brute(rows) if d == component]
    assert {g * 10 for g in range(30)} | {1001, 1003, 1004} <= set(want) and 60 < len(want) < 180
    # rows without an id come after all others; a repeated row is one document
    extra = [(None, "no id", "", "", ""), (None, "short text", "", "", ""), rows[-3]]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows + extra, SCHEMA))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=str) == sorted([*want, None], key=str)


def test_whole_table(spark, sf):
    from folioflow.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op3_simhash_groups"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
