"""Repeated windows against comparing every window."""

import hashlib
import random

import pytest

from folioflow.llm import suffix_dedup

SCHEMA = "doc_id long, text string, at string, n string, _key string"


def brute(rows, threshold):
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    seen, result = set(), {}
    for doc_id, text in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - threshold + 1):
            window = data[i : i + threshold]
            if window in seen:
                gone[i : i + threshold] = b"\1" * threshold
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        result[doc_id, text] = (doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return sorted((result[r[0], r[1] or ""] for r in rows), key=str)


def made(seed, n, alphabet):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randrange(90, 400)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else word(rng.randrange(200)) for _ in range(rng.randrange(6))]
        text = "".join(parts)
        if rng.random() < 0.3 and rows:
            text = rng.choice(rows)[1] or ""
            if text and rng.random() < 0.7:
                k = rng.randrange(len(text))
                text = text[:k] + word(rng.randrange(3)) + text[k + rng.randrange(3) :]
        rows.append((i * 13 % n, text, "a", "b", None))
    return rows


def same(spark, rows, threshold=100, block=suffix_dedup.BLOCK):
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(7), threshold, block=block).collect()
    want = brute(rows, threshold)
    got = sorted(((*r[:5], bytes(r[5])) for r in map(tuple, got)), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert got == want


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefghij klmno"), (2, "aé漢😀 "), (3, "ab")])
def test_matches_all_windows(spark, seed, alphabet):
    same(spark, made(seed, 101, alphabet))


def test_odd_texts_and_ids(spark):
    rows = made(4, 40, "abcdefgh ")
    rows += [(1, "x" * 450, "", "", ""), (2, "x" * 100, "", "", ""), (3, "", "", "", ""), (4, None, "", "", ""), (None, "xy" * 200, "", "", ""), (None, "xy" * 300, "", "", "")]
    rows += [rows[0], rows[0], (rows[0][0], "ab" * 120, "", "", "")]
    same(spark, rows)


def test_long_texts_are_worked_on_in_blocks(spark):
    rows = made(5, 30, "abcdefgh ")
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows += [(1000, long, "", "", ""), (1001, "zz" + long[300:4800] + "yy" + long, "", "", "")]
    same(spark, rows, block=700)


def test_threshold_is_a_parameter(spark):
    same(spark, made(6, 60, "abcdefgh "), threshold=53)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
