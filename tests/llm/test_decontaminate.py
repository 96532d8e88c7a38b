"""Leaks against aligning every document with every item cell by cell."""

import random

import numpy as np
import pytest

from folioflow.llm import decontaminate as dc

DOCS = "doc_id long, text string, item_id string, similarity string"
ITEMS = "item_id long, text string, doc_id string"


def plain_score(text, words):
    best, above = 0, [0] * (len(text) + 1)
    for w in words:
        row = [0]
        for j, t in enumerate(text, 1):
            row.append(max(0, above[j - 1] + (dc.MATCH if t == w else dc.MISMATCH), above[j] + dc.GAP, row[-1] + dc.GAP))
        best, above = max(best, *row), row
    return best


def test_align_matches_cell_by_cell():
    rng = np.random.default_rng(4)
    for _ in range(200):
        text, words = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(1, 6, rng.integers(1, 12))
        score, first, last = dc.align(text, words)
        assert score == plain_score(text.tolist(), words.tolist())
        if score:
            assert plain_score(text[first : last + 1].tolist(), words.tolist()) == score


def edited(words, rng, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 3:
            continue
        out += ["other%d" % rng.randrange(99)] if r < 2 * share / 3 else [w, "more"] if r < share else [w]
    return out


@pytest.fixture
def tables():
    rng = random.Random(6)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "w%d" % rng.randrange(3000)
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 60))), "x") for i in range(20)]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.randrange(400))]
        if d % 3 == 0:
            piece = edited(rng.choice(items)[1].split(), rng, rng.choice([0, 0.1, 0.25]))
            k = rng.randrange(len(words) + 1)
            words[k:k] = piece
        if d % 4 == 0:  # one item that very many documents hold
            words += items[7][1].upper().split()
        docs.append((d, ", ".join(words), "a", "b"))
    return docs, items


def test_matches_all_pairs(spark, tables):
    docs, items = tables
    docs = [*docs, (900, "", "", ""), (901, None, "", ""), (None, items[3][1], "", ""), docs[0], (902, "word " * 20000, "", "")]
    items = [*items, (50, "two words", ""), (51, None, ""), (52, "", "")]
    want = all_pairs(docs, items)
    got = dc.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got} == want


def all_pairs(docs, items):
    """Every document aligned with every item as a whole; items of one or two words count as whole copies."""
    number, want = {}, set()
    as_numbers = lambda t: np.array([number.setdefault(w, len(number) + 1) for w in dc.words_of(t or "")], np.int64)
    for d, t, *_ in docs:
        text = as_numbers(t)
        for i, s, _ in items:
            words = as_numbers(s)
            if len(words) and len(text):
                score = dc.align(text, words)[0] / (2 * len(words))
                if score >= (0.5 if len(words) > 2 else 1):
                    want.add((d, i, round(score, 9)))
    return want


def test_heavily_edited_copies_match_all_pairs(spark):
    """Items of 1 to 300 words; copies with words changed, left out and put in until none of three words in a row may be left."""
    rng = random.Random(21)
    word = lambda: rng.choice("the of and to in a is it".split()) if rng.random() < 0.5 else "w%d" % rng.randrange(300)
    items = [(n, " ".join(word() for _ in range(size)), "") for n, size in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 11, 16, 25, 40, 80, 150, 300])]
    items += [(50, "alpha beta gamma delta epsilon", ""), (51, "a1 a2 a3 a4 a5 a6 a7 a8", ""), (52, "rareword", "")]
    docs = []
    for n in range(150):
        words = rng.choice(items)[1].split()
        every, kind = rng.randrange(1, 5), rng.randrange(3)
        out = []
        for k, w in enumerate(words):
            hit = k % every == every - 1
            out += [w, "more%d" % k] if hit and kind == 0 else ["other"] if hit and kind == 1 else [] if hit and kind == 2 and every > 1 else [w]
        docs.append((n, " ".join([word() for _ in range(rng.randrange(40))] + out + [word() for _ in range(rng.randrange(40))]), "", ""))
    docs += [(900, "x alpha beta zzz delta epsilon y", "", ""), (901, "a1 a2 q a4 a5 q a7 a8", "", ""), (902, "a1 q a2 q a3 q a4 q a5 q a6 q a7 q a8", "", "")]
    docs += [(903, "one RareWord here", "", "")]
    want = all_pairs(docs, items)
    assert {(900, 50, 0.7), (901, 51, 0.625), (903, 52, 1.0)} <= want and any(w[:2] == (902, 51) for w in want) and len(want) > 100
    got = dc.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got} == want


def test_clean_documents_stay(spark, tables):
    docs, items = tables
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    leaking = {r["doc_id"] for r in dc.find_leaks(*frames).collect()}
    kept = dc.drop_leaks(*frames)
    assert kept.columns == ["doc_id", "text", "item_id", "similarity"]
    assert {r["doc_id"] for r in kept.collect()} == {d[0] for d in docs} - leaking


def test_blocks_of_items(spark, tables, monkeypatch):
    docs, items = tables
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    blocks = list(dc.item_blocks(frames[1], 200))
    assert len(blocks) > 2 and sum(len(b.ids) for b in blocks) == len(items)


def test_texts_without_any_seed(spark):
    items = spark.createDataFrame([(1, "some words of an item", "")], ITEMS)
    docs = spark.createDataFrame([(1, "nothing in common at all", "", ""), (2, "", "", "")], DOCS)
    assert dc.find_leaks(docs, items).collect() == []
    assert dc.drop_leaks(docs, items).count() == 2


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert dc.find_leaks(docs, items).collect() == []
    assert dc.find_leaks(docs, spark.createDataFrame([(1, "some words of an item", "")], ITEMS)).collect() == []
    assert dc.drop_leaks(spark.createDataFrame([(1, "t", "", "")], DOCS), items).count() == 1


def test_long_items_edited_and_partial_copies(spark, monkeypatch):
    """Copies that keep few of an item's n-grams, alone in the corpus and next to an exact copy."""
    monkeypatch.setattr(dc, "GROUP_HITS", 50)
    rng = random.Random(11)
    cases = [(100, 6, 1.0), (80, 4, 1.0), (150, 8, 1.0), (200, 8, 1.0), (200, 0, 0.6), (300, 5, 0.9)]
    items, docs = [], []
    for n, (size, every, share) in enumerate(cases * 2):
        words = ["w%d" % rng.randrange(2000) for _ in range(size)]
        copy = ["edit" if every and k % every == every - 1 else w for k, w in enumerate(words)][: int(size * share)]
        around = [["v%d" % rng.randrange(2000) for _ in range(50)] for _ in range(2)]
        items.append((n, " ".join(words), ""))
        docs.append((n, " ".join(around[0] + copy + around[1]), "", ""))
        if n >= len(cases):
            docs.append((100 + n, " ".join(words), "", ""))
    want = set()
    for d, t, *_ in docs:
        for i, s, _ in items:
            score, *_ = dc.align(*(np.array([int(w[1:]) + 1 if w[0] == "w" else -1 for w in x.split()]) for x in (t, s)))
            if score >= len(s.split()):
                want.add((d, i, score / 2 / len(s.split())))
    assert {w[:2] for w in want} == {(d[0], d[0] % 100) for d in docs}
    got = dc.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in got} == want
