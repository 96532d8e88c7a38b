"""Source divergence against plain counting of every term in every group."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall(fold(text or ""))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = sorted(s for of, s in groups if of == lang)

        def p(term, of, lang=lang, kept=kept):
            n = sum((counts[lang, s][term] for s in of), 0)
            return 1 + 10**9 * (n + 2) // (sum(counts[lang, s][t] for s in of for t in kept) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        pairs = [(s, sum(f(p(t, [source]), p(t, [s])) for t in kept)) for s in mine if s != source]
        whole = [(t, p(t, [source]), p(t, mine)) for t in kept if counts[lang, source][t]]
        terms = [(t, f(a, b)) for t, a, b in whole if a > b]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, t, v, i) for i, (t, v) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "a", "Ångström", "ångström", "wordlonger", "wordlongest", "wordlonger" * 3, "eight888", "exactly8x", "abcdefgh", "abcdefghabcdefgh", "né", "日本語", "x"]
    words += [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    rows = []
    for i in range(200):
        source = rng.choice(["hot"] * 4 + ["b", "c", None, "", "d"])
        lang = rng.choice(["en"] * 4 + ["de", None])
        text = rng.choice([" ", ".", "\n", "7"]).join(rng.choices(words, k=rng.randrange(0, 30)))
        rows.append((i, text, lang, source, "clash", 7))
    rows += [rows[3]] * 5 + [(None, None, "en", "b", None, None), (900, "", "fr", "alone", None, None), (901, None, "fr", "other", None, None), (902, "only here", "it", "one", None, None)]
    return rows


@pytest.mark.parametrize("seed,least,slice_bytes,pairs", [(1, 3, 1 << 20, 1 << 21), (2, 10, 64, 3), (3, 1, 500, 40)])
def test_matches_plain_counts(spark, monkeypatch, seed, least, slice_bytes, pairs):
    monkeypatch.setattr(divergence, "SLICE", slice_bytes)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    rows = corpus(seed)
    got = divergence.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), least=least, top=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 4)


def test_very_long_texts_and_words(spark):
    long = "q" * 100_000
    rows = [(i, f"{long} {long}a " + "many words here " * 20_000, "en", s, "", 0) for i, s in enumerate("abab")]
    got = divergence.source_divergence(spark.createDataFrame(rows, SCHEMA), least=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 10)


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pointers_come_in_byte_order():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abz", k=rng.randrange(1, 30))) for _ in range(50)) for _ in range(40)] + ["", "end", "abcdefgh abcdefghi abcdefg"]
    text, starts, lengths, row = divergence.words(pa.array(texts).slice(1))
    order, first = divergence.pointer_sort(text, starts, lengths)
    found = [bytes(text[starts[i] : starts[i] + lengths[i]]) for i in order]
    want = [(w.encode(), k) for k, t in enumerate(texts[1:]) for w in t.split()]
    assert found == sorted(w for w, _ in want)
    assert [found[i] for i in np.flatnonzero(first)] == sorted(set(found))
    assert [(bytes(text[s : s + n]), k) for s, n, k in zip(starts, lengths, row, strict=True)] == want
