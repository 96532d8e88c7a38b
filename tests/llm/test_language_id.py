"""Language identification: held-out accuracy, the fall-back, a plain version of the model."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import language_id
from folioflow.llm.common import table

SCHEMA = "doc_id long, text string, lang string, held_out string, score string"
TEXTS = {"en": "the house and the water were there with thing", "de": "das haus und die wasser waren schön für dich", "fr": "la maison et les eaux étaient là avec ça"}


def rows():
    out = [(i, f"{TEXTS[lang]} {lang}wort{chr(97 + i % 26)}", lang, None, "x") for i, lang in enumerate(list(TEXTS) * 30)]
    return out + [(1000, None, "en", "", ""), (1001, "", "de", "", ""), (1002, "12 34 ... 5_6", "fr", "", ""), (None, "haus und wasser", None, "", ""), (1003, "THE HOUSE " * 50_000, "en", "", "")]


def fitted(spark, data, **bounds):
    docs = spark.createDataFrame(data, SCHEMA)
    return docs, language_id.fit(docs, ~language_id.held_out(docs), **bounds)


def test_held_out_rows_train_nothing(spark):
    data = rows()
    _, model = fitted(spark, data)
    kept = [r for r in data if zlib.crc32((str(r[0]) if r[0] is not None else "").encode()) % 4 != 2]
    assert len(kept) < len(data)
    words = {w for _, text, lang, *_ in kept if text and lang for w in language_id.words_of(text)}
    assert set(model.words) == words
    assert model.langs == sorted(TEXTS)


def test_scores_match_a_plain_version(spark):
    data = rows()
    docs, model = fitted(spark, data)
    counts, grams = defaultdict(Counter), defaultdict(Counter)
    for d, text, lang, *_ in data:
        if text and lang and zlib.crc32((str(d) if d is not None else "").encode()) % 4 != 2:
            counts[lang].update(language_id.words_of(text))
    for lang, seen in counts.items():
        for word in seen:
            for order in language_id.ORDERS:
                marked = f"<{word}>" if order > 1 else word
                for i in range(len(marked) - order + 1):
                    grams[lang, order][marked[i : i + order]] += 1

    def log(of, lang, item):
        everything = {x for table in of.values() for x in table}
        return math.log((of[lang][item] + 0.5) / (sum(of[lang].values()) + 0.5 * (len(everything) + 1)))

    def total(lang, text):
        out = 0.0
        for word in language_id.words_of(text):
            if any(word in counts[x] for x in counts):
                out += log(counts, lang, word)
                continue
            for order in language_id.ORDERS:
                of = {x: grams[x, order] for x in counts}
                marked = f"<{word}>" if order > 1 else word
                known = [g for g in (marked[i : i + order] for i in range(len(marked) - order + 1)) if any(g in t for t in of.values())]
                if known:
                    out += sum(log(of, lang, g) for g in known) / len(known)
                    break
        return out

    for text in ["the wasser", "thingly hausen zzzz", "maisonnette", "q", "x ça ça"]:
        want = [total(lang, text) for lang in model.langs]
        assert model.totals(text).tolist() == pytest.approx(want)
        best = max(range(3), key=lambda k: want[k])
        lang, score = model.predict(text)
        assert lang == model.langs[best]
        assert score == pytest.approx(1 / sum(math.exp(w - want[best]) for w in want))


def test_every_row_has_a_result(spark):
    data = rows()
    docs, model = fitted(spark, data + data[:3])
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(data) + 3
    by_id = {r["doc_id"]: r for r in got}
    for d in (1000, 1001, 1002):
        assert (by_id[d]["lang_pred"], by_id[d]["score"]) == ("und", 0.0)
    assert by_id[None]["lang_pred"] == "de" and by_id[1003]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None, "", "")], SCHEMA)
    model = language_id.fit(docs, ~language_id.held_out(docs))
    assert [r["lang_pred"] for r in language_id.identify(docs, model).collect()] == ["und"]
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.identify(empty, language_id.fit(empty, F.lit(True))).collect() == []


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = language_id.identify(docs, language_id.fit(docs, ~language_id.held_out(docs), rows=200))
    right = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.99
