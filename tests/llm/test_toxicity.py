"""Toxicity scores on rows that trained nothing, and the fold."""

import zlib

import numpy as np
import pytest

from folioflow.llm import toxicity

SCHEMA = "doc_id long, text string, score string, held_out string, _toxic string"


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    values, inverse, counts = np.unique(np.array(scores), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    ones = np.array(labels) == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_rows_of_the_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    rows = scores.filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("score", "predicted", "toxic", "lang").collect()
    # some 360 toxic training texts here, 27 of them Spanish
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) > 0.93
    for lang in {r["lang"] for r in rows if r["lang"]}:
        part = [r for r in rows if r["lang"] == lang]
        assert auc([r["score"] for r in part], [r["toxic"] for r in part]) > 0.85, lang
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.94


def test_features_against_plain_compression():
    import zstandard as z

    rng = np.random.default_rng(5)
    model = toxicity.Model(b" dreadful horrid nasty beastly", b" the of and water under bridge house garden")
    setup = z.ZstdCompressionParameters.from_level(
        3, window_log=17, min_match=6, strategy=z.STRATEGY_BTOPT, write_checksum=False, write_content_size=False, write_dict_id=False
    )

    def length(window, content):
        raw = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT) if content else None
        return len(z.ZstdCompressor(compression_params=setup, dict_data=raw).compress(window))

    for n in (0, 1, 7, 8, 9, 100, 3000):
        words = rng.choice(["Dreadful", "horridly", "the", "WATER", "garden", "of", "bridges", "x1"], n).tolist()
        cut = [(" " + " ".join(words[i : i + 8]).lower() + " ").encode() for i in range(0, n, 8)]
        alone = [max(length(w, b"") - length(w, model.toxic), 0) for w in cut]
        beyond = [max(length(w, model.ordinary) - length(w, model.toxic + model.ordinary), 0) for w in cut]
        want = [1, np.log1p(len(cut))]
        for saved in (alone, beyond):
            want += [max(saved, default=0), np.log1p(sum(saved)), sum(saved) / max(len(cut), 1)]
        np.testing.assert_allclose(model.features(", ".join(words)), want)


def test_training_windows_come_from_the_whole_text():
    words = ["w%d" % (i % 1000) for i in range(20_000)]
    start, _, sample = toxicity.sample_of(" ".join(words))
    taken = sample.split()
    assert start == b"w0 w1 w2 w3 w4 w5 w6 w7" and len(taken) <= toxicity.SAMPLE_WINDOWS * toxicity.SAMPLE_WINDOW
    places = [i for i in range(0, 20_000, toxicity.SAMPLE_WINDOW) if " ".join(words[i : i + 5]).encode() + b" " in sample]
    assert max(places) > 10_000
    assert toxicity.sample_of("")[2] == b"" and toxicity.sample_of("one")[2] == b" one "


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(1)
    words = np.array(["w%d" % i for i in range(300)])
    rows, marks = [], []
    for i in range(400):
        text = " ".join(rng.choice(words, 60))
        if i % 4 == 0:
            text += " dreadfulword " + " ".join(rng.choice(words, 20)) + " horridthing"
        rows.append((i, text, "a", "b", "c"))
        marks.append((i, int(i % 4 == 0)))
    return rows, marks


def test_small_table_and_odd_rows(spark, small):
    rows, marks = small
    docs = spark.createDataFrame([*rows, (900, "", "", "", ""), (901, None, "", "", ""), (None, "dreadfulword", "", "", ""), rows[0], (902, rows[0][1] * 900, "", "", "")], SCHEMA)
    labels = spark.createDataFrame([*marks, (None, 1), (7, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    truth = dict(marks)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]) > 0.95
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in got)


def test_labels_of_held_out_rows_change_nothing(spark, small):
    rows, marks = small
    docs = spark.createDataFrame(rows, SCHEMA)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in marks]
    models = [toxicity.fit(docs, spark.createDataFrame(m, "doc_id long, toxic int")) for m in (marks, turned)]
    assert models[0] == models[1]


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "some text", "", "", "")], SCHEMA)
    assert [r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()] == [0.0]
    assert toxicity.score_documents(spark.createDataFrame([], SCHEMA), toxicity.fit(docs, none)).collect() == []
