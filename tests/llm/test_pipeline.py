"""Each stage of the pipeline against a plain version of its decision."""

from collections import Counter

import pyarrow as pa

import corpus_pipeline
from folioflow.llm import decontaminate, mixing, toxicity
from test_simhash import brute as groups_of_all_pairs
from test_tokens import brute as plain_tokens


def without_copies(rows):
    """Ids that stay if all pairs of fingerprints are compared."""
    return {d for d, _, component in groups_of_all_pairs(rows) if d == component}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test-" + name)
        seen[name] = docs.collect()
        if name != "token_files":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.fit(spark.createDataFrame(before), labels)
            assert {r["doc_id"] for r in seen[name]} == {r["doc_id"] for r in before if model.score(r["text"]) < 0.5}
        if name == "near_duplicates":
            assert {r["doc_id"] for r in seen[name]} == without_copies([(r["doc_id"], r["text"]) for r in before])
        if name == "decontamination":
            leaking = {r["doc_id"] for r in decontaminate.find_leaks(spark.createDataFrame(before), benchmark).collect()}
            assert leaking and {r["doc_id"] for r in seen[name]} == {r["doc_id"] for r in before} - leaking
        if name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mixed_sizes(spark.createDataFrame(before)).collect()}
            assert Counter(r["doc_id"] for r in seen[name]) == Counter({d: n for d, n in copies.items() if n})
        if name == "token_files":
            assert sorted(map(tuple, seen[name]), key=lambda r: r[1]) == plain_tokens([(r["doc_id"], r["text"]) for r in before])


def test_run_and_empty_table(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_texts_go_to_python_in_batches_of_bounded_bytes(spark):
    from folioflow.llm import simhash, toxicity
    from folioflow.llm.common import BATCH_BYTES, scanned

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    docs = spark.range(0, 96, 1, 1).selectExpr("id as doc_id", "repeat('word ', 100000) as text")
    found = [r.size for r in scanned(docs, sizes, "size long").collect()]
    assert sum(found) > 48_000_000 and max(found) < 2 * BATCH_BYTES
    assert {"scanned"} <= set(simhash.fingerprints.__code__.co_names) & set(toxicity.drop_toxic.__code__.co_names)
