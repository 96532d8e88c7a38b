"""Registered queries of the subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.llm import (
    decontaminate,
    divergence,
    html_crf,
    language_id,
    line_chunks,
    mixing,
    ranked_search,
    secrets,
    simhash,
    suffix_dedup,
    tokens,
    topk,
    toxicity,
)
from folioflow.llm.common import table


def op1_token_sequences(spark, sf_dir):
    return tokens.token_documents(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_simhash_groups(spark, sf_dir):
    return simhash.near_fingerprints(table(spark, sf_dir, "documents"))


def op4_toxicity_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_main_text(spark, sf_dir):
    return html_crf.main_text(table(spark, sf_dir, "pages"))


def op6_secret_spans(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_benchmark_leaks(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mix_sources(spark, sf_dir):
    return mixing.mixed_sizes(table(spark, sf_dir, "documents")).drop("copies", "source")


def op9_line_chunks(spark, sf_dir):
    kept = line_chunks.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


def op11_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs, ~language_id.held_out(docs)))


def op12_ranked_search(spark, sf_dir):
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_sequences,
        op2_exact_topk,
        op3_simhash_groups,
        op4_toxicity_scores,
        op5_main_text,
        op6_secret_spans,
        op7_benchmark_leaks,
        op8_mix_sources,
        op9_line_chunks,
        op10_suffix_dedup,
        op11_language_id,
        op12_ranked_search,
        op13_source_divergence,
    )
}
