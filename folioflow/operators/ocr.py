"""OCR page tables: page budget, roll-up per document, text-layer preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import clamp_percent, each, half_up, let, normalize, preview, struct, trim
from folioflow.operators.routing import page_budget
from folioflow.rules import PREVIEW_PAGES


def _page_columns(pages: DataFrame, limit: int, value: str) -> list:
    """One aggregate per page within the limit: bounded state, combined map-side."""
    return [F.max(F.expr(f"case when page_no = {i} then {value} end")).alias(f"p{i}") for i in range(1, limit + 1)]


def roll_up(pages: DataFrame, key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """Pages (total_pages, page_no, status, text, confidence) to one OCR result per document.

    Reading stops at the first page that did not complete, a page without a status included. If no text came
    before it, the failure is the result; otherwise the pages before it are. ``limit`` is an optional page budget.
    """
    read = pages if limit is None else pages.filter(F.col("page_no") <= limit)
    complete = F.col("status").eqNullSafe("Completed")
    page = struct(n="page_no", text=normalize("coalesce(text, '')"), confidence=clamp_percent(half_up("confidence")))
    within = F.expr(f"page_no <= {page_budget('total_pages', limit)}")
    wide = read.filter(within).groupBy(key).agg(
        F.max("total_pages").alias("total_pages"),
        F.min(F.when(~complete, F.struct(F.col("page_no").alias("n"), "status"))).alias("stop"),
        # one document's own pages, in order
        F.array_sort(F.collect_list(F.when(complete, F.expr(page)))).alias("pages"),
    )
    done = each("filter", "pages", lambda p: f"stop is null or {p}.n < stop.n")
    wide = wide.withColumn("done", F.expr(done))
    wide = wide.withColumn("texts", F.expr(each("filter", "done", lambda p: f"{p}.text <> ''")))
    headed = each("transform", "texts", lambda p: f"concat('Page ', {p}.n, '\\n', {p}.text)")
    failed = "stop is not null and size(texts) = 0"
    scores = each(
        "transform", each("filter", "done", lambda p: f"{p}.confidence is not null"), lambda p: f"double({p}.confidence)"
    )
    joined = trim(f"array_join({headed}, '\\n\\n')")
    mean = let(scores, lambda s: f"case when size({s}) > 0 then {half_up(f'aggregate({s}, 0D, (a, c) -> a + c) / size({s})')} end")
    wide = wide.select(
        key, "total_pages",
        F.expr(f"int({page_budget('total_pages', limit)})").alias("page_limit"),
        F.expr("int(size(done))").alias("pages_processed"),
        F.expr(f"case when {failed} then stop.status else 'Completed' end").alias("status"),
        F.expr(f"case when {failed} then '' else {joined} end").alias("text"),
        F.expr(f"case when not ({failed}) then int({mean}) end").alias("confidence"),
    )
    return wide.select(
        "*", F.expr("bigint(length(text))").alias("extracted_characters"), F.expr(preview("text")).alias("text_preview")
    )


def text_preview(pages: DataFrame, key: str = "doc_id", limit: int = PREVIEW_PAGES) -> DataFrame:
    """Display excerpt from the first pages of a text layer."""
    wide = pages.filter(F.col("page_no") <= limit).groupBy(key).agg(*_page_columns(pages, limit, "text"))
    joined = f"concat_ws('\\n', {', '.join(f'p{i}' for i in range(1, limit + 1))})"
    return wide.select(key, F.expr(preview(normalize(joined))).alias("preview_text"))
