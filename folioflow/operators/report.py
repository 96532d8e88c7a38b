"""Report summary, status roll-ups and the spreadsheet-safe row layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import Sql, iso_timestamp
from folioflow.operators.dedupe import with_copies

CLASSIFIED_FROM = 60

# Summary member -> row condition.
SUMMARY_CONDITIONS = {
    "parsed_locally": "status = 'Parsed locally'",
    "ocr_completed": "ocr.status = 'Completed'",
    "classified": f"analysis.confidence >= {CLASSIFIED_FROM}",
    "metadata_only": "status = 'Metadata only'",
    "issues": "status = 'Error'",
    "restricted": "analysis.sensitivity = 'Restricted'",
    "pending_review": "review.status = 'Pending'",
    "approved": "review.status = 'Approved'",
    "needs_review": "review.status = 'Needs review'",
    "rejected": "review.status = 'Rejected'",
    "documents_with_pii": "pii.total_matches > 0",
    "high_pii_risk": "pii.risk_level = 'High'",
}


def summary(queue: DataFrame, active_filter: str = "", counted: bool = False) -> DataFrame:
    """One row of 16 members.

    Every counter is summed per fingerprint first and then in total. Both steps
    pre-aggregate map-side, so members of copy groups are counted without a
    window or a join and a hot fingerprint never meets in one task as rows.
    ``counted`` rows (of :func:`report_documents`) know whether they are duplicates: they are summed
    by that alone, and no fingerprint travels again.
    """
    sums = [
        F.count("*").alias("documents"),
        F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"),
        *[F.count_if(F.expr(condition)).alias(name) for name, condition in SUMMARY_CONDITIONS.items()],
    ]
    # Rows without a fingerprint are one group either way.
    group = F.expr("case when sha256 is null or duplicate then sha256 is null end").alias("_group") if counted else F.col("sha256").alias("_group")
    copied = F.col("documents") > 1
    per_copy = queue.groupBy(group).agg(*sums)

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    return per_copy.agg(
        total(F.col("documents")).alias("documents_selected"),
        total(F.when(copied & F.col("_group").isNotNull() if counted else copied, F.col("documents"))).alias("duplicates"),
        total(F.col("pages")).alias("total_pages"),
        *[total(F.col(name)).alias(name) for name in SUMMARY_CONDITIONS],
    ).withColumn("active_filter", F.lit(active_filter.strip() or None).cast("string"))


def class_profile(queue: DataFrame) -> DataFrame:
    """Documents, pages and findings per class, sensitivity, risk and template."""
    return queue.groupBy(
        F.col("analysis.document_class").alias("document_class"),
        F.col("analysis.sensitivity").alias("sensitivity"),
        F.col("pii.risk_level").alias("risk_level"),
        F.col("extraction.template").alias("template"),
    ).agg(
        F.count("*").alias("documents"),
        F.sum("pii.total_matches").alias("matches"),
        F.sum(F.col("analysis.confidence").cast("long")).alias("confidence_sum"),
    )


# Column titles of the sheet, in order, with the value each shows.
CSV_COLUMNS = {
    "Name": "name",
    "Extension": "extension",
    "Size (bytes)": "size_bytes",
    "Pages": "page_count",
    "Inspection status": "status",
    "Document class": "analysis.document_class",
    "Sensitivity": "analysis.sensitivity",
    "Classification confidence": "analysis.confidence",
    "PII risk": "pii.risk_level",
    "PII matches": "pii.total_matches",
    "Extraction template": "extraction.template",
    "Review status": "review.status",
    "Reviewed at": iso_timestamp("review.reviewed_at"),
    "OCR status": "ocr.status",
    "Duplicate": "case when duplicate then 'Yes' else 'No' end",
    "SHA-256": "sha256",
    "Path": "path",
}


def safe_cell(value: Sql) -> Sql:
    """Text of a cell, with spreadsheet formulas neutralised; null shows as empty."""
    text = f"coalesce(string({value}), '')"
    return f"case when {text} rlike '^[=+@\\\\t-]' then concat('\\'', {text}) else {text} end"


def quoted_cell(text: Sql) -> Sql:
    """Quote a cell that holds a comma, quote or line break; double inner quotes."""
    return f"case when {text} rlike '[\",\\n\\r]' then concat('\"', replace({text}, '\"', '\"\"'), '\"') else {text} end"


def csv_table(queue: DataFrame) -> DataFrame:
    """The 17 sheet columns as safe text, ready for the CSV writer."""
    rows = queue if "duplicate" in queue.columns else with_copies(queue)
    return rows.selectExpr(*[f"{safe_cell(value)} as `{title}`" for title, value in CSV_COLUMNS.items()])


def csv_lines(queue: DataFrame) -> DataFrame:
    """Path and the finished CSV line of each document."""
    sheet = csv_table(queue)
    cells = ", ".join(quoted_cell(f"`{title}`") for title in CSV_COLUMNS)
    return sheet.selectExpr("`Path` as path", f"concat_ws(',', {cells}) as line")


def report_documents(queue: DataFrame) -> DataFrame:
    """Detail rows of the report: the document, its copy count and duplicate flag."""
    return with_copies(queue)
