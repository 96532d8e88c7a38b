"""Saved workspaces: sanitising untrusted JSON, and snapshot tables published atomically."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from folioflow.functions import coerce as c
from folioflow.functions.text import Sql, basename, clamp_percent, each, extension, half_up, lit, struct
from folioflow.operators import bind
from folioflow.operators.classify import in_list
from folioflow.operators.pii import DETECTORS
from folioflow.rules import REVIEW_STATUSES, SUPPORTED_EXTENSIONS
from folioflow.sources.states import state_documents

VERSION = 1
NO_ANALYSIS = "No local analysis was available for this document."
NO_EXTRACTION = "No structured extraction was available for this document."


def _positive(value: Sql) -> Sql:
    return f"greatest(0D, {value})"


def _when_object(value: Sql, present: Sql, absent: Sql) -> Sql:
    return f"case when {c.is_object(value)} then {present} else {absent} end"


def _review(doc: Sql) -> Sql:
    v = c.at(doc, "review")
    return struct(
        status=c.choice(doc, "review.status", REVIEW_STATUSES, "Pending"),
        notes=_when_object(v, c.text(doc, "review.notes", "''"), "''"),
        reviewed_at=c.text(doc, "review.reviewedAt", "cast(null as string)"),
    )


def _analysis(doc: Sql) -> Sql:
    return struct(
        document_class=c.text(doc, "analysis.documentClass", "'Unavailable'"),
        sensitivity=c.choice(doc, "analysis.sensitivity", ("Restricted", "Internal", "Standard"), "Unknown"),
        confidence=clamp_percent(c.number(doc, "analysis.confidence")),
        summary=c.text(doc, "analysis.summary", lit(NO_ANALYSIS)),
        signals=c.texts(doc, "analysis.signals"),
    )


def _extraction(doc: Sql) -> Sql:
    records = each("filter", c.elements(doc, "extraction.fields"), c.is_object)
    fields = each(
        "transform",
        records,
        lambda f: struct(
            key=c.text(f, "key", "'field'"),
            label=c.text(f, "label", "'Field'"),
            value=c.text(f, "value", "''"),
            confidence=clamp_percent(c.number(f, "confidence")),
            status=c.choice(f, "status", ("Extracted", "Detected label", "Missing"), "Missing"),
            validation=c.choice(f, "validation", ("Valid", "Suspect"), "Not checked"),
        ),
    )
    return struct(
        template=c.text(doc, "extraction.template", "cast(null as string)"),
        summary=c.text(doc, "extraction.summary", lit(NO_EXTRACTION)),
        fields=fields,
    )


def _pii(doc: Sql) -> Sql:
    known = tuple(d.category for d in DETECTORS)
    records = each("filter", c.elements(doc, "pii.findings"), lambda f: f"{c.is_object(f)} and {in_list(c.text(f, 'category'), known)}")
    findings = each(
        "transform",
        records,
        lambda f: struct(
            category=c.text(f, "category"),
            count=_positive(f"double({half_up(c.number(f, 'count'))})"),
            examples=c.texts(f, "examples"),
        ),
    )
    return struct(
        risk_level=c.choice(doc, "pii.riskLevel", ("High", "Low"), "None"),
        total_matches=_positive(f"double({half_up(c.number(doc, 'pii.totalMatches'))})"),
        findings=findings,
    )


def _ocr(doc: Sql) -> Sql:
    none, missing = "cast(null as string)", "cast(null as double)"
    return struct(
        status=c.choice(doc, "ocr.status", ("Completed", "Skipped", "Failed", "Not run"), "Not run"),
        source=c.text(doc, "ocr.source", none),
        engine=c.text(doc, "ocr.engine", none),
        confidence=f"case when {c.is_number(c.at(doc, 'ocr.confidence'))} then"
        f" {clamp_percent('double(' + half_up(c.number(doc, 'ocr.confidence')) + ')')} end",
        duration_ms=c.number(doc, "ocr.durationMs", missing),
        pages_processed=_positive(c.number(doc, "ocr.pagesProcessed")),
        page_limit=c.number(doc, "ocr.pageLimit", missing),
        preprocessing=c.choice(doc, "ocr.preprocessing", ("Scan cleanup",), "None"),
        extracted_characters=_positive(c.number(doc, "ocr.extractedCharacters")),
        text_preview=c.text(doc, "ocr.textPreview", "''"),
        note=c.text(doc, "ocr.note", "'OCR not run.'"),
    )


def sanitize_documents(df: DataFrame, doc: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Saved documents (VARIANT column ``doc``) as typed records.

    Non-objects, relative paths and unsupported types are rejected; every other
    wrong value falls back to its default.
    """
    # Bound: a filter above a projection would have the saved text parsed again at every place it names the record.
    staged = bind(bind(df.withColumnRenamed(doc, "_doc"), doc, "_doc").drop("_doc"), "_path", c.text(doc, "path"))
    valid = f"{c.is_object(doc)} and startswith(_path, '/') and {in_list(extension('_path'), SUPPORTED_EXTENSIONS)}"
    return staged.filter(F.expr(valid)).selectExpr(
        *keep,
        f"{c.text(doc, 'id', '_path')} as id",
        f"{c.text(doc, 'name', basename('_path'))} as name",
        "_path as path",
        f"{extension('_path')} as extension",
        f"{_positive(c.number(doc, 'fileSizeBytes'))} as size_bytes",
        f"{c.text(doc, 'modifiedAt', lit(''))} as modified_at",
        f"{c.text(doc, 'sha256', lit(''))} as sha256",
        f"{c.text(doc, 'parser', lit('Filesystem only'))} as parser",
        f"{c.number(doc, 'pageCount', 'cast(null as double)')} as page_count",
        f"{c.text(doc, 'previewText', lit(''))} as preview_text",
        f"{_positive(c.number(doc, 'previewPages'))} as preview_pages",
        f"{_positive(c.number(doc, 'extractedCharacters'))} as extracted_characters",
        f"{c.choice(doc, 'status', ('Parsed locally', 'Metadata only', 'Error'), 'Metadata only')} as status",
        f"{c.text(doc, 'note', lit(''))} as note",
        f"{_ocr(doc)} as ocr",
        struct(**{k: c.text(doc, f"metadata.{k}") for k in ("title", "author", "creator", "producer", "subject")}) + " as metadata",
        f"{_analysis(doc)} as analysis",
        f"{_extraction(doc)} as extraction",
        f"{_pii(doc)} as pii",
        f"{_review(doc)} as review",
    )


def load_documents(df: DataFrame, raw: str, keep: tuple[str, ...], cap: int | None = None) -> DataFrame:
    """Documents of saved states (JSON text) in their order; ``cap`` keeps the first ones of each state.

    A state may have any size. Text that is no JSON object yields no row.
    """
    rows = state_documents(df, raw, keep).withColumn("doc", F.expr("try_parse_json(doc)"))
    clean = sanitize_documents(rows, "doc", (*keep, "filter_value", "position"))
    if cap is None:
        return clean
    place = F.row_number().over(W.partitionBy(*keep).orderBy("position"))
    return clean.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")


def write_snapshot(documents: DataFrame, root: str, snapshot: int, filter_value: str = "") -> None:
    """Write a snapshot table, then publish it by appending one pointer row.

    Readers only follow published pointers, so a failed write is never visible. A published number is taken for good.
    """
    pointers = _published(documents.sparkSession, root)
    if pointers is not None and pointers.filter(F.col("snapshot") == snapshot).take(1):
        raise ValueError(f"snapshot {snapshot} is published already")
    documents.write.mode("overwrite").parquet(f"{root}/snapshots/{snapshot:012d}")
    spark = documents.sparkSession
    pointer = spark.range(1).select(
        F.lit(snapshot).cast("long").alias("snapshot"), F.lit(VERSION).alias("version"),
        F.lit(filter_value).alias("filter_value"), F.current_timestamp().alias("saved_at"),
    )
    pointer.write.mode("append").parquet(f"{root}/published")


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """Documents of the newest published snapshot, None when nothing was saved."""
    newest = newest_snapshot(spark, root)
    return None if newest is None else spark.read.parquet(f"{root}/snapshots/{newest.snapshot:012d}")


def newest_snapshot(spark: SparkSession, root: str) -> Row | None:
    """Pointer of the newest published snapshot: snapshot, version, filter_value, saved_at."""
    pointers = _published(spark, root)
    return None if pointers is None else pointers.orderBy(F.desc("snapshot")).first()


def _published(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
