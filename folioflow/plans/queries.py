"""Registered queries: one callable per operator, (spark, sf_dir) -> DataFrame.

Every query reads whole tables and whole texts; results are flat columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as t
from folioflow.functions import validators as v
from folioflow.operators import bind, classify, dedupe, inspection, ocr, pii, queue, report, routing, search, templates
from folioflow.rules import TEMPLATES
from folioflow.session import scratch_dir, spread, stored
from folioflow.sources import corpus as src
from folioflow.sources import files, images, intake, sinks, workspace
from folioflow.streaming import intake as stream
from folioflow.streaming import queue_table

Query = Callable[[SparkSession, str], DataFrame]
NEEDLE = "  Net 30 "
QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    texts = src.corpus(spark, sf).selectExpr("path", f"{t.source_text('text', 'title', 'subject')} as source")
    return pii.scan(texts, "source").drop("source")


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    texts = src.corpus(spark, sf).selectExpr("path", f"{t.source_text('text', 'title', 'subject')} as source")
    return templates.extract(texts, "source").drop("source")


def _records(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    parts = parts or classify.PARTS
    return classify.with_intelligence(src.corpus(spark, sf), parts=parts).select("path", *parts)


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    source = t.fold(t.source_text("text", "title", "subject"))
    return bind(src.corpus(spark, sf).select("path", "extension", "text", "title", "subject"), "low", source)


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    """The inspected queue as a stored table: what reads it several times inspects once."""
    return stored(src.queue(spark, sf), "queue")


def _sheet_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of the inspected queue that a sheet shows, as a stored table."""
    parts = [F.struct(f"{name}.{member}").alias(name) for name, member in (("ocr", "status"), ("extraction", "template"))]
    shown = ("path", "name", "extension", "size_bytes", "page_count", "status", "sha256", "review")
    analysis = F.struct("analysis.document_class", "analysis.sensitivity", "analysis.confidence").alias("analysis")
    pii_part = F.struct("pii.risk_level", "pii.total_matches").alias("pii")
    return stored(src.queue(spark, sf).select(*shown, *parts, analysis, pii_part), "queue")


def findings_text(findings: str) -> str:
    return "array_join(" + t.each(
        "transform", findings, lambda f: f"concat({f}.category, ' x', {f}.count, ': ', array_join({f}.examples, '; '))"
    ) + ", ' | ')"


# --- sources and scalar work ------------------------------------------------


@_query
def text_normalize(spark, sf):
    return src.documents(spark, sf).selectExpr(
        "path", "bigint(length(text)) as chars", "sha2(text, 256) as text_sha256", f"sha2({t.preview('text')}, 256) as preview_sha256"
    )


@_query
def fingerprints(spark, sf):
    return src.corpus(spark, sf).select("path", "extension", "size_bytes", "sha256")


@_query
def ocr_gate(spark, sf):
    return src.documents(spark, sf).selectExpr(
        "path", f"bigint({t.signal_chars('text')}) as signal_chars", f"{t.needs_ocr('text')} as needs_ocr"
    )


@_query
def intake_paths(spark, sf):
    return intake.accept_paths(src.requests(spark, sf))


@_query
def uri_list_paths(spark, sf):
    return intake.dropped_paths(src.payloads(spark, sf))


@_query
def file_scan(spark, sf):
    root = scratch_dir(spark, "files")
    docs = src.table(spark, sf, "documents").selectExpr("concat(source, '/', doc_id % 7, '/', doc_id, '.pdf') as path", "text as content")
    files.write_files(docs, root)
    return files.scan_files(spark, root).select("name", "extension", "size_bytes", "sha256", "error")


@_query
def missing_files(spark, sf):
    asked = src.table(spark, sf, "events").selectExpr("concat('/store/', event_id, '.pdf') as path")
    seen = src.table(spark, sf, "documents").selectExpr(
        "concat('/store/', doc_id, '.pdf') as path", "bigint(octet_length(text)) as size_bytes", "sha2(text, 256) as sha256"
    )
    return intake.with_missing(asked, seen)


@_query
def file_inspection(spark, sf):
    """Documents lie in a folder as files, but for those that the request names in vain."""
    root = files.plain(scratch_dir(spark, "inbox"))
    given = src.delivered(spark, sf, 0).withColumn("path", F.expr(f"concat({t.lit(root)}, path)"))
    files.write_files(src.inbox(spark, sf), root)
    found = inspection.inspect_files(given.select("path", "seq"), given)
    return found.selectExpr(
        f"substring(path, {len(root) + 1}) as path", "seq", "route", "status", "note", "size_bytes", "sha256", "analysis.document_class",
        "analysis.sensitivity", "analysis.summary", "extraction.summary as extraction_summary", "pii.total_matches",
    )


@_query
def page_preview(spark, sf):
    return ocr.text_preview(src.page_lines(spark, sf).drop("text").withColumnRenamed("line", "text"))


@_query
def labels_and_units(spark, sf):
    rows = src.table(spark, sf, "orders").selectExpr("o_orderkey as k", "o_orderkey * o_orderkey * 3 as n", "o_orderdate as d")
    millis = "case when k % 10 = 0 then null else n % 90000 end"
    page = "case when k % 3 = 0 then null else k % 3 end"
    raw_date = "case k % 4 when 0 then '' when 1 then 'soon' else date_format(d, 'yyyy-MM-dd') end"
    return rows.selectExpr("k", "n", f"{millis} as ms", f"{page} as page", f"{raw_date} as raw_date").selectExpr(
        "k", f"{t.size_label('n')} as size_label", f"{t.duration_label('ms')} as duration_label",
        f"{t.date_label('raw_date')} as date_label", f"{t.progress_label('k', 'n', 'page', '3')} as progress_label",
    )


# --- personal data ----------------------------------------------------------


@_query
def pii_candidates(spark, sf):
    texts = src.corpus(spark, sf).selectExpr("path", f"{t.source_text('text', 'title', 'subject')} as source")
    return pii.candidates(texts, "source", ["path"]).selectExpr(
        "path", "category", "bigint(start) as start_at", "bigint(stop) as stop_at", "valid", "masked"
    )


@_query
def pii_scan(spark, sf):
    return _scanned(spark, sf).selectExpr(
        "path", "pii.risk_level", "pii.total_matches", f"{findings_text('pii.findings')} as findings"
    )


@_query
def pii_findings(spark, sf):
    return pii.findings_table(_scanned(spark, sf), "path").selectExpr(
        "path", "bigint(position) as position", "category", "count as matches", "array_join(examples, '; ') as examples"
    )


@_query
def pii_risk(spark, sf):
    return _scanned(spark, sf).groupBy(F.col("pii.risk_level").alias("risk_level")).agg(
        F.count("*").alias("documents"), F.sum("pii.total_matches").alias("matches")
    )


@_query
def pii_examples(spark, sf):
    found = pii.findings_table(_scanned(spark, sf), "path")
    return found.select("category", F.explode("examples").alias("masked")).groupBy("category", "masked").agg(
        F.count("*").alias("documents")
    )


@_query
def pii_cards(spark, sf):
    digits = "concat(o_orderkey % 10, lpad(concat('', o_orderkey * 7919 % 1000000007), 11 + int(o_orderkey % 9), '4'))"
    return src.table(spark, sf, "orders").selectExpr("o_orderkey", f"{digits} as digits").selectExpr(
        "o_orderkey", "digits", f"{v.passes_luhn('digits')} as luhn", f"{v.is_card('digits')} as card"
    )


@_query
def pii_routing(spark, sf):
    digits = "lpad(concat('', o_orderkey * 104729 % 1000000007), 8 + int(o_orderkey % 3 > 0), '0')"
    return src.table(spark, sf, "orders").selectExpr("o_orderkey", f"{digits} as digits").selectExpr(
        "o_orderkey", "digits", f"{v.is_routing('digits')} as routing"
    )


# --- templates --------------------------------------------------------------


@_query
def template_scores(spark, sf):
    scores = [f"bigint({templates.score(x, 'low')}) as {x.id.replace('-', '_')}" for x in TEMPLATES]
    return _folded(spark, sf).selectExpr("path", *scores)


@_query
def template_match(spark, sf):
    chosen = bind(_folded(spark, sf), "choice", templates.choose("low"))
    name = "case " + " ".join(f"when choice.order = {-i} then {t.lit(x.name)}" for i, x in enumerate(TEMPLATES)) + " end"
    return chosen.selectExpr("path", f"{name} as template", "bigint(choice.score) as score")


@_query
def extraction_fields(spark, sf):
    return templates.fields_table(_extracted(spark, sf), "path").withColumn("confidence", F.col("confidence").cast("long"))


@_query
def extraction_summary(spark, sf):
    return _extracted(spark, sf).selectExpr("path", "extraction.template", "extraction.summary")


@_query
def field_quality(spark, sf):
    return templates.field_quality(templates.fields_table(_extracted(spark, sf), "path"))


@_query
def field_validation(spark, sf):
    v.register(spark)
    checks = ", ".join(f"is_{name}(value) as is_{name}" for name in v.VALIDATORS)
    fields = templates.fields_table(_extracted(spark, sf), "path")
    return spark.sql(f"select path, key, value, {checks} from {{fields}} where value <> ''", fields=fields)


# --- classification ---------------------------------------------------------


@_query
def doc_class(spark, sf):
    kind = bind(_folded(spark, sf), "kind", classify.classify_text("extension", "low"))
    return kind.selectExpr("path", "kind.document_class", "bigint(kind.confidence) as confidence")


@_query
def doc_signals(spark, sf):
    return _records(spark, sf, "analysis").selectExpr("path", "array_join(analysis.signals, ' | ') as signals")


@_query
def doc_sensitivity(spark, sf):
    return _records(spark, sf, "analysis", "pii").selectExpr("path", "pii.risk_level", "analysis.sensitivity")


@_query
def doc_summary(spark, sf):
    return _records(spark, sf, "analysis").selectExpr("path", "analysis.summary")


@_query
def document_intelligence(spark, sf):
    return _records(spark, sf).selectExpr(
        "path", "analysis.document_class", "analysis.sensitivity", "bigint(analysis.confidence) as confidence",
        "analysis.summary", "array_join(analysis.signals, ' | ') as signals", "extraction.template",
        "extraction.summary as extraction_summary", "bigint(size(extraction.fields)) as fields",
        "pii.risk_level", "pii.total_matches", f"{findings_text('pii.findings')} as findings",
    )


@_query
def fallback_class(spark, sf):
    files = src.light_queue(spark, sf, 0, 1, 2).selectExpr("path", f"{t.extension('path')} as extension")
    return bind(files, "r", classify.fallback("extension")).selectExpr(
        "path", "r.analysis.document_class", "r.analysis.sensitivity", "bigint(r.analysis.confidence) as confidence",
        "r.analysis.summary", "r.extraction.summary as extraction_summary", "r.pii.risk_level",
    )


# --- inspection and queue ---------------------------------------------------


@_query
def inspection_routing(spark, sf):
    return routing.inspect(src.delivered(spark, sf)).selectExpr(
        "path", "route", "status", "parser", "note", "bigint(page_count) as page_count", "bigint(preview_pages) as preview_pages",
        "extracted_characters", "size_bytes", "sha256", "ocr.status as ocr_status", "ocr.source as ocr_source", "ocr.note as ocr_note",
        "bigint(ocr.confidence) as ocr_confidence", "bigint(ocr.pages_processed) as ocr_pages", "bigint(ocr.page_limit) as ocr_page_limit",
        "analysis.document_class", "analysis.sensitivity", "bigint(analysis.confidence) as confidence", "analysis.summary",
        "extraction.summary as extraction_summary", "pii.total_matches",
    )


def _flat_queue(rows: DataFrame, *more: str) -> DataFrame:
    return rows.selectExpr(
        "path", "name", "seq", "size_bytes", "bigint(page_count) as page_count", "review.status as review_status",
        "review.notes as notes", f"{t.iso_timestamp('review.reviewed_at')} as reviewed_at", *more,
    )


def _merged(spark, sf):
    current = src.light_queue(spark, sf, 0, 1)
    incoming = src.light_queue(spark, sf, 0, 2).drop("review").withColumn("size_bytes", F.col("size_bytes") + 1)
    return current, incoming


@_query
def queue_merge(spark, sf):
    current, incoming = _merged(spark, sf)
    return queue.merge(queue.by_path(current), incoming).selectExpr(
        "path", "name", "seq", "size_bytes", "review.status as review_status", "review.notes as notes",
        f"{t.iso_timestamp('review.reviewed_at')} as reviewed_at", "bigint(batch_rank) as batch_rank",
    )


@_query
def merge_summary(spark, sf):
    return queue.merge_summary(*_merged(spark, sf), "drag and drop")


@_query
def queue_reinspect(spark, sf):
    current, _ = _merged(spark, sf)
    fresh = src.light_queue(spark, sf, 0, 1, 2).drop("review").withColumn("size_bytes", F.col("size_bytes") + 5)
    return _flat_queue(queue.refresh(current, fresh))


@_query
def queue_review_filter(spark, sf):
    return _flat_queue(queue.with_status(src.light_queue(spark, sf, 0, 1, 2), "Needs review"))


@_query
def queue_remove(spark, sf):
    return _flat_queue(queue.remove(src.light_queue(spark, sf, 0, 1), src.light_queue(spark, sf, 0)))


@_query
def queue_sorted(spark, sf):
    return queue.positions(queue.merge(*_merged(spark, sf)), "added").select("path", "seq", "position")


@_query
def queue_sort_name(spark, sf):
    return queue.positions(src.light_queue(spark, sf, 0, 1, 2), "name").select("name", "path", "position")


@_query
def queue_sort_size(spark, sf):
    return _flat_queue(queue.positions(src.light_queue(spark, sf, 0, 1, 2), "size"), "position")


@_query
def queue_sort_pages(spark, sf):
    return _flat_queue(queue.positions(src.light_queue(spark, sf, 0, 1, 2), "pages"), "position")


@_query
def queue_search(spark, sf):
    root = scratch_dir(spark, "searchable")
    search.store(src.queue(spark, sf), root)
    return search.search(spark, root, NEEDLE).selectExpr("path", "status", "review.status as review_status")


@_query
def review_state(spark, sf):
    return queue.review_state(src.review_events(spark, sf)).selectExpr(
        "path", "status", "notes", f"{t.iso_timestamp('reviewed_at')} as reviewed_at"
    )


@_query
def duplicates(spark, sf):
    return dedupe.with_copies(stored(src.corpus(spark, sf).select("path", "sha256"), "fingerprints"))


@_query
def fingerprint_counts(spark, sf):
    return dedupe.fingerprint_counts(src.corpus(spark, sf))


# --- reports ----------------------------------------------------------------


@_query
def report_summary(spark, sf):
    return report.summary(src.queue(spark, sf, ("analysis", "pii")), " net 30 ")


@_query
def review_counts(spark, sf):
    return queue.status_counts(src.light_queue(spark, sf, 0, 1, 2))


@_query
def class_profile(spark, sf):
    records = _records(spark, sf, "analysis", "pii", classify.TEMPLATE)
    return report.class_profile(records.withColumn("extraction", F.struct(classify.TEMPLATE)))


@_query
def queue_csv(spark, sf):
    return report.csv_lines(_sheet_queue(spark, sf))


@_query
def report_docs(spark, sf):
    root = scratch_dir(spark, "report")
    sinks.write_report(_queue(spark, sf), root, "net 30")
    schema = (
        "path string, name string, status string, sha256 string, duplicate boolean, duplicate_count bigint, modified_at string,"
        " analysis struct<document_class:string,sensitivity:string>, pii struct<total_matches:bigint>, review struct<status:string>"
    )
    return spark.read.schema(schema).json(f"{root}/documents").selectExpr(
        "path", "name", "status", "sha256", "duplicate", "duplicate_count", "modified_at", "analysis.document_class",
        "analysis.sensitivity", "pii.total_matches", "review.status as review_status",
    )


@_query
def csv_sheet(spark, sf):
    root = scratch_dir(spark, "csv")
    sinks.write_csv(_sheet_queue(spark, sf), root)
    return sinks.read_csv(spark, root).selectExpr(
        "`Path` as path", "`Name` as name", "`Pages` as pages", "`Document class` as document_class", "`Reviewed at` as reviewed_at",
        "`Duplicate` as duplicate", "`SHA-256` as sha256",
    )


# --- saved workspaces -------------------------------------------------------


@_query
def workspace_sanitize(spark, sf):
    parsed = src.saved(spark, sf).selectExpr("k", "try_parse_json(raw) as doc")
    field = t.each("transform", "extraction.fields", lambda f: f"concat_ws('/', {f}.key, {f}.label, {f}.value, {f}.confidence, {f}.status, {f}.validation)")
    return workspace.sanitize_documents(parsed, "doc", ("k",)).selectExpr(
        "k", "id", "path", "name", "extension", "size_bytes", "page_count", "status", "parser", "review.status as review_status",
        "review.notes as notes", "review.reviewed_at as reviewed_at", "analysis.document_class", "analysis.sensitivity",
        "double(analysis.confidence) as confidence", "analysis.summary", "array_join(analysis.signals, ',') as signals", "extraction.template",
        f"array_join({field}, ' | ') as fields", "pii.risk_level", "pii.total_matches", f"{findings_text('pii.findings')} as findings",
        "ocr.status as ocr_status", "double(ocr.confidence) as ocr_confidence", "ocr.pages_processed as ocr_pages", "ocr.preprocessing",
    )


@_query
def workspace_load(spark, sf):
    return workspace.load_documents(src.saved_states(spark, sf), "raw", ("k",)).selectExpr(
        "k", "filter_value", "bigint(position) as position", "path", "name", "extension", "status"
    )


@_query
def workspace_roundtrip(spark, sf):
    root = scratch_dir(spark, "workspace")
    workspace.write_snapshot(src.light_queue(spark, sf, 0), root, 1)
    workspace.write_snapshot(src.light_queue(spark, sf, 0, 1, 2), root, 2, "net 30")
    return _flat_queue(workspace.read_snapshot(spark, root))


# --- OCR tables and images --------------------------------------------------


@_query
def ocr_rollup(spark, sf):
    return ocr.roll_up(src.page_lines(spark, sf).drop("line")).selectExpr(
        "doc_id", "bigint(total_pages) as total_pages", "bigint(page_limit) as page_limit", "bigint(pages_processed) as pages_processed",
        "status", "text", "bigint(confidence) as confidence", "extracted_characters",
    )


@_query
def scan_cleanup(spark, sf):
    docs = spread(src.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    rasters = docs.selectExpr(
        "string(doc_id) as origin", "int(ceil(octet_length(text) / 3)) as height", "1 as width", "3 as nChannels",
        "concat(encode(text, 'UTF-8'), X'0000') as data",
    )
    return images.scan_cleanup(rasters).selectExpr("bigint(origin) as doc_id", "bigint(octet_length(gray)) as pixels", "hex(gray) as gray_hex").selectExpr(
        "doc_id", "pixels", "sha2(gray_hex, 256) as gray_sha256"
    )


# --- streaming --------------------------------------------------------------


def _landed(spark, sf, label: str):
    """Documents as a folder of files, the way they would land."""
    root = scratch_dir(spark, label)
    docs = src.table(spark, sf, "documents")
    docs.repartition(6, "doc_id").write.parquet(f"{root}/landing")
    return root, docs.schema


@_query
def stream_intake(spark, sf):
    root, schema = _landed(spark, sf, "stream-intake")
    rows = stream.arriving(spark, f"{root}/landing", schema, 2)
    stream.run_to_table(src.describe_documents(rows).select("path", "extension", "size_bytes", "sha256"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@_query
def stream_pii(spark, sf):
    root, schema = _landed(spark, sf, "stream-pii")
    # Two files a batch are few tasks, and the scan is much work a row.
    arriving = stream.arriving(spark, f"{root}/landing", schema, 2).repartition(spark.sparkContext.defaultParallelism, "doc_id")
    rows = src.describe_documents(arriving)
    scanned = pii.scan(rows.selectExpr("path", f"{t.source_text('text', 'title', 'subject')} as source"), "source").drop("source")
    stream.run_to_table(scanned, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").selectExpr(
        "path", "pii.risk_level", "pii.total_matches", f"{findings_text('pii.findings')} as findings"
    )


@_query
def stream_duplicates(spark, sf):
    root, schema = _landed(spark, sf, "stream-duplicates")
    # every document is delivered a second time, and counts once
    spark.read.parquet(f"{root}/landing").repartition(6, "doc_id").write.mode("append").parquet(f"{root}/landing")
    arriving = stream.arriving(spark, f"{root}/landing", schema, 4)
    rows = src.describe_documents(arriving).select("path", "sha256", F.timestamp_seconds("size_bytes").alias("modified_at"))
    stream.run_duplicate_counts(rows, f"{root}/out", f"{root}/checkpoint", row_id="path", time="modified_at", delay="3650 days")
    return stream.current_counts(spark, f"{root}/out")


@_query
def stream_queue_merge(spark, sf):
    root = scratch_dir(spark, "stream-merge")
    docs = src.table(spark, sf, "documents").selectExpr(
        f"concat('/inbox/0/', doc_id, '.', {src.FILE_TYPE_SQL.replace('k %', 'doc_id %')}) as path", "bigint(n_chars) as n_chars"
    )
    # Every document arrives, and later arrives again one character longer.
    for version in (0, 1):
        rows = docs.selectExpr("path", f"n_chars + {version} as n_chars", f"{version}L as version")
        rows.repartition(6, "path").write.mode("append").parquet(f"{root}/landing")
    known = src.light_queue(spark, sf, 0)
    reviews = known.selectExpr("path", "coalesce(review.reviewed_at, timestamp'2026-01-01') as ts", "seq as event_id", "review.status as status", "review.notes as notes")
    reviews.repartition(4, "path").write.parquet(f"{root}/reviews")
    arriving = stream.arriving(spark, f"{root}/landing", rows.schema, 6)
    reviewed = stream.arriving(spark, f"{root}/reviews", reviews.schema, 2)
    queue_table.run(arriving, reviewed, f"{root}/queue", f"{root}/checkpoint", seq="version")
    return queue_table.current(spark, f"{root}/queue").selectExpr("path", "n_chars", "review.status as review_status")
