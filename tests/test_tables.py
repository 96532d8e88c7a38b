"""Intake, routing, queue, reports, saved workspaces, OCR tables, images, streams."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as t
from folioflow.operators import dedupe, ocr, queue, report, routing
from folioflow.operators.routing import page_budget
from folioflow.plans.queries import QUERIES
from folioflow.sources import corpus, files, images, intake, sinks, states, workspace
from folioflow.streaming import intake as stream
from folioflow.streaming import queue_table


def test_intake_order_and_cap(spark):
    paths = ["/a.pdf", "b.pdf", " /c.PNG ", "/a.pdf", "/d.exe", "", "/e.docx"]
    df = spark.createDataFrame(list(enumerate(paths)), "seq long, path string")
    every = intake.accept_paths(df).orderBy("seq").collect()
    assert [(r.path, r.seq) for r in every] == [("/a.pdf", 0), ("/c.PNG", 2), ("/e.docx", 6)]
    assert [r.path for r in intake.accept_paths(df, cap=2).collect()] == ["/a.pdf", "/c.PNG"]


def test_dropped_uris(spark):
    body = "# note\r\nfile:///a%20b+c.pdf\r\nhttp://x/y.pdf\nfile:///C:/x.pdf\n\nfile:///a%20b+c.pdf?q\nfile:///bad%zz.pdf"
    got = intake.dropped_paths(spark.createDataFrame([(1, body)], "seq long, uri_list string")).orderBy("line").collect()
    assert [r.path for r in got] == ["/a b+c.pdf", "C:/x.pdf"]


def test_dropped_uris_are_plain_paths(spark):
    body = "file:///a/../b.pdf\nfile:///c/./d/e/../../f.pdf\nfile:///g%5Ch.pdf\nfile:///bad%E9.pdf\nfile:///../../i.pdf"
    got = intake.dropped_paths(spark.createDataFrame([(1, body)], "seq long, uri_list string")).orderBy("line").collect()
    assert [r.path for r in got] == ["/b.pdf", "/c/f.pdf", "/g/h.pdf", "/i.pdf"]


def test_a_snapshot_keeps_its_filter_and_is_not_overwritten(spark, tmp_path):
    root = str(tmp_path / "w")
    assert workspace.newest_snapshot(spark, root) is None and workspace.read_snapshot(spark, root) is None
    workspace.write_snapshot(spark.range(3).toDF("n"), root, 1, "net 30")
    newest = workspace.newest_snapshot(spark, root)
    assert (newest.snapshot, newest.filter_value) == (1, "net 30") and newest.saved_at is not None
    with pytest.raises(ValueError):
        workspace.write_snapshot(spark.range(5).toDF("n"), root, 1)
    assert workspace.read_snapshot(spark, root).count() == 3


def test_file_scan(spark, tmp_path):
    (tmp_path / "x.PDF").write_bytes(b"hello")
    row = files.scan_files(spark, str(tmp_path)).first()
    assert (row["name"], row.extension, row.size_bytes, row.sha256) == ("x.PDF", "PDF", 5, hashlib.sha256(b"hello").hexdigest())


def test_every_route_occurs(spark, sf):
    got = {r.route: r.n for r in QUERIES["inspection_routing"](spark, sf).groupBy("route").agg(F.count("*").alias("n")).collect()}
    # b and f occur only with size limits
    assert sorted(got) == list("acdeghijkl")


def test_forms_exercise_every_rule(spark, sf):
    fields = QUERIES["extraction_fields"](spark, sf).cache()
    assert fields.select("template").distinct().count() == 5
    assert {r.status for r in fields.select("status").distinct().collect()} == {"Extracted", "Detected label", "Missing"}
    assert {r.validation for r in fields.select("validation").distinct().collect()} == {"Valid", "Suspect", "Not checked"}
    assert QUERIES["pii_findings"](spark, sf).select("category").distinct().count() == 7
    assert {r.risk_level for r in QUERIES["pii_risk"](spark, sf).collect()} == {"High", "Low", "None"}


def _queue(spark, rows):
    schema = "path string, seq long, review struct<status:string,notes:string,reviewed_at:timestamp>"
    return spark.createDataFrame(rows, schema)


def test_merge_keeps_reviews(spark):
    current = _queue(spark, [("/a", 0, ("Approved", "ok", None)), ("/b", 1, ("Pending", "", None))])
    incoming = spark.createDataFrame([("/c", 0), ("/a", 1)], "path string, seq long")
    merged = queue.ordered(queue.merge(current, incoming)).collect()
    assert [(r.path, r.review.status) for r in merged] == [("/c", "Pending"), ("/a", "Approved"), ("/b", "Pending")]
    note = queue.merge_summary(current, incoming, "the file picker").first()
    assert note.message == "Added 1 document(s) from the file picker and refreshed 1 existing item(s)."


def test_review_state(spark):
    log = [("/a", 1, "Approved", None), ("/a", 2, None, "n1"), ("/a", 3, "Pending", None), ("/b", 4, "Rejected", None), ("/c", 5, None, "n2")]
    df = spark.createDataFrame(log, "path string, event_id long, status string, notes string").withColumn("ts", F.timestamp_seconds("event_id"))
    got = {r.path: (r.status, r.notes, r.reviewed_at is not None) for r in queue.review_state(df).collect()}
    assert got == {"/a": ("Pending", "n1", False), "/b": ("Rejected", "", True), "/c": ("Pending", "n2", False)}


def test_search_is_literal(spark, sf):
    rows = corpus.queue(spark, sf).filter("kind = 2 and k < 20").cache()
    everything = rows.count()
    assert queue.search(rows, "   ").count() == everything
    assert queue.search(rows, "%").count() == 0
    assert 0 < queue.search(rows, "  ACME ").count() < everything


def test_copies_with_a_hot_fingerprint(spark):
    df = spark.range(9000).selectExpr("string(id) as path", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then string(id div 6) else concat('u', id) end as sha256")
    got = dedupe.with_copies(df, hot=2)
    want = df.groupBy("sha256").agg(F.count("*").alias("n"))
    assert got.count() == 9000
    assert got.join(want, "sha256").filter("copies <> n or duplicate <> (n > 1)").count() == 0


def test_rows_without_a_fingerprint_are_no_copies_and_lie_apart(spark):
    df = spark.range(600).selectExpr("string(id) as path", "case when id >= 500 then 'x' end as sha256")
    got = dedupe.with_copies(df)
    assert {(r.sha256, r.copies, r.duplicate) for r in got.collect()} == {("x", 100, True), (None, 1, False)}
    probe = got._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(" in probe and "row:" in probe


def test_name_order_is_locale_aware(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["b", "Z", "a10", "B", "A", "a", "\u00e4"])], "seq long, name string")
    assert [r["name"] for r in queue.ordered(df, "name").collect()] == ["a", "A", "\u00e4", "a10", "b", "B", "Z"]


CELLS = ["=1+1", "+x", "-5", "@a", "\tlead", 'say "hi"', "a,b", "line\nbreak", "cr\rhere", " padded ", "", "plain", "x=1", "'q", "a\\b"]


def test_csv_sheet_and_lines(spark, tmp_path):
    safe = [f"'{c}" if c[:1] in ("=", "+", "-", "@", "\t") and c else c for c in CELLS]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "id int, cell string")
    shown = df.selectExpr("id", f"{report.safe_cell('cell')} as cell")
    assert [r.cell for r in shown.orderBy("id").collect()] == safe
    quoted = shown.selectExpr("id", f"{report.quoted_cell('cell')} as cell").orderBy("id").collect()
    for r, s in zip(quoted, safe):
        assert r.cell == ('"' + s.replace('"', '""') + '"' if any(ch in s for ch in '",\n\r') else s)
    writer = shown.coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(str(tmp_path / "sheet"))
    back = {r.id: r.cell for r in sinks.read_csv(spark, str(tmp_path / "sheet")).collect()}
    assert {k: v.replace("\r", "\n") for k, v in back.items()} == {str(i): s.replace("\r", "\n") for i, s in enumerate(safe)}


def test_saved_records_are_coerced(spark):
    good = {"path": "/x.pdf", "name": 5, "fileSizeBytes": -1, "analysis": {"confidence": 140, "signals": ["s", 1] + ["t"] * 30},
            "extraction": {"fields": [{"key": "k"}] * 30}, "pii": {"findings": [{"category": "Phone number", "examples": ["a"] * 5}]}, "review": {"status": "Bogus", "notes": 7}}
    raws = [json.dumps(x) for x in (good, {"path": "x.pdf"}, {"path": "/x.exe"}, [1], 5)] + ["{oops"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "k int, raw string").selectExpr("k", "try_parse_json(raw) as doc")
    got = workspace.sanitize_documents(df, "doc", ("k",)).collect()
    assert [r.k for r in got] == [0]
    r = got[0]
    assert (r["name"], r.size_bytes, r.analysis.confidence, len(r.analysis.signals), len(r.extraction.fields)) == ("x.pdf", 0, 100, 31, 30)
    assert (r.pii.findings[0].examples, r.review.status, r.review.notes) == (["a"] * 5, "Pending", "")


def test_saved_state_cap(spark):
    state = json.dumps({"filterValue": "f", "documents": [{"path": "bad"}] + [{"path": f"/{i}.pdf"} for i in range(5)]})
    df = spark.createDataFrame([(1, state), (2, "nope"), (3, "[]")], "k int, raw string")
    assert workspace.load_documents(df, "raw", ("k",)).count() == 5
    assert [r.path for r in workspace.load_documents(df, "raw", ("k",), cap=2).orderBy("position").collect()] == ["/0.pdf", "/1.pdf"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "ws")
    assert workspace.read_snapshot(spark, root) is None
    workspace.write_snapshot(spark.range(3), root, 1)
    workspace.write_snapshot(spark.range(5), root, 2)
    # written but never published: invisible
    spark.range(9).write.parquet(f"{root}/snapshots/{3:012d}")
    assert workspace.read_snapshot(spark, root).count() == 5


@pytest.mark.parametrize(("total", "limit", "expected"), [(0, 3, 1), (1, 3, 1), (2, 3, 2), (8, 3, 3), (8, None, 8), (0, None, 1)])
def test_page_budget(spark, total, limit, expected):
    assert spark.range(1).selectExpr(f"{page_budget(str(total), limit)} as x").first().x == expected


def test_ocr_roll_up(spark):
    pages = [
        ("first fails", 2, 1, "Failed", "", None), ("first fails", 2, 2, "Completed", "b", 50.0),
        ("empty then fail", 3, 1, "Completed", "", 80.0), ("empty then fail", 3, 2, "Failed", "", None),
        ("third fails", 3, 1, "Completed", "a", 70.5), ("third fails", 3, 2, "Completed", " \n", None), ("third fails", 3, 3, "Failed", "", None),
        *[("five pages", 5, i, "Completed", f"p{i}", float(i)) for i in range(1, 6)],
        ("late", 9, 7, "Completed", "seven", None),
        ("no status", 2, 1, "Completed", "one", None), ("no status", 2, 2, None, "two", None),
    ]
    df = spark.createDataFrame(pages, "doc_id string, total_pages int, page_no int, status string, text string, confidence double")
    got = {r.doc_id: (r.status, r.pages_processed, r.text, r.confidence) for r in ocr.roll_up(df).collect()}
    assert got == {
        "first fails": ("Failed", 0, "", None),
        "empty then fail": ("Failed", 1, "", None),
        "third fails": ("Completed", 2, "Page 1\na", 71),
        "five pages": ("Completed", 5, "\n\n".join(f"Page {i}\np{i}" for i in range(1, 6)), 3),
        "late": ("Completed", 1, "Page 7\nseven", None),
        "no status": ("Completed", 1, "Page 1\none", None),
    }
    assert ocr.roll_up(df, limit=3).filter("doc_id = 'five pages'").first().pages_processed == 3


def test_scan_cleanup(spark):
    bgr = np.random.default_rng(1).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    df = spark.createDataFrame([("i", 7, 5, 3, bytearray(bgr.tobytes()))], "origin string, height int, width int, nChannels int, data binary")
    gray = list(images.scan_cleanup(df).first().gray)
    for px, out in zip(bgr.reshape(-1, 3).tolist(), gray):
        x = min(max((px[2] * 0.299 + px[1] * 0.587 + px[0] * 0.114 - 128) * 1.45 + 128, 0), 255)
        assert out == (0 if x <= 92 else 255 if x >= 188 else round(x))


def test_large_rasters_are_cleaned_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(images, "BLOCK", 1000)
    raster = np.random.default_rng(2).integers(0, 256, (300, 211, 3), dtype=np.uint8)
    whole = images._clean(raster.ravel(), 3)
    import pyarrow as pa

    blocks = images._cleaned(pa.scalar(raster.tobytes()), 300, 211, 3)
    assert blocks[0].as_py() == whole.tobytes()


def test_many_large_rasters_in_bounded_memory(spark):
    """A hundred rasters of 14 megapixels through one task's function: beside the input it holds one gray copy and a block."""
    import tracemalloc

    import pyarrow as pa

    data = pa.scalar(bytes(3500 * 4000 * 3))
    tracemalloc.start()
    for _ in range(100):
        assert len(images._cleaned(data, 4000, 3500, 3)[0].as_buffer()) == 14_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_states_are_read_like_a_json_parser_does(spark):
    doc = '{"path": "/a.pdf", "name": "[,]} \\\\\\" {"}'
    raws = [
        f' {{"filterValue" : "f" ,\n "documents":[ {doc} , 3,[1,[2]],"x",null ]}}\t', f'{{"documents":[{doc}]', f'{{"documents":[{doc},]}}', f'[{{"documents":[{doc}]}}]',
        f'{{"documents":[{doc}]}} x', f'{{"documents":5,"documents":[{doc}],"filterValue":7}}', f'{{"documents":[{doc}],"documents":{{}}}}', '{"documents":[NaN]}',
        f'{{"documents":[],"x":{doc}}}', "{}", "", None, f'{{"documents":[{doc} {doc}]}}', '{"filterValue":"\\ud800","documents":[1]}', "[" * 100_000,
    ]
    want = []
    for k, raw in enumerate(raws):
        try:
            state = json.loads(raw or "", parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError, RecursionError):
            continue
        if isinstance(state, dict) and isinstance(state.get("documents"), list):
            shown = state["filterValue"] if isinstance(state.get("filterValue"), str) else ""
            want += [(k, "?" if k == 13 else shown, i, d) for i, d in enumerate(state["documents"])]
    df = spark.createDataFrame(list(enumerate(raws)), "k int, raw string")
    got = [(r.k, r.filter_value, r.position, json.loads(r.doc)) for r in states.state_documents(df, "raw", ("k",)).collect()]
    assert sorted(got, key=lambda r: r[:3]) == want and {k for k, *_ in want} == {0, 5, 13}


def test_a_state_beyond_the_variant_limit(spark):
    filler = "word " * 1000
    raw = json.dumps({"filterValue": "big", "documents": [{"path": f"/{i}.pdf", "previewText": filler} for i in range(30_000)]})
    assert len(raw) > 150_000_000
    df = spark.createDataFrame([(1, raw)], "k int, raw string")
    got = workspace.load_documents(df, "raw", ("k",)).agg(F.count("*"), F.countDistinct("path"), F.max("position"), F.sum(F.length("preview_text"))).first()
    assert tuple(got) == (30_000, 30_000, 29_999, 30_000 * len(filler))


def test_stream_restart_adds_only_new_rows(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(10).selectExpr("string(id) as path", "id as seq", "string(id % 3) as sha256")
    df.write.parquet(f"{root}/in")
    for _ in range(2):
        stream.run_upserts(stream.arriving(spark, f"{root}/in", df.schema), f"{root}/log", f"{root}/ck")
        stream.run_duplicate_counts(stream.arriving(spark, f"{root}/in", df.schema), f"{root}/counts", f"{root}/ck2")
    newer = spark.range(5).selectExpr("string(id) as path", "id + 100 as seq", "string(id % 3) as sha256")
    newer.write.mode("append").parquet(f"{root}/in")
    stream.run_upserts(stream.arriving(spark, f"{root}/in", df.schema), f"{root}/log", f"{root}/ck")
    stream.run_duplicate_counts(stream.arriving(spark, f"{root}/in", df.schema), f"{root}/counts", f"{root}/ck2")
    now = {r.path: r.seq for r in stream.current_rows(spark, f"{root}/log", "path", "seq").collect()}
    assert now == {str(i): i + 100 if i < 5 else i for i in range(10)}
    counts = {r.sha256: r.copies for r in stream.current_counts(spark, f"{root}/counts").collect()}
    assert counts == {"0": 6, "1": 5, "2": 4}


def test_redelivered_rows_count_once_and_state_is_forgotten(spark, tmp_path):
    root = str(tmp_path)
    schema = "path string, sha256 string, at timestamp"

    def arrive(day, rows):
        spark.createDataFrame(rows, "path string, sha256 string").selectExpr("*", f"timestamp'2026-01-{day:02d} 10:00:00' as at").coalesce(1).write.mode("append").parquet(f"{root}/in")
        got = stream.run_duplicate_counts(
            stream.arriving(spark, f"{root}/in", rows_schema), f"{root}/counts", f"{root}/ck", row_id="path", time="at", delay="2 days"
        )
        return [p["stateOperators"][0]["numRowsTotal"] for p in got.recentProgress if p["stateOperators"]][-1]

    rows_schema = spark.createDataFrame([], schema).schema
    first = [(f"/{i}", f"s{i % 10}") for i in range(500)]
    assert arrive(1, first) == 500
    arrive(2, first[:100] + [("/new", "s0")])
    arrive(20, [("/late", "s1")])
    # the watermark has passed the first days: their rows are forgotten
    assert arrive(20, [("/later", "s1")]) < 10
    counts = {r.sha256: r.copies for r in stream.current_counts(spark, f"{root}/counts").collect()}
    assert counts == {f"s{k}": 50 for k in range(2, 10)} | {"s0": 51, "s1": 52}


def _reviews(spark, *rows):
    return spark.createDataFrame(rows, "path string, ts string, event_id long, status string, notes string").withColumn("ts", F.to_timestamp("ts"))


def test_queue_table_merges_documents_and_reviews(spark, tmp_path):
    root = str(tmp_path)
    docs = spark.range(300).selectExpr("concat('/', id) as path", "id as seq", "concat('v0-', id) as body")
    said = _reviews(spark, ("/1", "2026-01-01", 1, "Approved", None), ("/1", "2026-01-02", 2, None, "n1"), ("/absent", "2026-01-01", 3, "Rejected", None))

    def run(new_docs=None, new_reviews=None):
        if new_docs is not None:
            new_docs.coalesce(1).write.mode("append").parquet(f"{root}/docs")
        if new_reviews is not None:
            new_reviews.coalesce(1).write.mode("append").parquet(f"{root}/reviews")
        queue_table.run(
            stream.arriving(spark, f"{root}/docs", docs.schema), stream.arriving(spark, f"{root}/reviews", said.schema), f"{root}/queue", f"{root}/ck", buckets=16
        )
        return {r.path: (r.body, r.review.status, r.review.notes) for r in queue_table.current(spark, f"{root}/queue").collect()}

    assert queue_table.current(spark, f"{root}/queue") is None
    got = run(docs, said)
    assert len(got) == 300 and got["/1"] == ("v0-1", "Approved", "n1") and got["/2"] == ("v0-2", "Pending", "")
    before = queue_table._places(spark, f"{root}/queue")
    # one document again, one that was reviewed before it came: only their buckets are written anew
    got = run(docs.filter("seq = 1").withColumn("body", F.lit("v1")).unionByName(spark.range(1).selectExpr("'/absent' as path", "9L as seq", "'b' as body")))
    assert got["/1"] == ("v1", "Approved", "n1") and got["/absent"] == ("b", "Rejected", "") and len(got) == 301
    after = queue_table._places(spark, f"{root}/queue")
    assert 1 <= sum(after[b] != before[b] for b in after) <= 2
    for k in range(6):
        got = run(None, _reviews(spark, ("/7", f"2026-02-0{k + 1}", 10 + k, "Needs review" if k % 2 else "Pending", f"k{k}")))
    assert got["/7"] == ("v0-7", "Needs review", "k5")
    # reads do not grow with the number of batches: one folder per bucket
    assert len({f.rpartition("/")[0] for f in queue_table.current(spark, f"{root}/queue").inputFiles()}) == 16


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    root = str(tmp_path)
    row = "struct(bigint({seq}) as seq) as order, struct('{body}' as body) as document, cast(null as struct<at:struct<ts:timestamp,event_id:bigint>,status:string>) as status, cast(null as struct<at:struct<ts:timestamp,event_id:bigint>,notes:string>) as notes"

    def batch(n, body):
        return spark.sql(f"select concat('/', id) as path, {row.format(seq=1, body=body)} from range({n})")

    queue_table.merge_batch(batch(20, "a"), 0, root, 4)
    queue_table.merge_batch(batch(10, "b"), 1, root, 4)
    want = {r.path: r.body for r in queue_table.current(spark, root).collect()}
    for _ in range(2):
        queue_table.merge_batch(batch(10, "b"), 1, root, 4)
    assert {r.path: r.body for r in queue_table.current(spark, root).collect()} == want
    assert sorted(want.values()) == ["a"] * 10 + ["b"] * 10


def test_binary_stream(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.pdf").write_text(f"body {i % 2}")
    files = stream.arriving_files(spark, str(tmp_path), 2).selectExpr("path", f"{t.extension('path')} as extension", "sha2(content, 256) as sha256")
    out = str(tmp_path / "out")
    stream.run_to_table(files, out, str(tmp_path / "ck"))
    assert spark.read.parquet(out).count() == 5


def delivered(spark, *rows):
    values = [{"is_file": True, "sha256": "x", "total_pages": 1, **row} for row in rows]
    return spark.createDataFrame(values, routing.DELIVERED)


def test_large_files_are_read_unless_limited(spark):
    big = {"path": "/a.pdf", "size_bytes": 20 << 20, "parsed_text": "Payroll keeps 417-38-6120 for this hire. " * 5}
    image = {"path": "/b.png", "size_bytes": 12 << 20, "ocr_status": "Completed", "ocr_text": "Payroll keeps 417-38-6120", "ocr_pages": 1}
    df = delivered(spark, big, image)
    assert {r.path: r.pii.risk_level for r in routing.inspect(df).collect()} == {"/a.pdf": "High", "/b.png": "High"}
    limited = {r.path: (r.route, r.status) for r in routing.inspect(df, max_pdf_bytes=15 << 20, max_image_bytes=10 << 20).collect()}
    assert limited == {"/a.pdf": ("f", "Metadata only"), "/b.png": ("b", "Metadata only")}


def test_unread_images_and_empty_ocr_keep_what_was_said(spark):
    df = delivered(
        spark,
        {"path": "/a.png", "size_bytes": 9, "ocr_status": "Not run", "ocr_note": "No engine."},
        {"path": "/b.pdf", "size_bytes": 9, "parse_error": "broken", "ocr_status": "Completed", "ocr_text": " ", "ocr_pages": 1, "ocr_confidence": 41.6},
    )
    got = {r.path: r for r in routing.inspect(df).collect()}
    assert (got["/a.png"].route, got["/a.png"].note) == ("b", "No engine.")
    assert (got["/b.pdf"].route, got["/b.pdf"].ocr.confidence) == ("k", 42)


def test_refresh_keeps_vanished_paths_as_errors(spark):
    inspected = routing.inspect(delivered(spark, {"path": "/a.pdf", "size_bytes": 9, "parsed_text": "some words"}))
    saved = inspected.unionByName(routing.missing(spark.createDataFrame([("/gone.pdf",)], "path string")))
    review = "named_struct('status', 'Approved', 'notes', 'n', 'reviewed_at', cast(null as timestamp))"
    got = {r.path: r for r in queue.refresh(saved.withColumn("review", F.expr(review)), inspected).collect()}
    assert {p: (r.status, r.review.status) for p, r in got.items()} == {"/a.pdf": ("Parsed locally", "Approved"), "/gone.pdf": ("Error", "Approved")}


def test_a_real_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/with blank.pdf").write_bytes(b"abc")
    (tmp_path / "in/folder.pdf").mkdir()
    wanted = [f"{tmp_path}/in/{n}" for n in ("with blank.pdf", "folder.pdf", "absent.pdf")]
    requests = intake.accept_paths(spark.createDataFrame(list(enumerate(wanted)), "seq long, path string"))
    got = {r.path: (r.is_file, r.size_bytes, r.sha256) for r in intake.with_missing(requests, files.scan_files(spark, f"{tmp_path}/in")).collect()}
    assert got == {wanted[0]: (True, 3, hashlib.sha256(b"abc").hexdigest()), wanted[1]: (False, 0, ""), wanted[2]: (False, 0, "")}


def test_timestamps_are_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert spark.range(1).selectExpr(f"{t.iso_timestamp('timestamp_seconds(0)')} as x").first().x == "1970-01-01T00:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_counts_tell_a_null_status_from_all(spark):
    df = spark.createDataFrame([("Pending",), (None,)], "status string").selectExpr("named_struct('status', status) as review")
    assert sorted(map(tuple, queue.status_counts(df).collect()), key=str) == [("All", 2), ("Pending", 1), (None, 1)]


def test_positions_number_the_whole_queue(spark):
    df = spark.range(1000).selectExpr("id as seq", "id * 7 % 97 as size_bytes", "string(id) as path")
    got = [r.path for r in queue.positions(df, "size").orderBy("position").collect()]
    assert got == [str(i) for i in sorted(range(1000), key=lambda i: (-(i * 7 % 97), i))]
    assert sorted(r.position for r in queue.positions(df, "size").collect()) == list(range(1, 1001))
