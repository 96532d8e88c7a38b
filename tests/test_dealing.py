"""Rendered rows are dealt over the cores however the key tables are split, and costly steps run once, where needed."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as t
from folioflow.plans import queries
from folioflow.plans.queries import QUERIES
from folioflow.sources import corpus as src
from folioflow.sources import sinks
from test_queries import plan


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents in many files; orders and customers in one file of one row group each."""
    root = str(tmp_path_factory.mktemp("tables"))
    docs = spark.range(0, 64, 1, 16).selectExpr("id as doc_id", "concat('Text ', id) as text", "'en' as lang", "'a' as source", "8L as n_chars")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.range(0, 800, 1, 1).selectExpr("id as o_orderkey", "id % 50 as o_custkey").write.parquet(f"{root}/orders.parquet")
    spark.range(0, 800, 1, 1).selectExpr("id as c_custkey", "concat('C', id) as c_name").write.parquet(f"{root}/customer.parquet")
    return root


@pytest.mark.parametrize("rows", [src.corpus, src.delivered, src.saved, src.saved_states])
def test_rendered_rows_are_dealt_over_the_cores(spark, tables, rows):
    made = rows(spark, tables)
    kind = F.lit("") if "raw" in made.columns else F.regexp_extract("path", "/(invoice|customer|1|2)/", 1)
    counts = made.groupBy(kind.alias("kind"), F.spark_partition_id().alias("task")).count().groupBy("kind").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    big = [r for r in counts.collect() if r["all"] >= 400]
    assert big and all(r["most"] < r["all"] / 4 for r in big)


def test_saved_records_are_parsed_once(spark, tables):
    assert plan(QUERIES["workspace_sanitize"](spark, tables)).lower().count("parsejson") == 1


def test_trim_and_ocr_gate_look_at_edges_first(spark):
    values = ["", " ", "a", " a", "a　", "\n a b \t", "a b", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    plain = f"trim(both {t.lit(t.SPACE_CHARS)} from v)"
    for r in rows.selectExpr(f"{t.trim('v')} as x", f"{t.trim('concat(v)')} as y", f"{plain} as z").collect():
        assert r.x == r.y == r.z
    texts = ["", None, "x" * 119, "x" * 120, "." * 400 + "x" * 119, "." * 400 + "x" * 120, "." * 250 + "x" * 60 + "é" * 80 + "x" * 60]
    rows = spark.createDataFrame([(v,) for v in texts], "v string")
    for r in rows.selectExpr(f"{t.needs_ocr('v')} as x", f"{t.signal_chars('v')} < 120 as y").collect():
        assert r.x == r.y
    assert "left(" in t.needs_ocr("v") and "case when" in t.trim("v")


def test_report_takes_no_more_room_than_the_queue(spark, tables, tmp_path):
    queue = src.queue(spark, tables)
    queue.write.parquet(f"{tmp_path}/queue")
    stored = spark.read.parquet(f"{tmp_path}/queue")
    sinks.write_report(stored, f"{tmp_path}/report", "net 30")

    def room(folder):
        return sum(f.stat().st_size for f in Path(tmp_path, folder).rglob("part-*"))

    assert room("report/documents") < 2 * room("queue")
    read = spark.read.json(f"{tmp_path}/report/documents")
    assert sorted(r.path for r in read.select("path").collect()) == sorted(r.path for r in stored.select("path").collect())
    assert spark.read.json(f"{tmp_path}/report/summary").first().documents_selected == stored.count()


def test_arriving_documents_are_scanned_on_all_cores(spark, tables):
    found = QUERIES["stream_pii"](spark, tables)
    assert found.count() == 64
    assert len(found.inputFiles()) > 2 * spark.sparkContext.defaultParallelism


def test_sheet_queue_holds_no_texts(spark, tables):
    stored = queries._sheet_queue(spark, tables)
    assert not {"content", "preview_text", "metadata"} & set(stored.columns)
    assert stored.select("extraction.*").columns == ["template"] and stored.select("ocr.*").columns == ["status"]
