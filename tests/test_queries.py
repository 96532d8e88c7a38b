"""Registered queries: equal to their check SQL, and planned as intended."""

import pytest

import __spark_entry__ as driver
from check_oracles import compare, connect
from folioflow.operators import classify, queue, routing
from folioflow.plans.oracles import ORACLES
from folioflow.plans.queries import QUERIES
from folioflow.sources import corpus as src


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_check_sql(spark, duck, sf, name):
    problem, rows, _, _ = compare(spark, duck, sf, name, QUERIES[name], ORACLES[name])
    assert problem == ""
    assert rows > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"scan_cleanup"}))
def test_plans(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "SinglePartition, REPARTITION"):
        assert banned not in text


def test_intelligence_is_evaluated_once(spark, sf):
    text = plan(QUERIES["document_intelligence"](spark, sf).filter("total_matches > 2 and risk_level = 'High'"))
    # one evaluation: each detector pattern occurs once to match, once to locate
    assert text.count("regexp_extract_all(") == 7


def test_parts_left_out_are_not_planned(spark, sf):
    docs = src.corpus(spark, sf)
    field_status = "Detected label"
    assert field_status in plan(classify.with_intelligence(docs, parts=("extraction",)))
    assert plan(classify.with_intelligence(docs, parts=("extraction",))).count("regexp_extract_all(") == 0
    sensitivity = plan(QUERIES["doc_sensitivity"](spark, sf))
    assert sensitivity.count("regexp_extract_all(") == 7 and field_status not in sensitivity
    bare = routing.inspect(src.delivered(spark, sf), parts=())
    assert "regexp_extract_all(" not in plan(bare) and "Generate" not in plan(bare)
    assert {"path", "status", "note"} <= set(bare.columns) and not set(classify.PARTS) & set(bare.columns)


@pytest.mark.parametrize("parts", [("pii",), ("analysis",), ("extraction",), ("pii", "extraction")])
def test_parts_equal_those_of_the_whole_record(spark, sf, parts):
    docs = src.delivered(spark, sf)
    whole = {r.path: r for r in routing.inspect(docs).select("path", *parts).collect()}
    assert {r.path: r for r in routing.inspect(docs, parts=parts).select("path", *parts).collect()} == whole


def test_a_queue_stored_by_path_is_not_shuffled(spark, sf):
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        current, incoming = src.light_queue(spark, sf, 0, 1), src.light_queue(spark, sf, 0, 2).drop("review")
        text = plan(queue.merge(queue.by_path(current), incoming))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    # above each scan of the stored queue: a sort at most, up to the join
    lines = [(len(line) - len(line.lstrip(" :+-")), line) for line in text.split("\n")]
    scans = [n for n, (_, line) in enumerate(lines) if "Bucketed: true" in line]
    assert len(scans) == 2
    for n in scans:
        depth, above = lines[n][0], []
        for indent, line in reversed(lines[:n]):
            if indent < depth:
                depth = indent
                above.append(line.strip(" :+-"))
        assert not any(line.startswith("Exchange") for line in above), above
        assert any(line.startswith("SortMergeJoin") for line in above)


def test_scan_prunes_columns(spark, sf):
    text = plan(QUERIES["pii_scan"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
