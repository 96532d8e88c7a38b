"""Registered queries of the subpackage next to their check SQL; the contract's columns."""

import re

import pytest

from check_oracles import compare, connect
from folioflow.llm.oracles import ORACLES
from folioflow.llm.queries import QUERIES

COLUMNS = {
    1: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    2: "query_id bigint, rank int, vec_id bigint, score bigint",
    3: "doc_id bigint, fingerprint string, component_id bigint",
    4: "doc_id bigint, held_out boolean, score double, predicted int",
    5: "page_id bigint, url string, text string, n_chars bigint",
    6: "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    8: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    10: "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    11: "doc_id bigint, held_out boolean, lang_pred string, score double",
    12: "item_id bigint, rank int, doc_id bigint, score bigint",
    13: "lang string, source string, part string, item string, value bigint, rank int",
}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_check_sql(spark, duck, sf, name):
    problem, rows, _, _ = compare(spark, duck, sf, name, QUERIES[name], ORACLES[name])
    assert problem == ""
    assert rows > 0


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns(spark, sf, number):
    name = next(q for q in QUERIES if q.startswith(f"op{number}_"))
    types = QUERIES[name](spark, sf).dtypes
    assert ", ".join(f"{c} {t}" for c, t in types).startswith(COLUMNS[number])


@pytest.mark.parametrize("number", [6, 8, 9])
def test_native_queries_run_no_python(spark, sf, number):
    name = next(q for q in QUERIES if q.startswith(f"op{number}_"))
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
