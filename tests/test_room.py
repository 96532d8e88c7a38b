"""Large tables take little room on disk: whole rows seldom travel, shuffle files go with their step, scratch tables are packed."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.operators import dedupe, queue, report, search
from folioflow.session import stored, stored_in_blocks, tidied
from folioflow.sources import corpus, sinks

NEEDLES = ["  Net 30 ", "é", "w-9", "Internal memo 1", "never to be found zzz", ""]


@pytest.fixture(scope="module")
def rows(spark, sf):
    found = corpus.queue(spark, sf).cache()
    yield found
    found.unpersist()


def shuffle_bytes(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data"))


def comes_down_to(spark, most):
    """Whether shuffle files soon take at most so many bytes: they are removed behind the step."""
    for _ in range(40):
        if shuffle_bytes(spark) <= most:
            return True
        time.sleep(0.25)
    return False


def travelled(df):
    """Rows that the exchanges of a collected DataFrame wrote."""
    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        children = node.children()
        own = node.longMetric("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(walk(children.apply(i)) for i in range(children.length()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def copies(spark):
    """A hot fingerprint, 500 pairs, rows alone, empty fingerprints and none."""
    kind = "case when id % 10 < 2 then 'hot' when id < 5000 and id % 10 = 3 then concat('p', id div 10 % 250) when id % 10 = 4 then '' when id % 10 <> 5 then sha2(string(id), 256) end"
    return spark.range(10_000).selectExpr("string(id) as path", f"{kind} as sha256", "repeat('wide ', 50) as text")


def wanted(df):
    counts = df.filter("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n"))
    return df.join(counts, "sha256", "left").select("path", F.coalesce("n", F.lit(1)).alias("n"))


@pytest.mark.parametrize("sent", [0, dedupe.SENT])
def test_rows_without_copies_stay_where_they_are(spark, no_small_tables, sent):
    df = stored(copies(spark), "copies-test")
    got = dedupe.with_copies(df, hot=2, sent=sent)
    found = {r.path: (r.copies, r.duplicate) for r in got.collect()}
    assert found == {r.path: (r.n, r.n > 1) for r in wanted(df).collect()}
    assert len(found) == 10_000
    # before, all rows travelled; with marks those of the 250 fingerprints do, and their counts
    assert travelled(got) < 2_500


def test_report_rows_do_not_travel(spark, rows, no_small_tables):
    counted = report.report_documents(stored(rows, "queue"))
    counted.collect()
    assert travelled(counted) < 0.1 * rows.count()


def test_summary_of_counted_rows_is_the_same(spark, rows):
    odd = rows.withColumn("sha256", F.expr("case when k % 50 = 1 then null when k % 7 = 2 then concat('c', k % 100) else sha256 end"))
    for part in (odd, odd.filter("k % 50 = 1").limit(1), odd.filter("false")):
        plain = report.summary(part, " x ").collect()
        assert report.summary(report.report_documents(part), " x ", counted=True).collect() == plain
    assert report.summary(odd).first().duplicates > 0


def test_report_leaves_no_shuffle_files(spark, rows, tmp_path):
    kept = stored(rows, "queue")
    assert all(".zstd." in name for name in kept.inputFiles())
    time.sleep(1)
    before = shuffle_bytes(spark)
    sinks.write_report(kept, str(tmp_path / "report"))
    assert comes_down_to(spark, before + 50_000)


def test_searchable_blocks_hold_every_row_once(spark, rows, tmp_path, monkeypatch):
    seen = []

    def blocks(df, label):
        seen.extend(stored_in_blocks(df, label, most=3, at_least=1))
        return seen

    monkeypatch.setattr(search, "stored_in_blocks", blocks)
    before = shuffle_bytes(spark)
    root = str(tmp_path / "searchable")
    search.store(rows, root)
    assert len(seen) == 3 and all("search_text" not in block.columns for block in seen)
    assert sum(block.count() for block in seen) == rows.count() == spark.read.parquet(f"{root}/rows").count()
    assert comes_down_to(spark, before + 50_000)
    for needle in NEEDLES:
        found = sorted(r.path for r in search.search(spark, root, needle).select("path").collect())
        assert found == sorted(r.path for r in queue.search(rows, needle).select("path").collect())


@pytest.mark.parametrize("files,most,at_least,count", [(8, 3, 1, 3), (8, 20, 1, 8), (8, 3, 1 << 30, 1), (1, 8, 1, 1)])
def test_blocks_are_whole_files_in_order(spark, files, most, at_least, count):
    blocks = stored_in_blocks(spark.range(0, 8000, 1, files), "blocks", most=most, at_least=at_least)
    parts = [sorted(r.id for r in block.collect()) for block in blocks]
    assert len(parts) == count and [x for part in parts for x in part] == list(range(8000))


def test_blocks_of_an_empty_table(spark, rows, tmp_path):
    assert [b.count() for b in stored_in_blocks(spark.range(0), "none")] == [0]
    search.store(rows.limit(0), str(tmp_path / "none"))
    assert search.search(spark, str(tmp_path / "none"), "net 30").count() == 0


def test_setting_of_the_session_is_kept(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with pytest.raises(ValueError), tidied(spark):
        assert spark.conf.get(name) == "true"
        raise ValueError
    assert spark.conf.get(name) == "false"
