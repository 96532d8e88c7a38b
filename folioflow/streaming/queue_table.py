"""The review queue as a compacted table that streams of documents and of reviews keep up to date.

Rows lie in buckets by a hash of their path. A micro-batch reads and rewrites only the buckets it touches, into folders of
its own; a list of one row per bucket then says where each bucket's rows lie, and makes the batch visible. Two lists take
turns, so a batch that is run again starts from what the batch before it left and replaces its own work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from folioflow.streaming.intake import run_batches

BUCKETS = 64
_AT = "struct<ts:timestamp,event_id:bigint>"
_STATUS, _NOTES = f"struct<at:{_AT},status:string>", f"struct<at:{_AT},notes:string>"


def run(documents: DataFrame, reviews: DataFrame, root: str, checkpoint: str, seq: str = "seq", buckets: int = BUCKETS) -> StreamingQuery:
    """Drain both streams into the table at ``root``.

    ``documents`` (path, ``seq``, any other columns): the latest batch's row of a path replaces it, within a batch the one with the
    greatest ``seq``. ``reviews`` (path, ts, event_id, status, notes): a status or notes that are not null replace
    older ones. Reviews outlive new versions of their document, and may come before it.
    """
    columns = [c for c in documents.columns if c != "path"]
    arrived = documents.select(
        "path", F.struct(F.col(seq).cast("bigint").alias("seq")).alias("order"), F.struct(*columns).alias("document"),
        F.lit(None).cast(_STATUS).alias("status"), F.lit(None).cast(_NOTES).alias("notes"),
    )
    at = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id"))
    said = reviews.select(
        "path", F.lit(None).cast("struct<seq:bigint>").alias("order"), F.lit(None).cast(arrived.schema["document"].dataType).alias("document"),
        F.when(F.col("status").isNotNull(), F.struct(at.alias("at"), "status")).alias("status"),
        F.when(F.col("notes").isNotNull(), F.struct(at.alias("at"), "notes")).alias("notes"),
    )
    return run_batches(arrived.unionByName(said), checkpoint, lambda batch, batch_id: merge_batch(batch, batch_id, root, buckets))


def merge_batch(batch: DataFrame, batch_id: int, root: str, buckets: int = BUCKETS) -> None:
    """Merge one micro-batch (path, order, document, status, notes) and publish it."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    new = batch.select(bucket.alias("bucket"), "path", F.when(F.col("document").isNotNull(), F.struct(F.lit(batch_id).cast("bigint").alias("batch"), "order.seq")).alias("order"), "document", "status", "notes")
    touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
    places = _places(spark, root, batch_id)
    if touched:
        old = _rows(spark, root, {b: v for b, v in places.items() if b in touched}, new)
        merged = old.unionByName(new).groupBy("bucket", "path").agg(
            F.max("order").alias("order"), F.max_by("document", "order").alias("document"), F.max("status").alias("status"), F.max("notes").alias("notes")
        )
        merged = merged.repartition("bucket").sortWithinPartitions("bucket", "path")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/rows/version={batch_id}")
    places |= dict.fromkeys(touched, batch_id)
    listed = spark.createDataFrame([(b, v, batch_id) for b, v in sorted(places.items())] or [(-1, -1, batch_id)], "bucket int, version bigint, batch bigint")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{root}/list/turn={batch_id % 2}")


def _places(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """Version folder of every bucket (at most one entry per bucket), as of the batch before, or the newest."""
    lists = []
    for turn in (0, 1):
        try:
            lists.append(spark.read.schema("bucket int, version bigint, batch bigint").parquet(f"{root}/list/turn={turn}").collect())
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    lists = [rows for rows in lists if rows and (before is None or rows[0]["batch"] < before)]
    newest = max(lists, key=lambda rows: rows[0]["batch"], default=[])
    return {r["bucket"]: r["version"] for r in newest if r["bucket"] >= 0}


def _rows(spark: SparkSession, root: str, places: dict[int, int], like: DataFrame) -> DataFrame:
    if not places:
        return spark.createDataFrame([], like.schema)
    folders = [f"{root}/rows/version={v}/bucket={b}" for b, v in sorted(places.items())]
    return spark.read.option("basePath", f"{root}/rows").parquet(*folders).select(*like.columns)


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """Queued documents with their review; None before the first batch. One folder per bucket is read, however many batches there were."""
    places = _places(spark, root)
    if not places:
        return None
    folders = [f"{root}/rows/version={v}/bucket={b}" for b, v in sorted(places.items())]
    rows = spark.read.option("basePath", f"{root}/rows").parquet(*folders).filter("document is not null")
    review = (
        "named_struct('status', coalesce(status.status, 'Pending'), 'notes', coalesce(notes.notes, ''),"
        " 'reviewed_at', case when status.status <> 'Pending' then status.at.ts end)"
    )
    return rows.selectExpr("path", "document.*", f"{review} as review")
