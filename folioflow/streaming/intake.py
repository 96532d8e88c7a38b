"""Streaming intake: the batch expressions on arriving files, and two running tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioflow.operators.dedupe import fingerprint_counts

# Fixed value: files taken per micro-batch.
FILES_PER_BATCH = 24

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Rows of parquet files as they land in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def arriving_files(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Files themselves (path, modificationTime, length, content) as they land."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain what has arrived into an exactly-once parquet table."""
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand what has arrived to ``write`` batch by batch; a batch that is handed over again has the same number."""
    spark = stream.sparkSession
    before = spark.conf.get(_STATE_STORE, None)
    # state on local disk with changelogs in the checkpoint, not on the heap
    spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)
    query.awaitTermination()
    return query


def _to_folders(out: str, made: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; a replayed batch overwrites itself."""
    return lambda batch, batch_id: made(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def run_upserts(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append arriving documents to an upsert log; see :func:`current_rows`."""
    run_batches(stream, checkpoint, _to_folders(out))


def current_rows(spark: SparkSession, out: str, key: str, seq: str) -> DataFrame:
    """Newest row per key of an upsert log: later batch wins, then later ``seq``."""
    log = spark.read.option("basePath", out).parquet(out)
    row = F.struct(*[c for c in log.columns if c not in (key, "batch")])
    return log.groupBy(key).agg(F.max_by(row, F.struct("batch", seq)).alias("r")).select(key, "r.*")


def run_duplicate_counts(
    stream: DataFrame, out: str, checkpoint: str, key: str = "sha256", row_id: str | None = None, time: str | None = None, delay: str = "7 days"
) -> StreamingQuery:
    """Running copies per fingerprint: each batch writes its own counts, which :func:`current_counts` adds up.

    Counting keeps no state. With ``row_id`` and ``time`` a row that is delivered again counts once, as long as its
    time lies within ``delay`` of the latest: only rows of that span are kept as state, and older ones are forgotten.
    """
    if row_id and time:
        stream = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([row_id, key])
    return run_batches(stream, checkpoint, _to_folders(out, lambda batch: fingerprint_counts(batch, key)))


def current_counts(spark: SparkSession, out: str, key: str = "sha256") -> DataFrame:
    return spark.read.option("basePath", out).parquet(out).groupBy(key).agg(F.sum("copies").alias("copies"))
