"""Shared helpers: scratch tables, document keys, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import scratch_dir

#: White space of the word rules: blank and U+0009 to U+000D. A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of words stay (letters and digits of ASCII, every byte of other characters), all others part words.
WORD_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Bytes of texts that go to Python at a time. Spark counts rows only, 10,000 a batch, however long their texts are.
BATCH_BYTES = 8 << 20

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    Cuts the lineage at files that outlive any executor. Shuffle files of the write are
    dropped as soon as it has committed, so steps do not add up on disk.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def scanned(rows: DataFrame, scan: Callable, schema) -> DataFrame:
    """``rows.mapInArrow``, in batches of bounded size.

    A session that bounds its batches keeps its own bound; one without gets ``BATCH_BYTES``, for good, as rows are read later.
    """
    conf = rows.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return rows.mapInArrow(scan, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows of :func:`keyed_documents`."""
    return keyed_documents(docs, *columns)[0]


def keyed_documents(docs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows, the same with one row per key): ``_key`` (long, unique per distinct doc_id and text, ascending with doc_id), doc_id, text and ``columns``.

    Ids that are whole are the key themselves. Only where some id is null or repeated, rows are
    numbered in the order (doc_id with nulls last, text) and written; rows that repeat both
    doc_id and text are one document and share a key, and each gets that document's result.
    A null text is empty.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *columns)
    bad = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1)
    if not bad.take(1):
        rows = rows.withColumn("_key", F.col("doc_id").cast("long"))
        return rows, rows
    order = [F.col("doc_id").asc_nulls_last(), F.col("_digest")]
    ids = rows.select("doc_id", F.sha2("text", 256).alias("_digest")).distinct()
    numbered = ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_key", F.monotonically_increasing_id())
    numbered = written(numbered, "keys").withColumnRenamed("doc_id", "_id")
    rows = rows.withColumn("_sha", F.sha2("text", 256))
    rows = rows.join(numbered, rows["doc_id"].eqNullSafe(numbered["_id"]) & (rows["_sha"] == numbered["_digest"])).drop(
        "_id", "_digest", "_sha"
    )
    return rows, rows.dropDuplicates(["_key"])


def meet(rows: DataFrame, per_key: DataFrame, key: str, hot: int, salts: int, *deal_by: str) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row per ``key`` and the number of its rows in ``copies``.

    Keys with more than one in ``hot`` of all rows are fewer than ``hot``; they are sent out, and the rows of each are dealt to
    ``salts`` tasks by the hash of ``deal_by``. The other keys grow with the data and are never sent out, however few they are.
    """
    total = per_key.agg(F.sum("copies")).first()[0] or 0
    often = F.broadcast(per_key.filter(F.col("copies") > total / hot).select(key, F.lit(True).alias("_hot")))

    def salted(side: DataFrame, if_hot: Column, otherwise: Column) -> DataFrame:
        return side.join(often, key, "left").withColumn("_salt", F.when(F.col("_hot"), if_hot).otherwise(otherwise)).drop("_hot")

    dealt = salted(rows, F.pmod(F.xxhash64(*deal_by), F.lit(salts)).cast("int"), F.lit(0))
    copied = salted(per_key.drop("copies"), F.sequence(F.lit(0), F.lit(salts - 1)), F.array(F.lit(0))).withColumn("_salt", F.explode("_salt"))
    return dealt.join(copied.hint("merge"), [key, "_salt"]).drop("_salt")


def words_of(text: str) -> list[bytes]:
    """Words in lower case; punctuation parts them and does not count."""
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()
