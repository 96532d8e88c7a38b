"""Session helpers: local builder for tests and benches, shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A table that is worked through in blocks has at most so many, of at least so many bytes of files each.
BLOCKS, BLOCK_BYTES = 8, 128 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioflow")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for written tables and streaming checkpoints.

    It lies under ``spark.checkpoint.dir``, the folder every executor can reach.
    Only a local-mode session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="folioflow-")
    return f"{root.rstrip('/')}/folioflow/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a source that arrives in fewer partitions than there are cores.

    Large tables already arrive in many splits and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal narrow rows that stand for much work evenly over the cores, however their table is split.

    Texts rendered from keys are many times the size of the keys, so splits that suit the table, a row group
    each at best, leave most cores idle. Call it on the keys, before anything is rendered from them.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, 2 * df.rdd.getNumPartitions())
    return df.repartition(tasks, *keys)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each write inside are dropped as soon as it has committed, so steps do not add up on disk."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: How scratch tables are packed: level 9 takes a tenth less room than the default and hardly more time.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    Cuts the lineage, so what reads the table several times computes it once and
    a lost executor costs a re-read, not a recomputation.
    """
    path = _write(df, label)
    return df.sparkSession.read.parquet(path)


def _write(df: DataFrame, label: str) -> str:
    path = scratch_dir(df.sparkSession, label)
    with tidied(df.sparkSession):
        df.write.options(**PACKED).parquet(path)
    return path


def stored_in_blocks(df: DataFrame, label: str, most: int = BLOCKS, at_least: int = BLOCK_BYTES) -> list[DataFrame]:
    """A stored table as ``most`` blocks of whole files, or fewer of some ``at_least`` bytes, in the order it was written.

    What shuffles whole rows block by block, inside :func:`tidied`, holds the shuffle files of one block at a time.
    """
    spark = df.sparkSession
    path = _write(df, label)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    files = sorted((r["path"], r["length"]) for r in listed.collect())
    total = sum(size for _, size in files)
    room = -(-total // max(1, min(most, -(-total // at_least))))
    blocks: list[list[str]] = []
    before = 0
    for name, size in files:
        # A file belongs to the block in which its middle lies.
        at = (before + size // 2) // room
        blocks += [[] for _ in range(at + 1 - len(blocks))]
        blocks[at].append(name)
        before += size
    schema = spark.read.parquet(path).schema
    return [spark.read.schema(schema).parquet(*names) for names in blocks if names]
