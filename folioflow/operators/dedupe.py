"""Exact-copy groups by fingerprint.

Counting pre-aggregates map-side, so a fingerprint shared by a third of all rows
costs one partial row per task. Fingerprints that repeat are stored with their
counts, and attaching the counts moves only rows that need it. Up to ``SENT``
repeated fingerprints are sent out, and no row moves. Of more, the ``hot`` most
frequent ones go by broadcast (at most ``hot`` rows, a proven bound), and bits of
all that repeat, of fixed number, tell which other rows may have copies. Those
meet their counts in an ordinary shuffled join, in which any group holds at most
``1/hot`` of the rows; the rest stay where they are, however wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import stored

HOT_KEYS = 1024
#: Repeated fingerprints that are sent out as they are (some 30 MB).
SENT = 200_000
#: Bits that mark repeated fingerprints, sent out in words of 64: at most 262,144 rows.
MARKS = 1 << 24


def fingerprint_counts(df: DataFrame, key: str = "sha256") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("copies"))


def with_copies(df: DataFrame, key: str = "sha256", row_id: str = "path", hot: int = HOT_KEYS, sent: int = SENT) -> DataFrame:
    """Append ``copies`` (rows sharing the fingerprint) and ``duplicate`` (more than one); a row without a fingerprint is no copy.

    Counts at once, and reads ``df`` two or three times in all: a costly table is best stored before.
    """
    repeated = stored(fingerprint_counts(df, key).filter(F.col(key).isNotNull() & (F.col("copies") > 1)), "copies")
    heavy = repeated.orderBy(F.desc("copies"), key).limit(hot).select(F.col(key).alias("_hot_key"), F.col("copies").alias("_hot"))
    light = repeated.select(F.col(key).alias("_cold_key"), F.col("copies").alias("_cold"))
    marked = df.join(F.broadcast(heavy), df[key] == F.col("_hot_key"), "left")
    # Rows already answered, and rows without a fingerprint, get a spread-out key that matches nothing.
    probe = F.coalesce(F.when(F.col("_hot").isNull(), F.col(key)), F.concat(F.lit("row:"), F.col(row_id).cast("string")), F.lit("row"))

    def met(rows: DataFrame, counts: DataFrame) -> DataFrame:
        joined = rows.withColumn("_probe", probe).join(counts, F.col("_probe") == F.col("_cold_key"), "left")
        return joined.select(*df.columns, F.coalesce("_hot", "_cold", F.lit(1)).cast("long").alias("copies"))

    if repeated.count() <= sent:
        counted = met(marked, F.broadcast(light))
    else:
        place = f"pmod(xxhash64(`{key}`), {MARKS}L)"
        words = repeated.groupBy(F.expr(f"{place} div 64").alias("_word")).agg(F.expr(f"bit_or(shiftleft(1L, int({place} % 64)))").alias("_marks"))
        marked = marked.join(F.broadcast(words), F.expr(f"{place} div 64") == F.col("_word"), "left")
        moves = F.expr(f"_hot is null and `{key}` is not null and coalesce(shiftright(_marks, int({place} % 64)) & 1L, 0L) = 1L")
        stay = marked.filter(~moves).select(*df.columns, F.coalesce("_hot", F.lit(1)).cast("long").alias("copies"))
        counted = stay.unionByName(met(marked.filter(moves), light))
    return counted.withColumn("duplicate", F.col("copies") > 1)
