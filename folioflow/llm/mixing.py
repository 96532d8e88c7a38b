"""Mixing sources to target weights by capped water-filling, with DataFrame and SQL functions only.

Targets: every source is clamped at ``max_epochs`` times its size; what it cannot take is
shared among the others by weight until none is above its clamp. Sorted by size over weight,
the clamped sources are a prefix, so prefix sums give the fixed point of that loop exactly.

Sampling: a document is repeated ``whole = floor(target / source size)`` times, and the rest
of the target is filled with documents in the order of a seeded digest of their id. The cut of
each source is found in 4,096 digest buckets first and only then inside one bucket, so a source
that holds a third of all rows is never sorted in one task. Rerunning gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import WORD, written

#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Sources up to this number are broadcast (a few tens of bytes each); more are joined by a salted key.
BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: str = "text"):
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: str, doc_id: str = "doc_id"):
    """Seeded random order of documents: a digest of the id, then the id."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(seed + ":"), name)), F.lit(":"), name)


def rank_weights(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight`` to one row per source: by code point, null last, the weights repeat.

    The ranking window sees one row per source, not documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))


def targets(totals: DataFrame, percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, weight) to these and target, whole, excess.

    ``percent`` of the sum of all sizes is shared by weight, no target above ``max_epochs`` times
    its source's size. Sums are exact decimals (in hundredths); a weight of 0 or null gets target 0.
    """
    number = "decimal(38,0)"
    rows = totals.select(
        "source",
        "source_size",
        F.coalesce("weight", F.lit(0)).cast(number).alias("weight"),
        (F.col("source_size").cast(number) * (100 * max_epochs)).cast(number).alias("_cap"),
        (F.sum("source_size").over(W.partitionBy()).cast(number) * percent).cast(number).alias("_all"),
    )
    ratio = F.when(F.col("weight") > 0, F.col("source_size") / F.col("weight").cast("double"))
    order = W.orderBy(ratio.asc_nulls_last(), F.col("source").asc_nulls_last())
    rows = rows.withColumns(
        {
            "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast(number),
            "_left": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)).cast(number),
        }
    )
    clamped = (F.col("weight") > 0) & (
        (F.col("_cap") * F.col("_left")).cast(number) <= (F.col("weight") * (F.col("_all") - F.col("_before"))).cast(number)
    )
    rows = rows.withColumn("_clamped", clamped)
    rows = rows.withColumns(
        {
            "_taken": F.coalesce(F.sum(F.when(F.col("_clamped"), F.col("_cap"))).over(W.partitionBy()), F.lit(0)).cast(number),
            "_open": F.coalesce(F.sum(F.when(~F.col("_clamped"), F.col("weight"))).over(W.partitionBy()), F.lit(0)).cast(number),
        }
    )
    shared = (F.col("weight") * (F.col("_all") - F.col("_taken"))).cast(number).cast("double") / (100 * F.col("_open")).cast("double")
    target = F.when(F.col("_clamped"), (F.col("source_size") * max_epochs).cast("double")).when(F.col("weight") > 0, shared).otherwise(0.0)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return rows.select("source", "source_size", "weight", target.alias("target")).withColumn("whole", whole).withColumn(
        "excess", F.col("target") - F.col("whole") * F.col("source_size")
    )


def cuts(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """Adds to each source ``cut``: documents whose order key is not above it get one more repetition.

    A document (with all its repeated rows) is taken while half of it still fits in ``excess``, so a
    source ends at most half a document from its target.
    """
    bucket = F.substring("order_key", 1, 3)
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    last = sums.alias("a").join(shares.alias("b"), same).filter("before <= excess").groupBy("a.source").agg(
        F.max(F.struct("bucket", "before", "excess")).alias("last")
    )
    last = written(last.select("source", "last.*"), "mix-cuts")
    # only the rows of each source's last bucket: about one in 4,096
    inside = sized.alias("a").join(last.alias("b"), same & (bucket == F.col("b.bucket")))
    units = inside.groupBy("a.source", "order_key", "before", "excess").agg(F.sum("size").alias("size"))
    ordered = W.partitionBy("source").orderBy("order_key").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(ordered), F.lit(0))
    fitting = units.withColumn("start", start).filter("start + size / 2 <= excess").groupBy("source").agg(F.max("order_key").alias("key"))
    found = last.alias("a").join(fitting.alias("b"), same, "left").select("a.source", F.coalesce("key", "bucket").alias("cut"))
    return shares.alias("a").join(found.alias("b"), same, "left").select("a.*", F.coalesce("cut", F.lit("")).alias("cut"))


def mix_rules(docs: DataFrame, seed: str = "mix", percent: int = 150, max_epochs: int = 2, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sized documents, rules): doc_id, source, size, order_key per row; one rule per source.

    ``weights`` (source, weight) replaces the weights by rank. Texts are read once and not shuffled.
    """
    sized = written(docs.select("doc_id", "source", word_count().alias("size"), order_key(seed).alias("order_key")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        totals = rank_weights(totals)
    else:
        named = weights.select(F.col("source").alias("_source"), "weight")
        totals = totals.join(named, totals["source"].eqNullSafe(named["_source"]), "left").drop("_source")
    shares = written(targets(totals, percent, max_epochs), "mix-targets")
    return sized, written(cuts(sized, shares), "mix-rules")


def with_rules(rows: DataFrame, rules: DataFrame, source: str = "source", key: str = "order_key") -> DataFrame:
    """Rows with their source's rule as column ``rule`` and ``copies``, the repetitions they get."""
    rule = rules.select(F.struct(*rules.columns).alias("rule"))
    if rules.count() <= BROADCAST_SOURCES:
        out = rows.join(F.broadcast(rule), F.col(source).eqNullSafe(F.col("rule.source")))
    else:
        rule = rule.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_row_salt", F.pmod(F.hash(key), F.lit(SALTS)))
        on = F.col(source).eqNullSafe(F.col("rule.source")) & (F.col("_row_salt") == F.col("_salt"))
        out = rows.join(rule, on).drop("_salt", "_row_salt")
    copies = F.col("rule.whole") + (F.col(key) <= F.col("rule.cut")).cast("long")
    return out.withColumn("copies", copies)


def mixed_sizes(docs: DataFrame, seed: str = "mix", percent: int = 150, max_epochs: int = 2, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of ``docs``.

    A null text has size 0; a null source is a source of its own, last in the ranking; repeated rows
    of one doc_id are taken together; an empty table gives no rows; other columns are ignored.
    """
    sized, rules = mix_rules(docs, seed, percent, max_epochs, weights)
    return with_rules(sized, rules).select(
        "doc_id",
        "size",
        F.col("rule.source_size").alias("source_size"),
        F.col("rule.target").alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"),
        "source",
        F.col("copies"),
    )


def mixed_documents(docs: DataFrame, seed: str = "mix", percent: int = 150, max_epochs: int = 2, weights: DataFrame | None = None) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs``; same rules as :func:`mixed_sizes`."""
    _, rules = mix_rules(docs, seed, percent, max_epochs, weights)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("_source"), order_key(seed).alias("order_key"))
    taken = with_rules(rows, rules, "_source").filter("copies > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select("row.*")
