"""Line dedup by content-defined chunks of lines, with DataFrame and SQL functions only.

Lines are hashed, a rolling hash over ``WINDOW`` line hashes marks the lines after which a chunk ends,
so boundaries depend on nearby content alone and an insertion shifts no chunk beyond it. Chunks of
at least ``MIN_LINES`` lines that occur more than once in the corpus keep their first occurrence.

A passage of few lines seldom holds a whole chunk, and a longer one's ends lie outside its chunks. So the lines that
repeated chunks leave are compared once more, by every window of ``MIN_LINES`` lines: what is removed in
the end are the lines of all windows that occur earlier. A window inside a removed chunk is left out, as it occurs in the
chunk's first occurrence, which stays.

Texts travel whole once a join (their marks grow with the corpus, so they are joined by merging at every size); of chunks and windows only those whose hash repeats travel with their bytes, which
are compared, so a hash collision removes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import keyed_documents, meet, written

#: Lines in the rolling hash; one position in ``SPREAD`` ends a chunk; shorter chunks are never removed.
WINDOW, SPREAD, MIN_LINES = 2, 4, 2
#: Hashes with more than one in ``HOT`` of all repeated pieces are fewer than ``HOT``; each is dealt to ``SALTS`` tasks.
HOT, SALTS = 1024, 32
#: Lines without any character but white space, and two of them in a row.
BLANK = r"^[\x20\x09-\x0D]*$"
BLANK_PAIR = r"(^|\n)[\x20\x09\x0B-\x0D]*\n[\x20\x09\x0B-\x0D]*(\n|$)"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often lambdas inside refer to it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def _chunks(text: Column, window: int, spread: int) -> Column:
    """Array of a text's chunks. A chunk ends after line i where the hash of lines i - window + 1 .. i says so, and at the end."""

    def marks(lines, hashes):
        def ends(i):
            near = F.slice(hashes, F.greatest(i - window + 2, F.lit(1)), F.least(i + 1, F.lit(window)))
            return (F.pmod(F.xxhash64(F.array_join(F.transform(near, lambda h: h.cast("string")), " ")), F.lit(spread)) == 0) | (i == F.size(lines) - 1)

        return F.filter(F.transform(lines, lambda _, i: F.when(ends(i), i + 1)), lambda m: m.isNotNull())

    def cut(lines, stops):
        def chunk(stop, k):
            first = F.when(k == 0, F.lit(0)).otherwise(F.element_at(stops, F.greatest(k, F.lit(1))))
            return _let(
                first,
                lambda at: F.struct(
                    k.alias("chunk"), at.alias("first"), (stop - at).alias("n_lines"), F.array_join(F.slice(lines, at + 1, stop - at), "\n").alias("content")
                ),
            )

        return F.transform(stops, chunk)

    return _let(
        F.split(text, "\n", -1),
        lambda lines: _let(F.transform(lines, lambda x: F.xxhash64(x)), lambda hashes: _let(marks(lines, hashes), lambda stops: cut(lines, stops))),
    )


def chunk_table(texts: DataFrame, window: int = WINDOW, spread: int = SPREAD) -> DataFrame:
    """(_key, chunk, first, n_lines, content) of every chunk of ``texts`` (_key, text); a text's lines end at line feeds."""
    return texts.select("_key", F.inline(_chunks(F.col("text"), window, spread)))


def window_table(texts: DataFrame, size: int = MIN_LINES) -> DataFrame:
    """(_key, first, n_lines, content) of the windows of ``size`` lines of ``texts`` (_key, text, gone) that lie in no span of ``gone``."""

    def starts(lines, spans):
        def between(k):
            before, after = F.element_at(spans, F.greatest(k, F.lit(1))), F.element_at(spans, F.least(k + 1, F.size(spans)))
            low = F.when(k == 0, F.lit(0)).otherwise(before["first"] + before["n_lines"] - (size - 1))
            high = F.least(F.size(lines) - size, F.when(k == F.size(spans), F.size(lines)).otherwise(after["first"] - 1))
            return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

        alone = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.greatest(F.size(lines) - size, F.lit(0))))
        return F.when(F.size(spans) == 0, alone).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), between)))

    def cut(lines):
        piece = lambda i: F.struct(i.alias("first"), F.lit(size).alias("n_lines"), F.array_join(F.slice(lines, i + 1, size), "\n").alias("content"))
        return F.transform(_let(F.array_sort(F.coalesce("gone", F.array().cast("array<struct<first:int,n_lines:int>>"))), lambda spans: starts(lines, spans)), piece)

    return texts.select("_key", F.inline(_let(F.split("text", "\n", -1), cut)))


def later_ones(texts: DataFrame, pieces: DataFrame, label: str) -> DataFrame:
    """(_key, first, n_lines) of every piece of ``texts`` that equals an earlier one: smaller _key, or earlier in the same text.

    Only hashes and places of all pieces travel. Those whose hash repeats are cut from their texts once more, and bytes are
    compared by the least and the greatest content of a hash, which are combined before they travel; pieces whose hash
    stands for several contents, if there are any, are grouped by content.
    """
    places = written(pieces.select(F.xxhash64("content").alias("hash"), "_key", "first", "n_lines"), f"{label}-places")
    counts = written(places.groupBy("hash").agg(F.count("*").alias("copies")).filter("copies > 1"), f"{label}-hashes")
    repeats = written(meet(places, counts, "hash", HOT, SALTS, "_key", "first"), f"{label}-repeats")
    marked = repeats.groupBy("_key").agg(F.collect_list(F.struct("first", "n_lines", "hash")).alias("at"))

    def cut(lines):
        return F.transform("at", lambda p: F.struct(p["hash"], p["first"], p["n_lines"], F.array_join(F.slice(lines, p["first"] + 1, p["n_lines"]), "\n").alias("content")))

    again = texts.join(marked.hint("merge"), "_key").select("_key", F.inline(_let(F.split("text", "\n", -1), cut)))
    place = F.struct("_key", "first")
    groups = again.groupBy("hash").agg(
        F.min(place).alias("kept"), F.min("content").alias("least"), F.max("content").alias("greatest"), F.count("*").alias("copies")
    )
    groups = written(groups.select("hash", "kept", "copies", (F.col("least") == F.col("greatest")).alias("equal")), f"{label}-groups")
    later = (F.col("kept._key") != F.col("_key")) | (F.col("kept.first") != F.col("first"))
    rows = meet(repeats, groups.filter("equal").drop("equal"), "hash", HOT, SALTS, "_key", "first").filter(later)
    mixed = groups.filter("not equal").select("hash")
    if not mixed.take(1):
        return rows.select("_key", "first", "n_lines")
    apart = written(again.join(mixed, "hash", "left_semi"), f"{label}-mixed")
    starts = apart.groupBy("hash", "content").agg(F.min(place).alias("kept"))
    rest = apart.join(starts, ["hash", "content"]).filter(later)
    return rows.select("_key", "first", "n_lines").unionByName(rest.select("_key", "first", "n_lines"))


def _merged(spans: DataFrame) -> DataFrame:
    """(_key, gone): each text's spans in order; spans that overlap or meet are one."""
    before = W.partitionBy("_key").orderBy("first", "n_lines").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("_key").orderBy("first", "n_lines").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.col("first") + F.col("n_lines")
    parted = spans.withColumn("new", (F.col("first") > F.coalesce(F.max(end).over(before), F.lit(-1))).cast("int"))
    runs = parted.withColumn("run", F.sum("new").over(upto)).groupBy("_key", "run").agg(F.min("first").alias("first"), F.max(end).alias("end"))
    span = F.struct("first", (F.col("end") - F.col("first")).cast("int").alias("n_lines"))
    return runs.groupBy("_key").agg(F.array_sort(F.collect_list(span)).alias("gone"))


def repeated_lines(texts: DataFrame, window: int = WINDOW, spread: int = SPREAD, min_lines: int = MIN_LINES) -> DataFrame:
    """(_key, gone) of every text of ``texts`` (_key, text) that repeats lines: the runs of lines that lie in windows which occur earlier."""
    chunks = chunk_table(texts, window, spread).filter((F.col("n_lines") >= min_lines) & ~F.col("content").rlike(BLANK_PAIR))
    by_chunk = written(later_ones(texts, chunks.drop("chunk"), "chunk"), "chunk-later")
    left = texts.join(_merged(by_chunk).hint("merge"), "_key", "left")
    windows = window_table(left, min_lines).filter(~F.col("content").rlike(BLANK))
    return _merged(by_chunk.unionByName(later_ones(texts, windows, "window")))


def dedup_lines(docs: DataFrame, window: int = WINDOW, spread: int = SPREAD, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chunks_removed (runs of removed lines), text (what is left) per row of ``docs``.

    Removed are the lines of all ``min_lines`` lines in a row that equal earlier ones, byte by byte: at a smaller doc_id (nulls
    last, equal ids by text digest) or earlier in the same text; lines of white space only stay where as many stand
    together. A null text is empty and an empty text has one empty line; very long texts are compared whole; exact repeats of
    id and text are one document and get its result each; an empty table gives no rows; other columns are ignored.
    """
    texts, single = keyed_documents(docs)
    gone = written(repeated_lines(single.select("_key", "text"), window, spread, min_lines).withColumnRenamed("_key", "_gone_key"), "chunk-removals")
    rows = texts.join(gone.hint("merge"), texts["_key"] == gone["_gone_key"], "left")

    def kept(lines, spans):
        """Lines between the removed spans, which are in order and do not meet."""

        def between(k):
            before, after = F.element_at(spans, F.greatest(k, F.lit(1))), F.element_at(spans, F.least(k + 1, F.size(spans)))
            start = F.when(k == 0, F.lit(0)).otherwise(before["first"] + before["n_lines"])
            stop = F.when(k == F.size(spans), F.size(lines)).otherwise(after["first"])
            return F.slice(lines, start + 1, stop - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), between))

    rest = _let(F.split("text", "\n", -1), lambda lines: _let(F.col("gone"), lambda spans: F.array_join(kept(lines, spans), "\n")))
    removed = F.aggregate("gone", F.lit(0), lambda s, x: s + x["n_lines"])
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_chunks_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("text"),
    )
