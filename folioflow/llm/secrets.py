"""Secret scan with corpus-wide ownership frequency, with DataFrame and SQL functions only.

Fixed patterns find base spans in whole texts. A wider net takes further token-like strings, which a text
alone cannot tell from identifiers. Every candidate's digest is counted over the corpus: by
distinct repository and owner, combined in steps before each shuffle. Every value then has one of three classes: ``copied``
(many owners or many repositories hold it: a widely copied example), ``specific`` (one owner, few repositories: it looks live) or
``shared`` (few repositories of several owners). A wide-net value that is specific is added as an ``owned`` span.

Texts are read once and never shuffled. Positions come from the lengths of matches and of the pieces between
them, by a running sum over the matches of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import meet, written

# The base patterns, in the order in which kinds are listed; the group whose length counts, the least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: ``hex`` asks for its least length in the pattern: a run of hexadecimal digits matches whole or not at all.
OWNED = "owned"
#: The wider net: long runs of token characters with a digit and letters of either case.
WIDE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = (*BASE, OWNED)
CLASSES = ("specific", "shared", "copied")
#: Owners, or repositories, from which on a value counts as a widely copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 6
#: Values with more than one in ``HOT`` of all candidates are fewer than ``HOT``; the rows of each are dealt to ``SALTS`` tasks.
HOT, SALTS = 1024, 32


def _found(text: str, pattern: str, group: int) -> Column:
    """Per match in order: length of the piece before it, its own length, the value of ``group``."""
    regex = F.lit(pattern)
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    values = F.regexp_extract_all(text, regex, F.lit(group)) if group else matches
    zipped = F.transform(
        matches,
        lambda m, i: F.struct(pieces[i].alias("before"), F.length(m).alias("length"), values[i].alias("value"), i.alias("i")),
    )
    return F.when(F.col(text).rlike(pattern), zipped)


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Stored rows: _row, doc_id, owner, repository and, per kind, the raw matches."""
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    found = {k: _found("text", p, g) for k, (p, g, _) in BASE.items()} | {OWNED: _found("text", WIDE, 0)}
    rows = text.select("doc_id", "owner", "repository", *[c.alias(k) for k, c in found.items()])
    return written(rows.withColumn("_row", F.monotonically_increasing_id()), "secret-scan")


def candidates(scanned: DataFrame) -> DataFrame:
    """(_row, owner, repository, kind, start, end, digest) of every match that passes its kind's tests; end is exclusive."""
    parts = [scanned.select("_row", "owner", "repository", F.lit(k).alias("kind"), F.inline(k)) for k in KINDS]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = W.partitionBy("_row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("before") + F.col("length")).over(order)
    rows = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("length"))
    least = F.create_map(*[F.lit(x) for k, (_, _, n) in BASE.items() for x in (k, n)])
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    passes = F.when(F.col("kind") == OWNED, mixed).otherwise(F.length("value") >= least[F.col("kind")])
    return rows.filter(passes).select("_row", "owner", "repository", "kind", "start", "end", F.sha2("value", 256).alias("digest"))


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories, copies, class): distinct holders and rows of each value; a null owner or repository is one holder."""
    held = found.groupBy("digest", "owner", "repository").agg(F.count("*").alias("copies"))
    by_owner = held.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("copies").alias("copies"))
    counted = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("copies").alias("copies"))
    many = (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES)
    return counted.withColumn("class", F.when(many, "copied").when(F.col("owners") == 1, "specific").otherwise("shared"))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_specific, n_shared, n_copied, most_repositories per row of ``docs``.

    ``owned`` spans are wide-net matches that overlap no base span and whose value is specific to its owner.
    n_specific, n_shared and n_copied count all spans by the class of their value, most_repositories is the largest number of
    repositories that hold one of them (0 without spans). Wide-net matches that are shared or copied are no spans and count nowhere.
    A null text is empty; texts without spans have empty lists; repeated rows each get their result; an empty table
    gives no rows; other columns are ignored.
    """
    scanned = scan(docs, owner, repository)
    found = written(candidates(scanned), "secret-candidates")
    holders = written(ownership(found), "secret-holders")
    counted = meet(found, holders, "digest", HOT, SALTS, "_row", "start").select("_row", "kind", "start", "end", "class", "repositories")
    by_row = W.partitionBy("_row").orderBy("start")
    base = F.col("kind") != OWNED
    reached = F.max(F.when(base, F.col("end"))).over(by_row.rangeBetween(W.unboundedPreceding, W.currentRow))
    coming = F.min(F.when(base, F.col("start"))).over(by_row.rangeBetween(W.currentRow, W.unboundedFollowing))
    counted = counted.withColumns({"reached": F.coalesce(reached, F.lit(-1)), "coming": F.coalesce(coming, F.col("end"))})
    kept = counted.filter(base | ((F.col("class") == "specific") & (F.col("reached") <= F.col("start")) & (F.col("coming") >= F.col("end"))))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", "kind")
    base_spans = F.collect_list(F.when(base, span))
    lists = kept.groupBy("_row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        *[F.count(F.when(F.col("class") == c, 1)).alias(f"n_{c}") for c in CLASSES],
        F.max("repositories").alias("most_repositories"),
        _joined(base_spans).alias("base"),
        _joined(F.collect_list(span)).alias("spans"),
    )
    numbers = [f"n_{k}" for k in BASE]
    out = scanned.select("_row", "doc_id").join(lists, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id",
        *map(zero, numbers),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *map(zero, [f"n_{OWNED}", *(f"n_{c}" for c in CLASSES), "most_repositories"]),
    )
