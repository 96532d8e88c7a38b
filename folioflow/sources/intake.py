"""Intake: requested paths, dropped URI lists and missing files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import extension, lit, trim
from folioflow.operators.classify import in_list
from folioflow.rules import SUPPORTED_EXTENSIONS

_FILE_URI = lit(r"(?i)^file:(?://[^/?#]*)?/?([^?#]*)")


def first_seen(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Distinct keys with their first position; pre-aggregated, so hot keys are cheap."""
    return df.groupBy(key).agg(F.min(seq).alias(seq))


def accept_paths(requests: DataFrame, path: str = "path", seq: str = "seq", cap: int | None = None) -> DataFrame:
    """Absolute paths of supported types, distinct in first-seen order.

    ``cap`` stops after that many distinct paths; by default nothing is dropped.
    """
    cleaned = requests.select(F.expr(trim(path)).alias("path"), F.col(seq).alias("seq"))
    allowed = cleaned.filter(F.expr(f"startswith(path, '/') and {in_list(extension('path'), SUPPORTED_EXTENSIONS)}"))
    distinct = first_seen(allowed, "path", "seq").withColumn("extension", F.expr(extension("path")))
    return distinct.orderBy("seq").limit(cap) if cap else distinct


def dropped_paths(payloads: DataFrame, uri_list: str = "uri_list", seq: str = "seq") -> DataFrame:
    """Local paths of ``text/uri-list`` payloads: file URIs only, comments skipped, decoded and normalised.

    Backslashes count as slashes, ``.`` and ``..`` are resolved; an entry with invalid escapes names no path.
    """
    lines = payloads.select(F.col(seq).alias("payload"), F.posexplode(F.split(uri_list, "\n")).alias("line", "entry"))
    lines = lines.withColumn("entry", F.expr(trim("entry"))).filter("entry rlike '(?i)^file:'")
    # '+' is an ordinary character in a path; the decoder would read it as a blank.
    decoded = f"try_url_decode(replace(concat('/', regexp_extract(entry, {_FILE_URI}, 1)), '+', '%2B'))"
    paths = lines.withColumn("path", F.expr(decoded)).filter(F.col("path").isNotNull() & ~F.col("path").contains("\ufffd"))
    steps = F.split(F.translate("path", "\\", "/"), "/")
    resolved = F.aggregate(
        F.filter(steps, lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s))),
    )
    paths = paths.withColumn("path", F.concat(F.lit("/"), F.array_join(resolved, "/")))
    paths = paths.withColumn("path", F.expr("case when path rlike '^/[A-Za-z]:' then substring(path, 2) else path end"))
    order = F.struct("payload", "line")
    return paths.groupBy("path").agg(F.min(order).alias("at")).selectExpr("path", "at.payload as payload", "int(at.line) as line")


def with_missing(requested: DataFrame, scanned: DataFrame) -> DataFrame:
    """Requested paths with what the scan found; unseen paths become Error rows."""
    found = scanned.withColumn("is_file", F.lit(True))
    joined = requested.select("path").distinct().join(found, "path", "left")
    return joined.selectExpr(
        "path", "coalesce(is_file, false) as is_file", "coalesce(size_bytes, 0L) as size_bytes", "coalesce(sha256, '') as sha256",
        "case when is_file then 'Metadata only' else 'Error' end as status",
        "case when is_file then '' else 'Inspection failed: path is not a regular file.' end as note",
    )
