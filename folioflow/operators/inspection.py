"""From requested paths to document records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import routing
from folioflow.session import stored
from folioflow.sources import files, intake


def inspect_files(
    requests: DataFrame, texts: DataFrame | None = None, max_pdf_bytes: int | None = None, max_image_bytes: int | None = None
) -> DataFrame:
    """The record of every requested file (path, seq), one row per accepted path.

    Each file is measured and fingerprinted where it lies; ``texts`` (path and any other columns of ``routing.DELIVERED``, one row per
    path) adds what text extraction and OCR found. A path without a file, and a file that cannot be read, is an Error record whose note
    names the cause. ``seq`` is the first position at which the path was asked for.
    """
    asked = stored(intake.accept_paths(requests).select("path", "seq"), "asked")
    found = files.examine_evenly(asked).withColumnRenamed("error", "read_error")
    measured = set(found.columns)
    kinds = [c.split() for c in routing.DELIVERED.split(", ")]
    given = [] if texts is None else [c for c, _ in kinds if c in texts.columns and c not in measured]
    joined = found.join(asked, "path")
    if given:
        joined = joined.join(texts.select("path", *given), "path", "left")
    absent = {c: F.lit(None).cast(kind) for c, kind in kinds if c not in measured and c not in given}
    joined = joined.withColumns(absent | {"total_pages": F.coalesce("total_pages", F.lit(0))} if "total_pages" in given else absent | {"total_pages": F.lit(0)})
    return routing.inspect(joined, keep=("seq",), max_pdf_bytes=max_pdf_bytes, max_image_bytes=max_image_bytes)
