"""Report sinks: JSON lines with a summary row, and the spreadsheet CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import iso_timestamp
from folioflow.operators import report
from folioflow.session import tidied


def write_report(queue: DataFrame, path: str, active_filter: str = "", compression: str = "gzip") -> None:
    """``documents/`` holds one JSON line per document, ``summary/`` the single summary row.

    A line names every member of its record, so plain JSON takes many times the room of the queue; readers of JSON lines
    unpack ``.json.gz`` themselves.
    """
    counted = report.report_documents(queue)
    rows = counted.withColumnRenamed("copies", "duplicate_count").withColumn("modified_at", F.expr(iso_timestamp("modified_at")))
    with tidied(queue.sparkSession):
        rows.write.mode("overwrite").json(f"{path}/documents", compression=compression)
    stamped = report.summary(counted, active_filter, counted=True).withColumn("generated_at", F.expr(iso_timestamp("current_timestamp()")))
    stamped.write.mode("overwrite").json(f"{path}/summary", compression=compression)


def write_csv(queue: DataFrame, path: str) -> None:
    """17 safe columns; the writer quotes cells that need it and keeps blanks as they are."""
    report.csv_table(queue).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a written sheet back, cell by cell as text; empty cells are empty text."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    sheet = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return sheet.na.fill("")
