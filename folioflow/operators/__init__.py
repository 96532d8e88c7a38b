"""DataFrame operators. Each takes tables and returns a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Append an expensive column that is evaluated exactly once per row.

    A plain projection would be copied into every filter and projection above it
    by the optimizer; a generator of one element is never copied.
    """
    return df.select("*", F.explode(F.array(F.expr(expression))).alias(name))
