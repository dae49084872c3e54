"""Of several reports of one thing, the one that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_report(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Per ``keys`` the ``value`` of the row with the greatest ``at``, even if that value is null.

    A null ``at`` is older than any other; among rows with the same ``at`` a value goes before null and the greater before the lesser.
    Partial results combine on the map side. Rows with a null key form groups like others.
    """
    best = F.max(F.struct(F.col(at), F.col(value).isNotNull(), F.col(value).alias("v")))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, F.col("__best.v").alias(value))
