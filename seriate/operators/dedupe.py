"""Rows delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once_per_id(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """One row per ``id_col`` with ``cols``; for copies that agree on ``cols`` (they may differ elsewhere, as in a load time).

    The aggregate is a hash aggregate with map-side combine on evenly spread ids, so no value of another column can skew it.
    Where copies disagree, each column gets its greatest non-null value. Rows with a null id identify nothing and are dropped.
    An empty table gives an empty table.
    """
    kept = [c for c in cols if c != id_col]
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.max(c).alias(c) for c in kept]) if kept else df.where(F.col(id_col).isNotNull()).select(id_col).distinct()
