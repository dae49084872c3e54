"""Nested vector columns: folding the rows of a group into ordered arrays, functions on arrays, and flattening them again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriate.functions.vector import Order


def group_fold(df: DataFrame, order: Order, values: dict[str, Column], reduced: dict[str, Column] | None = None) -> DataFrame:
    """One row per key with the ``values`` as arrays in the assumed order, nulls included, and aggregates ``reduced`` beside them.

    A group becomes one value and so must fit into a task; where rows will do, keep the rows instead (see ``OrderedFrame.rows``).
    """
    items = F.struct(*[F.col(c).alias(f"__o{i}") for i, (c, _) in enumerate(order.by)], F.struct(*[c.alias(n) for n, c in values.items()]).alias("__v"))
    folded = df.groupBy(*order.keys).agg(F.collect_list(items).alias("__items"), *[c.alias(n) for n, c in (reduced or {}).items()])

    def before(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, (_, up) in reversed(list(enumerate(order.by))):
            x, y = a[f"__o{i}"], b[f"__o{i}"]
            # As in an ORDER BY: nulls first when ascending, last when descending.
            less = F.coalesce(x < y, x.isNull() & y.isNotNull())
            more = F.coalesce(x > y, y.isNull() & x.isNotNull())
            out = F.when(less, -1 if up else 1).when(more, 1 if up else -1).otherwise(out)
        return out

    if order.by:
        ordered = F.transform(F.array_sort(F.col("__items"), before), lambda e: e["__v"])
    else:
        ordered = F.transform("__items", lambda e: e["__v"])
    folded = folded.withColumn("__items", ordered)
    return folded.select(*order.keys, *[F.col(f"__items.{n}").alias(n) for n in values], *(reduced or {}))


def flatten(df: DataFrame, arrays: list[str], how: str = "zip") -> DataFrame:
    """One row per element of the ``arrays``: side by side (``zip``, shorter ones padded with null) or every combination (``cross``).

    Rows whose arrays are all empty or null give no row with ``zip``; with ``cross`` one empty or null array is enough.
    """
    if how == "zip":
        rest = [c for c in df.columns if c not in arrays]
        # A null array would make the whole zip null.
        filled = [F.coalesce(F.col(a), F.array().cast(df.schema[a].dataType)).alias(a) for a in arrays]
        zipped = df.select(*rest, *filled).select(*rest, F.explode(F.arrays_zip(*arrays)).alias("__z"))
        return zipped.select(*[F.col("__z")[c].alias(c) if c in arrays else F.col(c) for c in df.columns])
    if how != "cross":
        raise ValueError("how is 'zip' or 'cross'")
    for a in arrays:
        df = df.select(*[F.explode(a).alias(a) if c == a else F.col(c) for c in df.columns])
    return df


def pack(*cols: Column | str) -> Column:
    """Columns of one type as a vector per row."""
    return F.array(*cols)


def subvec(a: Column | str, start: int, end: int | None = None) -> Column:
    """Elements ``start`` up to, not including, ``end`` of an array, counted from 0; as many as there are."""
    a = F.col(a) if isinstance(a, str) else a
    return F.slice(a, start + 1, F.size(a) if end is None else F.lit(max(end - start, 0)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _prefix_sums(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else np.nancumsum(np.array(x, dtype=float)))


def array_sums(a: Column | str) -> Column:
    """Prefix sums of an array; null elements add nothing."""
    return _prefix_sums((F.col(a) if isinstance(a, str) else a).cast("array<double>"))


def array_deltas(a: Column | str) -> Column:
    """Difference of each element to the one before, 0 for the first."""
    a = F.col(a) if isinstance(a, str) else a
    return F.transform(a, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise((x - F.get(a, i - 1)).cast("double")))


def array_windows(a: Column | str, w: int, how: str) -> Column:
    """``sum``, ``avg``, ``min`` or ``max`` of the last ``w`` elements at each place of an array."""
    a = F.col(a) if isinstance(a, str) else a

    def at(_, i):
        part = F.slice(a, F.greatest(i - w + 2, F.lit(1)), F.least(i + 1, F.lit(w)))
        if how in ("min", "max"):
            return (F.array_min if how == "min" else F.array_max)(part).cast("double")
        known = F.filter(part, lambda x: x.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x)
        return total if how == "sum" else F.when(F.size(known) > 0, total / F.size(known))

    return F.transform(a, at)
