"""Results when a few keys hold most rows: two-stage salted aggregation, and joins that leave hot keys where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriate.session import materialize

_MERGE = {"count": F.sum, "count_all": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys holding at least ``share`` of all rows, with their row count ``n`` and the rows of the table ``n_all``.

    At most ``1 / share`` keys can qualify, so the result is safe to broadcast whatever the table's size. Counting combines on the
    map side: what is shuffled is one row per key and task. Null keys count as keys; an empty table has none.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = per_key.agg(F.sum("__n").alias("__all")).scalar()
    return per_key.select(*keys, F.col("__n").alias("n"), total.alias("n_all")).where(F.col("n") >= F.col("n_all") * F.lit(share))


def salted_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str | None]], heavy: DataFrame, row_id: str, salts: int = 32) -> DataFrame:
    """Aggregate ``df`` by ``keys`` in two stages, so that no task holds the rows of a whole heavy key.

    ``aggs`` maps an output name to ``(kind, column)``; kinds are count_all, count, sum, min, max and ``mean`` (a sum and a count until the
    end). Rows whose key is in ``heavy`` (a bounded table, see :func:`heavy_keys`) get one of ``salts`` salts, partial results are
    computed per (key, salt) and merged per key. The salt is a hash of ``row_id``, not a random number: a task that is run
    again after an executor is lost sends each row to the same salt. Null keys form groups of their own; null values are skipped.
    """
    marks = heavy.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__heavy"))
    match = None
    for k in keys:
        cond = F.col(k).eqNullSafe(F.col(f"__h_{k}"))
        match = cond if match is None else match & cond
    salt = F.when(F.col("__heavy"), F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    needed = list(dict.fromkeys([*keys, row_id, *[c for _, c in aggs.values() if c]]))
    salted = df.select(*needed).join(F.broadcast(marks), match, "left").withColumn("__salt", salt)
    partial, final = [], []
    for out, (kind, col) in aggs.items():
        if kind == "mean":
            partial += [F.sum(col).alias(f"__s_{out}"), F.count(col).alias(f"__c_{out}")]
            final.append((F.sum(f"__s_{out}") / F.sum(f"__c_{out}")).alias(out))
            continue
        first = {"count_all": lambda c: F.count(F.lit(1)), "count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[kind](col)
        partial.append(first.alias(f"__p_{out}"))
        final.append(_MERGE[kind](f"__p_{out}").alias(out))
    return salted.groupBy(*keys, "__salt").agg(*partial).groupBy(*keys).agg(*final)


def _same(keys: list[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def look_up(left: DataFrame, right: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """Left join of ``left`` with ``right``, which has one row per ``keys`` at most, without a task that gets all rows of a hot key.

    Keys that hold at least ``share`` of the rows of ``left``, ``1 / share`` of them at most, are looked up in a broadcast; only the rows of other keys are
    shuffled. Null keys match null keys. Columns: those of ``left``, then those of ``right`` that are no keys (names must not clash).
    """
    new = [c for c in right.columns if c not in keys]
    hot = materialize(heavy_keys(left, keys, share).select(*keys), "hot_keys")
    theirs = right.alias("r").join(F.broadcast(hot.alias("h")), _same(keys, "r", "h"), "left_semi")
    marked = left.alias("l").join(F.broadcast(hot.withColumn("__hot", F.lit(True)).alias("h")), _same(keys, "l", "h"), "left").select("l.*", "__hot")
    parts = []
    for rows, side in ((marked.where("__hot"), F.broadcast(theirs.alias("r"))), (marked.where("__hot IS NULL"), right.alias("r"))):
        parts.append(rows.alias("l").join(side, _same(keys, "l", "r"), "left").select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in new]))
    return parts[0].unionByName(parts[1])
