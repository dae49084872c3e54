"""Totals and averages over trailing periods, by segment trees per entity and shard of the calendar.

A tree holds ``SHARD`` periods of one entity as two arrays in heap order: ``sums`` and ``counts`` (node 1 is the whole shard, the children of node i are
2i and 2i+1, the leaves follow from node SHARD on). Building it needs each entity's per-period totals only, so a hot entity costs no more than
its calendar is long. A range query adds at most two nodes per level; a late correction adds to one leaf and its ancestors. A range over several
shards is the end of one tree, the start of another, and a range of a top tree whose leaves are the roots of the trees between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

SHARD = 64
_TREE_SQL = "entity_id long, shard long, first_period long, last_period long, sums array<long>, counts array<long>"
_TREE = pa.schema([("entity_id", pa.int64()), ("shard", pa.int64()), ("first_period", pa.int64()), ("last_period", pa.int64()), ("sums", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def period_totals(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Per entity and period: sum and count of the non-null ``value`` (a whole number), and a row for periods with null values only.

    Columns ``entity_id, period, total, n``. Rows with a null entity or period take no part.
    """
    kept = df.where(F.col(entity).isNotNull() & F.col(period).isNotNull())
    return kept.groupBy(F.col(entity).cast("long").alias("entity_id"), F.col(period).cast("long").alias("period")).agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"), F.count(value).alias("n")
    )


def build_trees(totals: DataFrame) -> DataFrame:
    """Segment trees of :func:`period_totals`: one row per entity and shard, without gaps from the entity's first to its last shard."""
    shard = F.floor(F.col("period") / SHARD)
    leaf = F.struct((F.col("period") - shard * SHARD).alias("slot"), "total", "n")
    # A shard has at most SHARD totals, so the lists are bounded; an entity has as many rows as its calendar has shards.
    packed = totals.groupBy("entity_id", shard.alias("from_shard")).agg(F.collect_list(leaf).alias("leaves"), F.min("period").alias("low"), F.max("period").alias("high"))
    mine = W.Window.partitionBy("entity_id")
    upto = F.coalesce(F.lead("from_shard").over(mine.orderBy("from_shard")) - 1, F.col("from_shard"))
    filled = packed.select("entity_id", "from_shard", "leaves", F.min("low").over(mine).alias("first_period"), F.max("high").over(mine).alias("last_period"), upto.alias("to_shard"))
    # Shards between two with totals are empty.
    joined = filled.select("entity_id", F.explode(F.sequence("from_shard", "to_shard")).alias("shard"), "from_shard", "first_period", "last_period", "leaves")
    leaves = F.when(F.col("shard") == F.col("from_shard"), F.col("leaves"))
    joined = joined.select("entity_id", "shard", "first_period", "last_period", leaves["slot"].alias("slots"), leaves["total"].alias("totals"), leaves["n"].alias("ns"))
    return joined.mapInArrow(_build, _TREE_SQL)


def _lists(a: np.ndarray) -> pa.Array:
    n, width = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(a.ravel()))


def _climb(sums: np.ndarray, counts: np.ndarray) -> None:
    """Fill the inner nodes from the leaves, a level at a time."""
    size = SHARD
    while size > 1:
        half = size // 2
        for a in (sums, counts):
            a[:, half:size] = a[:, size : 2 * size : 2] + a[:, size + 1 : 2 * size : 2]
        size = half


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        sums, counts = np.zeros((n, 2 * SHARD), np.int64), np.zeros((n, 2 * SHARD), np.int64)
        slots = b.column("slots")
        row = pc.list_parent_indices(slots).to_numpy()
        leaf = slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + SHARD
        np.add.at(sums, (row, leaf), b.column("totals").flatten().to_numpy(zero_copy_only=False))
        np.add.at(counts, (row, leaf), b.column("ns").flatten().to_numpy(zero_copy_only=False))
        _climb(sums, counts)
        yield pa.RecordBatch.from_arrays([b.column("entity_id"), b.column("shard"), b.column("first_period"), b.column("last_period"), _lists(sums), _lists(counts)], schema=_TREE)


def correct_trees(trees: DataFrame, corrections: DataFrame) -> DataFrame:
    """Trees after late corrections (``entity_id, period, total, n``: what to add to a period's total and count, negative to take away).

    Only the leaf of a correction and its ancestors change; shards without a correction keep their sums. A correction before an entity's first
    period or after its last widens its calendar, with the shards that are missing; one of a new entity makes its trees. Corrections without an entity or
    period take no part; other nulls count as 0.
    """
    corrections = corrections.where("entity_id IS NOT NULL AND period IS NOT NULL")
    span = corrections.groupBy("entity_id").agg(F.min("period").alias("__low"), F.max("period").alias("__high"))
    wide = trees.join(span, "entity_id", "left").withColumn("first_period", F.least("first_period", "__low")).withColumn("last_period", F.greatest("last_period", "__high"))
    built = trees.groupBy("entity_id").agg(F.min("shard").alias("a"), F.max("shard").alias("b"), F.min("first_period").alias("__first"), F.max("last_period").alias("__last"))
    ends = span.join(built, "entity_id", "left").select("entity_id", "a", "b", F.least("__first", "__low").alias("first_period"), F.greatest("__last", "__high").alias("last_period"))
    shards = F.sequence(F.floor(F.col("first_period") / SHARD), F.floor(F.col("last_period") / SHARD))
    shards = F.when(F.col("a").isNull(), shards).otherwise(F.array_except(shards, F.sequence("a", "b")))
    empty = F.array_repeat(F.lit(0).cast("long"), 2 * SHARD)
    missing = ends.select("entity_id", F.explode(shards).alias("shard"), "first_period", "last_period", empty.alias("sums"), empty.alias("counts"))
    trees = wide.drop("__low", "__high").unionByName(missing)
    shard = F.floor(F.col("period") / SHARD)
    slot = F.col("period") - shard * SHARD
    fixes = corrections.groupBy(F.col("entity_id"), shard.alias("shard"), slot.alias("slot")).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    per_tree = fixes.groupBy("entity_id", "shard").agg(F.collect_list(F.struct("slot", "total", "n")).alias("__fixes"))

    def added(col: str, part: str):
        # Node i is an ancestor of leaf l iff l >> (levels between them) is i.
        level = lambda i: (SHARD.bit_length() - 1) - F.floor(F.log2(F.greatest(i, F.lit(1)))).cast("int")
        add = lambda v, i: v + F.aggregate(F.col("__fixes"), F.lit(0).cast("long"), lambda s, f: s + F.when((i > 0) & (F.call_function("shiftright", (f["slot"] + SHARD).cast("long"), level(i)) == i), f[part]).otherwise(0))
        return F.when(F.col("__fixes").isNull(), F.col(col)).otherwise(F.transform(F.col(col), add)).alias(col)

    joined = trees.join(per_tree, ["entity_id", "shard"], "left")
    return joined.select("entity_id", "shard", "first_period", "last_period", added("sums", "total"), added("counts", "n"))


def _ranges(trees: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums over the leaves [low, high) of the trees in ``rows``, climbing from the leaves."""
    total = np.zeros(len(rows), np.int64)
    left, right = low + trees.shape[1] // 2, high + trees.shape[1] // 2
    while (on := left < right).any():
        take = on & (left & 1 == 1)
        total[take] += trees[rows[take], left[take]]
        left = left + take
        take = on & (right & 1 == 1)
        right = right - take
        total[take] += trees[rows[take], right[take]]
        left, right = left >> 1, right >> 1
    return total


def _top(roots: np.ndarray) -> np.ndarray:
    """A tree whose leaves are the roots of trees that follow each other."""
    size = 1 << max(0, len(roots) - 1).bit_length()
    tree = np.zeros((1, 2 * size), np.int64)
    tree[0, size : size + len(roots)] = roots
    while size > 1:
        tree[0, size // 2 : size] = tree[0, size : 2 * size : 2] + tree[0, size + 1 : 2 * size : 2]
        size //= 2
    return tree


def _query(windows: list[int]):
    out = pa.schema([("entity_id", pa.int64()), ("period", pa.int64()), *[(f"{k}_{w}", pa.int64()) for w in windows for k in ("total", "n")]])
    # Earlier shards that a window can reach into.
    reach = (max(windows) - 2) // SHARD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # entity, shard and both trees of the last shards so far
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = [b.column("entity_id").to_numpy(), b.column("shard").to_numpy(), *[b.column(c).flatten().to_numpy().reshape(n, 2 * SHARD) for c in ("sums", "counts")]]
            entity, shard, *trees = [np.concatenate(p) for p in zip(held, new)] if held else new
            earlier = len(entity) - n
            held = [a[max(0, len(a) - reach) :].copy() for a in (entity, shard, *trees)] if reach > 0 else []
            starts = np.flatnonzero(np.r_[True, (entity[1:] != entity[:-1]) | (shard[1:] != shard[:-1] + 1)])
            run_start = np.repeat(starts, np.diff(np.r_[starts, len(entity)]))
            tops = [_top(t[:, 1]) for t in trees]
            first, final = b.column("first_period").to_numpy(), b.column("last_period").to_numpy()
            cols: dict[str, list[np.ndarray]] = {name: [] for name in out.names}
            for slot in range(SHARD):
                period = new[1] * SHARD + slot
                on = (period >= first) & (period <= final)
                if not on.any():
                    continue
                rows = np.flatnonzero(on) + earlier
                cols["entity_id"].append(new[0][on])
                cols["period"].append(period[on])
                fill = lambda v, rows=rows: np.full(len(rows), v)
                for w in windows:
                    back, from_slot = divmod(slot - w + 1, SHARD)
                    for name, t, top in (("total", trees[0], tops[0]), ("n", trees[1], tops[1])):
                        got = _ranges(t, rows, fill(max(0, slot - w + 1)), fill(slot + 1))
                        if back < 0:
                            far = rows + back
                            there = far >= run_start[rows]
                            got[there] += _ranges(t, far[there], fill(from_slot)[there], fill(SHARD)[there])
                            if back < -1:
                                got += _ranges(top, np.zeros(len(rows), np.int64), np.maximum(far + 1, run_start[rows]), rows)
                        cols[f"{name}_{w}"].append(got)
            if cols["period"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[f.name])) for f in out], schema=out)

    return run


def trailing_totals(trees: DataFrame, windows: list[int]) -> DataFrame:
    """``total_w`` and ``n_w`` (sum and count of values) over the ``w`` periods ending with each period, for each of ``windows``.

    One row per entity and period of its calendar, which runs from its first to its last period with any row; periods without a row count as
    empty. Windows may be of any length from 1 period; a task holds the trees of as many shards as the longest one can reach into.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows must hold at least one period")
    ordered = trees.repartition("entity_id").sortWithinPartitions("entity_id", "shard")
    kinds = ", ".join(f"{k}_{w} long" for w in windows for k in ("total", "n"))
    return ordered.mapInArrow(_query(windows), f"entity_id long, period long, {kinds}")
