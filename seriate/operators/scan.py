"""Running and moving functions over series too long for one task: one series of the whole table, or keys that hold much of it.

The table is range-partitioned by keys and order, sorted, and written once. A partition's part of a series is a segment. Windows run within segments; what a
segment needs from others is small: totals of the earlier segments (for running functions), the last ``w`` rows before it, be they in one
segment or in many (for moving and shifted ones), the first row after it. Only series that lie in more than one partition have such needs, at most two of a
partition's, so these tables are bounded by the number of partitions, and a segment is lent at most ``w`` rows. The partitions stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from seriate.functions import vector as v
from seriate.session import materialize


#: A series with more rows than this is worked on in segments.
HOT_ROWS = 5_000_000
#: An input of no more than so many bytes, by Catalyst's estimate, which is never too low for a plan of scans, filters and joins, has no such series; it isn't counted.
SMALL_BYTES = 32 << 20


@dataclass(frozen=True)
class Vec:
    """A column to add: ``function`` of ``column``, moving over ``w`` rows if given."""

    name: str
    function: str
    column: str | None = None
    w: int | None = None

    def __post_init__(self):
        if self.w is not None and self.w < 1:
            raise ValueError("a moving window holds at least one row")


def _same(keys: tuple[str, ...], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def plain(df: DataFrame, order: v.Order, vecs: list[Vec]) -> DataFrame:
    """The functions as ordinary windows: one exchange by key, one sort."""
    def column(x: Vec) -> Column:
        if x.function == "position":
            return v.position(order)
        if x.function in v.RUNNING:
            return v.RUNNING[x.function](x.column, order, *([x.w] if x.w else []))
        return {**v.SHIFTED, "first": v.first, "last": v.last}[x.function](x.column, order)

    return df.select("*", *[column(x).alias(x.name) for x in vecs])


def add_vectors(df: DataFrame, order: v.Order, vecs: list[Vec]) -> DataFrame:
    """The columns by the cheaper of :func:`plain` and :func:`spread`; the results are the same.

    Small inputs are planned as plain windows at once. Of others the rows per key are counted first (a pass over the keys, combined on the
    map side); they are worked on in segments if a series is longer than ``HOT_ROWS``.
    """
    return (spread if too_long(df, order.keys) else plain)(df, order, vecs)


def too_long(df: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether a series has more than ``HOT_ROWS`` rows. Rows are counted, since the estimate for a join is the product of its sides."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= SMALL_BYTES:
        return False
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS).isEmpty()


def spread(df: DataFrame, order: v.Order, vecs: list[Vec], partitions: int | None = None) -> DataFrame:
    """The same columns as :func:`plain`, for series of any length; the order must have no ties within a series, or ties are broken arbitrarily.

    Sums of whole numbers are exact. Variances are computed from sums of differences to the series' first value.
    """
    keys, back = order.keys, max([x.w or 1 for x in vecs if x.function in v.RUNNING and (x.w or x.function == "ratios")] + [1] * any(x.function in ("deltas", "prev") for x in vecs) + [0])
    ahead = any(x.function == "next" for x in vecs)
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(f"`{k}`").asc() for k in keys], *order.columns()]
    # Rows that tie in keys and order meet in one partition. `__at` counts up along the sorted rows of a partition.
    parts = df.repartitionByRange(n_parts, *by).sortWithinPartitions(*by)
    parts = materialize(parts.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "segments")

    # Segments of series in several partitions: the first and the last series of a partition may go on elsewhere.
    if keys:
        edges = parts.groupBy("__pid").agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi"))
        along = W.Window.orderBy("__pid")
        shared = F.array_distinct(F.array_compact(F.array(
            F.when(F.col("lo").eqNullSafe(F.lag("hi").over(along)), F.col("lo")), F.when(F.col("hi").eqNullSafe(F.lead("lo").over(along)), F.col("hi"))
        )))
        split = edges.select("__pid", shared.alias("shared")).select("__pid", F.explode("shared").alias("k")).select("__pid", "k.*")
    else:
        split = parts.select("__pid").distinct()

    # Totals of these segments, in one pass over their rows.
    columns = list(dict.fromkeys(x.column for x in vecs if x.column))
    numeric = {c: isinstance(parts.schema[c].dataType, T.NumericType) for c in columns}
    nothing = F.lit(None).cast("double")
    sums = []
    for i, c in enumerate(columns):
        x = F.col(f"p.{c}")
        numbers = (F.sum(x), F.avg(x), F.var_pop(x)) if numeric[c] else (nothing,) * 3
        ends = F.min_by(x, F.col("p.__at")), F.max_by(x, F.col("p.__at"))
        for name, value in zip(("s", "mean", "var", "first", "last", "c", "min", "max"), (*numbers, *ends, F.count(x), F.min(x), F.max(x))):
            sums.append(value.alias(f"__{name}_{i}"))
    inside = parts.alias("p").join(F.broadcast(split.alias("l")), _same(keys, "p", "l") & (F.col("p.__pid") == F.col("l.__pid")))
    stats = inside.groupBy(*[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.__pid").alias("__pid")).agg(F.count(F.lit(1)).alias("__n"), F.min("p.__at").alias("__start"), *sums)

    # What all earlier segments of a series amount to.
    line = W.Window.partitionBy(*keys).orderBy("__pid")
    whole, prior = line.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing), line.rowsBetween(W.Window.unboundedPreceding, -1)
    stats = stats.withColumns({f"__{n}_{i}": F.expr(f"{n}(__{n}_{i})").over(whole) for i in range(len(columns)) for n in ("first", "last")})
    for i, c in enumerate(columns):
        off = F.col(f"__mean_{i}") - F.coalesce(F.col(f"__first_{i}").cast("double"), F.lit(0.0)) if numeric[c] else nothing
        stats = stats.withColumns({f"__d_{i}": F.col(f"__c_{i}") * off, f"__q_{i}": F.col(f"__c_{i}") * (F.col(f"__var_{i}") + off * off)})
    fold = {"s": F.sum, "c": F.sum, "min": F.min, "max": F.max, "d": F.sum, "q": F.sum}
    heads = stats.select(
        *keys, "__pid", "__start", F.lag("__pid").over(line).alias("__before"), F.lead("__pid").over(line).alias("__after"), F.sum("__n").over(whole).alias("__all"),
        F.coalesce(F.sum("__n").over(prior), F.lit(0)).alias("__rows"), F.sum("__n").over(line).alias("__end"),
        *[F.col(f"__{n}_{i}") for i in range(len(columns)) for n in ("first", "last")], *[f(f"__{n}_{i}").over(prior).alias(f"__{n}_{i}") for i in range(len(columns)) for n, f in fold.items()],
    )
    heads = materialize(heads, "segment_heads")

    # Rows lent to other segments: of each segment that ends less than `back` rows before another begins, those within that distance; its first row to the one before.
    lends = []
    if back:
        near = W.Window.partitionBy(*keys).orderBy("__end").rangeBetween(-(back - 1), 0)
        lender = F.collect_list(F.struct("__pid", "__start", "__rows")).over(near)
        lent = heads.select(*keys, F.col("__after").alias("__to"), (F.col("__end") - back).alias("__from"), lender.alias("lenders")).where("__to IS NOT NULL")
        lent = lent.select(*keys, "__to", "__from", F.explode("lenders").alias("l"))
        lends.append(lent.select(*keys, F.col("l.__pid").alias("__pid"), "__to", (F.col("l.__start") + F.col("__from") - F.col("l.__rows")).alias("__low"), F.lit((1 << 63) - 1).alias("__high")))
    if ahead:
        lends.append(heads.where("__before IS NOT NULL").select(*keys, "__pid", F.col("__before").alias("__to"), F.col("__start").alias("__low"), F.col("__start").alias("__high")))
    rows = parts.withColumn("__own", F.lit(True))
    if lends:
        lends = lends[0] if len(lends) == 1 else lends[0].unionByName(lends[1])
        within = _same(keys, "p", "l") & (F.col("p.__pid") == F.col("l.__pid")) & F.col("p.__at").between(F.col("l.__low"), F.col("l.__high"))
        lent = parts.alias("p").join(F.broadcast(lends.alias("l")), within).select(*[F.col(f"p.`{c}`") for c in parts.columns if c != "__pid"], F.col("l.__to").alias("__pid"), F.lit(False).alias("__own"))
        rows = rows.unionByName(lent)
    o = v.Order(order.by, (*keys, "__pid"))
    with_offsets = rows.alias("r").join(F.broadcast(heads.alias("o")), _same(keys, "r", "o") & (F.col("r.__pid") == F.col("o.__pid")), "left").select("r.*", *[F.col(f"o.{c}").alias(c) for c in heads.columns if c not in (*keys, "__pid", "__start", "__before", "__after", "__end")])
    place = F.coalesce("__rows", F.lit(0)) + F.sum(F.col("__own").cast("int")).over(o.upto())
    n_all = F.coalesce("__all", F.sum(F.col("__own").cast("int")).over(o.whole()))
    out: list[Column] = []
    # Values of own rows only, for running functions and for windows of the whole segment.
    for x in vecs:
        i = columns.index(x.column) if x.column else -1
        col = F.col(x.column) if x.column else None
        mine = F.when(F.col("__own"), col) if x.column else None
        first = F.coalesce(F.when(F.col("__all").isNotNull(), F.col(f"__first_{i}")), F.when(F.col("__all").isNull(), F.first(mine).over(o.upto()))) if x.column else None
        if x.function == "position":
            c = place - 1
        elif x.function == "first":
            c = first
        elif x.function == "last":
            c = F.when(F.col("__all").isNotNull(), F.col(f"__last_{i}")).otherwise(F.last(col).over(o.spec().rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)))
        elif x.function in ("deltas", "prev"):
            c = v.SHIFTED[x.function](x.column, o)
        elif x.function == "next":
            c = F.when(place == n_all, col).otherwise(F.lead(col).over(o.spec()))
        elif x.function == "ratios":
            w = x.w or 1
            long = F.when(place > w, F.lag(col, w).over(o.spec())).otherwise(first)
            short = F.when(place > 1, F.lag(col).over(o.spec())).otherwise(first)
            c = F.try_divide(col.cast("double"), F.when(n_all <= w, short).otherwise(long).cast("double"))
        elif x.w:
            c = v.RUNNING[x.function](x.column, o, x.w)
        else:
            plus = lambda n, f: F.when(F.col(f"__{n}_{i}").isNull(), f).when(f.isNull(), F.col(f"__{n}_{i}")).otherwise(F.col(f"__{n}_{i}") + f)  # noqa: B023, E731
            upto = o.upto()
            total, count = plus("s", F.sum(mine).over(upto)) if numeric[x.column] else None, plus("c", F.count(mine).over(upto))
            if x.function == "sums":
                c = total
            elif x.function == "counts":
                c = count
            elif x.function == "avgs":
                c = F.when(count > 0, total.cast("double") / count)
            elif x.function in ("mins", "maxs"):
                f, g, n = (F.min, F.least, "min") if x.function == "mins" else (F.max, F.greatest, "max")
                c = g(F.col(f"__{n}_{i}"), f(mine).over(upto))
            else:
                d = F.when(F.col("__own"), (col - F.coalesce(F.when(F.col("__all").isNotNull(), F.col(f"__first_{i}")), F.lit(0))).cast("double"))
                single = (F.var_pop if x.function == "vars" else F.stddev_pop)(mine).over(upto)
                s, q = plus("d", F.sum(d).over(upto)), plus("q", F.sum(d * d).over(upto))
                var = F.greatest(F.lit(0.0), q / count - (s / count) * (s / count))
                c = F.when(F.col("__all").isNull(), single).otherwise(F.when(count > 0, var if x.function == "vars" else F.sqrt(var)))
        out.append(c.alias(x.name))
    return with_offsets.select(*df.columns, "__own", *out).where("__own").select(*df.columns, *[x.name for x in vecs])
