"""Joins of ordered data: the latest row before (as-of), points in ranges, and ranges that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriate.functions.vector import Order
from seriate.operators.scan import Vec, add_vectors


#: Level of ranges that are single values.
SINGLE = -9999


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[tuple[str, str]], tie: str | None = None, before: bool = False) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` whose ``right_on`` is at most ``left_on`` (less than it, with ``before``), within equal ``by`` (pairs of names).

    Of several right rows with that ``right_on`` the one with the greatest ``tie`` counts (any, without one). Columns: those of ``left``, then those of ``right``, null where
    there is none; names must not clash. Rows of ``left`` with a null ``left_on`` or ``by`` match nothing; right ones take no part.

    Both sides are put in one order and the latest right row is carried along as a running maximum, so a join costs a sort however many rows match,
    and a key that holds much of the data is worked on in segments.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    known = right.where(F.col(right_on).isNotNull())
    for _, r in by:
        known = known.where(F.col(r).isNotNull())
    held = F.struct(F.col(right_on).alias("at"), (F.col(tie) if tie else F.lit(0)).alias("tie"), F.struct(*right.columns).alias("row"))
    # At equal times right rows come first, unless they have to be earlier.
    ours = left.select(*[F.col(x).alias(k) for (x, _), k in zip(by, keys)], F.col(left_on).alias("__at"), F.lit(0 if before else 1).alias("__side"), F.monotonically_increasing_id().alias("__id"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(known.select(held).schema[0].dataType).alias("__right"))
    theirs = known.select(*[F.col(y).alias(k) for (_, y), k in zip(by, keys)], F.col(right_on).alias("__at"), F.lit(1 if before else 0).alias("__side"), F.monotonically_increasing_id().alias("__id"), F.lit(None).cast(ours.schema["__left"].dataType).alias("__left"), held.alias("__right"))
    both = add_vectors(ours.unionByName(theirs), Order.of("__at", "__side", "__id", keys=keys), [Vec("__last", "maxs", "__right")])
    usable = F.col("__at").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    found = F.when(usable, F.col("__last.row"))
    return both.where("__left IS NOT NULL").select("__left.*", *[found[c].alias(c) for c in right.columns])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, by: list[tuple[str, str]] = (), closed: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Pairs of a row of ``points`` and a row of ``ranges`` with ``point`` between ``low`` and ``high``, within equal ``by`` (pairs of names); names must not clash.

    ``closed`` says whether the ends belong to a range. Nulls and NaN match nothing; a range whose ends are the wrong way round holds nothing.
    A range lies in at most two bins of the level whose bins are just longer than it; a point looks in the one bin of each level that has ranges. So it is a join
    of equal bins, whatever mixture of short and long ranges there is, and neither side is compared as a whole with the other.
    """
    ends = _ranges(ranges, low, high).withColumns({"__low": _number(ranges, low), "__high": _number(ranges, high)})
    length, far = F.col("__high") - F.col("__low"), F.greatest(F.abs("__low"), F.abs("__high"))
    # Level of a power of two at least as long as the range, and not so fine that bins outgrow a long. Single values are looked up by their hashes.
    level = F.ceil(F.log2(length)).cast("int")
    ends = ends.withColumn("__level", F.when(length <= 0, SINGLE).when(far > 0, F.greatest(level, F.floor(F.log2(far)).cast("int") - 50)).otherwise(level))
    bins = lambda v: F.when(F.col("__level") == SINGLE, F.xxhash64(v + F.lit(0.0))).otherwise(F.floor(v / F.pow(F.lit(2.0), F.col("__level"))).cast("long"))
    ends = ends.withColumn("__bin", F.explode(F.sequence(bins(F.col("__low")), bins(F.col("__high")))))
    # At most one level per power of two.
    levels = sorted(r[0] for r in ends.select("__level").distinct().collect())
    there = points.withColumn("__point", _number(points, point)).where("__point IS NOT NULL AND NOT isnan(__point)")
    there = there.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bin", bins(F.col("__point")))
    p, r = there.alias("p"), ends.alias("r")
    match = (F.col("p.__level") == F.col("r.__level")) & (F.col("p.__bin") == F.col("r.__bin"))
    for x, y in by:
        match = match & (F.col(f"p.{x}") == F.col(f"r.{y}"))
    above, below = F.col(f"p.{point}"), F.col(f"p.{point}")
    match = match & (above >= F.col(f"r.{low}") if closed[0] else above > F.col(f"r.{low}")) & (below <= F.col(f"r.{high}") if closed[1] else below < F.col(f"r.{high}"))
    return p.join(r, match).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"r.{c}") for c in ranges.columns])


def _number(df: DataFrame, c: str) -> Column:
    """For bins: any function that never falls as the column grows; times in seconds."""
    kind = dict(df.dtypes)[c]
    if kind == "date":
        return F.unix_date(c).cast("double") * 86_400
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double") / 1e6
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.least(x, F.lit(1e300)), F.lit(-1e300)))


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], by: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of rows whose ranges, ends included, have a value in common, within equal ``by``; names must not clash.

    Either the left range begins within the right one, or the right one begins within the left one and after its start.
    """
    begins = range_join(_ranges(left, *left_range), right, left_range[0], *right_range, by=by)
    later = range_join(_ranges(right, *right_range), left, right_range[0], *left_range, by=[(y, x) for x, y in by], closed=(False, True))
    return begins.unionByName(later)


def _ranges(df: DataFrame, low: str, high: str) -> DataFrame:
    """The rows that are ranges."""
    a, b = _number(df, low), _number(df, high)
    return df.where((a <= b) & ~F.isnan(a) & ~F.isnan(b))
