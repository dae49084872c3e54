"""Running and moving functions over a column in an assumed order, as window expressions.

Each takes a column, an :class:`Order` and, where it makes sense, a width ``w``: without it the function runs over the whole prefix, with it
over the last ``w`` rows (fewer at the start). All expressions of one order share one window specification, so Catalyst plans them
with a single exchange and sort. Nulls are skipped by sums, averages, extrema and variances; shifted functions see them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import window as W

UNBOUNDED = W.Window.unboundedPreceding


@dataclass(frozen=True)
class Order:
    """Rows with equal ``keys`` (names) form a series; ``by`` are pairs of a column name and whether it ascends."""

    by: tuple[tuple[str, bool], ...]
    keys: tuple[str, ...] = field(default=())

    @staticmethod
    def of(*by: str | tuple[str, bool], keys: list[str] | tuple[str, ...] = ()) -> Order:
        return Order(tuple((b, True) if isinstance(b, str) else b for b in by), tuple(keys))

    def columns(self) -> list[Column]:
        return [F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in self.by]

    def spec(self) -> W.WindowSpec:
        if not self.by:
            raise ValueError("an order is needed: name the columns to assume the rows are ordered by")
        return W.Window.partitionBy(*[F.col(f"`{k}`") for k in self.keys]).orderBy(*self.columns())

    def whole(self) -> W.WindowSpec:
        return W.Window.partitionBy(*[F.col(f"`{k}`") for k in self.keys])

    def upto(self, w: int | None = None) -> W.WindowSpec:
        return self.spec().rowsBetween(UNBOUNDED if w is None else 1 - w, 0)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _width(w: int | None) -> int | None:
    if w is not None and w < 1:
        raise ValueError("a moving window holds at least one row")
    return w


def sums(x, o: Order, w: int | None = None) -> Column:
    return F.sum(_col(x)).over(o.upto(_width(w)))


def avgs(x, o: Order, w: int | None = None) -> Column:
    return F.avg(_col(x)).over(o.upto(_width(w)))


def mins(x, o: Order, w: int | None = None) -> Column:
    return F.min(_col(x)).over(o.upto(_width(w)))


def maxs(x, o: Order, w: int | None = None) -> Column:
    return F.max(_col(x)).over(o.upto(_width(w)))


def counts(x, o: Order, w: int | None = None) -> Column:
    return F.count(_col(x)).over(o.upto(_width(w)))


def vars(x, o: Order, w: int | None = None) -> Column:  # noqa: A001
    """Population variance; 0 for a single row."""
    return F.var_pop(_col(x)).over(o.upto(_width(w)))


def stddevs(x, o: Order, w: int | None = None) -> Column:
    """Population standard deviation; 0 for a single row."""
    return F.stddev_pop(_col(x)).over(o.upto(_width(w)))


def position(o: Order) -> Column:
    """Place of the row in its series, from 0."""
    return F.row_number().over(o.spec()).cast("long") - 1


def first(x, o: Order) -> Column:
    return F.first(_col(x)).over(o.spec().rowsBetween(UNBOUNDED, W.Window.unboundedFollowing))


def last(x, o: Order) -> Column:
    return F.last(_col(x)).over(o.spec().rowsBetween(UNBOUNDED, W.Window.unboundedFollowing))


def prev(x, o: Order) -> Column:
    """The value before; the first row has its own."""
    return F.when(F.row_number().over(o.spec()) == 1, _col(x)).otherwise(F.lag(_col(x)).over(o.spec()))


def next(x, o: Order) -> Column:  # noqa: A001
    """The value after; the last row has its own."""
    return F.when(F.row_number().over(o.spec()) == F.count(F.lit(1)).over(o.whole()), _col(x)).otherwise(F.lead(_col(x)).over(o.spec()))


def deltas(x, o: Order) -> Column:
    """Difference to the value before; 0 in the first row."""
    return F.when(F.row_number().over(o.spec()) == 1, F.lit(0)).otherwise(_col(x) - F.lag(_col(x)).over(o.spec()))


def ratios(x, o: Order, w: int = 1) -> Column:
    """Quotient of the value and the one ``w`` rows before, or the series' first value where there is none; null where that is 0.

    A series of ``w`` or fewer rows is treated as if ``w`` were 1.
    """
    _width(w)
    value, spec = _col(x).cast("double"), o.spec()
    row = F.row_number().over(spec)
    start = F.first(_col(x)).over(o.upto())
    long = F.when(row > w, F.lag(_col(x), w).over(spec)).otherwise(start)
    if w == 1:
        return F.try_divide(value, long.cast("double"))
    short = F.when(row > 1, F.lag(_col(x)).over(spec)).otherwise(start)
    n = F.count(F.lit(1)).over(o.whole())
    return F.try_divide(value, F.when(n <= w, short).otherwise(long).cast("double"))


#: Functions of a column, an order and perhaps a width.
RUNNING = {"sums": sums, "avgs": avgs, "mins": mins, "maxs": maxs, "vars": vars, "stddevs": stddevs, "counts": counts, "ratios": ratios}
SHIFTED = {"deltas": deltas, "prev": prev, "next": next}
