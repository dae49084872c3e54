"""A table with an assumed row order: the fluent way to ordered queries.

    OrderedFrame(events).assuming("ts", "event_id").group("user_id").vectors(low=("mins", "v")).reduce(best=F.max(F.col("v") - F.col("low")))

Vector functions become window columns of one specification; aggregates of them a second stage; nothing is evaluated before the result is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriate.functions.vector import Order, position
from seriate.operators import fold as folding
from seriate.operators.scan import Vec, add_vectors, plain, spread


class OrderedFrame:
    """A DataFrame with series keys and an assumed order. Every method returns a new one."""

    def __init__(self, df: DataFrame, order: Order | None = None):
        self.df, self.order = df, order or Order(())

    def assuming(self, *by: str | tuple[str, bool]) -> OrderedFrame:
        """Assume the rows are ordered by these columns: names, or pairs of a name and whether it ascends."""
        return OrderedFrame(self.df, Order.of(*by, keys=self.order.keys))

    def group(self, *keys: str) -> OrderedFrame:
        """Rows with equal keys form a series."""
        return OrderedFrame(self.df, Order(self.order.by, tuple(keys)))

    def where(self, condition: Column | str) -> OrderedFrame:
        """Keep rows, before any vector function that comes later."""
        return OrderedFrame(self.df.where(condition), self.order)

    def derive(self, **columns: Column) -> OrderedFrame:
        return OrderedFrame(self.df.withColumns(columns), self.order)

    def vectors(self, _spread: bool | None = None, **vectors: tuple) -> OrderedFrame:
        """Add vector columns: ``name=(function, column)`` or ``name=(function, width, column)``; ``("position",)`` takes no column.

        Whether long series are worked on in segments is chosen by the input's size and its keys, unless ``_spread`` says.
        """
        vecs = [Vec(name, spec[0], spec[-1] if len(spec) > 1 else None, spec[1] if len(spec) > 2 else None) for name, spec in vectors.items()]
        if not self.order.by:
            raise ValueError("an order is needed: use assuming()")
        how = add_vectors if _spread is None else spread if _spread else plain
        return OrderedFrame(how(self.df, self.order, vecs), self.order)

    def reduce(self, **aggregates: Column) -> DataFrame:
        """Aggregates per key, or of the whole table."""
        columns = [c.alias(n) for n, c in aggregates.items()]
        return self.df.groupBy(*self.order.keys).agg(*columns) if self.order.keys else self.df.agg(*columns)

    def first(self, column: str) -> Column:
        """Aggregate: the value of the first row in the assumed order."""
        return self._edge(column, False)

    def last(self, column: str) -> Column:
        """Aggregate: the value of the last row in the assumed order."""
        return self._edge(column, True)

    def _edge(self, column: str, end: bool) -> Column:
        directions = {up for _, up in self.order.by}
        if len(directions) != 1:
            raise ValueError("first and last as aggregates need an order in one direction; use vectors(x=('first', ...)) otherwise")
        place = F.struct(*[F.col(c) for c, _ in self.order.by])
        return (F.max_by if end == directions.pop() else F.min_by)(F.col(column), place)

    def fold(self, **values: Column) -> DataFrame:
        """One row per key with the values as ordered arrays."""
        return folding.group_fold(self.df, self.order, values)

    def subvec(self, start: int, end: int | None = None) -> OrderedFrame:
        """Keep of each series the rows from ``start`` up to, not including, ``end``."""
        place = self.df.withColumn("__place", position(self.order))
        kept = F.col("__place") >= start if end is None else (F.col("__place") >= start) & (F.col("__place") < end)
        return OrderedFrame(place.where(kept).drop("__place"), self.order)

    def sessions(self, time: Column, gap: Column | float, name: str = "session") -> OrderedFrame:
        """Number the sessions of each series: a new one begins where ``time`` is more than ``gap`` after the row before."""
        out = self.derive(__time=time).vectors(__delta=("deltas", "__time"))
        return out.derive(__new=(F.col("__delta") > gap).cast("int")).vectors(**{name: ("sums", "__new")})._drop("__time", "__delta", "__new")

    def rows(self) -> DataFrame:
        return self.df

    def _drop(self, *columns: str) -> OrderedFrame:
        return OrderedFrame(self.df.drop(*columns), self.order)
