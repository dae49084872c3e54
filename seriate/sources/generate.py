"""Deterministic made-up tables of any size, built where they are needed: trades and ticks of many symbols, and a reader for labelled vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _uniform(seed: int, *cols: str | Column) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / float(1 << 52)


def trades(spark: SparkSession, n: int, symbols: int = 70_000, seed: int = 1, low: int = 50, high: int = 500) -> DataFrame:
    """``stocksymbol, time, quantity, price``: a trade at each time 1..n; few symbols have most trades; prices wander between ``low`` and ``high``.

    A price is a sum of waves of the time, of phases and periods of the symbol's own, so that rows are made independently of each other.
    """
    time = F.col("time")
    rows = spark.range(1, n + 1).select(F.col("id").alias("time"))
    # A power of a uniform number: the first symbols come up far more often than the last.
    symbol = F.floor(F.pow(_uniform(seed, "time"), 3) * symbols).cast("int")
    rows = rows.select("time", symbol.alias("s"))
    wave = sum((F.sin(time * 2 * 3.141592653589793 / (F.lit(period) * (1 + _uniform(seed + i, "s"))) + 6.3 * _uniform(seed + 10 + i, "s")) / (i + 1) for i, period in enumerate((50_000, 7_000, 400))), F.lit(0.0))
    price = F.round(low + (high - low) * (wave + 1.84) / 3.68).cast("int")
    return rows.select(F.concat(F.lit("S"), F.col("s")).alias("stocksymbol"), time.cast("int").alias("time"), (100 + F.floor(_uniform(seed + 5, "time") * 9901)).cast("int").alias("quantity"), price.alias("price"))


def ticks(spark: SparkSession, n: int, ids: list[str], days: int = 30, seed: int = 1) -> DataFrame:
    """``ID, timestamp, tradeDate, price``: ticks of a few ids over some days."""
    rows = trades(spark, n, len(ids), seed)
    place = F.substring("stocksymbol", 2, 9).cast("int")
    day = F.date_add(F.to_date(F.lit("2003-01-01")), F.floor((F.col("time") - 1) * days / n).cast("int"))
    return rows.select(F.element_at(F.array(*map(F.lit, ids)), place + 1).alias("ID"), F.col("time").alias("timestamp"), day.alias("tradeDate"), "price")


def labelled_vectors(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """Lines of numbers, the last of which is the class: ``x`` (array of double), ``y`` (bigint). Lines without two numbers are left out."""
    parts = F.filter(F.split(F.trim("value"), f"(?:\\Q{separator}\\E)+"), lambda p: p != "")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 2)
    numbers = F.transform(F.slice("p", 1, F.size("p") - 1), lambda p: p.try_cast(T.DoubleType()))
    return rows.select(numbers.alias("x"), F.element_at("p", -1).try_cast(T.DoubleType()).cast("long").alias("y"))
