"""Ordered functions over streams: running totals with state per series, sessions by gaps with late data cut off by a watermark."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from seriate.session import shared_folder


def running_stream(stream: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Running sum, count, minimum and maximum of ``value`` (double) per ``key``, going on from batch to batch.

    Rows are ordered within a batch; a row that arrives in a later batch counts as later. The state of a series is four numbers. Null values
    leave the totals as they are; rows with a null key form a series.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    columns = [c for c in stream.columns if c != value]
    out = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{value}` double, n long, total double, low double, high double"

    def step(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, low, high = state.get if state.exists else (0, 0.0, float("inf"), float("-inf"))
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        v = rows[value].astype(float)
        rows["n"] = n + v.notna().cumsum()
        rows["total"] = total + v.fillna(0).cumsum()
        rows["low"] = v.fillna(float("inf")).cummin().clip(upper=low)
        rows["high"] = v.fillna(float("-inf")).cummax().clip(lower=high)
        state.update((int(rows["n"].iloc[-1]), float(rows["total"].iloc[-1]), float(rows["low"].iloc[-1]), float(rows["high"].iloc[-1])))
        yield rows[[*columns, value, "n", "total", "low", "high"]]

    return stream.groupBy(key).applyInPandasWithState(step, out, "n long, total double, low double, high double", "append", GroupStateTimeout.NoTimeout)


def session_stream(stream: DataFrame, key: str, time: str, gap: str, late: str, aggregates: list[Column]) -> DataFrame:
    """Sessions per key, closed by a gap (as ``30 minutes``); rows later than ``late`` behind the watermark are dropped."""
    out = stream.withWatermark(time, late).groupBy(key, F.session_window(F.col(time), gap)).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", *[c for c in out.columns if c not in (key, "session_window", "n")])


def window_stream(stream: DataFrame, key: str, time: str, width: str, late: str, aggregates: list[Column], slide: str | None = None) -> DataFrame:
    """Tumbling, or with ``slide`` sliding, windows per key."""
    window = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    out = stream.withWatermark(time, late).groupBy(key, window).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return out.select(key, F.col("window.start").alias("start"), "n", *[c for c in out.columns if c not in (key, "window", "n")])


def run_stream(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Run a stream over the Parquet files at ``path`` to their end, into files in the shared folder, and read the result."""
    schema = spark.read.parquet(path).schema
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    # A single file is a stream of one: a source reads folders.
    folder, _, name = path.rpartition("/")
    single = _is_file(spark, path)
    result = build(spark.readStream.schema(schema).option("pathGlobFilter", name if single else "*.parquet").parquet(folder if single else path))
    q = result.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    jpath = spark._jvm.org.apache.hadoop.fs.Path(base)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(result.schema).parquet(f"{base}/out")


def _is_file(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isFile()
