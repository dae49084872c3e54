"""Streams against the same question asked of the whole table."""

from pyspark.sql import functions as F

from seriate.streaming.running import run_stream, running_stream, session_stream, window_stream


def files(spark, path):
    """Readings of three users over a day, in several files; user u has pauses of u hours."""
    for part in range(3):
        rows = [(part * 100 + i, f"u{i % 3}", f"2020-01-01 {(part * 7 + i * (i % 3 + 1) // 20) % 24:02d}:{i % 60:02d}:00", float(i % 11)) for i in range(100)]
        spark.createDataFrame(rows, "id long, user string, at string, x double").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def test_running_totals_go_on_over_batches(spark, tmp_path):
    df = files(spark, f"{tmp_path}/in.parquet")
    out = run_stream(spark, f"{tmp_path}/in.parquet", lambda s: running_stream(s, "user", ["at", "id"], "x"))
    assert out.count() == df.count()
    ends = {r["user"]: r for r in out.groupBy("user").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    for r in df.groupBy("user").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
        e = ends[r["user"]]
        assert (e["n"], e["total"], e["low"], e["high"]) == (r["n"], r["total"], r["low"], r["high"])


def test_windows_and_sessions(spark, tmp_path):
    df = files(spark, f"{tmp_path}/in.parquet")
    last = df.agg(F.max("at")).first()[0]
    for build, whole in (
        (lambda s: window_stream(s, "user", "at", "1 hour", "1 day", [F.sum("x").alias("total")]), lambda d: d.groupBy("user", F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")).select("user", F.col("window.start").alias("start"), "n", "total")),
        (lambda s: session_stream(s, "user", "at", "30 minutes", "1 day", [F.sum("x").alias("total")]).drop("end"), lambda d: d.groupBy("user", F.session_window("at", "30 minutes")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")).select("user", F.col("session_window.start").alias("start"), "n", "total")),
    ):
        # A row far in the future lets the watermark pass everything before it.
        path = f"{tmp_path}/{'window' if 'window' in build.__code__.co_names[0] else 'session'}.parquet"
        df.coalesce(1).write.parquet(path)
        spark.createDataFrame([(999, "end", 0.0)], "id long, user string, x double").withColumn("at", F.lit(last) + F.expr("INTERVAL 9 DAYS")).select("id", "user", "at", "x").coalesce(1).write.mode("append").parquet(path)
        got = {tuple(r) for r in run_stream(spark, path, build).collect()}
        assert got == {tuple(r) for r in whole(df).collect()}
