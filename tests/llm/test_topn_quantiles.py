"""Top rows per group and percentiles, against sorting."""

import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriate.llm import quantiles, topn
from seriate.llm.quantiles import K, RANK_ERROR, Sketch, _seed, build_sketches, merge_sketches, pack, sketch_quantiles, unpack
from seriate.llm.topn import double_code, top_n


def test_double_codes_are_in_the_order_of_doubles(spark):
    rnd = random.Random(2)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1021, 1.0, 1.0 - 2**-53, 2.0, math.nextafter(2.0, 3), 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 0.3, 7.58]
    xs += [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.randint(-320, 308) for _ in range(3000)] + [float(2**k) for k in range(-1074, 1024)] + [math.nextafter(float(2**k), 0) for k in range(-1070, 1024)]
    got = {r["x"]: r["c"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", double_code(F.col("x")).alias("c")).collect()}
    bits = lambda x: (lambda b: b if b >= 0 else -(b & (2**63 - 1)))(struct.unpack("<q", struct.pack("<d", x))[0])
    assert all(got[x] == bits(x) for x in xs)
    assert spark.createDataFrame([(float("nan"),)], "x double").select(double_code(F.col("x")).alias("c")).first()["c"] > got[float("inf")]


SCHEMA = "g int, h string, score double, at timestamp_ntz, id long"


def by_sorting(rows, n):
    out, groups = set(), {}
    for r in set(rows):
        if None not in r[:3]:
            groups.setdefault(r[:2], []).append(r)
    for part in groups.values():
        part.sort(key=lambda r: (r[2] == r[2], -r[2] if r[2] == r[2] else 0, r[3] is None, r[3] or 0, r[4] is None, r[4] or 0))
        out |= {(r[0], r[1], r[4]) for r in part[:n]}
    return out


def random_rows(seed, size):
    rnd = random.Random(seed)
    base = dt.datetime(2009, 1, 1)
    rows = []
    for i in range(size):
        g = rnd.choice([1, 1, 1, 2, 3, None, rnd.randint(4, 40)])
        score = rnd.choice([None, 1.5, 1.5, 2.25, -3.0, round(rnd.uniform(-10, 10), 2), rnd.uniform(-1e300, 1e300), 0.0, -0.0])
        rows.append((g, rnd.choice(["a", "b", None]), score, rnd.choice([None, base + dt.timedelta(minutes=rnd.randint(0, 5), microseconds=rnd.randint(0, 3))]), i))
    return rows + rows[: size // 10]


@pytest.mark.parametrize(("seed", "n", "fan"), [(1, 3, 256), (2, 1, 2), (3, 20, 16)])
def test_top_n(spark, seed, n, fan):
    rows = random_rows(seed, 2500)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("__w0", F.lit("clash")).withColumn("n", F.lit(1))
    got = top_n(df, ["g", "h"], [("score", True), ("at", False), ("id", False)], n, fan)
    assert got.columns == ["g", "h", "score", "at", "id"]
    found = [(r["g"], r["h"], r["id"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == by_sorting(rows, n)


def test_top_n_by_joined_cutoffs(spark, monkeypatch):
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 2)
    rows = random_rows(5, 800)
    got = top_n(spark.createDataFrame(rows, SCHEMA), ["g", "h"], [("score", True), ("at", False), ("id", False)], 4)
    assert {(r["g"], r["h"], r["id"]) for r in got.collect()} == by_sorting(rows, 4)


def test_top_n_of_many_groups_one_of_them_hot(spark):
    """More groups than cutoffs are broadcast for; one holds a third of the rows."""
    n = topn.BROADCAST_GROUPS + 1000
    df = spark.range(n + n // 2).select(F.when(F.col("id") < n, F.col("id")).otherwise(-1).alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("score"), "id")
    got = top_n(df, ["g"], [("score", True), ("id", False)], 2, unique=True)
    assert got.groupBy((F.col("g") < 0).alias("hot")).count().orderBy("hot").collect() == [(False, n), (True, 2)]
    best = sorted(range(n, n + n // 2), key=lambda i: (-(i * 7919 % 100_003), i))[:2]
    assert sorted(r["id"] for r in got.where("g < 0").collect()) == sorted(best)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan


def test_top_n_edge_cases(spark):
    df = spark.createDataFrame([(1, "a", 5.0, None, 1)] * 4, SCHEMA)
    assert top_n(df, ["g", "h"], [("score", True), ("id", True)], 2).count() == 1
    assert top_n(df.limit(0), ["g", "h"], [("score", True), ("id", True)], 2).count() == 0
    assert top_n(df.where("false").unionByName(df.withColumn("score", F.lit(None).cast("double"))), ["g"], [("score", True)], 2).count() == 0
    for bad, error in [(lambda: top_n(df, ["g"], [("h", True)], 2), TypeError), (lambda: top_n(df, ["g"], [("score", True)], 0), ValueError)]:
        with pytest.raises(error):
            bad()


def test_no_window_over_whole_groups(spark):
    """The rows of a group are never sorted together: windows see counts, `fan` a group at most."""
    df = spark.range(20000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("score"), "id")
    got = top_n(df, ["g"], [("score", True), ("id", True)], 3)
    assert sorted(r["id"] for r in got.collect()) == [19997, 19998, 19999]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


DISTRIBUTIONS = {
    "uniform": lambda r, n: r.random(n),
    "heavy tail": lambda r, n: r.pareto(1.1, n),
    "few values": lambda r, n: r.integers(0, 7, n).astype(float),
    "rising": lambda r, n: np.arange(n, dtype=float),
    "falling": lambda r, n: -np.arange(n, dtype=float),
}


def check_ranks(values, sketch, slack=4.0):
    values = np.sort(values)
    n = len(values)
    assert sketch.n == n and sketch.weighted()[1][-1] == n
    for q in (0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 0.9999, 1.0):
        x = sketch.quantiles([q])[0]
        low, high = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        allowed = slack * RANK_ERROR / K * (1 - q) * n + 1
        assert low <= q * n + allowed and high >= q * n - allowed, (q, low, high, q * n, allowed)


@pytest.mark.parametrize("name", DISTRIBUTIONS)
def test_sketch_error_is_relative(name):
    values = DISTRIBUTIONS[name](np.random.default_rng(1), 200_000)
    sketch = Sketch(seed=3).update(values)
    check_ranks(values, sketch)
    assert sum(map(len, sketch.levels)) < 20_000


@pytest.mark.parametrize("name", DISTRIBUTIONS)
def test_merged_sketches_are_as_good(name):
    values = DISTRIBUTIONS[name](np.random.default_rng(2), 120_000)
    parts = np.split(values, [10, 11, 5000, 70_000])
    sketches = [Sketch(seed=i).update(p) for i, p in enumerate(parts)]
    whole = sketches[0]
    for s in sketches[1:]:
        whole.merge(unpack(*pack(s), K, 1))
    check_ranks(values, whole)


def test_small_sketches_are_exact():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 10, 383):
        values = rnd.random(n)
        for q in (0.0, 0.1, 0.5, 0.999, 1.0):
            assert Sketch().update(values).quantiles([q])[0] == np.sort(values)[max(1, math.ceil(q * n)) - 1]
    assert Sketch().quantiles([0.5]) == [None]
    assert Sketch().update(np.array([1.0, 2.0])).rank(1.5) == 1


def test_sketches_in_spark(spark):
    rnd = np.random.default_rng(7)
    rows = [(int(k) if k else None, int(d), None if rnd.random() < 0.05 else float("nan") if rnd.random() < 0.02 else float(rnd.lognormal())) for k, d in zip(rnd.choice([0, 1, 1, 1, 2], 30_000), rnd.integers(0, 5, 30_000))]
    df = spark.createDataFrame(rows, "k int, day int, x double").withColumn("part", F.lit("clash")).repartition(7)
    one = merge_sketches(build_sketches(df, ["k"], ["x"]), ["k"])
    days = merge_sketches(build_sketches(df, ["k", "day"], ["x"]), ["k", "day"])
    both = merge_sketches(days.withColumn("part", F.col("day")), ["k"])
    qs = [0.5, 0.9, 0.99, 1.0]
    for out in (one, both):
        got = {r["k"]: r for r in sketch_quantiles(out, ["k"], qs).collect()}
        assert set(got) == {None, 1, 2}
        for k, r in got.items():
            values = np.sort([x for kk, _, x in rows if kk == k and x is not None and x == x])
            assert r["n"] == len(values) and r["values"][-1] == values[-1]
            for q, x in zip(qs, r["values"]):
                assert abs(np.searchsorted(values, x, "right") - q * len(values)) <= 5 * RANK_ERROR / K * (1 - q) * len(values) + 1
    assert sketch_quantiles(merge_sketches(build_sketches(df.limit(0), ["k"], ["x"]), ["k"]), ["k"], qs).count() == 0


def test_sketches_given_out_early(spark, monkeypatch):
    """A partition that holds few sketches open gives out several of a key; they merge to the same counts."""
    monkeypatch.setattr(quantiles, "HELD", 3)
    monkeypatch.setattr(quantiles, "TOGETHER", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        df = spark.range(6000).select((F.col("id") % 20).alias("k"), F.col("id").cast("double").alias("x")).coalesce(2)
        sketches = build_sketches(df, ["k"], ["x"])
        merged = sketch_quantiles(merge_sketches(sketches, ["k"]), ["k"], [0.5, 1.0]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["k"], r["n"], r["values"][0], r["values"][1]) for r in merged} == {(k, 300, 20.0 * 149 + k, 20.0 * 299 + k) for k in range(20)}


def test_partitions_throw_their_own_coins():
    """The mean error of many merged parts is no bias."""
    rnd = np.random.default_rng(12)
    off = []
    for trial in range(10):
        values = rnd.random(200 * 600)
        whole = None
        for part, x in enumerate(np.split(values, 200)):
            s = Sketch(seed=_seed((5, trial), part)).update(x)
            whole = s if whole is None else whole.merge(s)
        for q in (0.01, 0.25):
            off.append(((values <= whole.quantiles([q])[0]).sum() - q * len(values)) / (RANK_ERROR / K * (1 - q) * len(values)))
    assert abs(np.mean(off)) < 0.6, off
