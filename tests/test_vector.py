"""Vector functions against plain loops, as windows, in segments, and folded."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from seriate.functions.vector import Order
from seriate.operators.fold import array_deltas, array_sums, array_windows, flatten, group_fold, pack, subvec
from seriate.operators.ordered import OrderedFrame
from seriate.operators.scan import Vec, plain, spread
from seriate.session import materialize


def expected(x, function, w):
    out = []
    for i in range(len(x)):
        part = [v for v in x[max(0, i - w + 1) if w else 0 : i + 1] if v is not None]
        known = {"sums": lambda: sum(part), "avgs": lambda: sum(part) / len(part), "mins": lambda: min(part), "maxs": lambda: max(part), "vars": lambda: statistics.pvariance(part), "stddevs": lambda: statistics.pstdev(part), "counts": lambda: len(part)}
        if function in known:
            out.append(known[function]() if part or function == "counts" else None)
        elif function == "deltas":
            out.append(0 if i == 0 else None if None in (x[i], x[i - 1]) else x[i] - x[i - 1])
        elif function == "prev":
            out.append(x[max(i - 1, 0)])
        elif function == "next":
            out.append(x[min(i + 1, len(x) - 1)])
        elif function == "ratios":
            k = 1 if len(x) <= (w or 1) else (w or 1)
            below = x[i - k] if i >= k else x[0]
            out.append(None if x[i] is None or below in (None, 0) else x[i] / below)
        elif function in ("first", "last"):
            out.append(x[0] if function == "first" else x[-1])
        else:
            out.append(i)
    return out


SPECS = [(f, w) for f in ("sums", "avgs", "mins", "maxs", "vars", "stddevs", "counts") for w in (None, 1, 3)] + [("ratios", None), ("ratios", 4), ("deltas", None), ("prev", None), ("next", None), ("first", None), ("last", None), ("position", None)]


def series(seed, nulls):
    rnd = random.Random(seed)
    rows = []
    for key in ("a", "b", None, "c"):
        n = {"a": 1, "b": 3, None: 40, "c": 400}[key]
        places = rnd.sample(range(1000), n)
        rows += [(key, t, None if nulls and rnd.random() < 0.2 else rnd.randint(-5, 9)) for t in places]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", ["plain", "spread"])
@pytest.mark.parametrize("nulls", [False, True])
@pytest.mark.parametrize("up", [True, False])
def test_against_loops(spark, how, nulls, up):
    rows = series(3, nulls)
    df = spark.createDataFrame(rows, "k string, t int, x int")
    vecs = [Vec(f"v{i}", f, None if f == "position" else "x", w) for i, (f, w) in enumerate(SPECS)]
    order = Order.of(("t", up), keys=["k"])
    got = (plain(df, order, vecs) if how == "plain" else spread(df, order, vecs, partitions=6)).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append(r)
    for _key, part in by_key.items():
        part.sort(key=lambda r: r["t"], reverse=not up)
        for i, (f, w) in enumerate(SPECS):
            want = expected([r["x"] for r in part], f, w)
            for r, y in zip(part, want):
                z = r[f"v{i}"]
                assert (z is None) == (y is None), (f, w, z, y)
                assert z is None or math.isclose(z, y, rel_tol=1e-9, abs_tol=1e-9), (f, w, z, y)


def test_spread_one_series(spark):
    n = 2000
    df = spark.range(n).select(F.col("id").alias("t"), (F.col("id") * 7919 % 1009).alias("x"))
    out = spread(df, Order.of("t"), [Vec("s", "sums", "x"), Vec("m", "mins", "x", 50), Vec("d", "deltas", "x"), Vec("l", "last", "x")], partitions=8).orderBy("t").collect()
    x = [i * 7919 % 1009 for i in range(n)]
    assert [r["s"] for r in out] == [sum(x[: i + 1]) for i in range(n)]
    assert [r["m"] for r in out] == [min(x[max(0, i - 49) : i + 1]) for i in range(n)]
    assert [r["d"] for r in out] == [x[i] - x[i - 1] if i else 0 for i in range(n)]
    assert {r["l"] for r in out} == {x[-1]}


def test_spread_wide_window_borrows_from_many_segments(spark):
    df = spark.range(100).select(F.col("id").alias("t"), F.lit(1).alias("x"))
    out = spread(df, Order.of("t"), [Vec("s", "sums", "x", 60), Vec("r", "ratios", "t", 30)], partitions=16).orderBy("t").collect()
    assert [r["s"] for r in out] == [min(i + 1, 60) for i in range(100)]
    assert [r["r"] for r in out] == [None] * 31 + [i / (i - 30) for i in range(31, 100)]


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_spread_many_short_series_keeps_partitions(spark, monkeypatch, partitions):
    """Series shorter than the window cross many partition edges: the table is written once, in all partitions."""
    from seriate.operators import scan

    df = spark.range(3000).select((F.col("id") / 7).cast("int").alias("k"), F.col("id").alias("t"), (F.col("id") * 7919 % 1009).alias("x"))
    written = []
    monkeypatch.setattr(scan, "materialize", lambda d, name: written.append((name, d.rdd.getNumPartitions())) or materialize(d, name))
    order, vecs = Order.of("t", keys=["k"]), [Vec("m", "sums", "x", 50), Vec("n", "next", "x"), Vec("v", "vars", "x"), Vec("q", "ratios", "x", 3)]
    got = sorted(map(tuple, spread(df, order, vecs, partitions=partitions).collect()))
    want = sorted(map(tuple, plain(df, order, vecs).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want] and all(math.isclose(a, b, abs_tol=1e-6) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]) if a is not None or b is not None)
    assert [n for n, _ in written] == ["segments", "segment_heads"] and written[0][1] == partitions


def test_spread_null_first_value(spark):
    df = spark.createDataFrame([(t, None if t == 0 else float(t % 5)) for t in range(60)], "t int, x double")
    vecs = [Vec("v", "vars", "x"), Vec("a", "avgs", "x"), Vec("f", "first", "x")]
    got, want = (sorted(map(tuple, f.collect())) for f in (spread(df, Order.of("t"), vecs, partitions=5), plain(df, Order.of("t"), vecs)))
    assert all(x == y or math.isclose(x, y, abs_tol=1e-9) for g, w in zip(got, want) for x, y in zip(g, w))


@pytest.mark.parametrize("how", [plain, spread])
def test_empty_table(spark, how):
    df = spark.createDataFrame([], "k string, t int, x int")
    assert how(df, Order.of("t", keys=["k"]), [Vec("s", "sums", "x"), Vec("p", "prev", "x")]).count() == 0


def test_no_order_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="order"):
        OrderedFrame(df).vectors(s=("sums", "x"))
    with pytest.raises(ValueError, match="at least one row"):
        OrderedFrame(df).assuming("x").vectors(s=("sums", 0, "x"))


def test_fold_and_flatten(spark):
    df = spark.createDataFrame([("a", 2, 20), ("a", 1, None), ("b", 5, 50), (None, 1, 7)], "k string, t int, x int")
    folded = group_fold(df, Order.of("t", keys=["k"]), {"t": F.col("t"), "x": F.col("x")}, {"n": F.count("x")})
    got = {r["k"]: (r["t"], r["x"], r["n"]) for r in folded.collect()}
    assert got == {"a": ([1, 2], [None, 20], 1), "b": ([5], [50], 1), None: ([1], [7], 1)}
    assert sorted((r["t"], r["x"]) for r in flatten(folded, ["t", "x"]).where("k = 'a'").collect()) == [(1, None), (2, 20)]
    assert flatten(folded, ["t", "x"]).count() == 4
    assert flatten(folded, ["t", "x"], "cross").count() == 6
    uneven = spark.createDataFrame([([1, 2, 3], [9], "r"), ([], [], "s"), (None, [4], "t")], "a array<int>, b array<int>, c string")
    assert sorted(tuple(r) for r in flatten(uneven, ["a", "b"]).na.fill(-1).collect()) == [(-1, 4, "t"), (1, 9, "r"), (2, -1, "r"), (3, -1, "r")]
    assert flatten(uneven, ["a", "b"], "cross").count() == 3
    with pytest.raises(ValueError):
        flatten(uneven, ["a"], "other")


def test_fold_descending_with_ties(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, None, "z"), (1, 9, "y")], "k int, t int, v string")
    assert group_fold(df, Order.of(("t", False), keys=["k"]), {"v": F.col("v")}).first()["v"] == ["y", "x", "z"]


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.0, 8.0],), ([],)], "a array<double>")
    rows = df.select(array_sums("a").alias("s"), array_deltas("a").alias("d"), array_windows("a", 2, "avg").alias("m"), array_windows("a", 3, "min").alias("l"), subvec("a", 1, 3).alias("v"), subvec("a", 2).alias("w")).collect()
    assert rows[0].asDict() == {"s": [1, 5, 7, 15], "d": [0, 3, -2, 6], "m": [1, 2.5, 3, 5], "l": [1, 1, 1, 2], "v": [4, 2], "w": [2, 8]}
    assert rows[1]["s"] == [] and rows[1]["v"] == []
    assert df.select(pack(F.lit(1), F.lit(2)).alias("p")).first()["p"] == [1, 2]


def test_one_exchange_for_all_functions(spark):
    df = spark.createDataFrame([(1, 1, 1)], "k int, t int, x int")
    out = plain(df, Order.of("t", keys=["k"]), [Vec("a", "sums", "x"), Vec("b", "mins", "x", 3), Vec("c", "deltas", "x")])
    text = out._jdf.queryExecution().sparkPlan().toString()
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1, text
