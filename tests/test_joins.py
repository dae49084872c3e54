"""As-of, range and overlap joins against plain loops."""

import math
import random

import pytest

from seriate.operators import scan
from seriate.operators.joins import asof_join, overlap_join, range_join


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("segments", [False, True])
def test_asof(spark, monkeypatch, before, segments):
    if segments:
        monkeypatch.setattr(scan, "SMALL_BYTES", 0)
        monkeypatch.setattr(scan, "HOT_ROWS", 20)
    rnd = random.Random(3)
    left = [(i, rnd.choice(["a", "a", "b", None]), rnd.choice([None, *range(30)])) for i in range(120)] + [(200, "c", 4)]
    right = [(rnd.choice(["a", "a", "b", None]), rnd.choice([None, *range(30)]), n) for n in range(60)]
    got = asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "rk string, rt int, n int"), "t", "rt", [("k", "rk")], "n", before)
    assert got.columns == ["i", "k", "t", "rk", "rt", "n"]
    want = []
    for i, k, t in left:
        fit = [(rt, n, rk) for rk, rt, n in right if k is not None and k == rk and t is not None and rt is not None and (rt < t if before else rt <= t)]
        rt, n, rk = max(fit) if fit else (None, None, None)
        want.append((i, k, t, rk, rt, n))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    empty = asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame([], "rk string, rt int, n int"), "t", "rt", [("k", "rk")])
    assert empty.where("n IS NULL").count() == len(left)


NAN, INF = float("nan"), float("inf")


def test_ranges(spark):
    rnd = random.Random(4)
    points = [(i, rnd.choice(["a", "b", None]), rnd.choice([rnd.uniform(-50, 50), rnd.randint(-5, 5), rnd.uniform(0, 1e9), None, NAN, INF, 0.0])) for i in range(150)]
    points = [(i, k, None if x is None else float(x)) for i, k, x in points]
    ranges = []
    for j in range(80):
        low = rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-5, 5)), -0.0, 1e8, -INF])
        ranges.append((j, rnd.choice(["a", "b"]), low, low + rnd.choice([0.0, 1e-9, 0.5, 7.0, 1e6, 1e12, -1.0, INF])))
    ranges += [(90, "a", None, 1.0), (91, "a", 0.0, NAN), (92, None, 0.0, 1.0)]
    ranges = [(j, k, a, None if b != b else b) if a == -INF else (j, k, a, b) for j, k, a, b in ranges]
    p, r = spark.createDataFrame(points, "i int, k string, x double"), spark.createDataFrame(ranges, "j int, rk string, low double, high double")
    fits = lambda x, a, b: None not in (x, a, b) and not any(math.isnan(v) for v in (x, a, b))
    for by in ((), (("k", "rk"),)):
        want = sorted((i, j) for i, k, x in points for j, rk, a, b in ranges if fits(x, a, b) and a <= x <= b and (not by or k is not None and k == rk))
        assert sorted((q["i"], q["j"]) for q in range_join(p, r, "x", "low", "high", list(by)).collect()) == want
    assert range_join(p, r.limit(0), "x", "low", "high").count() == 0 and range_join(p.limit(0), r, "x", "low", "high").count() == 0
    good = [(j, a, b) for j, _, a, b in ranges if fits(0.0, a, b) and a <= b]
    other = r.toDF("jj", "kk", "alow", "ahigh")
    want = sorted((x[0], y[0]) for x in good for y in good if x[1] <= y[2] and y[1] <= x[2])
    assert sorted((q["j"], q["jj"]) for q in overlap_join(r, other, ("low", "high"), ("alow", "ahigh")).collect()) == want
