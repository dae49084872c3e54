"""The cleaning operators against brute force, on small tables with nulls, ties, repeats, hot keys and odd columns."""

import datetime as dt
import random
import re
import statistics

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seriate import cleaning
from seriate.operators import anomaly
from seriate.operators.anomaly import Reading, exact_medians, implausible_readings
from seriate.operators.dedupe import once_per_id
from seriate.operators.latest import latest_report
from seriate.operators.skew import heavy_keys, look_up, salted_aggregate
from seriate.operators.trailing import SHARD, build_trees, correct_trees, period_totals, trailing_totals
from seriate.sources.delimited import rejected_lines, trip_fields, typed_rows

GOOD = "1,2/2/2009 14:44,2/2/2009 15:07,1,3.77,1,N,101,43,1,13.5,0.5,0.5,2.91,0,0.3,17.71"


def with_field(i, value):
    cells = GOOD.split(",")
    cells[i] = value
    return ",".join(cells)


LINES = [
    (GOOD, None),
    (GOOD + "\r", None),
    (GOOD.replace(",", " ,\t"), None),
    (",".join(f' " {c} " ' for c in GOOD.split(",")), None),
    (with_field(1, "02/29/2008 00:00"), None),
    (with_field(2, ""), None),
    (with_field(2, '""'), None),
    (with_field(5, "99"), None),
    (with_field(7, "007"), None),
    (with_field(10, "-8.5"), None),
    (",".join([*GOOD.split(",")[:2], *[""] * 15]), None),
    ("", "column_count"),
    (None, "column_count"),
    ("\r", "column_count"),
    (GOOD + ",", "column_count"),
    (GOOD.replace(",", ";"), "column_count"),
    (GOOD.rpartition(",")[0], "column_count"),
    ('"' + GOOD, "quoting"),
    (with_field(6, '"N"x'), "quoting"),
    (with_field(6, 'N"'), "quoting"),
    (with_field(6, '"N""'), "quoting"),
    (with_field(6, '"N'), "quoting"),
    (GOOD + ',"', "quoting"),
    (with_field(6, '"N"""'), "value"),
    (with_field(6, '"N,Y"'), "value"),
    (with_field(0, ""), "value"),
    (with_field(0, "3"), "value"),
    (with_field(1, ""), "value"),
    (with_field(1, "2/29/2009 10:00"), "value"),
    (with_field(1, "4/31/2009 10:00"), "value"),
    (with_field(1, "13/1/2009 10:00"), "value"),
    (with_field(1, "2/2/2009 24:00"), "value"),
    (with_field(1, "2/2/2009 1:5"), "value"),
    (with_field(1, "2/2/09 1:05"), "value"),
    (with_field(1, "2/29/1900 1:05"), "value"),
    (with_field(1, "1/1/0000 1:05"), "value"),
    (with_field(3, "-1"), "value"),
    (with_field(3, "1.0"), "value"),
    (with_field(4, "1e5"), "value"),
    (with_field(4, ".5"), "value"),
    (with_field(4, "5."), "value"),
    (with_field(5, "7"), "value"),
    (with_field(6, "y"), "value"),
    (with_field(7, "0"), "value"),
    (with_field(7, "266"), "value"),
    (with_field(9, "1 2"), "value"),
    (with_field(16, "NaN"), "value"),
    (with_field(16, "1\n"), "value"),
    ("x" * 300_000, "column_count"),
    ("," * 300_000, "column_count"),
    ('"' + '""' * 200_000, "quoting"),
    (with_field(4, "1" * 100_000), None),
    (with_field(3, "99999999999"), None),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, line, "x", "y", 5) for i, (line, _) in enumerate(LINES)], "raw_id int, raw_line string, reason string, VendorID string, __other int")
    got = {r["raw_id"]: r["reason"] for r in rejected_lines(df, "raw_line", trip_fields()).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(LINES) if reason}
    loaded = {r["raw_id"]: r for r in typed_rows(df, "raw_line", trip_fields(), ["raw_id"]).collect()}
    assert set(loaded) == {i for i, (_, reason) in enumerate(LINES) if reason is None}
    for i in range(4):
        assert loaded[i]["tpep_pickup_datetime"] == dt.datetime(2009, 2, 2, 14, 44) and loaded[i]["total_amount"] == 17.71 and loaded[i]["store_and_fwd_flag"] == "N"
    assert loaded[4]["tpep_pickup_datetime"] == dt.datetime(2008, 2, 29) and loaded[5]["tpep_dropoff_datetime"] is None and loaded[10]["total_amount"] is None
    assert {i for i, r in loaded.items() if r["out_of_range"]} == {len(LINES) - 1} and loaded[len(LINES) - 1]["out_of_range"] == "passenger_count"
    fields = {r["raw_id"]: r["broken_field"] for r in rejected_lines(df, "raw_line", trip_fields()).collect()}
    assert fields[LINES.index((with_field(0, "3"), "value"))] == "VendorID" and fields[LINES.index((with_field(16, "NaN"), "value"))] == "total_amount" and fields[11] is None


def test_lines_random_dates(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(3000):
        y, m, d = rnd.randint(1, 3000), rnd.randint(0, 13), rnd.randint(0, 32)
        try:
            dt.date(y, m, d)
            ok = True
        except ValueError:
            ok = False
        rows.append((i, with_field(1, f"{m}/{d}/{y:04d} 5:07"), ok))
    df = spark.createDataFrame(rows, "raw_id int, raw_line string, ok boolean")
    bad = {r["raw_id"] for r in rejected_lines(df, "raw_line", trip_fields()).collect()}
    assert bad == {i for i, _, ok in rows if not ok}


def test_once_per_id(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, None, "c"), (None, 7, "d")], "id int, x int, at string")
    assert sorted((r["id"], r["x"]) for r in once_per_id(df, "id", ["x"]).collect()) == [(1, 5), (2, None)]
    assert once_per_id(df, "id", []).count() == 2
    assert once_per_id(df.limit(0), "id", ["x"]).count() == 0


def test_salted_aggregate(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([1, 1, 1, 1, 1, None, rnd.randint(2, 50)]), rnd.choice([None, rnd.randint(-5, 100)])) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, k int, x int").withColumn("__salt", F.lit(9)).withColumn("n", F.lit("clash"))
    heavy = heavy_keys(df, ["k"], 0.1)
    assert {r["k"] for r in heavy.collect()} == {1, None}
    aggs = {"n": ("count_all", None), "known": ("count", "x"), "total": ("sum", "x"), "low": ("min", "x"), "high": ("max", "x"), "mean": ("mean", "x")}
    got = {r["k"]: r for r in salted_aggregate(df, ["k"], aggs, heavy, "id", salts=4).collect()}
    for k in {r[1] for r in rows}:
        x = [r[2] for r in rows if r[1] == k]
        known = [v for v in x if v is not None]
        r = got[k]
        assert (r["n"], r["known"], r["total"], r["low"], r["high"]) == (len(x), len(known), sum(known) if known else None, min(known, default=None), max(known, default=None))
        assert r["mean"] is None if not known else abs(r["mean"] - statistics.mean(known)) < 1e-9
    empty = df.limit(0)
    assert salted_aggregate(empty, ["k"], aggs, heavy_keys(empty, ["k"], 0.1), "id").count() == 0


def test_salting_spreads_a_heavy_key(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("k"))
    plan = salted_aggregate(df, ["k"], {"n": ("count_all", None)}, heavy_keys(df, ["k"], 0.5), "id", salts=8)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in text and not re.search(r"\brand\(", text) and len(re.findall(r"Aggregate \[k#\d+L, __salt", text)) == 1


def found(rows, ratio=10.0, run=8):
    """The definition, by loops."""
    out, meters = set(), {}
    for trip, meter, start, end, *x in sorted({r for r in rows if None not in r[:3]}, key=lambda r: (r[1], r[2], r[0])):
        meters.setdefault(meter, []).append((trip, start, end, x))
    for series in meters.values():
        for k, name in enumerate(("d", "f", "p")):
            values = [(t, a, b, x[k]) for t, a, b, x in series if x[k] is not None]
            level = statistics.median([v for *_, v in values if v > 0]) if any(v > 0 for *_, v in values) else None
            i = 0
            while i < len(values):
                j = i
                while j < len(values) and values[j][3] == values[i][3]:
                    j += 1
                for t, a, b, v in values[i:j]:
                    fast = name == "d" and b is not None and b > a and v * 3600 > 200 * (b - a).total_seconds()
                    if v < 0 or (level and v >= ratio * level) or fast or (name != "p" and v > 0 and j - i >= run):
                        out.add((t, name))
                i = j
    return out


def random_trips(seed, hot):
    rnd = random.Random(seed)
    base = dt.datetime(2009, 1, 1)
    rows, trip = [], 0
    for meter in range(12):
        level = rnd.choice([1.0, 3.0, 20.0])
        stuck = None
        for _ in range(hot if meter == 5 else rnd.choice([1, 3, 60, 200])):
            trip += 1
            start = base + dt.timedelta(minutes=rnd.randint(0, 40000))
            end = rnd.choice([None, start, start + dt.timedelta(minutes=rnd.randint(1, 50)), start - dt.timedelta(minutes=5)])
            x = []
            for _k in range(3):
                v = round(level * rnd.lognormvariate(0, 0.6), 1)
                r = rnd.random()
                v = None if r < 0.1 else -v if r < 0.12 else v * rnd.choice([9, 10, 12]) if r < 0.15 else 0.0 if r < 0.2 else v
                x.append(v)
            if rnd.random() < 0.05:
                stuck = None if stuck else round(level, 1)
            if stuck:
                x[0] = stuck
            row = (trip, meter, start, end, *x)
            rows += [row] * rnd.choice([1, 1, 1, 2])
    rnd.shuffle(rows)
    return rows


SCHEMA = "trip long, meter int, a timestamp_ntz, b timestamp_ntz, d double, f double, p double"
FIELDS = [Reading("d", per_hour=200.0), Reading("f"), Reading("p", stuck=False)]


@pytest.mark.parametrize(("seed", "hot", "stretch"), [(1, 50, 1_000_000), (2, 3000, 1_000_000), (3, 400, 7), (4, 900, 50)])
def test_implausible_readings(spark, seed, hot, stretch):
    rows = random_trips(seed, hot)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pid", F.lit("clash")).withColumn("source", F.lit(1))
    got = implausible_readings(df, "meter", "a", "trip", FIELDS, end_time="b", stretch_rows=stretch).where("negative or too_fast or stuck or far").collect()
    assert len(got) == len({(r["trip"], r["field_name"]) for r in got})
    assert {(r["trip"], r["field_name"]) for r in got} == found(rows)


def test_long_stuck_run_over_many_stretches(spark):
    base = dt.datetime(2009, 1, 1)
    rows = [(i, 1, base + dt.timedelta(minutes=i), None, 2.0 if 100 <= i < 3900 else float(i % 7 + 1), None, 1.0) for i in range(4000)]
    got = implausible_readings(spark.createDataFrame(rows, SCHEMA), "meter", "a", "trip", FIELDS, end_time="b", stretch_rows=300).where("stuck").collect()
    assert {(r["trip"], r["field_name"]) for r in got} == {t for t in found(rows) if t[1] == "d"}


def test_readings_edge_cases(spark):
    base = dt.datetime(2009, 1, 1)
    rows = [(1, 1, base, base, None, 0.0, None), (2, None, base, base, -1.0, 1.0, 1.0), (3, 2, None, base, -1.0, 1.0, 1.0), (None, 2, base, base, -1.0, 1.0, 1.0), (5, 3, base, base, float("nan"), -2.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = implausible_readings(df, "meter", "a", "trip", FIELDS, end_time="b").where("negative or far or stuck or too_fast").collect()
    assert [(r["trip"], r["field_name"]) for r in got] == [(5, "f")]
    assert implausible_readings(df.limit(0), "meter", "a", "trip", FIELDS, end_time="b").count() == 0
    with pytest.raises(ValueError, match="ratio"):
        implausible_readings(df, "meter", "a", "trip", FIELDS, ratio=2)


def test_model_sees_every_far_reading():
    """The bound on candidates and prediction: any reading of the guaranteed multiple of the level is a candidate."""
    import numpy as np

    rnd = np.random.default_rng(3)
    for _ in range(50):
        n = int(rnd.integers(1, 300))
        x = np.where(rnd.random(n) < 0.3, rnd.lognormal(0, 3, n), rnd.lognormal(0, 0.5, n))
        group = np.sort(rnd.integers(0, 3, n))
        group = np.unique(group, return_inverse=True)[1]
        level = anomaly.segment_median(x, group, group.max() + 1)
        _, score, candidate = anomaly.fit_series(x, group, level)
        far = x >= anomaly.LEVEL_GUARANTEE * level[group]
        assert (candidate[far] > 1).all() and np.isfinite(score).all()


def test_level_shift_is_told_from_spikes():
    import numpy as np

    x = np.r_[np.full(100, 1.0), np.full(60, 9.0)] + np.random.default_rng(1).normal(0, 0.02, 160)
    x[30] = 12.0
    raw, score, _ = anomaly.fit_series(x, np.zeros(160, int), np.array([1.0]))
    assert raw[30] > 1 and score[30] > 1
    assert (raw[110:] > 1).all() and (score[110:] <= 1).mean() > 0.9


def test_any_number_of_level_shifts_is_taken_out():
    import numpy as np

    regimes = [1.0, 9.0, 20.0, 9.0, 30.0, 12.0, 25.0, 1.0, 14.0]
    x = np.repeat(regimes, 100) + np.random.default_rng(2).normal(0, 0.02, 900)
    x[450] = 90.0
    raw, score, _ = anomaly.fit_series(x, np.zeros(900, int), np.array([1.0]))
    high = np.repeat(np.array(regimes) > 8, 100)
    assert (raw[high] > 1).all() and score[450] > 1
    assert all((score[i : i + 100] <= 1).mean() > 0.9 for i in range(0, 900, 100))


@pytest.mark.parametrize("stretch", [7, 90])
def test_model_does_not_depend_on_stretches(spark, stretch):
    """A meter with level shifts, spikes and gaps in several stretches is fitted as one series."""
    import numpy as np

    rnd = np.random.default_rng(4)
    x = np.repeat([1.0, 9.0, 1.0, 12.0, 25.0], [250, 80, 150, 60, 60]) * rnd.lognormal(0, 0.1, 600)
    x[[20, 200, 330, 590]] *= 30
    base = dt.datetime(2009, 1, 1)
    rows = [(i, 1 if i < 560 else 2, base + dt.timedelta(minutes=i), None, None if i % 9 == 0 else float("nan") if i % 50 == 1 else float(v), float(rnd.lognormal(0, 1)), None if i > 30 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    flags = lambda n: {tuple(r) for r in implausible_readings(df, "meter", "a", "trip", FIELDS, end_time="b", stretch_rows=n).collect()}
    whole = flags(1_000_000)
    assert flags(stretch) == whole
    assert sum(r[-3] for r in whole) > 100


def test_exact_medians(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, None), (1, 1.0), (1, 8.0), (2, None), (None, 4.0)], "k int, x double")
    assert {r["k"]: r["median"] for r in exact_medians(df, ["k"], "x").collect()} == {1: 2.0, None: 4.0}


def windows_by_loops(values, w):
    """Totals and counts per entity and period over the trailing w periods."""
    out = {}
    for e in {e for e, _, _ in values if e is not None}:
        mine = [(p, v) for f, p, v in values if f == e and p is not None]
        if not mine:
            continue
        for p in range(min(p for p, _ in mine), max(p for p, _ in mine) + 1):
            part = [v for q, v in mine if p - w < q <= p and v is not None]
            out[(e, p)] = (sum(part), len(part))
    return out


def totals(df, w):
    return {(r["entity_id"], r["period"]): (r[f"total_{w}"], r[f"n_{w}"]) for r in df.collect()}


def test_trailing_totals(spark):
    rnd = random.Random(6)
    values = [(rnd.choice([1, 2, 3, 4, None]), rnd.choice([None, rnd.randint(-200, 500)]), rnd.choice([None, rnd.randint(-9, 99)])) for _ in range(300)] + [(9, 1000, None), (8, -3, 5)]
    df = spark.createDataFrame(values, "e int, p int, v int").withColumn("shard", F.lit("clash"))
    trees = build_trees(period_totals(df, "e", "p", "v"))
    widths = [1, 7, 30, SHARD, SHARD + 1, SHARD + 2, 90, 2 * SHARD + 1, 200, 365, 5000]
    for some in (widths, [90], [1]):
        out = trailing_totals(trees, some)
        for w in some:
            assert totals(out, w) == windows_by_loops(values, w)
    with pytest.raises(ValueError):
        trailing_totals(trees, [0])
    assert trailing_totals(build_trees(period_totals(df.limit(0), "e", "p", "v")), [7]).count() == 0


def test_corrections_change_leaf_and_ancestors_only(spark):
    values = [(1, p, p % 5) for p in range(0, 150)]
    fixes = [(1, 10, 100, 1), (1, 10, -7, 0), (1, 130, 50, 2), (None, 5, 1, 1), (1, None, 1, 1)]
    trees = build_trees(period_totals(spark.createDataFrame(values, "e int, p int, v int"), "e", "p", "v"))
    fixed = correct_trees(trees, spark.createDataFrame(fixes, "entity_id long, period long, total long, n long"))
    before, after = ({(r["entity_id"], r["shard"]): r for r in t.collect()} for t in (trees, fixed))
    assert before.keys() == after.keys()
    changed = {k: [i for i in range(2 * SHARD) if before[k]["sums"][i] != after[k]["sums"][i]] for k in before}
    line = lambda slot: sorted((slot + SHARD) >> s for s in range(SHARD.bit_length()))
    assert changed == {(1, 0): [n for n in line(10) if n], (1, 1): [], (1, 2): [n for n in line(130 % SHARD) if n]}
    want = windows_by_loops([*values, (1, 10, 93), (1, 130, 50)], 30)
    assert {k: t for k, (t, _) in totals(trailing_totals(fixed, [30]), 30).items()} == {k: t for k, (t, _) in want.items()}


@pytest.mark.parametrize("late", [[(1, 155, 50)], [(1, 300, 50), (1, -70, 4)], [(3, 40, 1)], [(5, -3, 4), (5, 200, 1), (1, 20, 1)]])
def test_corrections_widen_the_calendar(spark, late):
    values = [(1, p, p % 5) for p in range(0, 150)] + [(3, 70, 2)]
    trees = build_trees(period_totals(spark.createDataFrame(values, "e int, p int, v int"), "e", "p", "v"))
    fixed = correct_trees(trees, spark.createDataFrame([(*f, 1) for f in late], "entity_id long, period long, total long, n long"))
    assert totals(trailing_totals(fixed, [30]), 30) == windows_by_loops([*values, *late], 30)


def test_latest_report(spark):
    rows = [(1, 1, 5, "2020-01-01"), (1, 1, None, "2020-01-02"), (1, 2, 7, None), (1, 2, 8, None), (1, 3, None, "2020-01-01"), (1, 3, 4, "2020-01-01"), (None, 1, 2, "2020-01-01")]
    df = spark.createDataFrame(rows, "s int, m int, x int, at string")
    assert {(r["s"], r["m"]): r["x"] for r in latest_report(df, ["s", "m"], "at", "x").collect()} == {(1, 1): None, (1, 2): 8, (1, 3): 4, (None, 1): 2}


@pytest.mark.parametrize("name", sorted(cleaning.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("nyctx100", "nyctx100_raw", "moving_avg"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cleaning.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_planted_spikes_and_shifts():
    """Recall and precision of the model's own flags on autocorrelated meters with planted spikes and level shifts."""
    import numpy as np

    rnd = np.random.default_rng(11)
    meters, n = 60, 600
    x, spikes, shifted = [], np.zeros((meters, n), bool), np.zeros((meters, n), bool)
    for m in range(meters):
        noise = rnd.normal(0, 0.12, n)
        for t in range(1, n):
            noise[t] += 0.5 * noise[t - 1]
        v = rnd.choice([1.0, 4.0, 30.0]) * np.maximum(0.05, 1 + noise)
        if m % 2:
            a = int(rnd.integers(100, 400))
            shifted[m, a : a + 150] = True
            v[shifted[m]] *= rnd.choice([4.0, 8.0])
        at = rnd.choice(n, 6, replace=False)
        spikes[m, at] = True
        v[at] *= rnd.choice([5.0, 12.0, 40.0], 6)
        x.append(v)
    group = np.repeat(np.arange(meters), n)
    level = np.array([np.median(v) for v in x])
    raw, score, _ = anomaly.fit_series(np.concatenate(x), group, level)
    spike, shift = score > 1, (score <= 1) & (raw > 1)
    spikes, shifted = spikes.ravel(), shifted.ravel() & ~spikes.ravel()
    figures = {
        "spike recall": (spike & spikes).sum() / spikes.sum(), "spike precision": (spike & spikes).sum() / spike.sum(),
        "shift recall": (shift & shifted).sum() / shifted.sum(), "shift precision": (shift & shifted).sum() / shift.sum(),
    }
    print({k: round(float(v), 3) for k, v in figures.items()})
    assert min(figures.values()) > 0.9, figures


def test_look_up_leaves_hot_keys_where_they_are(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, i) for i in range(600)]
    left = spark.createDataFrame(rows, "k int, x int")
    right = spark.createDataFrame([(None, "n"), (7, "seven"), (8, "eight"), (5000, "far")], "k int, y string")
    got = look_up(left, right, ["k"], 0.2)
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in [Row(k=k, x=x, y={None: "n", 7: "seven", 8: "eight"}.get(k)) for k, x in rows])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert look_up(left.limit(0), right, ["k"]).count() == 0 and look_up(left, right.limit(0), ["k"]).where("y IS NULL").count() == 600
