"""Programs of the dialect."""

import time

import pytest
from pyspark.sql import functions as F

from seriate.cli import Shell
from seriate.engine import Engine
from seriate.plans import ast as a
from seriate.plans.parser import ParseError, parse
from seriate.plans.render import spark_type

PRICES = [15, 19, 16, 17, 15, 13, 5, 8, 7, 13, 11, 14, 10, 5, 2, 5]
STOCKS = "CREATE TABLE stocks(timestamp INT, price INT) INSERT INTO stocks VALUES " + ", ".join(f"({t},{p})" for t, p in enumerate(PRICES, 1)) + ";"
SALES = "CREATE TABLE sale(Mont INT, sales INT); INSERT INTO sale VALUES (1,100),(4,140),(5,130),(3,140),(2,120);"
PACKETS = "CREATE TABLE network(src varchar(3), dst varchar(3), len int, _time int); INSERT INTO network VALUES ('s1','s2',250,1),('s1','s2',270,20),('s1','s2',235,141),('s2','s1',330,47),('s2','s1',280,150),('s2','s1',305,155);"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    yield e
    e.close()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT min(timestamp * 2 - price) AS m FROM stocks", [(4 - 19,)]),
        ("SELECT max(maxs(price) - price) AS fall FROM stocks ASSUMING ASC timestamp", [(17,)]),
        ("SELECT max(maxs(price) - price) AS fall FROM stocks ASSUMING DESC timestamp", [(9,)]),
        ("SELECT timestamp FROM stocks WHERE price BETWEEN 14 AND 16 AND NOT (timestamp % 2 = 1) ORDER BY timestamp DESC", [(12,)]),
        ("SELECT last(price) - first(price) AS d FROM stocks ASSUMING ASC timestamp", [(-10,)]),
        ("SELECT price FROM stocks ASSUMING DESC timestamp LIMIT 2", [(5,), (2,)]),
        ("SELECT min(ratios(price)) AS r FROM stocks ASSUMING ASC timestamp WHERE timestamp <= 3", [(16 / 19,)]),
        ("SELECT sum(distinct price) AS s, count(distinct price) AS n FROM stocks", [(sum(set(PRICES)), len(set(PRICES)))]),
    ],
)
def test_stocks(engine, text, want):
    engine.run(STOCKS)
    assert rows(engine.sql(text)) == want


def test_aggregates_of_one_value(engine):
    engine.run(STOCKS)
    assert rows(engine.sql("SELECT sum(max(price)) AS a, count(min(price)) AS b, stddev(avg(price)) AS c, avg(sum(price) / 2) AS d FROM stocks")) == [(19, 1, 0, sum(PRICES) / 2)]
    assert rows(engine.sql("SELECT price % 2 AS k, max(price - min(price)) AS a, sum(count(*)) AS n FROM stocks GROUP BY price % 2 ORDER BY k")) == [(0, 14, 5), (1, 14, 11)]


def test_moving_windows(engine):
    engine.run(SALES)
    got = sorted(rows(engine.sql("SELECT Mont, maxs(2, sales) AS m, sums(4, sales) AS s FROM sale ASSUMING ASC Mont")))
    assert got == [(1, 100, 100), (2, 120, 220), (3, 140, 360), (4, 140, 500), (5, 140, 530)]


def test_order_dependent_group_key(engine):
    engine.run(PACKETS)
    got = rows(engine.sql("SELECT dst, src, max(len) AS m, count(len) AS n FROM network ASSUMING ASC dst, ASC src, ASC _time GROUP BY dst, src, sums(deltas(_time) > 100)"))
    assert sorted(got) == [("s1", "s2", 305, 2), ("s1", "s2", 330, 1), ("s2", "s1", 235, 1), ("s2", "s1", 270, 2)] or sorted(got) == [("s1", "s2", 330, 1), ("s1", "s2", 305, 2)] + [("s2", "s1", 270, 2), ("s2", "s1", 235, 1)]


def test_fold_without_keys_in_list(engine):
    engine.run(SALES)
    assert rows(engine.sql("select Mont % 2 AS odd, Mont, mins(2,sales) AS m from sale assuming desc Mont group by Mont % 2 order by odd")) == [(0, [4, 2], [140, 120]), (1, [5, 3, 1], [130, 130, 100])]


def test_functions_of_functions(engine):
    engine.run("""
    FUNCTION share (x, w) { sum(x * w) / sum(w) }
    FUNCTION around (x, w) { middle := share(x, w); off := x - middle; share(off * off, w) }
    FUNCTION tilt (x, y, w) { mx := share(x, w); my := share(y, w); share((x - mx) * (y - my), w) / around(x, w) }
    CREATE TABLE t(g int, a int, b int, w int); INSERT INTO t VALUES (1,1,2,1),(1,2,4,5),(1,3,6,1),(2,1,3,2),(2,2,2,2),(2,3,1,2);""")
    assert [(g, round(c, 9)) for g, c in rows(engine.sql("SELECT g, tilt(a, b, w) AS c FROM t GROUP BY g ORDER BY g"))] == [(1, 2.0), (2, -1.0)]
    got = rows(engine.sql("SELECT tilt(a, b, w) * a AS x, g, sum(a) AS s FROM t ASSUMING ASC a GROUP BY g ORDER BY g"))
    assert [([round(v, 6) for v in x], g, s) for x, g, s in got] == [([2, 4, 6], 1, 6), ([-1, -2, -3], 2, 6)]
    assert round(rows(engine.sql("SELECT around(a, w) AS s FROM t"))[0][0], 6) == round(6 / 13, 6)
    assert sorted(round(x, 6) for (x,) in rows(engine.sql("SELECT a - avg(a) AS c FROM t"))) == [-1, -1, 0, 0, 1, 1]


def test_series_too_long_for_a_task(engine, monkeypatch):
    """The same results when everything is worked on in segments and aggregates are joined back."""
    from seriate.operators import scan

    monkeypatch.setattr(scan, "SMALL_BYTES", 0)
    monkeypatch.setattr(scan, "HOT_ROWS", 3)
    engine.run(STOCKS)
    assert rows(engine.sql("SELECT max(maxs(price) - price) AS m FROM stocks ASSUMING ASC timestamp")) == [(17,)]
    got = rows(engine.sql("SELECT price % 2 AS k, max(sums(price) - avg(price)) AS m FROM stocks ASSUMING ASC timestamp GROUP BY price % 2 ORDER BY k"))
    odd, even = [p for p in PRICES if p % 2], [p for p in PRICES if p % 2 == 0]
    assert [(k, round(m, 6)) for k, m in got] == [(0, round(sum(even) - sum(even) / len(even), 6)), (1, round(sum(odd) - sum(odd) / len(odd), 6))]


def test_function_with_loops(engine):
    engine.run("""
    AGGREGATION FUNCTION twice(x, k) { l := x.len; for (i := 0; i < l; i += 1) { if (x[i] > 2) { _builtin_ret[i] := x[i] * k; } elif (x[i] = 2) _builtin_ret[i] := 0; else { _builtin_ret[i] := -1; } } Null }
    FUNCTION longest(x) { best := 0; run := 0; for (i := 1; i < x.len; i := i + 1) { if (x[i] > x[i - 1]) { run += 1; } else { run := 0; } if (run > best) { best := run; } } best }
    CREATE TABLE t(g int, a int); INSERT INTO t VALUES (1,1),(1,2),(1,3),(2,5);""")
    assert rows(engine.sql("SELECT g, twice(a, 10) AS t FROM t ASSUMING ASC a GROUP BY g ORDER BY g")) == [(1, [-1.0, 0.0, 30.0]), (2, [50.0])]
    assert rows(engine.sql("SELECT longest(a) AS n FROM t ASSUMING ASC a")) == [(3.0,)]


def test_function_bodies(spark):
    import numpy as np

    from seriate.plans.functions import compile_function

    e = Engine(spark)
    e.run("""
    FUNCTION fact(n) { r := 1; for (i := 2, k := 0; i <= n; i += 1, k += 1) r *= i; r }
    FUNCTION calls(x) { static n := 10; n += 1; { n -= 0; } n }
    FUNCTION mix(x, s) { y := x[1:3]; z := x(0, 2); q := x.vec; q2 := y; q2 /= 2; if (not (s > 1) or x[0] = 1 and s <> 3) { sum(y) - first(z) } else { w := 1; } _builtin_ret[0] := w; avg(q2) + fact(3) % 4 }
    AGGREGATION FUNCTION forever(x) { for (i := 0; i < 1; i += 0) { y := x; } y }
    FUNCTION wrong(x) { x[0] + nobody }""")
    assert compile_function("fact", e.functions)(5) == 120
    counted = compile_function("calls", e.functions)
    assert [counted(np.ones(2)) for _ in range(3)] == [11, 12, 13]
    with pytest.raises(UnboundLocalError):
        compile_function("mix", e.functions)(np.array([1.0, 2.0, 4.0]), 2)
    assert compile_function("mix", e.functions)(np.array([2.0, 2.0, 4.0]), 3) == 1.5 + 2
    with pytest.raises(ValueError, match="nobody"):
        compile_function("wrong", e.functions)


def test_nested_windows_and_expressions(engine):
    engine.run(STOCKS)
    got = rows(engine.sql("SELECT max(sums(2, deltas(price))) AS m, min(price) + count(*) AS c FROM stocks ASSUMING ASC timestamp"))
    d = [0] + [b - x for x, b in zip(PRICES, PRICES[1:])]
    assert got == [(max(d[i] + (d[i - 1] if i else 0) for i in range(16)), 2 + 16)]


def test_insertion_order(spark):
    e = Engine(spark, keep_order=True)
    e.run("CREATE TABLE t(x int); INSERT INTO t VALUES (3), (1); INSERT INTO t VALUES (2)")
    assert rows(e.sql("SELECT first(x), last(x), sum(deltas(x)) FROM t")) == [(3, 2, -1)]
    assert e.sql("SELECT * FROM t").columns == ["x"]
    e.close()


def test_order_is_needed(engine):
    engine.run(STOCKS)
    with pytest.raises(ValueError, match="ASSUMING"):
        engine.sql("SELECT sums(price) FROM stocks")


def test_tables(engine):
    engine.run("CREATE TABLE t (a int, b string) INSERT INTO t VALUES (1, 'x'), (2, NULL)")
    engine.run("CREATE TABLE IF NOT EXISTS t (z int); UPDATE t SET a = a + 1 WHERE b IS NULL; DELETE FROM t WHERE a = 1; INSERT INTO t SELECT * FROM t")
    assert rows(engine.sql("SELECT * FROM t")) == [(3, None), (3, None)]
    for bad, error in [("CREATE TABLE t (q int)", "exists"), ("INSERT INTO t VALUES (1)", "columns"), ("DROP TABLE nope", "no table"), ("INSERT INTO t(zz) VALUES (1)", "no column"), ("LOAD DATA INFILE 'x' INTO TABLE nope", "no table")]:
        with pytest.raises(ValueError, match=error):
            engine.run(bad)
    engine.run("DROP TABLE t; DROP TABLE t IF EXISTS")
    assert "t" not in engine.frames


def test_many_inserts_are_written_together(engine):
    engine.run("CREATE TABLE t (a int);" + "".join(f"INSERT INTO t VALUES ({i});" for i in range(40)))
    assert engine.parts["t"] <= 16
    assert rows(engine.sql("SELECT count(*), sum(a) FROM t")) == [(40, 780)]


def test_files(engine, tmp_path):
    (tmp_path / "in.csv").write_text("a, b , c\n 1, x ,2020-01-02\n\n2, ,bad\n,z,2021-12-31\n")
    (tmp_path / "nested.csv").write_text("a,b,c\n1, 2; 3.5 ;-1e2,7\n2,,8\n")
    engine.run(f"CREATE TABLE t (n int, s string, d date); LOAD DATA INFILE '{tmp_path}/in.csv' INTO TABLE t FIELDS TERMINATED BY ','")
    assert sorted(map(str, rows(engine.sql("SELECT n, s, CAST(d AS string) FROM t")))) == sorted(map(str, [(1, "x", "2020-01-02"), (2, None, None), (None, "z", "2021-12-31")]))
    engine.run(f"CREATE TABLE f (a float, b vecfloat, c int); LOAD COMPLEX DATA INFILE '{tmp_path}/nested.csv' INTO TABLE f FIELDS TERMINATED BY ',' ELEMENT TERMINATED BY ';'")
    assert rows(engine.sql("SELECT * FROM f ORDER BY c")) == [(1.0, [2.0, 3.5, -100.0], 7), (2.0, None, 8)]
    engine.run(STOCKS + f"SELECT timestamp, sums(price) AS s FROM stocks ASSUMING DESC timestamp INTO OUTFILE '{tmp_path}/out' FIELDS TERMINATED BY ';'")
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[:3] == ["timestamp;s", "16;5", "15;7"]


def test_joins_strip_equal_columns(engine):
    engine.run("CREATE TABLE x (a int, b int); CREATE TABLE y (c int, d int); INSERT INTO x VALUES (1, 10), (2, 20); INSERT INTO y VALUES (1, 5), (1, 6)")
    assert engine.sql("SELECT * FROM x, y WHERE x.a = y.c").columns == ["a", "b", "d"]
    assert engine.sql("SELECT y.* FROM x, y WHERE x.a = y.c").columns == ["c", "d"]
    assert sorted(rows(engine.sql("SELECT a, sums(d) AS s FROM x JOIN y ON a = c ASSUMING ASC d"))) == [(1, 5), (1, 11)]
    assert sorted(rows(engine.sql("SELECT a, d FROM x LEFT JOIN y ON a = c"))) == [(1, 5), (1, 6), (2, None)]


def test_ordered_subqueries_and_ctes(engine):
    engine.run(STOCKS)
    assert rows(engine.sql("SELECT max(d) AS m FROM (SELECT deltas(price) AS d FROM stocks ASSUMING ASC timestamp) x")) == [(6,)]
    assert rows(engine.sql("WITH s AS (SELECT timestamp, sums(price) AS t FROM stocks ASSUMING ASC timestamp) SELECT t FROM s WHERE timestamp = 3")) == [(50,)]
    assert sorted(rows(engine.sql("SELECT first(price) AS p FROM stocks ASSUMING ASC timestamp UNION ALL SELECT last(price) FROM stocks ASSUMING ASC timestamp"))) == [(5,), (15,)]
    assert rows(engine.sql("SELECT price % 2 AS k, max(sums(price)) AS m FROM stocks ASSUMING ASC timestamp GROUP BY price % 2 HAVING count(*) > 5 ORDER BY m DESC LIMIT 1")) == [(1, sum(p for p in PRICES if p % 2))]


def test_modules(engine, tmp_path, monkeypatch):
    (tmp_path / "mymod.py").write_text(
        "from seriate.plans.modules import module_function\nimport pandas as pd\n"
        "def mydiv(a: pd.Series, b: pd.Series) -> pd.Series:\n    return a / b\n"
        "@module_function('table')\ndef upto(n):\n    for i in range(n or 0):\n        yield i, i * i\n"
        "@module_function('table')\ndef letters(s):\n    yield from s or ''\n"
        "@module_function('vector')\ndef spanof(x):\n    return float(x.max() - x.min())\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    engine.spark.sparkContext.addPyFile(str(tmp_path / "mymod.py"))
    engine.run("LOAD MODULE FROM 'mymod' FUNCTIONS (mydiv(a:int, b:int) -> double, spanof(x:vecdouble) -> double)" + STOCKS)
    assert rows(engine.sql("SELECT spanof(price) AS s FROM stocks ASSUMING ASC timestamp")) == [(17.0,)]
    assert sorted(rows(engine.sql("SELECT mydiv(price, 2) AS h FROM stocks WHERE timestamp < 3"))) == [(7.5,), (9.5,)]
    engine.run("LOAD MODULE FROM 'mymod' FUNCTIONS (upto(n:int) -> struct<i: int, square: int>, letters(s:string) -> string)")
    assert rows(engine.sql("SELECT i, square FROM upto(3) u ORDER BY i")) == [(0, 0), (1, 1), (2, 4)]
    assert sorted(rows(engine.sql("SELECT timestamp, square FROM stocks JOIN LATERAL upto(price) u WHERE timestamp < 3 AND i > 16"))) == [(2, 289), (2, 324)]
    assert rows(engine.sql("SELECT value FROM letters('abc') l ORDER BY value DESC")) == [("c",), ("b",), ("a",)]
    with pytest.raises(ValueError, match="no function"):
        engine.run("LOAD MODULE FROM 'mymod' FUNCTIONS (absent(a:int) -> int)")


def test_procedures_and_triggers(spark, tmp_path):
    e = Engine(spark, procedures=str(tmp_path))
    e.run("CREATE TABLE t (a int)")
    e.run("PROCEDURE one RECORD")
    e.run("SELECT count(*) FROM t")
    e.run("PROCEDURE one STOP; PROCEDURE one SAVE; PROCEDURE one REMOVE")
    assert rows(e.sql("PROCEDURE DISPLAY")) == []
    e.run("PROCEDURE one LOAD")
    assert e.call_procedure("one") == 0
    calls = []
    e.define("act", lambda engine: calls.append(len(calls)))
    e.define("always", lambda engine: 1)
    e.run("CREATE TRIGGER c ON t ACTION act WHEN one; INSERT INTO t VALUES (1)")
    assert calls == [0]
    with pytest.raises(ValueError, match="exists"):
        e.run("CREATE TRIGGER c ON t ACTION act WHEN one")
    with pytest.raises(ValueError, match="no procedure"):
        e.run("CREATE TRIGGER d ON t ACTION nothing WHEN one")
    e.run("INSERT INTO t SELECT a FROM t; DROP TRIGGER c; INSERT INTO t VALUES (2)")
    assert calls == [0]
    e.run("CREATE TRIGGER i ACTION act INTERVAL 100")
    end = time.time() + 20
    while len(calls) < 3 and time.time() < end:
        time.sleep(0.05)
    e.close()
    n = len(calls)
    assert n >= 3
    time.sleep(0.5)
    assert len(calls) == n


def test_parser():
    assert parse("SELECT 2x + 1 FROM t")[0].query.items[0].value == a.Op("+", (a.Op("*", (a.Lit(2, "number"), a.Name(("x",)))), a.Lit(1, "number")))
    assert parse("select a = null")[0].query.items[0].value == a.Op("is null", (a.Name(("a",)),))
    assert parse("-- c\n# d\n/* e */ select 1.5e3")[0].query.items[0].value == a.Lit(1500.0, "number")
    assert parse("select a or b and not c = 1")[0].query.items[0].value.op == "or"
    for bad in ("SELECT", "SELECT a FROM t ASSUMING a", "FOO", "SELECT ^", "CREATE THING x", "SELECT a FROM t GROUP"):
        with pytest.raises(ParseError):
            parse(bad)


def test_types():
    assert [spark_type(t) for t in ("INT64", "vecvecdouble", "VARCHAR(10)", "hugeint", "decimal(10,2)", "Time", "timestamp", "vecint64")] == ["bigint", "array<array<double>>", "string", "decimal(38,0)", "decimal(10,2)", "bigint", "timestamp_ntz", "array<bigint>"]
    with pytest.raises(ValueError):
        spark_type("geometry3")


def test_shell(spark, tmp_path):
    said = []
    (tmp_path / "p.a").write_text("CREATE TABLE t(a int)\nINSERT INTO t VALUES (7)")
    shell = Shell(Engine(spark), said.append)
    assert shell.lines([f"f {tmp_path / 'p.a'}", "SELECT a FROM t", "print", "exec", "list table", "stats on", "r SELECT 1 AS one", "stats", "parse SELECT 1", "echo hi", "# note", f"save {tmp_path}/s", "r SELECT nope FROM t", "help", "stats reset"])
    assert any("7" in s for s in said) and "hi" in said and "t(a int)" in said
    assert not shell.command("exit")


def test_create_table_as_is_a_snapshot(engine, tmp_path):
    path = str(tmp_path / "f")
    engine.spark.range(3).write.parquet(path)
    engine.add_table("src", engine.spark.read.parquet(path))
    engine.run("CREATE TABLE t AS SELECT id, rand() AS r, NULL AS n FROM src; CREATE TABLE u (a bigint, b bigint); INSERT INTO u SELECT id, id FROM src")
    before = sorted(rows(engine.sql("SELECT * FROM t")))
    engine.spark.range(3, 9).write.mode("append").parquet(path)
    assert sorted(rows(engine.sql("SELECT * FROM t"))) == before and rows(engine.sql("SELECT count(*) FROM u")) == [(3,)]


def test_passthrough_leaves_views_of_the_user(engine):
    engine.spark.range(5).createOrReplaceTempView("mine")
    engine.run("CREATE TABLE mine (a int); INSERT INTO mine VALUES (7); CREATE TABLE other (a int)")
    assert rows(engine.sql("<sql> SELECT a FROM mine </sql>")) == [(7,)]
    assert engine.spark.table("mine").count() == 5 and not engine.spark.catalog.tableExists("other")
    engine.spark.catalog.dropTempView("mine")


def test_arrays_of_functions():
    import numpy as np

    from seriate.plans.functions import _ARRAY

    x = np.array([3.0, -1.0, 4.0, 1.0, -5.0, 9.0, 2.0])
    plain = {"sums": np.sum, "avgs": np.mean, "mins": np.min, "maxs": np.max, "vars": np.var, "stddevs": np.std}
    for name, f in plain.items():
        for w in (None, 1, 2, 5, 7, 50):
            want = [f(x[max(0, i + 1 - w) if w else 0 : i + 1]) for i in range(len(x))]
            assert np.allclose(_ARRAY[name](x) if w is None else _ARRAY[name](w, x), want), (name, w)
        assert len(_ARRAY[name](np.empty(0))) == 0 and len(_ARRAY[name](3, np.empty(0))) == 0


def test_forest(spark):
    from seriate.models import forest

    n = 1200
    df = spark.range(n).select(F.array(*[(F.abs(F.xxhash64("id", F.lit(i))) % 1000 / 1000.0) for i in range(4)]).alias("x"), F.col("id"))
    df = df.select("x", F.when(F.col("x")[0] + F.col("x")[1] > 1, 1).otherwise(0).alias("y"))
    e = Engine(spark)
    e.add_table("source", df).add_table("few", df.limit(0))
    e.run("LOAD MODULE FROM 'seriate.models.forest' FUNCTIONS (newtree(t:int, f:int64, g:double, c:int64, e:int) -> bool, fit_inc(X:vecdouble, y:int64) -> bool, fit(X:vecdouble, y:int64) -> bool, predict(X:vecdouble) -> int, test(X:vecdouble, y:int64) -> double)")
    assert rows(e.sql("SELECT newtree(10, 4, 0.3, 2, 1)")) == [(True,)]
    assert rows(e.sql("SELECT fit_inc(x, y) FROM source")) == [(True,)]
    assert rows(e.sql("SELECT fit_inc(x, y) FROM source")) == [(False,)]
    assert rows(e.sql("SELECT test(x, y) FROM source"))[0][0] < 0.1
    assert rows(e.sql("SELECT avg(CAST(predict(x) = y AS int)) AS a FROM source"))[0][0] > 0.9
    e.sql("SELECT fit(x, y) FROM source").collect()
    assert abs(forest.student_t_tail(2.0, 10) - 0.03669) < 1e-4 and forest.student_t_tail(0.0, 5) == 0.5
