"""Parts of the dialect that standard SQL has too, and the sources."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriate.engine import Engine
from seriate.sources.files import load_by_header, time_of_day, timestamp_text
from seriate.sources.generate import labelled_vectors, ticks, trades

TABLE = "CREATE TABLE t (a int PRIMARY KEY, b int NOT NULL DEFAULT 3, c string, UNIQUE (b), CHECK (a > 0)); INSERT INTO t VALUES (1, 10, 'x'), (2, 10, 'y'), (3, 20, NULL), (4, 30, 'z'), (5, 30, 'x');"


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.run(TABLE)
    yield e
    e.close()


CASES = [
    ("SELECT DISTINCT ON (b) a, b FROM t ORDER BY a DESC", [(2, 10), (3, 20), (5, 30)]),
    ("SELECT TOP 40 PERCENT a FROM t ORDER BY a", [(1,), (2,)]),
    ("SELECT TOP 1 WITH TIES b FROM t ORDER BY b", [(10,), (10,)]),
    ("SELECT TOP 2 a FROM t ORDER BY a DESC", [(5,), (4,)]),
    ("SELECT a FROM t ORDER BY a OFFSET 3 ROWS FETCH NEXT 1 ROWS ONLY", [(4,)]),
    ("SELECT a FROM t ORDER BY c DESC NULLS LAST, a LIMIT 2", [(4,), (2,)]),
    ("SELECT a::string || '!' AS s, TRY_CAST(c AS int) AS n FROM t WHERE a = 1", [("1!", None)]),
    ("SELECT ARRAY[1, a][1] AS e, MAP['k', a]['k'] AS m, STRUCT(a, b).b AS f FROM t WHERE a = 2", [(2, 2, 10)]),
    ("SELECT transform(ARRAY[1, 2], x -> x + a) AS l FROM t WHERE a = 1", [([2, 3],)]),
    ("SELECT c FROM t WHERE c SIMILAR TO '[xy]' AND c NOT RLIKE 'y' AND a IS NOT DISTINCT FROM 1", [("x",)]),
    ("SELECT CASE b WHEN 10 THEN 'ten' ELSE 'more' END AS w FROM t WHERE a < 4 ORDER BY a", [("ten",), ("ten",), ("more",)]),
    ("SELECT CAST(DATE '2020-01-31' + INTERVAL 1 month AS string) AS d", [("2020-02-29",)]),
    ("SELECT p, e FROM explode(array(7, 8)) WITH ORDINALITY x (e, p) ORDER BY p", [(1, 7), (2, 8)]),
    ("SELECT ordinality, key, value FROM explode(map('a', 5)) WITH ORDINALITY x", [(1, "a", 5)]),
    ("SELECT TOP 2 WITH TIES a, b FROM t ORDER BY b DESC NULLS LAST, c NULLS FIRST", [(5, 30), (4, 30)]),
    ("SELECT TOP 3 WITH TIES b FROM t ORDER BY b", [(10,), (10,), (20,)]),
    ("SELECT TOP 0 PERCENT a FROM t ORDER BY a", []),
    ("SELECT c FROM t WHERE c SIMILAR TO 'x|z' AND NOT c SIMILAR TO '_y%'", [("x",), ("x",), ("z",)]),
    ("SELECT a, v FROM t LATERAL VIEW OUTER explode(array()) x AS v WHERE a = 1", [(1, None)]),
    ("SELECT x.a FROM t x JOIN t y USING (a) WHERE y.b > 10 ORDER BY x.a", [(3,), (4,), (5,)]),
    ("SELECT count(*) AS n FROM t a NATURAL JOIN t b", [(4,)]),
    ("SELECT b, sum(a) AS s FROM t GROUP BY b HAVING sum(a) > 3 ORDER BY 1", [(30, 9)]),
    ("SELECT b AS k, count(*) AS n FROM t GROUP BY b ORDER BY n DESC, k LIMIT 1", [(10, 2)]),
    ("SELECT median(a) AS m, var(a) AS v, stddev(b) AS s FROM t WHERE b = 10", [(1.5, 0.25, 0.0)]),
    ("SELECT truncate(2.5, 0) AS a, truncate(-2.5, 0) AS b, xor(true, false) AS c, missing(NULL) AS d", [(3.0, -3.0, True, True)]),
    ("SELECT 7 % 0 AS a, 1 / 0 AS b, 1 / 4 AS c, 0x1F AS h", [(None, None, 0.25, 31)]),
    ("SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY a) AS p, count(*) FILTER (WHERE b = 10) AS n FROM t", [(3.0, 2)]),
    ("SELECT last_value(c) IGNORE NULLS OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM t ORDER BY a LIMIT 3", [("x",), ("y",), ("y",)]),
    ("(SELECT a FROM t WHERE a < 3) MINUS (SELECT 1) UNION ALL SELECT 9 ORDER BY a", [(2,), (9,)]),
    ("SELECT b, subvec(a, 0, 1) AS v, first(a) AS f FROM t ASSUMING DESC a GROUP BY b ORDER BY b", [(10, [2], 2), (20, [3], 3), (30, [5], 5)]),
    ("SELECT b, distinct(c) AS d FROM t ASSUMING ASC a WHERE b = 30 GROUP BY b", [(30, ["z", "x"])]),
    ("SELECT subvec(a, 1, 3) AS v FROM t ASSUMING DESC a", [(3,), (4,)]),
    ("SELECT `a` AS `odd name` FROM t WHERE a = 1 -- note", [(1,)]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_case(engine, text, want):
    got = [tuple(r) for r in engine.sql(text).collect()]
    assert (got if "ORDER BY" in text and "DISTINCT ON" not in text else sorted(got)) == want


def test_times(spark):
    df = spark.createDataFrame([("01:02:03",), ("23:59:59:999",), ("1:02:03.5",), ("24:00:00",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(time_of_day(F.col("t"))).collect()] == [3723000000, 86399999000, 3723500000, None, None, None]
    stamps = spark.createDataFrame([("2020-01-02 03:04:05:6",), ("2020-01-02 03:04:05.25",), ("bad",)], "t string").select(timestamp_text(F.col("t"))).collect()
    assert [str(r[0]) for r in stamps] == ["2020-01-02 03:04:05.600000", "2020-01-02 03:04:05.250000", "None"]


def test_load_by_header(spark, tmp_path):
    (tmp_path / "f.csv").write_text("B, extra ,a\n2,x,1\n")
    out = load_by_header(spark, str(tmp_path / "f.csv"), [("a", "int"), ("b", "int"), ("c", "string")], [T.IntegerType(), T.IntegerType(), T.StringType()])
    assert [tuple(r) for r in out.collect()] == [(1, 2, None)]


def test_generators(spark, tmp_path):
    df = trades(spark, 20_000, 50)
    counts = [r["count"] for r in df.groupBy("stocksymbol").count().orderBy(F.desc("count")).collect()]
    assert sum(counts) == 20_000 and counts[0] > 5 * counts[-1]
    assert df.where("price NOT BETWEEN 50 AND 500 OR quantity NOT BETWEEN 100 AND 10000").count() == 0
    assert df.orderBy("time").limit(50).collect() == trades(spark, 20_000, 50).orderBy("time").limit(50).collect()
    assert {r[0] for r in ticks(spark, 1000, ["S", "T"]).select("ID").distinct().collect()} == {"S", "T"}
    (tmp_path / "v.txt").write_text("1.5  2 0\n3 4 1\n\nbad\n")
    assert [(list(r["x"]), r["y"]) for r in labelled_vectors(spark, str(tmp_path / "v.txt")).collect()] == [([1.5, 2.0], 0), ([3.0, 4.0], 1)]
