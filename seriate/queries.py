"""Queries over the test tables, one or more for every operator, through the fluent interface and the text dialect; with SQL to compare them."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriate.engine import Engine
from seriate.operators.fold import flatten
from seriate.operators.joins import asof_join, overlap_join, range_join
from seriate.operators.ordered import OrderedFrame
from seriate.session import shared_folder
from seriate.sources.files import load_by_header, write_delimited
from seriate.streaming.running import run_stream, running_stream, session_stream, window_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "nyctx100", "moving_avg", "network", "historicquotes"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query, with the SQL that gives the same rows."""

    def mark(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return mark


def engine(spark: SparkSession, sf: str, *names: str, **options) -> Engine:
    e = Engine(spark, **options)
    for n in names:
        e.add_table(n, table(spark, sf, n))
    return e


def text_query(name: str, tables: list[str], program: str, sql: str | None = None) -> None:
    """Register a program of the dialect."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return engine(spark, sf, *tables).sql(program)

    run.__name__, run.__doc__ = name, program
    query(sql)(run)


_CENTS = "CAST(ROUND(value * 100) AS BIGINT)"


def events(spark: SparkSession, sf: str) -> OrderedFrame:
    """Events per user in time order, values in cents."""
    df = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return OrderedFrame(df).assuming("ts", "event_id").group("user_id")


def whole_events(spark: SparkSession, sf: str) -> OrderedFrame:
    return events(spark, sf).group()


# Vector functions per user

_EV = f"ev AS (SELECT event_id, ts, user_id, event_type, {_CENTS} AS v FROM events)"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_RUNNING = {"sums": ("CAST(sum(v) {} AS BIGINT)", None), "avgs": ("avg(v) {}", None), "mins": ("min(v) {}", None), "maxs": ("max(v) {}", None), "vars": ("var_pop(v) {}", 5), "stddevs": ("stddev_pop(v) {}", 4)}


def _frame(w: int | None) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS {'UNBOUNDED' if w is None else w - 1} PRECEDING)"


def _vector_query(name: str, function: str, w: int | None, far: bool, whole: bool = False) -> None:
    sql, digits = _RUNNING[function]
    over = _frame(w).replace("PARTITION BY user_id ", "") if whole else _frame(w)
    text = sql.format(over)
    # Variances of whole numbers are often halfway between two rounded values; their logarithms aren't.
    if function == "vars":
        text, digits = f"ln(1 + {text})", 9

    def run(spark: SparkSession, sf: str) -> DataFrame:
        frame = whole_events(spark, sf) if whole else events(spark, sf)
        out = frame.vectors(_spread=far or None, x=(function, "v") if w is None else (function, w, "v")).rows()
        return out.select("event_id", (F.round(F.log1p("x") if function == "vars" else F.col("x"), digits) if digits else F.col("x")).alias("x"))

    run.__name__ = name
    query(f"WITH {_EV} SELECT event_id, {f'round({text}, {digits})' if digits else text} AS x FROM ev")(run)


for _f, _name in (("sums", "sum"), ("avgs", "avg"), ("mins", "min"), ("maxs", "max")):
    _vector_query(f"running_{_name}", _f, None, False)
    _vector_query(f"moving_{_name}", _f, 5, False)
    _vector_query(f"spread_running_{_name}", _f, None, True)
    _vector_query(f"spread_moving_{_name}", _f, 5, True)
_vector_query("running_var", "vars", None, False)
_vector_query("spread_running_var", "vars", None, True)
_vector_query("spread_running_stddev", "stddevs", None, True)
_vector_query("spread_moving_stddev", "stddevs", 5, True)
_vector_query("running_stddev", "stddevs", None, False)
_vector_query("moving_stddev", "stddevs", 5, False)
_vector_query("moving_var", "vars", 5, False)
_vector_query("global_running_sum", "sums", None, True, True)
_vector_query("global_moving_avg", "avgs", 7, True, True)
_vector_query("global_running_max", "maxs", None, True, True)

_SHIFTS = {
    "ratios_1": (("ratios", "v"), "v / coalesce(lag(v) OVER w, v)"),
    "ratios_3": (("ratios", 3, "v"), "v / CASE WHEN count(*) OVER (PARTITION BY user_id) <= 3 THEN coalesce(lag(v) OVER w, v) ELSE coalesce(lag(v, 3) OVER w, first_value(v) OVER w) END"),
    "deltas": (("deltas", "v"), "v - coalesce(lag(v) OVER w, v)"),
    "prev": (("prev", "v"), "coalesce(lag(v) OVER w, v)"),
    "next": (("next", "v"), "coalesce(lead(v) OVER w, v)"),
    "series_first": (("first", "v"), "first_value(v) OVER w"),
    "series_last": (("last", "v"), "last_value(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "position": (("position",), "row_number() OVER w - 1"),
}


def _shift_query(name: str, spec: tuple, sql: str, far: bool) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = events(spark, sf).vectors(_spread=far or None, x=spec).rows()
        return out.select("event_id", (F.round("x", 9) if spec[0] == "ratios" else F.col("x")).alias("x"))

    run.__name__ = ("spread_" if far else "") + name
    query(f"WITH {_EV} SELECT event_id, {f'round({sql}, 9)' if spec[0] == 'ratios' else sql} AS x FROM ev {_W}")(run)


for _name, (_spec, _sql) in _SHIFTS.items():
    _shift_query(_name, _spec, _sql, False)
    _shift_query(_name, _spec, _sql, True)


def spread_descending(spark: SparkSession, sf: str) -> DataFrame:
    """Several functions and widths at once, in descending order over many short series, in segments."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    o = OrderedFrame(df).assuming(("l_linenumber", False), "l_partkey", "l_suppkey", "v").group("l_orderkey")
    out = o.vectors(_spread=True, r=("ratios", 2, "v"), wide=("ratios", 4, "v"), m=("maxs", 3, "v"), s=("sums", "v"), d=("deltas", "v"), n=("next", "v")).rows()
    return out.select("l_orderkey", "l_linenumber", F.round("r", 9).alias("r"), F.round("wide", 9).alias("wide"), "m", "s", "d", "n")


_DESC = "OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, v"
_BEFORE = "CASE WHEN count(*) OVER (PARTITION BY l_orderkey) <= {w} THEN coalesce(lag(v) " + _DESC + "), v) ELSE coalesce(lag(v, {w}) " + _DESC + "), first_value(v) " + _DESC + ")) END"
query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(v / {_BEFORE.format(w=2)}, 9) AS r, round(v / {_BEFORE.format(w=4)}, 9) AS wide, max(v) {_DESC} ROWS 2 PRECEDING) AS m, CAST(sum(v) {_DESC} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s,
v - coalesce(lag(v) {_DESC}), v) AS d, coalesce(lead(v) {_DESC}), v) AS n FROM l""")(spread_descending)

# Order-dependent questions


@query(f"WITH {_EV}, m AS (SELECT user_id, v, min(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS low FROM ev) SELECT user_id, max(v - low) AS profit FROM m GROUP BY user_id")
def best_profit(spark: SparkSession, sf: str) -> DataFrame:
    """The best gain of buying before selling, per user."""
    return events(spark, sf).vectors(low=("mins", "v")).reduce(profit=F.max(F.col("v") - F.col("low")))


@query(f"WITH {_EV}, m AS (SELECT v, min(v) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS low FROM ev) SELECT max(v - low) AS profit FROM m")
def best_profit_global(spark: SparkSession, sf: str) -> DataFrame:
    """The best gain over the whole ordered table, in segments."""
    return whole_events(spark, sf).vectors(_spread=True, low=("mins", "v")).reduce(profit=F.max(F.col("v") - F.col("low")))


@query(f"WITH {_EV}, m AS (SELECT user_id, stddev_pop(v) {_frame(3)} AS s FROM ev) SELECT user_id, round(max(s), 4) AS most FROM m GROUP BY user_id")
def max_rolling_std(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).vectors(s=("stddevs", 3, "v")).reduce(most=F.round(F.max("s"), 4))


@query(f"""WITH {_EV}, d AS (SELECT user_id, v, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 THEN 1 ELSE 0 END AS fresh, event_id, ts FROM ev {_W}),
s AS (SELECT user_id, v, sum(fresh) OVER w AS session FROM d {_W}) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM s GROUP BY user_id, session""")
def sessionize(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users, cut at gaps of more than half an hour."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    out = events(spark, sf).sessions(micros, 1_800_000_000).rows()
    return out.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query(f"WITH {_EV} SELECT user_id, arg_min(v, (ts, event_id)) AS first_v, arg_max(v, (ts, event_id)) AS last_v FROM ev GROUP BY user_id")
def group_first_last(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.reduce(first_v=e.first("v"), last_v=e.last("v"))


@query(f"WITH {_EV} SELECT user_id, event_id, v FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2")
def topk_subvec(spark: SparkSession, sf: str) -> DataFrame:
    """The first two rows of each series."""
    return events(spark, sf).subvec(0, 2).rows().select("user_id", "event_id", "v")


@query(f"WITH {_EV} SELECT user_id, count(*) AS n, string_agg(v, ',' ORDER BY ts, event_id) AS items FROM ev GROUP BY user_id")
def group_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Series as ordered vectors."""
    folded = events(spark, sf).fold(items=F.col("v"))
    return folded.select("user_id", F.size("items").cast("long").alias("n"), F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


@query(f"WITH {_EV} SELECT user_id, event_id, v - coalesce(lag(v) OVER w, v) AS d FROM ev {_W}")
def fold_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors folded and flattened side by side."""
    folded = events(spark, sf).vectors(d=("deltas", "v")).fold(event_id=F.col("event_id"), d=F.col("d"))
    return flatten(folded, ["event_id", "d"])


@query("WITH t AS (SELECT r_regionkey AS k, list(n_nationkey) AS x FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1) SELECT k, unnest(x) AS x, y FROM (SELECT k, x, unnest(x) AS y FROM t)")
def flatten_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of two vector columns."""
    nations = OrderedFrame(table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), "n_nationkey")).assuming("n_nationkey").group("k")
    return flatten(nations.fold(x=F.col("n_nationkey"), y=F.col("n_nationkey")), ["x", "y"], how="cross")


@query(f"WITH {_EV} SELECT event_id, round(v - avg(v) OVER (PARTITION BY user_id), 6) AS centred FROM ev")
def center_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """A vector minus an aggregate: the aggregate is joined back, so a hot user is no burden to one task."""
    df = events(spark, sf).rows()
    means = df.groupBy("user_id").agg(F.avg("v").alias("mean"))
    return df.join(means, "user_id").select("event_id", F.round(F.col("v") - F.col("mean"), 6).alias("centred"))


@query(f"WITH {_EV}, o AS (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, v, ts, event_id FROM ev ORDER BY user_id, event_type, ts DESC, event_id DESC) SELECT user_id, event_type, v FROM o")
def distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).group("user_id", "event_type")
    return e.reduce(v=e.last("v"))


# Text dialect: order-dependent

_QTY = "CAST(l_quantity AS BIGINT)"
_LINE = "lineitem"
_TIED = "ASSUMING ASC l_orderkey, ASC l_partkey, ASC l_suppkey, ASC l_linenumber"

text_query(
    "text_best_profit", ["events"], "SELECT user_id, max(v - mins(v)) AS profit FROM (SELECT user_id, ts, event_id, CAST(round(value * 100) AS bigint) AS v FROM events) e ASSUMING ASC ts, ASC event_id GROUP BY user_id",
    ORACLES["best_profit"],
)
text_query(
    "text_moving_avg", ["moving_avg"], "SELECT series_id, Month, avgs(3, sales) AS a FROM (SELECT DISTINCT * FROM moving_avg) m ASSUMING ASC series_id, ASC Month, ASC reported_at, ASC sales WHERE sales IS NOT NULL",
    "SELECT series_id, Month, avg(sales) OVER (ORDER BY series_id, Month, reported_at, sales ROWS 2 PRECEDING) AS a FROM (SELECT DISTINCT * FROM moving_avg) WHERE sales IS NOT NULL",
)
text_query(
    "text_sessions", ["network"], "SELECT src, dst, count(*) AS n, sum(len) AS total FROM (SELECT DISTINCT trim(src) AS src, dst, len, _time FROM network) p ASSUMING ASC src, ASC dst, ASC _time, ASC len GROUP BY src, dst, sums(deltas(_time) > 120)",
    """WITH p AS (SELECT DISTINCT trim(src) AS src, dst, len, _time FROM network), d AS (SELECT *, CASE WHEN _time - lag(_time) OVER w > 120 THEN 1 ELSE 0 END AS fresh FROM p WINDOW w AS (ORDER BY src NULLS FIRST, dst NULLS FIRST, _time NULLS FIRST, len NULLS FIRST)),
    s AS (SELECT *, sum(fresh) OVER (ORDER BY src NULLS FIRST, dst NULLS FIRST, _time NULLS FIRST, len NULLS FIRST ROWS UNBOUNDED PRECEDING) AS session FROM d) SELECT src, dst, count(*) AS n, CAST(sum(len) AS BIGINT) AS total FROM s GROUP BY src, dst, session""",
)
text_query(
    "text_ratio_extremes", ["events"], "SELECT user_id, round(max(ratios(v)), 9) AS most, round(min(ratios(2, v)), 9) AS least FROM (SELECT user_id, ts, event_id, CAST(round(value * 100) AS bigint) AS v FROM events) e ASSUMING ASC ts, ASC event_id GROUP BY user_id",
    f"WITH {_EV}, r AS (SELECT user_id, v / coalesce(lag(v) OVER w, v) AS a, v / CASE WHEN count(*) OVER (PARTITION BY user_id) <= 2 THEN coalesce(lag(v) OVER w, v) ELSE coalesce(lag(v, 2) OVER w, first_value(v) OVER w) END AS b FROM ev {_W}) SELECT user_id, round(max(a), 9) AS most, round(min(b), 9) AS least FROM r GROUP BY user_id",
)
text_query(
    "text_best_profit_where", ["events"], "SELECT max(round(value * 100) - mins(round(value * 100))) AS profit FROM events ASSUMING ASC ts, ASC event_id WHERE event_type = \"view\" AND value > 1",
    "WITH m AS (SELECT round(value * 100) AS v, min(round(value * 100)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS low FROM events WHERE event_type = 'view' AND value > 1) SELECT max(v - low) AS profit FROM m",
)
text_query(
    "text_max_prev_ratio", ["events"], "SELECT round(max(value / prev(value)), 9) AS max_ratio FROM events ASSUMING ASC ts, ASC event_id",
    "WITH r AS (SELECT value / nullif(coalesce(lag(value) OVER (ORDER BY ts, event_id), value), 0) AS a FROM events) SELECT round(max(a), 9) AS max_ratio FROM r",
)
text_query(
    "text_max_prev_ratio_users", ["events"], "SELECT user_id, round(max(value / prev(value)), 9) AS max_ratio FROM events ASSUMING ASC ts, ASC event_id GROUP BY user_id",
    "WITH r AS (SELECT user_id, value / nullif(coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value), 0) AS a FROM events) SELECT user_id, round(max(a), 9) AS max_ratio FROM r GROUP BY user_id",
)
text_query(
    "text_last_of_join", ["orders", "customer"], "SELECT c_nationkey, last(o_totalprice) AS price FROM orders o, customer c ASSUMING ASC o_orderdate, ASC o_orderkey WHERE o.o_custkey = c.c_custkey GROUP BY c_nationkey",
    "SELECT c_nationkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
)
text_query(
    "text_group_fold", ["events"], "SELECT user_id, concat_ws(',', transform(v, x -> CAST(x AS string))) AS items FROM (SELECT user_id, CAST(round(value * 100) AS bigint) AS v FROM events ASSUMING ASC ts, ASC event_id GROUP BY user_id) f",
    f"WITH {_EV} SELECT user_id, string_agg(v, ',' ORDER BY ts, event_id) AS items FROM ev GROUP BY user_id",
)
text_query(
    "text_moving_desc", ["events"], "SELECT event_id, mins(2, CAST(round(value * 100) AS bigint)) AS m FROM events ASSUMING DESC ts, DESC event_id",
    f"WITH {_EV} SELECT event_id, min(v) OVER (ORDER BY ts DESC, event_id DESC ROWS 1 PRECEDING) AS m FROM ev",
)
text_query(
    "text_nested_windows", ["events"], "SELECT user_id, max(sums(3, deltas(v))) AS climb FROM (SELECT user_id, ts, event_id, CAST(round(value * 100) AS bigint) AS v FROM events) e ASSUMING ASC ts, ASC event_id GROUP BY user_id",
    f"WITH {_EV}, d AS (SELECT *, v - coalesce(lag(v) OVER w, v) AS d FROM ev {_W}), s AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS s FROM d) SELECT user_id, CAST(max(s) AS BIGINT) AS climb FROM s GROUP BY user_id",
)
text_query(
    "text_center", ["events"], "SELECT event_id, round(value - avg(value), 6) AS centred, counts FROM (SELECT event_id, CAST(round(value * 100) AS bigint) AS value, 1 AS counts FROM events) e ASSUMING ASC event_id",
    f"WITH {_EV} SELECT event_id, round(v - avg(v) OVER (), 6) AS centred, 1 AS counts FROM ev",
)

_FUNCTIONS = """
FUNCTION weighted (x, w) { sum(x * w) / sum(w) }
FUNCTION spreadOf (x, w) { centre := weighted(x, w); away := x - centre; weighted(away * away, w) }
FUNCTION slopeOf (x, y, w) { mx := weighted(x, w); my := weighted(y, w); weighted((x - mx) * (y - my), w) / spreadOf(x, w) }
"""
_SLOPE = "sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx))"
_LINES = "l AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice AS y, l_linenumber AS w FROM lineitem)"
text_query("weighted_spread_udf", [_LINE], _FUNCTIONS + "SELECT l_returnflag, l_linestatus, round(spreadOf(l_quantity, l_linenumber), 4) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus", "WITH m AS (SELECT *, sum(l_quantity * l_linenumber) OVER g / sum(l_linenumber) OVER g AS mx FROM lineitem WINDOW g AS (PARTITION BY l_returnflag, l_linestatus)) SELECT l_returnflag, l_linestatus, round(sum(l_linenumber * (l_quantity - mx) * (l_quantity - mx)) / sum(l_linenumber), 4) AS c FROM m GROUP BY ALL")
text_query("weighted_slope_udf", [_LINE], _FUNCTIONS + "SELECT l_returnflag, round(slopeOf(l_quantity, l_extendedprice, l_linenumber), 4) AS r FROM lineitem GROUP BY l_returnflag", f"WITH {_LINES}, m AS (SELECT *, sum(x * w) OVER g / sum(w) OVER g AS mx, sum(y * w) OVER g / sum(w) OVER g AS my FROM l WINDOW g AS (PARTITION BY k)) SELECT k AS l_returnflag, round({_SLOPE}, 4) AS r FROM m GROUP BY k")
text_query("weighted_slope_global", [_LINE], _FUNCTIONS + "SELECT round(slopeOf(l_quantity, l_extendedprice, l_linenumber), 4) AS r FROM lineitem", f"WITH {_LINES}, m AS (SELECT *, sum(x * w) OVER () / sum(w) OVER () AS mx, sum(y * w) OVER () / sum(w) OVER () AS my FROM l) SELECT round({_SLOPE}, 4) AS r FROM m")


@query("WITH c AS (SELECT o_custkey, o_orderkey, covar_pop(o_orderkey % 1000, floor(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 3 PRECEDING) AS c FROM orders) SELECT o_custkey, o_orderkey, round(c, 5) AS c FROM c")
def moving_cov_udaf(spark: SparkSession, sf: str) -> DataFrame:
    """A function with loops and one result per row of its group, flattened beside the rows' keys."""
    program = """
    AGGREGATION FUNCTION movingcov(x, y, win) {
        l := _builtin_len;
        for (i := 0; i < l; i += 1) {
            s := 0;
            if (i >= win) { s := i - win + 1; }
            xm := avg(x(s, i + 1)); ym := avg(y(s, i + 1));
            _builtin_ret[i] := avg((x(s, i + 1) - xm) * (y(s, i + 1) - ym));
        }
        Null
    }
    SELECT o_custkey, o_orderkey, movingcov(o_orderkey % 1000, floor(o_totalprice), 4) AS c FROM orders ASSUMING ASC o_orderkey GROUP BY o_custkey"""
    out = flatten(engine(spark, sf, "orders").sql(program), ["o_orderkey", "c"])
    return out.select("o_custkey", "o_orderkey", F.round("c", 5).alias("c"))


# Group-by shapes

for _n, (_items, _keys) in enumerate(
    [
        ("sum({q}) AS v1", "l_returnflag"), ("sum({q}) AS v1", "l_returnflag, l_linestatus"), ("sum({q}) AS v1, round(avg({q}), 6) AS v3", "l_partkey"),
        ("round(avg({q}), 6) AS v1, round(avg(l_linenumber), 6) AS v2, min(l_discount) AS v3", "l_linenumber"), ("sum({q}) AS v1, sum(l_linenumber) AS v2, max(l_tax) AS v3", "l_suppkey"),
        ("median({q}) AS m, round({sd}, 4) AS sd", "l_returnflag, l_linenumber"), ("max({q}) - min(l_linenumber) AS span", "l_partkey"),
    ], 1,
):
    _sql_items = _items.format(q=_QTY, sd=f"stddev_pop({_QTY})").replace("sum(", "sum(").replace("avg(", "avg(")
    _sql_items = ", ".join(f"CAST({p.rsplit(' AS ', 1)[0]} AS BIGINT) AS {p.rsplit(' AS ', 1)[1]}" if p.startswith("sum(") else p for p in _sql_items.split(", ")) if "median" not in _sql_items and "round" not in _sql_items else _sql_items.replace(f"sum({_QTY})", f"CAST(sum({_QTY}) AS BIGINT)")
    text_query(f"groupby_{_n}", [_LINE], f"SELECT {_keys}, {_items.format(q=_QTY, sd=f'stddev({_QTY})')} FROM lineitem GROUP BY {_keys}", f"SELECT {_keys}, {_sql_items} FROM lineitem GROUP BY ALL")
@query("SELECT l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) <= 2")
def groupby_8(spark: SparkSession, sf: str) -> DataFrame:
    """The two highest prices of each supplier, as rows."""
    lines = OrderedFrame(table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber"))
    return lines.assuming(("l_extendedprice", False), "l_orderkey", "l_partkey", "l_linenumber").group("l_suppkey").subvec(0, 2).rows().select("l_suppkey", "l_extendedprice")


text_query("groupby_9", [_LINE], "SELECT l_returnflag, l_linenumber, round(pow(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem GROUP BY l_returnflag, l_linenumber", "SELECT l_returnflag, l_linenumber, round(pow(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem GROUP BY ALL")
text_query("groupby_10", [_LINE], f"SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, l_tax, l_discount, sum({_QTY}) AS v3, count(*) AS cnt FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber, l_suppkey, l_tax, l_discount", f"SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, l_tax, l_discount, CAST(sum({_QTY}) AS BIGINT) AS v3, count(*) AS cnt FROM lineitem GROUP BY ALL")

# Standard parts of the dialect: the same text is the oracle unless given

_SAME = {
    "arith": (["orders"], "SELECT o_orderkey, o_custkey * 2 + 1 - o_orderkey AS a, o_orderkey % 7 AS m, -o_custkey AS n, 3 * o_custkey AS t FROM orders"),
    "logic": (["orders"], "SELECT o_orderkey FROM orders WHERE o_custkey - 100 > 1 AND NOT (o_orderkey * 2 < 500) OR o_orderpriority = '1-URGENT' AND o_totalprice <> 0"),
    "where_range": (["orders"], "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 50000 AND o_totalprice <= 200000"),
    "null_test": (["nyctx100"], "SELECT trip_id, passenger_count IS NULL AS gone, PULocationID IS NOT NULL AS here, passenger_count IS DISTINCT FROM RatecodeID AS other FROM nyctx100"),
    "case_cast_between": (["orders"], "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice BETWEEN 50000 AND 200000 THEN 'mid' ELSE 'small' END AS size, CAST(floor(o_totalprice) AS bigint) AS whole FROM orders"),
    "like_in": (["customer"], "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1%' AND c_nationkey IN (1, 2, 3) AND c_mktsegment NOT IN ('BUILDING')"),
    "bits_concat": (["orders"], "SELECT o_orderkey, o_orderkey & 12 AS b, o_orderkey | 3 AS o, o_orderpriority || '-' || o_orderstatus AS s FROM orders"),
    "having": (["orders"], "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5 AND max(o_totalprice) > 1000"),
    "group_expression": (["orders"], "SELECT o_orderkey % 10 AS k, count(*) AS n, min(o_totalprice) AS low FROM orders GROUP BY o_orderkey % 10"),
    "count_distinct": (["lineitem"], "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) AS n, count(l_tax) AS taxed FROM lineitem GROUP BY l_returnflag"),
    "distinct_rows": (["lineitem"], "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem"),
    "order_limit": (["orders"], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "order_offset": (["orders"], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"),
    "agg_global": (["orders"], "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, count(DISTINCT o_custkey) AS c FROM orders"),
    "window_rank": (["orders"], "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders"),
    "window_frame": (["orders"], "SELECT o_orderkey, count(*) OVER w AS n, max(o_orderkey) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "agg_filter": (["lineitem"], "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n FROM lineitem GROUP BY l_returnflag"),
    "rollup": (["lineitem"], "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "cube": (["lineitem"], "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "grouping_sets": (["lineitem"], "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())"),
    "join_inner": (["orders", "customer"], "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_comma": (["nation", "region"], "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"),
    "join_left": (["customer", "orders"], "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"),
    "join_right": (["customer", "orders"], "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000"),
    "join_full": (["customer", "supplier"], "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey"),
    "join_cross": (["nation", "region"], "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region"),
    "join_theta": (["nation", "region"], "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "join_using": (["nation"], "SELECT n_nationkey, a.n_name AS x, b.n_regionkey AS y FROM nation a JOIN nation b USING (n_nationkey)"),
    "join_natural": (["nation"], "SELECT n_name, n_comment2 FROM (SELECT n_nationkey, n_name FROM nation) a NATURAL JOIN (SELECT n_nationkey, n_regionkey AS n_comment2 FROM nation) b"),
    "join_groups": (["nation", "region", "supplier"], "SELECT s_suppkey, r_name FROM supplier JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey"),
    "union_all": (["supplier", "customer"], "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer"),
    "union_distinct": (["supplier", "customer"], "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer"),
    "except_": (["orders", "customer"], "SELECT o_custkey % 97 AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    "except_all": (["lineitem", "supplier"], "SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier"),
    "intersect_": (["supplier", "customer"], "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer"),
    "set_order_limit": (["supplier", "customer"], "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer ORDER BY k LIMIT 7"),
    "cte": (["orders"], "WITH big (k, p) AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), n AS (SELECT k, count(*) AS n FROM big GROUP BY k) SELECT k, n FROM n WHERE n > 1"),
    "cte_recursive": ([], "WITH RECURSIVE t(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t"),
    "sub_from": (["orders"], "SELECT k, max(n) AS m FROM (SELECT o_custkey AS c, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) x GROUP BY k"),
    "sub_in": (["orders", "customer"], "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "sub_exists": (["orders", "customer"], "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"),
    "sub_scalar": (["orders"], "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)"),
    "values_query": ([], "VALUES (1, 'a'), (2, 'b')"),
    "select_no_from": ([], "SELECT 1 + 2 AS three, 'x' AS s"),
    "extract_dates": (["orders"], "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m FROM orders WHERE o_orderdate >= DATE '1995-01-01'"),
    "trim_text": (["network"], "SELECT trim(src) AS s, trim(both 's' FROM dst) AS d FROM network"),
}
_OTHER_SQL = {
    "window_rank": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS r, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders",
    "values_query": "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(col1, col2)",
    "extract_dates": "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, CAST(extract(month FROM o_orderdate) AS INTEGER) AS m FROM orders WHERE o_orderdate >= DATE '1995-01-01'",
    "trim_text": "SELECT trim(src, ' ') AS s, trim(dst, 's') AS d FROM network",
}
for _name, (_tables, _program) in _SAME.items():
    text_query(_name, _tables, _program, _OTHER_SQL.get(_name, _program))

text_query("division", ["orders"], "SELECT o_orderkey, round(o_custkey / 7, 9) AS q, o_orderkey / 0 AS z FROM orders", "SELECT o_orderkey, round(o_custkey / 7, 9) AS q, CAST(NULL AS DOUBLE) AS z FROM orders")
text_query("xor_test", ["orders"], "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 XOR o_custkey > 500", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000) <> (o_custkey > 500)")
text_query("join_star_dedupe", ["nation", "region"], "SELECT * FROM nation, region WHERE nation.n_regionkey = region.r_regionkey", "SELECT * EXCLUDE (r_regionkey) FROM nation, region WHERE n_regionkey = r_regionkey")
text_query("join_moving_avg", ["orders", "customer"], "SELECT o_orderkey, avgs(10, CAST(o_totalprice * 100 AS bigint)) AS a FROM orders JOIN customer ON o_custkey = c_custkey ASSUMING ASC c_custkey, ASC o_orderkey", "SELECT o_orderkey, avg(CAST(trunc(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY c_custkey, o_orderkey ROWS 9 PRECEDING) AS a FROM orders JOIN customer ON o_custkey = c_custkey")
text_query("lateral_view", ["embeddings"], "SELECT vec_id, pos, CAST(round(CAST(e AS double) * 1000) AS bigint) AS m FROM embeddings LATERAL VIEW posexplode(embedding) x AS pos, e", "SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(round(CAST(embedding[pos] AS DOUBLE) * 1000) AS BIGINT) AS m FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)")
text_query("join_lateral", ["customer", "orders"], "SELECT c_custkey, m FROM customer JOIN LATERAL (SELECT max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) x", "SELECT c_custkey, m FROM customer, LATERAL (SELECT max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) x")
text_query("join_semi", ["customer", "orders"], "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
text_query("join_anti", ["customer", "orders"], "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
text_query("truncate", ["events"], "SELECT event_id, truncate(value * 100, 0) AS t, truncate(user_id, 2) AS u FROM events", "SELECT event_id, round(value * 100, 0) AS t, user_id AS u FROM events")
text_query("math", ["orders"], "SELECT o_orderkey, round(sqrt(o_custkey), 9) AS s, round(log(2, o_custkey + 1), 9) AS l, round(sin(o_custkey), 9) AS x, round(cos(o_custkey), 9) AS y, round(tan(1), 9) AS t, pow(o_custkey, 2) AS p FROM orders", "SELECT o_orderkey, round(sqrt(o_custkey), 9) AS s, round(log(2, o_custkey + 1), 9) AS l, round(sin(o_custkey), 9) AS x, round(cos(o_custkey), 9) AS y, round(tan(1), 9) AS t, pow(o_custkey, 2) AS p FROM orders")
text_query("pack_vector", ["orders"], "SELECT o_orderkey, size(pack(o_orderkey, o_custkey)) AS n, pack(o_orderkey, o_custkey)[1] AS second FROM orders", "SELECT o_orderkey, 2 AS n, o_custkey AS second FROM orders")
text_query("vector_aggregates", ["lineitem"], f"SELECT l_suppkey, round(var({_QTY}), 4) AS v, round(stddev(l_linenumber), 6) AS s, median({_QTY}) AS m FROM lineitem GROUP BY l_suppkey", f"SELECT l_suppkey, round(var_pop({_QTY}), 4) AS v, round(stddev_pop(l_linenumber), 6) AS s, median({_QTY}) AS m FROM lineitem GROUP BY ALL")
text_query("top_n_rows", ["orders"], "SELECT TOP 5 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 5")
text_query("table_function", [], "SELECT x.col AS v FROM explode(array(3, 1, 2)) x", "SELECT unnest([3, 1, 2]) AS v")
text_query("stack_rows", ["nation"], "SELECT n_nationkey, k, x FROM nation LATERAL VIEW stack(2, 'key', n_nationkey, 'region', n_regionkey) s AS k, x", "SELECT n_nationkey, 'key' AS k, n_nationkey AS x FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey FROM nation")
text_query("aggregate_of_fold", ["nation"], "SELECT n_regionkey, sum(n_nationkey * 2) - min(n_nationkey) AS s, max(n_nationkey - avg(n_nationkey)) AS far FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(sum(n_nationkey * 2) - min(n_nationkey) AS BIGINT) AS s, max(n_nationkey) - avg(n_nationkey) AS far FROM nation GROUP BY n_regionkey")
text_query("sample_percent", ["lineitem"], "SELECT abs(count(*) - 0.3 * (SELECT count(*) FROM lineitem)) < 0.06 * (SELECT count(*) FROM lineitem) AS near FROM lineitem TABLESAMPLE (30 PERCENT)", "SELECT TRUE AS near")
text_query("null_equality", ["nyctx100"], "SELECT count(*) AS n FROM nyctx100 WHERE passenger_count = NULL", "SELECT count(*) AS n FROM nyctx100 WHERE passenger_count IS NULL")
text_query("approx_distinct", ["lineitem"], "SELECT abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) < 0.1 * count(DISTINCT l_partkey) AS near FROM lineitem", "SELECT TRUE AS near")


# Text forms

_FORMS = {
    "text_distinct_on": (["orders"], "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1"),
    "text_fetch": (["orders"], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 5 ROWS FETCH NEXT 12 ROWS ONLY", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 12 OFFSET 5"),
    "text_top_percent": (["orders"], "SELECT TOP 15 PERCENT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= ceil(0.15 * (SELECT count(*) FROM orders))"),
    "text_top_ties": (["lineitem"], "SELECT TOP 40 WITH TIES l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_linenumber", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY rank() OVER (ORDER BY l_quantity DESC, l_linenumber) <= 40"),
    "text_nulls_last": (["nyctx100"], "SELECT trip_id, passenger_count FROM nyctx100 ORDER BY passenger_count DESC NULLS FIRST, trip_id, loaded_at LIMIT 50", "SELECT trip_id, passenger_count FROM nyctx100 ORDER BY passenger_count DESC NULLS FIRST, trip_id, loaded_at LIMIT 50"),
    "text_similar": (["customer"], "SELECT c_custkey FROM customer WHERE c_name SIMILAR TO '%[13579]' AND c_name RLIKE '0[0-4][0-9]*$'", "SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, '.*[13579]') AND regexp_matches(c_name, '0[0-4][0-9]*$')"),
    "text_collate": (["customer"], "SELECT c_mktsegment COLLATE UTF8_LCASE = 'building' AS b, count(*) AS n FROM customer GROUP BY c_mktsegment COLLATE UTF8_LCASE = 'building'", "SELECT lower(c_mktsegment) = 'building' AS b, count(*) AS n FROM customer GROUP BY 1"),
    "text_ignore_nulls": (["historicquotes"], "SELECT ID, CAST(TradeDate AS string) AS day, last_value(volume) IGNORE NULLS OVER (PARTITION BY ID ORDER BY TradeDate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM (SELECT DISTINCT ID, TradeDate, volume FROM historicquotes) q", "SELECT ID, CAST(TradeDate AS VARCHAR) AS day, last_value(volume IGNORE NULLS) OVER (PARTITION BY ID ORDER BY TradeDate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM (SELECT DISTINCT ID, TradeDate, volume FROM historicquotes) q"),
    "text_range_frame": (["orders"], "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM orders", None),
    "text_array_map_struct": (["orders"], "SELECT o_orderkey, ARRAY[o_custkey, 7][0] AS a, MAP['k', o_custkey]['k'] AS m, STRUCT(o_orderkey, o_custkey).o_custkey AS s FROM orders", "SELECT o_orderkey, o_custkey AS a, o_custkey AS m, o_custkey AS s FROM orders"),
    "text_within_group": (["lineitem"], "SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q FROM lineitem GROUP BY l_returnflag"),
    "text_set_into": (["supplier", "customer"], "SELECT s_nationkey AS k INTO both FROM supplier UNION ALL SELECT c_nationkey FROM customer; SELECT k, count(*) AS n FROM both GROUP BY k", "SELECT k, count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) GROUP BY k"),
    "text_missing": (["nyctx100"], "SELECT missing(passenger_count) AS gone, count(*) AS n FROM nyctx100 GROUP BY missing(passenger_count)", "SELECT passenger_count IS NULL AS gone, count(*) AS n FROM nyctx100 GROUP BY 1"),
    "text_distinct_value": (["lineitem"], "SELECT l_returnflag, size(d) AS n FROM (SELECT l_returnflag, distinct(l_linenumber) AS d FROM lineitem ASSUMING ASC l_orderkey GROUP BY l_returnflag) x", "SELECT l_returnflag, CAST(count(DISTINCT l_linenumber) AS INTEGER) AS n FROM lineitem GROUP BY 1"),
    "text_sum_distinct": (["lineitem"], "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1"),
    "text_ranks": (["orders"], "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) AS d, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS q FROM orders", None),
    "text_strings": (["customer"], "SELECT c_custkey, upper(substring(c_name, 1, 4)) AS u, length(c_name) AS n, replace(c_mktsegment, 'U', 'x') AS r, concat_ws('-', c_name, c_mktsegment) AS c, lpad(c_mktsegment, 12, '.') AS p FROM customer", None),
    "text_json": (["events"], "SELECT event_id, CAST(get_json_object(props, '$.k') AS int) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "text_dates": (["orders"], "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS date) AS string) AS m, CAST(last_day(o_orderdate) AS string) AS l, date_format(o_orderdate, 'yyyy/MM') AS f, CAST(CAST(o_orderdate AS date) + INTERVAL 3 day AS string) AS t FROM orders", "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS m, CAST(last_day(o_orderdate) AS VARCHAR) AS l, strftime(o_orderdate, '%Y/%m') AS f, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 day AS DATE) AS VARCHAR) AS t FROM orders"),
    "text_ordinality": (["nation"], "SELECT e, p FROM explode(array(7, 8, 9)) WITH ORDINALITY x (e, p)", "SELECT * FROM (VALUES (7, 1), (8, 2), (9, 3)) v(e, p)"),
    "text_scalar_fallbacks": (["orders"], "SELECT max(avg(o_totalprice) - min(o_totalprice)) AS a, count(sum(o_custkey)) AS n, sum(max(o_custkey)) + var(count(*)) AS s FROM orders GROUP BY o_orderstatus", "SELECT avg(o_totalprice) - min(o_totalprice) AS a, 1 AS n, max(o_custkey) AS s FROM orders GROUP BY o_orderstatus"),
    "text_constraints": ([], "CREATE TABLE t (a int PRIMARY KEY, b int NOT NULL DEFAULT 3, UNIQUE (b), CHECK (a > 0)); INSERT INTO t VALUES (1, 2), (3, 4); SELECT a, b FROM t", "SELECT * FROM (VALUES (1, 2), (3, 4)) v(a, b)"),
}
for _name, (_tables, _program, _sql) in _FORMS.items():
    text_query(_name, _tables, _program, _sql or _program)


# Tables, files, procedures


text_query("insert_select", ["nation"], "CREATE TABLE t (k bigint, name string) INSERT INTO t SELECT n_nationkey, n_name FROM nation; INSERT INTO t VALUES (100, 'new'), (101, NULL); INSERT INTO t(name) VALUES ('only'); SELECT * FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation UNION ALL SELECT 100, 'new' UNION ALL SELECT 101, NULL UNION ALL SELECT NULL, 'only'")
text_query("delete_where", ["orders"], "CREATE TABLE t AS SELECT o_orderkey, o_totalprice FROM orders; DELETE FROM t WHERE o_totalprice > 100000; SELECT * FROM t", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT coalesce(o_totalprice > 100000, FALSE)")
text_query("update_where", ["nation"], "CREATE TABLE t AS SELECT n_nationkey, n_regionkey FROM nation; UPDATE t SET n_regionkey = n_regionkey + 10 WHERE n_nationkey < 5; SELECT * FROM t", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation")
text_query("ctas", ["nation"], "CREATE TABLE d AS SELECT n_regionkey, count(*) AS twice FROM nation GROUP BY n_regionkey; SELECT n_regionkey, 2twice AS t FROM d", "SELECT n_regionkey, 2 * count(*) AS t FROM nation GROUP BY n_regionkey")
text_query("select_into", ["orders"], "SELECT DISTINCT o_custkey INTO d FROM orders; SELECT o_custkey INTO d FROM orders WHERE o_totalprice > 200000; SELECT count(*) AS n FROM d", "SELECT (SELECT count(DISTINCT o_custkey) FROM orders) + (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS n")
text_query("create_view", ["nation"], "CREATE VIEW w (k, r) AS SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey > 1; SELECT r, count(*) AS n FROM w GROUP BY r; ", "SELECT n_regionkey AS r, count(*) AS n FROM nation WHERE n_regionkey > 1 GROUP BY 1")
text_query("insert_overwrite", ["nation"], "CREATE TABLE t (k bigint); INSERT INTO t VALUES (1), (2); INSERT OVERWRITE TABLE t SELECT n_nationkey FROM nation WHERE n_nationkey < 3; SELECT * FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey < 3")
text_query("passthrough", ["nation"], "<sql> CREATE INDEX i ON nation(n_name); SELECT n_name, upper(n_name) AS u FROM nation WHERE n_nationkey < 7; </sql>", "SELECT n_name, upper(n_name) AS u FROM nation WHERE n_nationkey < 7")
text_query("cache_scan", ["nation"], "CACHE TABLE FROM nation; SELECT max(n_nationkey - mins(n_nationkey)) AS span FROM nation ASSUMING ASC n_nationkey", "SELECT max(n_nationkey) - min(n_nationkey) AS span FROM nation")
text_query("drop_table", ["nation"], "CREATE TABLE x (a int); DROP TABLE x; DROP TABLE IF EXISTS x; CREATE TABLE x (b int); INSERT INTO x VALUES (4); SELECT b FROM x", "SELECT 4 AS b")
text_query("types", [], "CREATE TABLE t (a tinyint, b smallint, c int, d bigint, e real, f double, g boolean, h varchar(4), i date, j timestamp, k time); INSERT INTO t VALUES (1, 2, 3, 4, 1.5, 2.5, true, 'text', '2020-02-29', '2020-02-29 01:02:03:250', '01:02:03:004'); SELECT a, b, c, d, e, f, g, h, CAST(i AS string) AS i, j, k FROM t", "SELECT CAST(1 AS TINYINT) AS a, CAST(2 AS SMALLINT) AS b, 3 AS c, CAST(4 AS BIGINT) AS d, CAST(1.5 AS FLOAT) AS e, CAST(2.5 AS DOUBLE) AS f, TRUE AS g, 'text' AS h, '2020-02-29' AS i, TIMESTAMP '2020-02-29 01:02:03.25' AS j, CAST(3723004000 AS BIGINT) AS k")


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark).rstrip("/"), f"{name}-{uuid.uuid4().hex}")


@query("SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS INTEGER) AS c, o_orderpriority AS p, o_totalprice AS t FROM orders")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A table written to delimited files and loaded again."""
    path = _scratch(spark, "csv")
    e = engine(spark, sf, "orders")
    e.run(f"SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders INTO OUTFILE '{path}' FIELDS TERMINATED BY '|'")
    return e.sql(f"CREATE TABLE t (k bigint, c int, p varchar(20), t double); LOAD DATA INFILE '{path}' INTO TABLE t FIELDS TERMINATED BY '|'; SELECT * FROM t")


@query("SELECT o_totalprice AS t, CAST(o_orderkey AS BIGINT) AS k, CAST(NULL AS INTEGER) AS absent FROM orders")
def load_header(spark: SparkSession, sf: str) -> DataFrame:
    """A delimited file whose columns are found by the names in its header."""
    path = _scratch(spark, "header")
    write_delimited(table(spark, sf, "orders").select(F.col("o_orderkey").alias("K"), "o_orderstatus", F.col("o_totalprice").alias("t")), path, sep="|")
    return load_by_header(spark, path, [("t", "double"), ("k", "bigint"), ("absent", "int")], [T.DoubleType(), T.LongType(), T.IntegerType()], sep="|")


@query("SELECT vec_id, len(embedding) AS n, CAST(round(CAST(embedding[1] AS DOUBLE) * 1000) AS BIGINT) AS head FROM embeddings")
def nested_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors in cells of delimited files."""
    path = _scratch(spark, "nested")
    cells = table(spark, sf, "embeddings").select("vec_id", F.concat_ws(" ; ", F.col("embedding").cast("array<string>")).alias("e"))
    write_delimited(cells, path)
    e = Engine(spark)
    e.run(f"CREATE TABLE f (vec_id bigint, e vecfloat); LOAD COMPLEX DATA INFILE '{path}' INTO TABLE f FIELDS TERMINATED BY ',' ELEMENT TERMINATED BY ';'")
    return e.sql("SELECT vec_id, CAST(size(e) AS bigint) AS n, CAST(round(CAST(e[0] AS double) * 1000) AS bigint) AS head FROM f")


@query(f"WITH {_EV} SELECT user_id, event_id, max(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS m FROM ev")
def outfile_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """A grouped vector query written to a file, which flattens it."""
    path = _scratch(spark, "out")
    e = engine(spark, sf, "events")
    e.run(f"SELECT user_id, event_id, maxs(3, CAST(round(value * 100) AS bigint)) AS m FROM events ASSUMING ASC ts, ASC event_id GROUP BY user_id INTO OUTFILE '{path}' FIELDS TERMINATED BY ';'")
    return spark.read.csv(path, header=True, sep=";", schema="user_id long, event_id long, m long")


@query("SELECT 7 AS total, 3 AS logged")
def trigger_conditional(spark: SparkSession, sf: str) -> DataFrame:
    """An action after inserts, when a condition holds; the first row of the log is from recording, which also runs."""
    e = Engine(spark)
    e.run("CREATE TABLE t (a int); CREATE TABLE log (n int)")
    e.run("PROCEDURE cond RECORD")
    e.run("SELECT count(*) > 1 FROM t")
    e.run("PROCEDURE cond STOP; PROCEDURE act RECORD")
    e.run("INSERT INTO log SELECT CAST(count(*) AS int) AS n FROM t")
    e.run("PROCEDURE act STOP")
    e.run("CREATE TRIGGER c ON t ACTION act WHEN cond; INSERT INTO t VALUES (1); INSERT INTO t VALUES (2), (3); INSERT INTO t VALUES (4); DROP TRIGGER c; INSERT INTO t VALUES (5)")
    return e.sql("SELECT CAST(sum(n) AS int) AS total, CAST(count(*) AS int) AS logged FROM log")


@query()
def forest_predict(spark: SparkSession, sf: str) -> DataFrame:
    """A forest fitted in a program, and its prediction for every vector."""
    program = """LOAD MODULE FROM 'seriate.models.forest' FUNCTIONS (newtree(trees:int, f:int64, forget:double, classes:int64, e:int) -> bool, fit_inc(X:vecdouble, y:int64) -> bool, predict(X:vecdouble) -> int);
    SELECT newtree(8, 64, 0.3, 10, 0); SELECT fit_inc(x, y) FROM source; SELECT vec_id, y, predict(x) AS guess FROM source"""
    e = Engine(spark)
    vectors = table(spark, sf, "embeddings")
    n_classes = F.pmod("label", F.lit(10))
    e.add_table("source", vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), n_classes.cast("long").alias("y")).orderBy("vec_id"))
    return e.sql(program.replace("8, 64", f"8, {len(vectors.select('embedding').first()[0])}"))


@query("SELECT count(*) AS n, TRUE AS again FROM nation")
def trigger_interval(spark: SparkSession, sf: str) -> DataFrame:
    """An action at intervals, on the clock of a stream: what it logged, at least twice."""
    e = engine(spark, sf, "nation")
    e.run("CREATE TABLE log (n bigint)")
    e.define("act", "INSERT INTO log SELECT count(*) AS n FROM nation")
    e.run("CREATE TRIGGER t ACTION act INTERVAL 200")
    end = time.time() + 20
    while e.parts["log"] < 2 and time.time() < end:
        time.sleep(0.1)
    e.run("DROP TRIGGER t")
    return e.sql("SELECT n, count(*) >= 2 AS again FROM log GROUP BY n")


@query(f"WITH {_EV} SELECT event_id, CAST(sum(v) {_frame(None)} AS BIGINT) AS total, min(v) {_frame(None)} AS low FROM ev")
def stream_running(spark: SparkSession, sf: str) -> DataFrame:
    """Running functions over a stream of files, with the state of each series kept between batches."""
    return run_stream(spark, f"{sf}/events.parquet", lambda s: running_stream(s.select("event_id", "ts", "user_id", F.round(F.col("value") * 100).cast("double").alias("v")), "user_id", ["ts", "event_id"], "v")).select("event_id", F.col("total").cast("long").alias("total"), F.col("low").cast("long").alias("low"))


@query("SELECT c_custkey, o_orderkey AS last_order FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def asof_last(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer with the last of their orders."""
    orders = OrderedFrame(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")).assuming("o_orderdate", "o_orderkey").group("o_custkey")
    last = orders.reduce(last_order=orders.last("o_orderkey"))
    return table(spark, sf, "customer").select("c_custkey").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "last_order")


@query(f"""WITH {_EV}, p AS (SELECT event_id, user_id, ts FROM ev WHERE event_type = 'purchase'), c AS (SELECT user_id AS u, ts AS at, max(event_id) AS click FROM ev WHERE event_type = 'click' GROUP BY ALL)
SELECT event_id, click FROM p ASOF LEFT JOIN c ON p.user_id = c.u AND p.ts >= c.at""")
def join_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the user's last click before it."""
    df = events(spark, sf).rows()
    clicks = df.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("ts").alias("at"), F.col("event_id").alias("click"))
    return asof_join(df.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "ts", "at", [("user_id", "u")], "click").select("event_id", "click")


_BANDS = "bands AS (SELECT s_suppkey, s_acctbal AS low, s_acctbal + s_suppkey % 40 * 5 AS high FROM supplier)"


@query(f"WITH {_BANDS} SELECT c_custkey, s_suppkey FROM customer JOIN bands ON c_acctbal BETWEEN low AND high")
def join_range(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and the suppliers in whose band their balance is; bands are of many lengths."""
    return range_join(table(spark, sf, "customer"), _bands(spark, sf), "c_acctbal", "low", "high").select("c_custkey", "s_suppkey")


@query(f"WITH {_BANDS} SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM bands a JOIN bands b ON a.low <= b.high AND b.low <= a.high")
def join_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of bands that overlap."""
    a, b = _bands(spark, sf).toDF("x", "a_low", "a_high"), _bands(spark, sf).toDF("y", "b_low", "b_high")
    return overlap_join(a, b, ("a_low", "a_high"), ("b_low", "b_high")).select("x", "y")


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + F.col("s_suppkey") % 40 * 5).alias("high"))


def _timed(stream: DataFrame) -> DataFrame:
    return stream.select("user_id", F.col("ts").cast("timestamp").alias("at"), F.round(F.col("value") * 100).cast("long").alias("v"))


# The watermark ends an hour before the last event: only what is over by then comes out.
_OVER = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"WITH {_EV} SELECT user_id, start, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT user_id, v, time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') AS start FROM ev) WHERE start + INTERVAL 2 HOURS <= {_OVER} GROUP BY user_id, start")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of two hours per user over a stream, closed by the watermark."""
    out = run_stream(spark, f"{sf}/events.parquet", lambda s: window_stream(_timed(s), "user_id", "at", "2 hours", "1 hour", [F.sum("v").alias("total")]))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "total")


@query(f"""WITH {_EV}, d AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS fresh FROM ev {_W}), s AS (SELECT *, sum(fresh) OVER w AS no FROM d {_W})
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 30 MINUTES <= {_OVER}""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users over a stream, cut at gaps of half an hour and closed by the watermark."""
    out = run_stream(spark, f"{sf}/events.parquet", lambda s: session_stream(_timed(s), "user_id", "at", "30 minutes", "1 hour", [F.sum("v").alias("total")]))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", "total")


_FOREST = """LOAD MODULE FROM 'seriate.models.forest' FUNCTIONS (newtree(trees:int, f:int64, forget:double, classes:int64, e:int) -> bool, fit_inc(X:vecdouble, y:int64) -> bool, predict(X:vecdouble) -> int);"""


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items, and a class that follows from two of four features."""
    lines = table(spark, sf, "lineitem").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    x = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")])
    return lines.select(x.alias("x"), (2 * (F.col("l_quantity") > 20).cast("long") + (F.col("l_discount") > 0.045).cast("long")).alias("y"))


@query("SELECT count(*) AS n, TRUE AS learned FROM lineitem")
def forest_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """A forest fitted as rows arrive gives at least 95 % of all rows their class."""
    e = Engine(spark)
    e.add_table("source", _classes(spark, sf))
    return e.sql(_FOREST + "SELECT newtree(8, 4, 0.3, 4, 1); SELECT fit_inc(x, y) FROM source; SELECT count(*) AS n, avg(CAST(predict(x) = y AS int)) >= 0.95 AS learned FROM source")


@query("SELECT 3 AS refits, count(*) AS n, TRUE AS learned FROM lineitem")
def append_and_refit(spark: SparkSession, sf: str) -> DataFrame:
    """Rows are appended to a table in three parts; after each a conditional trigger has the forest learn from the new ones."""
    e = Engine(spark)
    e.add_table("source", _classes(spark, sf).withColumn("part", F.pmod(F.xxhash64("x"), F.lit(3))))
    e.run(_FOREST + "CREATE TABLE seen (x vecdouble, y bigint); CREATE TABLE log (n bigint); CREATE TABLE arrivals (part int); SELECT newtree(8, 4, 0.3, 4, 1);")
    e.define("grown", "SELECT (SELECT count(*) FROM seen) > coalesce((SELECT max(n) FROM log), 0)")
    e.define("refit", "SELECT fit_inc(x, y) FROM seen; INSERT INTO log SELECT count(*) FROM seen")
    e.run("CREATE TRIGGER t ON arrivals ACTION refit WHEN grown")
    for part in range(3):
        e.run(f"INSERT INTO seen SELECT x, y FROM source WHERE part = {part}; INSERT INTO arrivals VALUES ({part})")
    e.run("INSERT INTO arrivals VALUES (9)")
    out = e.sql("SELECT (SELECT CAST(count(*) AS int) FROM log) AS refits, count(*) AS n, avg(CAST(predict(x) = y AS int)) >= 0.95 AS learned FROM seen")
    e.run("DROP TRIGGER t")
    return out


@query(f"WITH {_EV} SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM ev GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows of an hour per user."""
    return events(spark, sf).rows().groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
