"""The engine: a session of tables, functions, modules, procedures and triggers that runs programs of the dialect."""

from __future__ import annotations

import itertools
import json
import re
import time
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriate.operators.fold import flatten
from seriate.plans import ast as a
from seriate.plans.lower import Lowering
from seriate.plans.modules import ModuleFunction, load_module, table_function
from seriate.plans.parser import parse
from seriate.plans.render import quote, spark_type
from seriate.session import materialize
from seriate.sources.files import load_delimited, parse_cell, write_delimited
from seriate.streaming.triggers import Triggers

_ids = itertools.count()
#: Appended parts of a table before they are written together.
MOST_PARTS = 16


class Engine:
    """Runs programs. Tables are views of this engine alone; names unknown to it are looked up in Spark's catalog.

    ``keep_order`` numbers the rows of loaded and inserted tables, so that queries without ASSUMING see them in that order.
    ``show_order`` sorts results without ORDER BY by the assumed order (otherwise only those with a limit or to a file are).
    """

    hidden = {"_rowid"}

    def __init__(self, spark: SparkSession, keep_order: bool = False, show_order: bool = False, procedures: str | None = None):
        self.spark, self.keep_order, self.show_order = spark, keep_order, show_order
        self.folder = Path(procedures) if procedures else None
        self.tag = f"seriate{next(_ids)}"
        self.frames: dict[str, DataFrame] = {}
        self.parts: dict[str, int] = {}
        self.schemas: dict[str, list[tuple[str, str]]] = {}
        self.functions: dict[str, a.Function] = {}
        self.modules: dict[str, ModuleFunction] = {}
        self.procedures: dict[str, list[str]] = {}
        self.recording: str | None = None
        self.triggers = Triggers(self)
        self.stats: list[dict] = []
        self.local: list[dict[str, str]] = []
        self.lowering = Lowering(self)
        self.next_row = 0

    # names

    def add_table(self, name: str, df: DataFrame) -> Engine:
        """Make a DataFrame a table of this engine."""
        key = name.lower()
        self.frames[key], self.parts[key] = df, 1
        self.schemas.setdefault(key, [(f.name, f.dataType.simpleString()) for f in df.schema if f.name not in self.hidden])
        df.createOrReplaceTempView(f"{self.tag}_{key.replace('.', '_')}")
        return self

    def view(self, name: str) -> str:
        key = name.lower()
        for scope in reversed(self.local):
            if key in scope:
                return scope[key]
        return f"{self.tag}_{key.replace('.', '_')}" if key in self.frames else ".".join(map(quote, name.split(".")))

    def table(self, name: str) -> DataFrame:
        return self.frames[name.lower()] if name.lower() in self.frames else self.spark.table(self.view(name).replace("`", ""))

    def columns(self, name: str) -> list[str]:
        return self.spark.table(self.view(name)).columns

    def register(self, df: DataFrame) -> str:
        view = f"{self.tag}_q{next(_ids)}"
        df.createOrReplaceTempView(view)
        return view

    @contextmanager
    def scope(self):
        self.local.append({})
        try:
            yield self.local[-1]
        finally:
            self.local.pop()

    def within(self, q: a.With, run):
        """Run with the queries of WITH as tables."""
        with self.scope() as names:
            for name, columns, sub in q.tables:
                df = self.lowering.query(sub)
                names[name.lower()] = self.register(df.toDF(*columns) if columns else df)
            return run()

    def module_kind(self, name: str) -> str | None:
        m = self.modules.get(name)
        return m.kind if m else None

    # programs

    def run(self, text: str) -> list[DataFrame | None]:
        """Run all statements; the results of queries, and None for others."""
        if self.recording is not None:
            statements = parse(text)
            if not any(isinstance(s, a.Procedure) for s in statements):
                self.procedures[self.recording].append(text)
        out = []
        t = time.perf_counter()
        statements = parse(text)
        parsed = time.perf_counter() - t
        for s in statements:
            t = time.perf_counter()
            out.append(self.execute(s))
            self.stats.append({"statement": type(s).__name__, "parse_s": parsed, "plan_s": time.perf_counter() - t})
            parsed = 0.0
        return out

    def sql(self, text: str) -> DataFrame:
        """The result of the last query of a program."""
        results = [r for r in self.run(text) if r is not None]
        if not results:
            raise ValueError("the program has no query")
        return results[-1]

    def run_file(self, path: str) -> list[DataFrame | None]:
        return self.run(Path(path).read_text())

    def execute(self, s) -> DataFrame | None:
        return getattr(self, "x_" + type(s).__name__.lower())(s)

    def query(self, q) -> DataFrame:
        self.prepare()
        return self.lowering.query(q)

    def prepare(self) -> None:
        """Functions that carry state are registered with what they know now."""
        for m in self.modules.values():
            if m.kind == "table":
                self.spark.udtf.register(m.name, table_function(m.call, spark_type(m.returns)))
            if m.kind in ("scalar", "rows"):
                call = m.call() if m.kind == "rows" else m.call
                self.spark.udf.register(m.name, F.pandas_udf(_over_series(call), T._parse_datatype_string(spark_type(m.returns))))

    def x_query(self, s: a.Query) -> DataFrame | None:
        show = self.show_order
        self.show_order = show or s.outfile is not None
        try:
            df = self.query(s.query)
        finally:
            self.show_order = show
        if s.into:
            self.append(s.into, snapshot(df))
            return None
        if s.outfile:
            arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
            write_delimited(flatten(df, arrays) if arrays else df, s.outfile, s.sep)
            return None
        return df

    # tables

    def x_createtable(self, s: a.CreateTable) -> None:
        key = s.name.lower()
        if key in self.frames:
            if s.if_not_exists:
                return
            raise ValueError(f"table {s.name} exists")
        if s.query is not None:  # a table is what the query gives now
            self.add_table(s.name, snapshot(self.query(s.query)))
            return
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(spark_type(t))) for n, t in s.columns])
        if self.keep_order:
            schema = schema.add("_rowid", T.LongType())
        self.schemas[key] = list(s.columns)
        self.add_table(s.name, self.spark.createDataFrame([], schema))
        self.parts[key] = 0

    def append(self, name: str, df: DataFrame, overwrite: bool = False) -> None:
        """Add rows by position of their columns; an absent table is made."""
        key = name.lower()
        if key not in self.frames:
            self.add_table(name, df)
            return
        old = self.frames[key]
        fields = [f for f in old.schema if f.name not in self.hidden]
        columns = [c for c in df.columns if c not in self.hidden]
        if len(fields) != len(columns):
            raise ValueError(f"{name} has {len(fields)} columns, {len(columns)} given")
        declared = dict(self.schemas.get(key, []))
        kinds = dict(df.dtypes)
        # Text is read like a cell of a file; anything else is cast.
        cast = [(parse_cell(F.col(quote(c)), declared.get(f.name, ""), f.dataType) if kinds[c] == "string" else F.col(quote(c)).cast(f.dataType)).alias(f.name) for c, f in zip(columns, fields)]
        if "_rowid" in old.columns:
            self.next_row += 1 << 40
            cast.append((F.monotonically_increasing_id() + self.next_row).alias("_rowid"))
        new = df.select(*cast)
        parts = 1 if overwrite or not self.parts[key] else self.parts[key] + 1
        both = new if parts == 1 else old.union(new)
        if parts > MOST_PARTS:
            both, parts = materialize(both, key), 1
        self.frames[key] = both
        both.createOrReplaceTempView(f"{self.tag}_{key.replace('.', '_')}")
        self.parts[key] = parts

    def x_insert(self, s: a.Insert) -> None:
        df = self.query(s.query)
        if not isinstance(s.query, a.Values):
            df = snapshot(df.toDF(*[c if c in self.hidden else f"{c}__{i}" for i, c in enumerate(df.columns)]))
        if s.columns:
            given = {c.lower(): n for c, n in zip(s.columns, df.columns)}
            fields = [f for f in self.table(s.table).schema if f.name not in self.hidden]
            unknown = set(given) - {f.name.lower() for f in fields}
            if unknown:
                raise ValueError(f"{s.table} has no column {', '.join(sorted(unknown))}")
            df = df.select(*[(F.col(quote(given[f.name.lower()])) if f.name.lower() in given else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
        self.append(s.table, df, s.overwrite)
        # As a query that moves rows replaces the step that arms triggers, only inserted values do.
        if isinstance(s.query, a.Values):
            self.triggers.inserted(s.table)

    def x_update(self, s: a.Update) -> None:
        df, cond = self.table(s.table), F.lit(True) if s.where is None else F.coalesce(F.expr(self.lowering.expr(s.where)), F.lit(False))
        sets = {c.lower(): F.expr(self.lowering.expr(e)) for c, e in s.sets}
        self.replace(s.table, df.select(*[F.when(cond, sets[f.name.lower()].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name.lower() in sets else F.col(f.name) for f in df.schema]))

    def x_delete(self, s: a.Delete) -> None:
        df = self.table(s.table)
        self.replace(s.table, df.limit(0) if s.where is None else df.where(~F.coalesce(F.expr(self.lowering.expr(s.where)), F.lit(False))))

    def replace(self, name: str, df: DataFrame) -> None:
        key = name.lower()
        self.frames[key], self.parts[key] = df, 1
        df.createOrReplaceTempView(f"{self.tag}_{key.replace('.', '_')}")

    def x_drop(self, s: a.Drop) -> None:
        key = s.name.lower()
        known = {"table": self.frames, "view": self.frames, "function": self.functions, "trigger": self.triggers.known}[s.kind]
        if key not in known:
            if s.if_exists:
                return
            raise ValueError(f"no {s.kind} {s.name}")
        if s.kind == "trigger":
            self.triggers.drop(key)
            return
        known.pop(key)
        if s.kind in ("table", "view"):
            self.schemas.pop(key, None)
            self.spark.catalog.dropTempView(f"{self.tag}_{key.replace('.', '_')}")

    def x_createview(self, s: a.CreateView) -> None:
        df = self.query(s.query)
        self.schemas.pop(s.name.lower(), None)
        self.add_table(s.name, df.toDF(*s.columns) if s.columns else df)

    def x_load(self, s: a.Load) -> None:
        key = s.table.lower()
        if key not in self.frames:
            raise ValueError(f"no table {s.table}")
        fields = [f for f in self.frames[key].schema if f.name not in self.hidden]
        declared = dict(self.schemas[key])
        df = load_delimited(self.spark, s.path, [(f.name, declared.get(f.name, "")) for f in fields], [f.dataType for f in fields], s.sep, s.element_sep)
        self.append(s.table, df)

    def x_cachetable(self, s: a.CacheTable) -> None:
        df = self.table(s.table).persist()
        if not s.lazy:
            df.count()
        if s.table.lower() in self.frames:
            self.replace(s.table, df)
        else:
            self.add_table(s.table, df)

    def x_passthrough(self, s: a.Passthrough) -> DataFrame | None:
        """Statements handed to Spark as they are; inserts into tables of this engine go to them."""
        out = None
        for text in s.statements:
            words = text.split(None, 2)
            head = " ".join(words[:2]).lower()
            if head.startswith(("insert", "delete from", "create index", "drop index", "update", "create table", "drop table")):
                for st in parse(text):
                    self.execute(st)
                continue
            # Spark parses the text itself; its names of our tables are made known as views for the time, views of the user's own set aside.
            said = {w.lower() for w in re.findall(r"\w+", text)}
            views = {key.replace(".", "_"): df for key, df in self.frames.items() if key.replace(".", "_") in said}
            there = {t.name.lower() for t in self.spark.catalog.listTables() if t.isTemporary} if views else set()
            own = {name: self.spark.table(name) for name in views if name in there}
            try:
                for name, df in views.items():
                    df.drop(*self.hidden).createOrReplaceTempView(name)
                out = self.spark.sql(text)
            finally:
                for name in views:
                    if name in own:
                        own[name].createOrReplaceTempView(name)
                    else:
                        self.spark.catalog.dropTempView(name)
        return out

    def x_ignored(self, s: a.Ignored) -> None:
        return None

    # functions and modules

    def x_function(self, s: a.Function) -> None:
        self.functions[s.name] = s

    def x_loadmodule(self, s: a.LoadModule) -> None:
        for f in load_module(s.path, s.functions):
            self.modules[f.name] = f

    def frame_call(self, lowering: Lowering, items: list[a.Item], q: a.Select) -> DataFrame | None:
        """The result of a query that is one call of a module's frame function."""
        if len(items) != 1 or not isinstance(items[0].value, a.Call) or self.module_kind(items[0].value.name) != "frame":
            return None
        call = items[0].value
        module = self.modules[call.name]
        columns = [x for x in call.args if not isinstance(x, a.Lit)]
        df = None
        if columns:
            df = lowering.query(a.Select(tuple(a.Item(x, f"arg{i}") for i, x in enumerate(columns)), q.source, q.assuming, q.where))
        value = module.call(df, *[x.value for x in call.args if isinstance(x, a.Lit)])
        return self.spark.createDataFrame([(value,)], T.StructType([T.StructField(items[0].alias or call.name, T._parse_datatype_string(spark_type(module.returns)))]))

    # procedures and triggers

    def x_procedure(self, s: a.Procedure) -> DataFrame | None:
        if s.verb == "display":
            return self.spark.createDataFrame([(n, len(t)) for n, t in sorted(self.procedures.items())], "procedure string, statements int")
        name = s.name.lower()
        if s.verb == "record":
            self.procedures[name], self.recording = [], name
        elif s.verb == "stop":
            self.recording = None
        elif s.verb == "run":
            self.call_procedure(name)
        elif s.verb == "remove":
            self.procedures.pop(name, None)
        elif s.verb in ("save", "load"):
            if self.folder is None:
                raise ValueError("the engine has no folder for procedures")
            path = self.folder / f"{name}.json"
            if s.verb == "save":
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(json.dumps(self.procedures[name]))
            else:
                self.procedures[name] = json.loads(path.read_text())
        else:
            raise ValueError(f"procedures can't {s.verb}")
        return None

    def define(self, name: str, *statements) -> None:
        """A procedure of texts, or of Python functions of the engine."""
        self.procedures[name.lower()] = list(statements)

    def call_procedure(self, name: str) -> int:
        """Run a procedure; the first cell of its last query, as a whole number, is its value (0 if there is none)."""
        value = 0
        for text in self.procedures[name.lower()]:
            results = [text(self)] if callable(text) else self.run(text)
            for r in results:
                if isinstance(r, DataFrame):
                    row = r.first()
                    cell = row[0] if row is not None and len(row) else 0
                    value = int(cell or 0) if isinstance(cell, (int, float, bool)) else 0
                elif isinstance(r, (int, float)):
                    value = int(r)
        return value

    def x_createtrigger(self, s: a.CreateTrigger) -> None:
        self.triggers.create(s)

    def close(self) -> None:
        """Stop triggers and drop the engine's views."""
        self.triggers.stop()
        for key in self.frames:
            self.spark.catalog.dropTempView(f"{self.tag}_{key.replace('.', '_')}")


def _over_series(call):
    def run(*series: pd.Series) -> pd.Series:
        got = call(*series)
        return got if isinstance(got, pd.Series) else pd.Series(got)

    return run


def snapshot(df: DataFrame) -> DataFrame:
    """The rows that a query gives now; columns without a type become text."""
    return materialize(df.select(*[F.col(quote(f.name)).cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(quote(f.name)) for f in df.schema]), "table")
