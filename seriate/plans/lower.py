"""Queries to DataFrames.

A query without order-dependent parts is rendered to Spark SQL as a whole. Any other is lowered in stages: the source with its filter and the columns
that are used; group keys, with vector functions in them taken over the whole ordered table; vector functions by level of nesting, all of a
level in one pass over one window specification; aggregates; and what follows them. Catalyst plans each stage's physical side.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriate.functions.vector import RUNNING, SHIFTED, Order
from seriate.operators.fold import group_fold
from seriate.operators.scan import Vec, add_vectors, too_long
from seriate.plans import ast as a
from seriate.plans.functions import compile_function, inlinable, inline
from seriate.plans.render import Renderer, children, quote, replace, spark_type, walk

VECTOR = {*RUNNING, *SHIFTED} - {"counts"}
REDUCED = {"count", "sum", "avg", "min", "max", "var", "stddev", "corr", "median", "first", "last"}
#: Other aggregates of Spark that a query may name.
_MORE = {"approx_count_distinct", "percentile_approx", "percentile", "collect_list", "collect_set", "any_value", "bool_and", "bool_or", "count_if", "covar_pop", "covar_samp", "mode", "skewness", "kurtosis", "stddev_pop", "stddev_samp", "var_pop", "var_samp", "variance", "mean", "max_by", "min_by", "listagg", "string_agg", "array_agg", "percentile_cont", "percentile_disc", "regr_slope", "regr_r2", "regr_count", "bit_and", "bit_or", "bit_xor", "sum_distinct", "product"}
#: Aggregates that a query may take of a value that is none of many.
_OF_SCALAR = {"count", "sum", "avg", "min", "max", "var", "stddev", "median", "first", "last"}
_ids = itertools.count()


class Lowering:
    """Lowers queries for an engine, which knows tables, functions and modules."""

    def __init__(self, engine):
        self.engine, self.spark = engine, engine.spark

    # whole queries

    def query(self, q) -> DataFrame:
        if isinstance(q, a.With):
            return self.engine.within(q, lambda: self.query(q.query)) if not q.recursive else self.sql(self.text(q))
        if isinstance(q, a.SetOp) and self.ordered(q):
            left, right = self.query(q.left), self.query(q.right)
            out = {"union all": left.union(right), "union": left.union(right).distinct(), "except": left.subtract(right), "except all": left.exceptAll(right), "intersect": left.intersect(right), "intersect all": left.intersectAll(right)}[q.op]
            return self.finish(out, q)
        if isinstance(q, a.Select) and (self.ordered(q) or self.folds(q)):
            return self.select(q)
        return self.sql(self.text(q))

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def is_special(self, c) -> bool:
        return isinstance(c, a.Call) and c.over is None and (c.name in VECTOR or c.name in self.engine.functions or self.engine.module_kind(c.name) in ("vector", "frame") or c.name in ("first", "last"))

    def ordered(self, q) -> bool:
        if isinstance(q, a.SetOp):
            return self.ordered(q.left) or self.ordered(q.right)
        if not isinstance(q, a.Select):
            return False
        parts = [*[i.value for i in q.items], *[k.value for k in q.group if isinstance(k, a.Item)], *([q.having] if q.having is not None else []), *[o.value for o in q.order], *([q.where] if q.where is not None else [])]
        if any(self.is_reduced(n) and any(self.is_reduced(m) for c in children(n) for m in walk(c)) for p in parts for n in walk(p)):
            return True  # an aggregate of an aggregate
        if not q.group and any(self.kind(i.value, []) == "vector" and any(self.is_reduced(n) for n in walk(i.value)) for i in q.items):
            return True  # a vector with an aggregate
        return bool(q.assuming) or any(self.is_special(n) for p in parts for n in walk(p))

    def folds(self, q: a.Select) -> bool:
        """Whether a grouped query projects what is neither a key nor an aggregate: a vector per group."""
        if not q.group or q.group_kind:
            return False
        keys = [k.value for k in q.group]
        return any(isinstance(i.value, a.Star) or self.kind(i.value, keys) == "vector" for i in q.items)

    def is_reduced(self, n) -> bool:
        return isinstance(n, a.Call) and n.over is None and (n.name in REDUCED or n.name in _MORE or self.is_udaf(n.name))

    def is_udaf(self, name: str) -> bool:
        f = self.engine.functions.get(name)
        return (f is not None and not inlinable(f)) or self.engine.module_kind(name) == "vector"

    def kind(self, e, keys: list) -> str:
        """key, reduced, vector or const."""
        if any(self.same(e, k) for k in keys):
            return "key"
        if self.is_reduced(e):
            return "reduced"
        if isinstance(e, (a.Name, a.Star)) or (isinstance(e, a.Call) and e.name in VECTOR):
            return "vector"
        kinds = {self.kind(c, keys) for c in children(e)}
        return next((k for k in ("vector", "reduced", "key") if k in kinds), "const")

    def scalars(self, e, keys: list):
        """Aggregates of what is one value already: its count is 1, its variance 0, anything else is the value."""
        def one(n):
            if not (self.is_reduced(n) and n.name in _OF_SCALAR and len(n.args) == 1 and n.filter is None):
                return None
            value = replace(n.args[0], one)
            if self.kind(value, keys) != "reduced":
                return a.Call(n.name, (value,), n.distinct, n.over, n.filter, n.nulls, n.within)
            return {"count": a.Lit(1, "number"), "var": a.Lit(0, "number"), "stddev": a.Lit(0, "number")}.get(n.name, value)

        return replace(e, one)

    @staticmethod
    def same(x, y) -> bool:
        if isinstance(x, a.Name) and isinstance(y, a.Name):
            # t.a and a are taken as one where only one of them is qualified.
            p, q = [s.lower() for s in x.parts], [s.lower() for s in y.parts]
            return p[-1] == q[-1] and (len(p) == 1 or len(q) == 1 or p == q)
        return x == y

    # plain queries as text

    def text(self, q) -> str:
        if isinstance(q, a.With):
            parts = [f"{quote(n)}{'(' + ', '.join(map(quote, c)) + ')' if c else ''} AS ({self.text(t)})" for n, c, t in q.tables]
            return f"WITH {'RECURSIVE ' if q.recursive else ''}{', '.join(parts)} {self.text(q.query)}"
        if isinstance(q, a.Values):
            return "VALUES " + ", ".join("(" + ", ".join(map(self.expr, r)) + ")" for r in q.rows)
        if isinstance(q, a.SetOp):
            return f"({self.text(q.left)}) {q.op.upper()} ({self.text(q.right)})" + self.tail(q)
        if self.ordered(q) or self.folds(q):
            return f"SELECT * FROM {self.engine.register(self.select(q))}"
        items, seen = [], set()
        for i in self.expand_stars(q):
            name = i.alias or self.label(i.value)
            text = self.expr(i.value)
            if name and not isinstance(i.value, a.Star):
                while name.lower() in seen:
                    name += "_1"
                seen.add(name.lower())
                text += f" AS {quote(name)}"
            items.append(text)
        top = ""
        out = f"SELECT {'DISTINCT ' if q.distinct and not q.distinct_on else ''}{top}{', '.join(items)}"
        if q.source is not None:
            out += f" FROM {self.source(q.source)}"
        if q.where is not None:
            out += f" WHERE {self.expr(q.where)}"
        if q.group:
            if q.group_kind == "sets":
                out += " GROUP BY GROUPING SETS (" + ", ".join("(" + ", ".join(map(self.expr, s)) + ")" for s in q.group) + ")"
            else:
                keys = ", ".join(self.expr(k.value) for k in q.group)
                out += f" GROUP BY {q.group_kind.upper()}({keys})" if q.group_kind else f" GROUP BY {keys}"
        if q.having is not None:
            out += f" HAVING {self.expr(q.having)}"
        if q.windows:
            out += " WINDOW " + ", ".join(f"{n} AS {self.renderer().window(w)}" for n, w in q.windows)
        if q.distinct_on or q.top:
            return self.limited(q, out)
        return out + self.tail(q)

    def limited(self, q: a.Select, inner: str) -> str:
        """DISTINCT ON and TOP, by numbering rows."""
        order = ", ".join(map(self.renderer().order, q.order)) or "1"
        if q.top:
            n, percent, ties = q.top
            if not percent and not ties:
                return inner + self.tail(a.Select(**{**q.__dict__, "limit": a.Lit(n, "number")}))
            return f"SELECT * FROM {self.engine.register(self.first_rows(q, inner))}"
        keys = ", ".join(map(self.expr, q.distinct_on))
        inner = inner.replace("SELECT ", f"SELECT row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS __place, ", 1)
        return f"SELECT * EXCEPT (__place) FROM ({inner}) WHERE __place = 1" + (f" LIMIT {self.expr(q.limit)}" if q.limit is not None else "")

    def first_rows(self, q: a.Select, inner: str) -> DataFrame:
        """TOP with PERCENT or WITH TIES: by the rows' places in the order, which are found in segments if the table is long."""
        n, percent, ties = q.top
        keys = [f"__k{i}" for i in range(len(q.order))]
        first = "".join(f"{self.expr(o.value)} AS {k}, " for o, k in zip(q.order, keys))
        df = self.sql(inner.replace("SELECT ", f"SELECT {first}", 1))
        n = math.ceil(df.count() * n / 100) if percent else int(n)
        if not keys:
            return df.limit(n)
        # Where nulls go is a key of its own: false comes before true.
        nulls = [(o.nulls or ("first" if o.up else "last")) == "last" for o in q.order]
        df = df.withColumns({f"{k}n": F.col(k).isNull() if last else F.col(k).isNotNull() for k, last in zip(keys, nulls)})
        by = [b for o, k in zip(q.order, keys) for b in ((f"{k}n", True), (k, o.up))]
        placed = add_vectors(df, Order.of(*by), [Vec("__place", "position")])
        out = placed.where(F.col("__place") < n)
        if ties:
            last = F.broadcast(placed.where(F.col("__place") == n - 1).select(*[F.col(k).alias(f"{k}l") for k in keys]))
            same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}l")) for k in keys])
            out = out.unionByName(placed.where(F.col("__place") >= n).join(last, same, "left_semi"))
        return out.orderBy("__place").drop(*keys, *[f"{k}n" for k in keys], "__place")

    def tail(self, q) -> str:
        out = f" ORDER BY {', '.join(map(self.renderer().order, q.order))}" if q.order else ""
        out += f" LIMIT {self.expr(q.limit)}" if q.limit is not None else ""
        return out + (f" OFFSET {self.expr(q.offset)}" if q.offset is not None else "")

    def renderer(self, name=None) -> Renderer:
        return Renderer(name, self.text)

    def expr(self, e) -> str:
        return self.renderer()(e)

    @staticmethod
    def label(e) -> str:
        """The name of an unnamed column: its text without what can't stand in a name."""
        if isinstance(e, a.Name):
            return e.parts[-1]
        return re.sub(r"[^0-9a-z_]", "", Renderer(query=lambda q: "query")(e).lower())[:80] or "column"

    def source(self, s) -> str:
        alias = f" AS {quote(s.alias)}" if getattr(s, "alias", None) and not isinstance(s, a.LateralView) else ""
        columns = f"({', '.join(map(quote, s.columns))})" if alias and getattr(s, "columns", ()) else ""
        if isinstance(s, a.TableRef):
            name = self.engine.view(s.name)
            if not alias and name != s.name:
                alias = f" AS {quote(s.name.split('.')[-1])}"
            return name + (f" TABLESAMPLE ({s.sample})" if s.sample else "") + alias + columns
        if isinstance(s, a.SubRef):
            return f"({self.text(s.query)}){alias}{columns}"
        if isinstance(s, a.FuncRef):
            if s.ordinality:  # numbers from 1, as the last column
                return f"(SELECT * EXCEPT (pos), pos + 1 AS ordinality FROM {self.expr(s.call)}){alias}{columns}"
            return f"{self.expr(s.call)}{alias}{columns}"
        if isinstance(s, a.LateralView):
            return f"{self.source(s.source)} LATERAL VIEW {'OUTER ' if s.outer else ''}{self.expr(s.call)} {quote(s.alias)}{' AS ' + ', '.join(map(quote, s.columns)) if s.columns else ''}"
        right = self.source(s.right)
        if isinstance(s.right, a.Join):
            right = f"({right})"
        kind = "cross" if s.kind == "comma" else s.kind
        lateral = "lateral " in kind
        kind = kind.replace("lateral ", "")
        out = f"{self.source(s.left)} {kind.upper()} JOIN {'LATERAL ' if lateral else ''}{right}"
        if s.on is not None:
            out += f" ON {self.expr(s.on)}"
        elif s.using:
            out += f" USING ({', '.join(map(quote, s.using))})"
        return out

    # scopes

    def tables(self, s) -> list[tuple[str, list[str]]]:
        """Aliases and columns of a source, from left to right."""
        if isinstance(s, a.Join):
            return self.tables(s.left) + self.tables(s.right)
        if isinstance(s, a.LateralView):
            return [*self.tables(s.source), (s.alias, list(s.columns))]
        if isinstance(s, a.TableRef):
            columns = list(s.columns) or self.engine.columns(s.name)
            return [(s.alias or s.name.split(".")[-1], columns)]
        df = self.spark.sql(f"SELECT * FROM {self.source(s)}")
        return [(s.alias or "", df.columns)]

    def equal_columns(self, q: a.Select) -> dict[tuple[str, str], tuple[str, str]]:
        """Columns that an inner join makes equal, with the leftmost of their class."""
        tables = self.tables(q.source) if q.source is not None else []
        owner: dict[str, list[str]] = {}
        for t, cols in tables:
            for c in cols:
                owner.setdefault(c.lower(), []).append(t.lower())
        place = {t.lower(): i for i, (t, _) in enumerate(tables)}
        parent: dict[tuple[str, str], tuple[str, str]] = {}

        def find(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        def unite(x, y):
            x, y = sorted((find(x), find(y)), key=lambda n: place.get(n[0], 99))
            if x != y:
                parent[y] = x

        def key(n):
            if not isinstance(n, a.Name):
                return None
            c = n.parts[-1].lower()
            if len(n.parts) > 1:
                return (n.parts[-2].lower(), c)
            return (owner[c][0], c) if len(owner.get(c, [])) == 1 else None

        def conditions(e):
            if isinstance(e, a.Op) and e.op == "and":
                for x in e.args:
                    conditions(x)
            elif isinstance(e, a.Op) and e.op == "=":
                x, y = map(key, e.args)
                if x and y and x[0] != y[0]:
                    unite(x, y)

        def joins(s) -> bool:
            """Whether all joins are inner ones."""
            if isinstance(s, a.LateralView):
                return joins(s.source)
            if not isinstance(s, a.Join):
                return True
            inner = joins(s.left) & joins(s.right) & (s.kind in ("comma", "inner", "natural inner", "cross"))
            if inner:
                if s.on is not None:
                    conditions(s.on)
                left, right = self.tables(s.left), self.tables(s.right)
                shared = s.using or ([c for _, cs in right for c in cs if any(c.lower() in map(str.lower, x) for _, x in left)] if s.kind.startswith("natural") else ())
                for c in shared:
                    for t, cs in left + right:
                        if c.lower() in map(str.lower, cs):
                            first = next(t2 for t2, cs2 in left if c.lower() in map(str.lower, cs2))
                            unite((first.lower(), c.lower()), (t.lower(), c.lower()))
            return inner

        if q.source is not None and joins(q.source) and q.where is not None:
            conditions(q.where)
        return {k: find(k) for k in list(parent)}

    def expand_stars(self, q: a.Select) -> list[a.Item]:
        """Items with stars over joins spelled out, without columns that a join made equal to one before."""
        if not any(isinstance(i.value, a.Star) for i in q.items) or q.source is None:
            return list(q.items)
        hidden = self.engine.hidden
        if not isinstance(q.source, (a.Join, a.LateralView)):
            tables = self.tables(q.source)
            if not any(c in hidden for _, cs in tables for c in cs):
                return list(q.items)
        else:
            tables = self.tables(q.source)
        outer = self.outer_using(q.source)
        equal = self.equal_columns(q)
        out = []
        for i in q.items:
            if not isinstance(i.value, a.Star):
                out.append(i)
                continue
            if outer and not i.value.table:
                out.append(i)  # Spark merges the columns of outer USING and NATURAL joins
                continue
            for t, cols in tables:
                if i.value.table and i.value.table.lower() != t.lower():
                    continue
                for c in cols:
                    if c in hidden:
                        continue
                    k = (t.lower(), c.lower())
                    if i.value.table or equal.get(k, k) == k:
                        out.append(a.Item(a.Name((t, c) if t else (c,)), c))
        return out

    def outer_using(self, s) -> bool:
        if isinstance(s, a.Join):
            return ((bool(s.using) or "natural" in s.kind) and "inner" not in s.kind) or self.outer_using(s.left) or self.outer_using(s.right)
        return False

    # ordered queries

    def select(self, q: a.Select) -> DataFrame:
        functions = self.engine.functions
        group = [inline(k.value, functions) for k in q.group]
        x = lambda e: self.scalars(inline(e, functions), group)
        items = [a.Item(x(i.value), i.alias or (None if isinstance(i.value, a.Star) else self.label(i.value))) for i in self.expand_stars(q)]
        keys = [a.Item(x(k.value), k.alias) for k in q.group]
        having = None if q.having is None else x(q.having)
        order = [a.OrderBy(x(o.value), o.up, o.nulls) for o in q.order]
        where = None if q.where is None else x(q.where)
        aliases = {k.alias.lower(): k.value for k in keys if k.alias}
        items = [a.Item(aliases.get(i.value.parts[0].lower(), i.value) if isinstance(i.value, a.Name) and len(i.value.parts) == 1 else i.value, i.alias) for i in items]

        frame = self.engine.frame_call(self, items, q)
        if frame is not None:
            return frame
        assuming = list(q.assuming)
        if q.source is not None and not assuming and isinstance(q.source, a.TableRef) and "_rowid" in self.engine.columns(q.source.name):
            assuming = [a.OrderBy(a.Name(("_rowid",)))]

        # 1. Source, filter and the columns used, each under a name of its own.
        used: dict[tuple[str, ...], str] = {}
        equal = self.equal_columns(q)
        tables = self.tables(q.source) if q.source is not None else []
        outputs = {i.alias.lower() for i in items if i.alias}

        def canonical(parts: tuple[str, ...]) -> tuple[str, ...]:
            low = tuple(p.lower() for p in parts)
            owners = [t.lower() for t, cs in tables if low[-1] in map(str.lower, cs)]
            if len(low) == 1 and len(owners) > 1:
                classes = {equal.get((t, low[0]), (t, low[0])) for t in owners}
                if len(classes) == 1:
                    return classes.pop()
                return low
            if len(low) == 1 and len(owners) == 1:
                low = (owners[0], low[0])
            return equal.get(low, low) if len(low) == 2 else low

        def internal(n: a.Name) -> a.Name:
            parts = canonical(n.parts)
            if parts not in used:
                used[parts] = f"__c{len(used)}_{re.sub(r'[^0-9A-Za-z_]', '', parts[-1])}"
            return a.Name((used[parts],))

        def own(e):
            return replace(e, lambda n: internal(n) if isinstance(n, a.Name) else None)

        items = [a.Item(own(i.value), i.alias) if not isinstance(i.value, a.Star) else i for i in items]
        if any(isinstance(i.value, a.Star) for i in items):
            cols = self.spark.sql(f"SELECT * FROM {self.source(q.source)}").columns
            items = [j for i in items for j in ([a.Item(internal(a.Name((c,))), c) for c in cols if c not in self.engine.hidden] if isinstance(i.value, a.Star) else [i])]
        keys = [a.Item(own(k.value), k.alias) for k in keys]
        having = None if having is None else own(having)
        order = [o if isinstance(o.value, a.Name) and len(o.value.parts) == 1 and o.value.parts[0].lower() in outputs else a.OrderBy(own(o.value), o.up, o.nulls) for o in order]
        by = tuple((internal(o.value).parts[0], o.up) for o in assuming)
        tests = f" WHERE {self.expr(where)}" if where is not None else ""
        resolve = lambda parts: ".".join(map(quote, parts)) if not (len(parts) == 2 and self.outer_using(q.source)) else quote(parts[-1])
        columns = ", ".join(f"{resolve(p)} AS {quote(n)}" for p, n in used.items()) or "1 AS __one"
        df = self.sql(f"SELECT {columns}" + (f" FROM {self.source(q.source)}" if q.source is not None else "") + tests)

        # 2. Group keys; vector functions in them see the whole table.
        stage = _Stage(self, df, Order(by))
        key_names = []
        if keys:
            values = stage.resolve([k.value for k in keys])
            for k, value in zip(keys, values):
                name = value.parts[0] if isinstance(value, a.Name) else stage.add(value)
                key_names.append(name)
                match = lambda n, k=k, name=name: a.Name((name,)) if n == k.value else None
                items = [a.Item(replace(i.value, match), i.alias) for i in items]
                having = None if having is None else replace(having, match)
                order = [a.OrderBy(replace(o.value, match), o.up, o.nulls) for o in order]
        stage.order = Order(by, tuple(key_names))
        key_nodes = [a.Name((k,)) for k in key_names]
        kinds = [self.kind(i.value, key_nodes) for i in items]
        reduced = all(k != "vector" for k in kinds) and (bool(keys) or "reduced" in kinds)

        # 3. Vector functions, level by level; aggregates that vectors need become columns.
        exprs = [i.value for i in items]
        extra = [having] if having is not None else []
        sort_by = [o.value for o in order if not (isinstance(o.value, a.Name) and o.value.parts[0].lower() in outputs)]
        top = [k != "vector" and (reduced or bool(keys)) for k in kinds]
        resolved = stage.resolve([*exprs, *extra, *sort_by], [*top, *([True] * len(extra)), *[reduced or self.kind(s, key_nodes) != "vector" for s in sort_by]])
        exprs, extra, sort_by = resolved[: len(exprs)], resolved[len(exprs) : len(exprs) + len(extra)], resolved[len(exprs) + len(extra) :]
        names = self.unique([i.alias or f"column{n}" for n, i in enumerate(items)])
        hidden_sort = [f"__sort{n}" for n in range(len(sort_by))]

        if not keys and not reduced:
            exprs = stage.slice_rows(exprs)
            out = stage.df.select(*[F.expr(self.expr(e)).alias(n) for e, n in zip([*exprs, *sort_by], [*names, *hidden_sort])], *[F.col(f"`{c}`").alias(f"__by{n}") for n, (c, _) in enumerate(by)])
            return self.finish(out, q, order, hidden_sort, names, [F.col(f"__by{n}").asc() if up else F.col(f"__by{n}").desc() for n, (_, up) in enumerate(by)])
        # 4. Aggregates, and arrays for what stays a vector.
        final = stage.aggregate(key_names, [*exprs, *extra, *sort_by], [*names, *["__having"] * len(extra), *hidden_sort])
        if extra:
            final = final.where("__having").drop("__having")
        return self.finish(final, q, order, hidden_sort, names, [])

    @staticmethod
    def unique(names: list[str]) -> list[str]:
        out: list[str] = []
        for n in names:
            while n.lower() in [o.lower() for o in out]:
                n += "_1"
            out.append(n)
        return out

    def finish(self, df: DataFrame, q, order=None, hidden=(), names=None, shown=()) -> DataFrame:
        """Distinct, order, limit and offset of a result."""
        names = names or df.columns
        if isinstance(q, a.SetOp):
            order, hidden = list(q.order), ()
        if getattr(q, "distinct", False):
            df = df.select(*[quote(n) for n in names]).distinct()
            hidden, shown = (), ()
        if getattr(q, "distinct_on", ()):
            df = df.dropDuplicates([self.label(e) for e in q.distinct_on])
        spare = list(hidden)
        columns = []
        for o in order or ():
            if isinstance(o.value, a.Name) and o.value.parts[-1].lower() in [n.lower() for n in names]:
                c = F.col(quote(o.value.parts[-1]))
            elif isinstance(o.value, a.Lit) and isinstance(o.value.value, int):
                c = F.col(quote(names[o.value.value - 1]))
            else:
                c = F.col(spare.pop(0))
            columns.append({(True, None): c.asc, (False, None): c.desc, (True, "first"): c.asc_nulls_first, (True, "last"): c.asc_nulls_last, (False, "first"): c.desc_nulls_first, (False, "last"): c.desc_nulls_last}[(o.up, o.nulls)]())
        limit = q.limit.value if q.limit is not None else q.top[0] if getattr(q, "top", None) else None
        if columns:
            df = df.orderBy(*columns)
        elif shown and (limit is not None or q.offset is not None or self.engine.show_order):
            df = df.orderBy(*shown)
        if q.offset is not None:
            df = df.offset(q.offset.value)
        if limit is not None:
            df = df.limit(limit)
        return df.select(*[quote(n) for n in names])


class _Stage:
    """A DataFrame that grows columns as parts of expressions are computed."""

    def __init__(self, lowering: Lowering, df: DataFrame, order: Order):
        self.lowering, self.df, self.order = lowering, df, order

    def add(self, e) -> str:
        name = f"__v{next(_ids)}"
        self.df = self.df.withColumn(name, F.expr(self.lowering.expr(e)))
        return name

    def column(self, e) -> str:
        return e.parts[0] if isinstance(e, a.Name) else self.add(e)

    def number(self, e) -> str:
        """A column to calculate with: truth values count as 0 and 1."""
        name = self.column(e)
        return self.add(a.Cast(a.Name((name,)), "int")) if isinstance(self.df.schema[name].dataType, T.BooleanType) else name

    def resolve(self, exprs: list, keep_top: list[bool] | None = None) -> list:
        """The expressions with vector functions, and the aggregates inside vectors, replaced by columns. Where ``keep_top`` is set, outermost aggregates stay."""
        low = self.lowering
        keep_top = keep_top or [False] * len(exprs)

        def special(n) -> bool:
            return isinstance(n, a.Call) and n.over is None and (n.name in VECTOR or low.is_reduced(n))

        def ready(n) -> bool:
            return special(n) and not any(special(m) for c in children(n) for m in walk(c))

        while True:
            todo: list[a.Call] = []

            def gather(e, inside: bool):
                """Specials to be computed now: all vectors, and aggregates below another special or in a vector expression."""
                if ready(e):
                    if (e.name in VECTOR or inside) and e not in todo:
                        todo.append(e)
                    return
                for c in children(e):
                    gather(c, inside or special(e))

            for e, top in zip(exprs, keep_top):
                gather(e, not top)
            if not todo:
                return exprs
            done: dict[a.Call, a.Name] = {}
            vecs = []
            for c in todo:
                name = f"__v{next(_ids)}"
                done[c] = a.Name((name,))
                if c.name in VECTOR:
                    w = None
                    if len(c.args) > 1:
                        if not (isinstance(c.args[0], a.Lit) and isinstance(c.args[0].value, int)):
                            raise ValueError(f"the width of {c.name} must be a whole number")
                        w = c.args[0].value
                    vecs.append(Vec(name, c.name, self.number(c.args[-1]) if c.name in ("sums", "avgs", "vars", "stddevs", "deltas", "ratios") else self.column(c.args[-1]), w))
                elif c.name in ("first", "last"):
                    vecs.append(Vec(name, c.name, self.column(c.args[0])))
            if vecs:
                self.need_order()
                self.df = add_vectors(self.df, self.order, vecs)
            for c in todo:
                if c.name not in VECTOR and c.name not in ("first", "last"):
                    self.value(done[c].parts[0], c)
            known = lambda n: done.get(n) if isinstance(n, a.Call) else None

            def below(n):
                """An outermost aggregate stays; what is in it is replaced."""
                if not special(n) or n.name in VECTOR:
                    return known(n)
                return replace(n, lambda m: None if m is n else known(m))

            exprs = [replace(e, below if top else known) for e, top in zip(exprs, keep_top)]

    def need_order(self) -> None:
        if not self.order.by:
            raise ValueError("the query uses the order of rows: say ASSUMING ASC or DESC and columns")

    def value(self, name: str, c: a.Call) -> None:
        """An aggregate as a column of its rows."""
        low = self.lowering
        if low.is_udaf(c.name):
            raise ValueError(f"{c.name} can't be used inside a vector expression")
        if self.order.keys:
            # Joined back where a window would hold too much; and where there is no such window.
            if c.distinct or c.name == "median" or too_long(self.df, self.order.keys):
                reduced = self.df.groupBy(*self.order.keys).agg(F.expr(low.expr(c)).alias(name))
                renamed = reduced.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.order.keys)], name)
                match = F.lit(True)
                for i, k in enumerate(self.order.keys):
                    match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
                self.df = self.df.join(renamed, match, "left").drop(*[f"__k{i}" for i in range(len(self.order.keys))])
            else:
                self.df = self.df.withColumn(name, F.expr(f"{low.expr(c)} OVER (PARTITION BY {', '.join(map(quote, self.order.keys))})"))
        else:
            # One row for the whole table: a scalar subquery, not a window over everything.
            self.df = self.df.withColumn(name, self.df.agg(F.expr(low.expr(c)).alias("x")).scalar())

    def aggregate(self, keys: list[str], exprs: list, names: list[str]) -> DataFrame:
        low = self.lowering
        key_nodes = [a.Name((k,)) for k in keys]
        aggs: dict[a.Call, str] = {}
        folds: dict[str, str] = {}
        calls: dict[a.Call, tuple[str, list[str]]] = {}

        def one(n):
            if not low.is_reduced(n):
                return None
            if low.is_udaf(n.name):
                if n not in calls:
                    columns = []
                    for x in n.args:
                        if isinstance(x, a.Lit):
                            columns.append(x)
                        else:
                            columns.append(folds.setdefault(self.column(x), f"__f{len(folds)}"))
                    calls[n] = (f"__u{len(calls)}", columns)
                return a.Name((calls[n][0],))
            return a.Name((aggs.setdefault(n, f"__a{len(aggs)}"),))

        outer = [replace(e, one) for e in exprs]
        vectors = []
        for i, e in enumerate(exprs):
            if low.kind(e, key_nodes) == "vector":
                # Parts of the vector, and its distinct values, are taken of the folded array.
                whole = self.of_vector(e)
                name = folds.setdefault(self.column(e.args[0] if whole else e), f"__f{len(folds)}")
                vectors.append((i, F.expr(low.expr(a.Call(e.name, (a.Name((name,)), *e.args[1:])))) if whole else F.col(name)))
        columns = [self.reduced(c).alias(n) for c, n in aggs.items()]
        if folds:
            order = Order(self.order.by, tuple(keys))
            df = group_fold(self.df, order, {n: F.col(c) for c, n in folds.items()}, {n: self.reduced(c) for c, n in aggs.items()})
        elif keys:
            df = self.df.groupBy(*keys).agg(*columns) if columns else self.df.select(*keys).distinct()
        else:
            df = self.df.agg(*columns) if columns else self.df.select(F.lit(1).alias("__one")).limit(1)
        for c, (name, args) in calls.items():
            df = df.withColumn(name, self.array_call(c, [x if isinstance(x, a.Lit) else F.col(x) for x in args]))
        out = dict(vectors)
        return df.select(*[(out[i] if i in out else F.expr(low.expr(e))).alias(n) for i, (e, n) in enumerate(zip(outer, names))])

    def of_vector(self, e) -> bool:
        """Whether the expression is a function of a whole vector, not of one value."""
        return isinstance(e, a.Call) and e.name in ("subvec", "distinct") and not isinstance(self.df.select(F.expr(self.lowering.expr(e.args[0])).alias("x")).schema["x"].dataType, T.ArrayType)

    def slice_rows(self, exprs: list) -> list:
        """Without keys the part of a vector is a part of the rows, the same for all columns."""
        parts = [e for e in exprs if self.of_vector(e) and e.name == "subvec"]
        if not parts:
            return exprs
        if len(parts) != len(exprs) or len({e.args[1:] for e in parts}) > 1:
            raise ValueError("without GROUP BY all columns must be the same part of their vectors")
        self.need_order()
        bounds = [x.value for x in parts[0].args[1:]]
        values = [self.column(e.args[0]) for e in parts]
        self.df = add_vectors(self.df, self.order, [Vec("__place", "position")]).where(F.col("__place") >= bounds[0])
        if len(bounds) > 1:
            self.df = self.df.where(F.col("__place") < bounds[1])
        return [a.Name((v,)) for v in values]

    def reduced(self, c: a.Call):
        low = self.lowering
        if c.name in ("first", "last"):
            self.need_order()
            directions = {up for _, up in self.order.by}
            if len(directions) > 1:
                raise ValueError("first and last need an order in one direction")
            place = F.struct(*[F.col(f"`{n}`") for n, _ in self.order.by])
            asc = directions.pop()
            return (F.min_by if (c.name == "first") == asc else F.max_by)(F.expr(low.expr(c.args[0])), place)
        return F.expr(low.expr(c))

    def array_call(self, c: a.Call, args: list):
        """A call of a function over the arrays of a group, in Arrow batches of groups."""
        engine = self.lowering.engine
        literals = {i: x.value for i, x in enumerate(args) if isinstance(x, a.Lit)}
        columns, n_args = [x for x in args if not isinstance(x, a.Lit)], len(args)
        module = engine.modules.get(c.name)
        if module is not None:
            kind, run = T._parse_datatype_string(spark_type(module.returns)), module.call
        else:
            functions = dict(engine.functions)
            f = functions[c.name]
            per_row = f.aggregation and any(isinstance(n, a.Name) and n.parts[0].lower() == "_builtin_ret" for n in _names(f.body))
            kind = T.ArrayType(T.DoubleType()) if per_row or f.result == a.Lit(None, "null") else T.DoubleType()
            name = c.name

            if len(c.args) != len(f.params):
                raise ValueError(f"{f.name} takes {len(f.params)} arguments, {len(c.args)} given")
            compile_function(name, functions)  # errors show when the query is planned
            made: dict = {}

            def run(*values):
                if name not in made:
                    made[name] = compile_function(name, functions)
                got = made[name](*values)
                return [None if v != v else float(v) for v in got] if isinstance(got, np.ndarray) else None if got is None or got != got else float(got)

        def vector(v):
            return None if v is None else np.array([float("nan") if e is None else e for e in v]) if not len(v) or not isinstance(v[0], (list, np.ndarray)) else np.array([np.asarray(e) for e in v])

        @F.pandas_udf(kind)
        def over_groups(*series: pd.Series) -> pd.Series:
            out = []
            for row in zip(*series):
                it = iter(row)
                out.append(run(*[literals[i] if i in literals else vector(next(it)) for i in range(n_args)]))
            return pd.Series(out)

        return over_groups(*columns)


def _names(body):
    for s in body:
        if isinstance(s, a.Assign):
            yield from walk(s.target)
            yield from walk(s.value)
        elif isinstance(s, a.If):
            for _, b in s.branches:
                yield from _names(b)
            yield from _names(s.otherwise)
        elif isinstance(s, a.For):
            yield from _names((*s.start, *s.step, *s.body))

