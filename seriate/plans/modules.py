"""Modules: Python packages whose functions a program can call.

A function is marked with how it wants its arguments:

* ``scalar``: pandas Series of equal length, a batch of rows at a time;
* ``vector``: the arrays of a group, in the assumed order; one result per group;
* ``rows``: returns, when a query is planned, a function over Series like a scalar one, so that it can carry state along (a fitted model);
* ``table``: yields the rows of a table, as tuples or single values, for one row of arguments; the declared type is that of a struct of its columns, or of the one column ``value``;
* ``frame``: a DataFrame of its column arguments and the literals; it runs once, on the driver, and returns one value.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.functions import udtf


@dataclass(frozen=True)
class ModuleFunction:
    name: str
    params: tuple[tuple[str, str], ...]
    returns: str
    kind: str
    call: Callable


def module_function(kind: str = "scalar"):
    """Mark a function of a module."""
    if kind not in ("scalar", "vector", "rows", "table", "frame"):
        raise ValueError("kind is scalar, vector, rows, table or frame")

    def mark(f):
        f.seriate_kind = kind
        return f

    return mark


def load_module(path: str, functions: tuple) -> list[ModuleFunction]:
    """The declared functions of a module, all marked ones if none are declared (then of doubles)."""
    module = importlib.import_module(path)
    if not functions:
        functions = tuple((n, (), "double") for n, f in vars(module).items() if hasattr(f, "seriate_kind"))
    out = []
    for name, params, returns in functions:
        found = next((f for n, f in vars(module).items() if n.lower() == name and callable(f)), None)
        if found is None:
            raise ValueError(f"module {path} has no function {name}")
        out.append(ModuleFunction(name, params, returns, getattr(found, "seriate_kind", "scalar"), found))
    return out


def table_function(call: Callable, returns: str):
    """A Spark table function that gives the rows of a Python generator."""

    class Rows:
        def eval(self, *args):
            for row in call(*args):
                yield row if isinstance(row, tuple) else (row,)

    schema = returns if returns.startswith("struct<") else f"struct<value: {returns}>"
    return udtf(Rows, returnType=T._parse_datatype_string(schema))
