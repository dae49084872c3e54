"""Nodes of the dialect: expressions, queries, statements."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object
    kind: str  # number, string, bool, null


@dataclass(frozen=True)
class Name:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    over: tuple | None = None  # (partition, order, frame text)
    filter: object = None
    nulls: str | None = None
    within: tuple = ()


@dataclass(frozen=True)
class Op:
    """An operator with its operands; unary ones have one."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Case:
    subject: object
    whens: tuple
    otherwise: object


@dataclass(frozen=True)
class Cast:
    value: object
    kind: str
    lenient: bool = False


@dataclass(frozen=True)
class Index:
    value: object
    at: object
    end: object = None  # x(s, e) and x[s:e]: a slice


@dataclass(frozen=True)
class Member:
    value: object
    name: str


@dataclass(frozen=True)
class Sub:
    """A subquery in an expression; ``how`` is scalar, in, exists or list."""

    query: object
    how: str = "scalar"


@dataclass(frozen=True)
class Raw:
    """Text passed to Spark as it stands, with expressions in between."""

    parts: tuple


@dataclass(frozen=True)
class Item:
    value: object
    alias: str | None = None


@dataclass(frozen=True)
class OrderBy:
    value: object
    up: bool = True
    nulls: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None
    sample: str | None = None
    columns: tuple = ()


@dataclass(frozen=True)
class SubRef:
    query: object
    alias: str | None = None
    columns: tuple = ()


@dataclass(frozen=True)
class FuncRef:
    call: Call
    alias: str | None = None
    columns: tuple = ()
    ordinality: bool = False


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    kind: str
    on: object = None
    using: tuple = ()


@dataclass(frozen=True)
class LateralView:
    source: object
    call: Call
    alias: str
    columns: tuple
    outer: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple
    source: object = None
    assuming: tuple = ()
    where: object = None
    group: tuple = ()
    group_kind: str = ""  # "", rollup, cube, sets
    having: object = None
    order: tuple = ()
    limit: object = None
    offset: object = None
    distinct: bool = False
    distinct_on: tuple = ()
    top: object = None  # (n, percent, ties)
    windows: tuple = ()


@dataclass(frozen=True)
class SetOp:
    op: str
    left: object
    right: object
    order: tuple = ()
    limit: object = None
    offset: object = None


@dataclass(frozen=True)
class Values:
    rows: tuple


@dataclass(frozen=True)
class With:
    tables: tuple  # (name, columns, query)
    query: object
    recursive: bool = False


@dataclass(frozen=True)
class Query:
    """A query as a statement: where its result goes."""

    query: object
    into: str | None = None
    outfile: str | None = None
    sep: str = ","


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple = ()
    query: object = None
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateView:
    name: str
    query: object
    columns: tuple = ()


@dataclass(frozen=True)
class Drop:
    kind: str
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple
    query: object
    overwrite: bool = False


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple
    where: object = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass(frozen=True)
class Load:
    path: str
    table: str
    sep: str = ","
    element_sep: str | None = None


@dataclass(frozen=True)
class LoadModule:
    path: str
    functions: tuple  # (name, ((param, type), ...), returned type)


@dataclass(frozen=True)
class Function:
    name: str
    params: tuple
    statics: tuple
    body: tuple
    result: object
    aggregation: bool = False


@dataclass(frozen=True)
class Assign:
    target: object
    op: str
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, statements)
    otherwise: tuple = ()


@dataclass(frozen=True)
class For:
    start: tuple
    condition: object
    step: tuple
    body: tuple


@dataclass(frozen=True)
class CreateTrigger:
    name: str
    action: str
    interval_ms: int | None = None
    table: str | None = None
    when: str | None = None


@dataclass(frozen=True)
class Procedure:
    name: str | None
    verb: str


@dataclass(frozen=True)
class CacheTable:
    table: str
    lazy: bool = False


@dataclass(frozen=True)
class Passthrough:
    statements: tuple


@dataclass(frozen=True)
class Ignored:
    """A statement with no effect here, as an index."""

    what: str = field(default="")
