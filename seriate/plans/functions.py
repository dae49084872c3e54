"""User functions: straight-line bodies become expressions, others run over the arrays of a group."""

from __future__ import annotations

import math

import numpy as np

from seriate.plans import ast as a
from seriate.plans.render import replace, walk

DEPTH = 32


def inlinable(f: a.Function) -> bool:
    """Whether the body is a sequence of assignments to plain names: then a call can be replaced by an expression."""
    nodes = [n for s in f.body if isinstance(s, a.Assign) for n in walk(s.value)] + list(walk(f.result))
    builtin = any(isinstance(n, a.Name) and n.parts[0].lower().startswith("_builtin") for n in nodes)
    indexed = any(isinstance(n, a.Index) for n in nodes)
    plain = all((isinstance(s, a.Assign) and isinstance(s.target, a.Name) and len(s.target.parts) == 1) or isinstance(s, a.Ignored) for s in f.body)
    return plain and not builtin and not indexed and not f.statics and not f.aggregation


def inline(e, functions: dict[str, a.Function], depth: int = 0):
    """The expression with calls of inlinable functions replaced by what they compute."""
    if depth > DEPTH:
        raise ValueError("functions call each other too deeply to be expanded; recursion is not supported in straight-line bodies")

    def one(n):
        if not (isinstance(n, a.Call) and n.name in functions and inlinable(functions[n.name])):
            return None
        f = functions[n.name]
        if len(n.args) != len(f.params):
            raise ValueError(f"{f.name} takes {len(f.params)} arguments, {len(n.args)} given")
        known = dict(zip(f.params, [inline(x, functions, depth + 1) for x in n.args]))

        def use(m):
            return known.get(m.parts[0].lower()) if isinstance(m, a.Name) and len(m.parts) == 1 else None

        for s in f.body:
            if isinstance(s, a.Ignored):
                continue
            name = s.target.parts[0].lower()
            value = replace(s.value, use)
            if s.op != ":=":
                value = a.Op(s.op[0], (known[name], value))
            known[name] = value
        return inline(replace(f.result, use), functions, depth + 1)

    return replace(e, one)


#: What vector functions mean on an array, in the interpreter. Each follows the definitions in ``functions.vector``.
def _moving(whole, f):
    """The function over prefixes, by ``whole``, or over the last ``w`` values: ``f`` of all windows at once, which hold fewer at the start."""

    def run(x, w):
        if w is None or w >= len(x):
            return whole(x)
        return np.concatenate([whole(x[: w - 1]), f(np.lib.stride_tricks.sliding_window_view(x, w), axis=1)])

    return run


def _prefix_var(x):
    if not len(x):
        return np.empty(0)
    d, n = x - x[0], np.arange(1, len(x) + 1)
    mean = np.cumsum(d) / n
    return np.maximum(np.cumsum(d * d) / n - mean * mean, 0)


def _ratios(x, w=1):
    w = 1 if len(x) <= w else w
    before = np.array([x[i - w] if i >= w else x[0] for i in range(len(x))], dtype=float) if len(x) else np.empty(0)
    return np.divide(x, before, out=np.full(len(x), np.nan), where=before != 0)


def _two(f):
    return lambda *args: f(np.asarray(args[-1], float), int(args[0]) if len(args) == 2 else None)


_ARRAY = {
    "sum": lambda x: np.sum(x), "avg": lambda x: np.mean(x) if np.size(x) else math.nan, "min": lambda x: np.min(x), "max": lambda x: np.max(x), "count": lambda x: np.size(x),
    "var": lambda x: np.var(x), "stddev": lambda x: np.std(x), "median": lambda x: np.median(x), "corr": lambda x, y: np.corrcoef(x, y)[0, 1],
    "first": lambda x: x[0], "last": lambda x: x[-1], "distinct": lambda x: np.unique(x),
    "sums": _two(_moving(np.cumsum, np.sum)), "avgs": _two(_moving(lambda x: np.cumsum(x) / np.arange(1, len(x) + 1), np.mean)), "mins": _two(_moving(np.minimum.accumulate, np.min)),
    "maxs": _two(_moving(np.maximum.accumulate, np.max)), "vars": _two(_moving(_prefix_var, np.var)), "stddevs": _two(_moving(lambda x: np.sqrt(_prefix_var(x)), np.std)),
    "ratios": lambda *args: _ratios(np.asarray(args[-1], float), int(args[0]) if len(args) == 2 else 1),
    "deltas": lambda x: np.diff(x, prepend=x[:1]), "prev": lambda x: np.concatenate([x[:1], x[:-1]]), "next": lambda x: np.concatenate([x[1:], x[-1:]]),
    "subvec": lambda x, s, e=None: x[int(s) : None if e is None else int(e)],
    "sqrt": np.sqrt, "log": lambda b, x=None: np.log(b) if x is None else np.log(x) / np.log(b), "sin": np.sin, "cos": np.cos, "tan": np.tan, "pow": np.power, "abs": np.abs, "exp": np.exp, "floor": np.floor, "ceil": np.ceil,
    "truncate": lambda x, p=0: np.sign(x) * np.floor(np.abs(x) * 10.0**p + 0.5) / 10.0**p, "missing": lambda x: np.isnan(x),
}


#: Loop steps of one call, against bodies that never end.
MOST_STEPS = 50_000_000


def _divide(x, y):
    with np.errstate(all="ignore"):
        if np.ndim(x) or np.ndim(y):
            return np.divide(np.asarray(x, float), y)
        return float(x) / float(y) if y else math.nan


def _both(x, y):
    return x & y() if isinstance(x, np.ndarray) else bool(x) and bool(y())


def _either(x, y):
    return x | y() if isinstance(x, np.ndarray) else bool(x) or bool(y())


def _not(x):
    return ~x if isinstance(x, np.ndarray) else not x


def _too_long(steps: int) -> int:
    if steps > MOST_STEPS:
        raise RuntimeError("a loop of a user function takes too many steps")
    return steps + 1


class Compiler:
    """Turns a function into Python over arrays. Numbers are scalars, vectors are arrays; ``_builtin_ret`` collects one value per row."""

    def __init__(self, f: a.Function, functions: dict[str, a.Function]):
        self.f, self.functions = f, functions
        self.local = {*f.params, "_builtin_len", "_builtin_ret", *[s.target.parts[0].lower() for s in f.statics]}
        self.find(f.body)
        self.lines: list[str] = []

    def find(self, body) -> None:
        """Names that the body assigns."""
        for s in body:
            if isinstance(s, a.Assign):
                target = s.target
                while isinstance(target, (a.Index, a.Member)):
                    target = target.value
                self.local.add(target.parts[0].lower())
            elif isinstance(s, a.If):
                for _, b in s.branches:
                    self.find(b)
                self.find(s.otherwise)
            elif isinstance(s, a.For):
                self.find((*s.start, *s.step, *s.body))

    @staticmethod
    def spell(name: str) -> str:
        return "v_" + "".join(c if c.isalnum() and c.isascii() or c == "_" else f"_{ord(c):x}_" for c in name.lower())

    def value(self, e) -> str:
        if isinstance(e, a.Lit):
            return repr(e.value)
        if isinstance(e, a.Name):
            if e.parts[0].lower() not in self.local:
                raise ValueError(f"unknown name {e.parts[0]} in function {self.f.name}")
            out = self.spell(e.parts[0])
            for part in e.parts[1:]:
                out = self.member(out, part.lower())
            return out
        if isinstance(e, a.Member):
            return self.member(self.value(e.value), e.name.lower())
        if isinstance(e, a.Index):
            value, at = self.value(e.value), f"int({self.value(e.at)})"
            if e.end is None:
                return f"{value}[{at}]"
            return f"{value}[{at}:{'' if e.end == a.Lit(None, 'null') else f'int({self.value(e.end)})'}]"
        if isinstance(e, a.Op):
            x = [self.value(v) for v in e.args]
            if e.op in ("and", "or"):
                return f"{'_both' if e.op == 'and' else '_either'}({x[0]}, lambda: {x[1]})"
            if e.op == "not":
                return f"_not({x[0]})"
            if e.op == "neg":
                return f"(-{x[0]})"
            if e.op == "/":
                return f"_divide({x[0]}, {x[1]})"
            if e.op in ("+", "-", "*", "%", "=", "<>", "<", ">", "<=", ">="):
                return f"({x[0]} {({'=': '==', '<>': '!='}).get(e.op, e.op)} {x[1]})"
        if isinstance(e, a.Call):
            args = [self.value(v) for v in e.args]
            if e.name in self.local:  # x(s, e): a slice
                return f"{self.spell(e.name)}[int({args[0]}):int({args[1]})]"
            if e.name in self.functions:
                return f"_user[{e.name!r}]({', '.join(args)})"
            if e.name in _ARRAY:
                return f"_array[{e.name!r}]({', '.join(args)})"
        raise ValueError(f"function {self.f.name} can't use {e!r}")

    @staticmethod
    def member(value: str, name: str) -> str:
        if name not in ("len", "vec"):
            raise ValueError(f"unknown member {name}")
        return f"len({value})" if name == "len" else value

    def body(self, statements, depth: int) -> None:
        pad = "    " * depth
        at = len(self.lines)
        for s in statements:
            if isinstance(s, a.Assign):
                value = self.value(s.value)
                target = self.value(s.target) if isinstance(s.target, a.Index) else self.spell(s.target.parts[0])
                if s.op == "/=":
                    value = f"_divide({target}, {value})"
                elif s.op != ":=":
                    value = f"{target} {s.op[0]} ({value})"
                self.lines.append(f"{pad}{target} = {value}")
            elif isinstance(s, a.If):
                for i, (condition, b) in enumerate(s.branches):
                    self.lines.append(f"{pad}{'elif' if i else 'if'} {self.value(condition)}:")
                    self.body(b, depth + 1)
                if s.otherwise:
                    self.lines.append(f"{pad}else:")
                    self.body(s.otherwise, depth + 1)
            elif isinstance(s, a.For):
                self.body(s.start, depth)
                self.lines.append(f"{pad}while {self.value(s.condition)}:")
                self.lines.append(f"{pad}    _steps = _too_long(_steps)")
                self.body((*s.body, *s.step), depth + 1)
        if len(self.lines) == at:
            self.lines.append(f"{pad}pass")

    def source(self) -> str:
        params = ", ".join(map(self.spell, self.f.params))
        ret, n = self.spell("_builtin_ret"), self.spell("_builtin_len")
        sizes = ", ".join(f"_size({self.spell(p)})" for p in self.f.params)
        self.lines = [f"def _f({params}):", f"    {n} = max([{sizes}], default=1)", f"    {ret} = _np.full({n}, _np.nan)", "    _steps = 0"]
        for s in self.f.statics:
            name = self.spell(s.target.parts[0])
            self.lines.append(f"    {name} = _static[{name!r}] if {name!r} in _static else {self.value(s.value)}")
        self.body(self.f.body, 1)
        for s in self.f.statics:
            name = self.spell(s.target.parts[0])
            self.lines.append(f"    _static[{name!r}] = {name}")
        self.lines += [f"    _out = {self.value(self.f.result)}", f"    return {ret} if _out is None else _out"]
        return "\n".join(self.lines)


def compile_function(name: str, functions: dict[str, a.Function]):
    """A Python function of arrays and numbers that does what the function of the dialect says."""
    user: dict[str, object] = {}
    size = lambda x: len(x) if isinstance(x, np.ndarray) else 1

    class Late(dict):
        def __missing__(self, key):
            self[key] = compile_function(key, functions)
            return self[key]

    user = Late()
    scope = {"_divide": _divide, "_both": _both, "_either": _either, "_not": _not, "_too_long": _too_long, "_array": _ARRAY, "_user": user, "_np": np, "_size": size, "_static": {}}
    exec(Compiler(functions[name], functions).source(), scope)  # noqa: S102 - source made from parsed nodes, names spelt out
    user[name] = scope["_f"]
    return scope["_f"]
