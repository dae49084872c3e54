"""Percentiles of very large numeric columns, by mergeable sketches of relative-rank compactors.

A sketch is a stack of compactors. Compactor h holds values that each stand for 2**h. When it is full, it sorts itself, leaves its upper part (the
protected tail) alone and passes every other value of a stretch of the lower part on to compactor h + 1. How long that stretch is
follows from the number of compactions so far (as many sections as that number ends in ones, plus one), so values near the protected
tail are moved the most rarely. The error of a rank is therefore a share of its distance from the top: with section size k the standard
error is about 0.13 / k of it. Up to its capacity a sketch is exact, and always exact at the very top.

Sketches of partitions, days or any separate sets of rows merge compactor by compactor. Which of two neighbours is passed on is drawn from a
generator seeded with the key and the compactor's history, so a task run again gives the same sketch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, FIRST_SECTIONS = 64, 3
#: Rows of a partition that are grouped at once.
TOGETHER = 500_000
#: Sketches of a partition that are held open.
HELD = 10_000
#: Stands for a null key.
LEAST = -(2**63)
#: Share of the distance from the top that a rank is off by with one standard error, for section size k: RANK_ERROR / k.
RANK_ERROR = math.sqrt(0.0512 / FIRST_SECTIONS)


def rank_bound(q: float, n: Column, k: int = K) -> Column:
    """By how many ranks the ``q`` quantile of ``n`` values may be off: four standard errors and one row; none while the sketch is exact."""
    return F.when(n < 2 * FIRST_SECTIONS * k, 0).otherwise(F.ceil(4 * RANK_ERROR / k * (1 - q) * n) + 1).cast("long")


class Compactor:
    """One level: values, number of compactions (state), sections and their size."""

    __slots__ = ("values", "state", "sections", "size", "parts")

    def __init__(self, k: float, values: np.ndarray | None = None, state: int = 0, sections: int = FIRST_SECTIONS):
        self.parts = [] if values is None or not len(values) else [values]
        self.state, self.sections, self.size = state, sections, float(k)

    def __len__(self) -> int:
        return sum(map(len, self.parts))

    def capacity(self) -> int:
        return 2 * self.sections * self._even(self.size)

    @staticmethod
    def _even(size: float) -> int:
        return max(4, 2 * round(size / 2))

    def take(self) -> np.ndarray:
        values = np.concatenate(self.parts) if len(self.parts) != 1 else self.parts[0]
        values.sort(kind="stable")
        return values

    def compact(self, seed: int) -> np.ndarray:
        """Values for the next level, each standing for two."""
        values = self.take().copy()
        ones = 1
        while self.state >> (ones - 1) & 1:
            ones += 1
        stretch = min(ones, self.sections) * self._even(self.size)
        # The upper half of the capacity is protected; what exceeds the capacity is moved on with the stretch.
        move = max(len(values) - self.capacity(), 0) + stretch
        move = min(move - move % 2, len(values) - len(values) % 2)
        odd = (seed * 0x9E3779B97F4A7C15 + self.state * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) >> 33 & 1
        self.parts = [values[move:]]
        self.state += 1
        if self.state >= 1 << (self.sections - 1) and self.size / math.sqrt(2) >= 4:
            self.sections, self.size = 2 * self.sections, self.size / math.sqrt(2)
        return values[odd:move:2]


class Sketch:
    """A stack of compactors for one key."""

    def __init__(self, k: int = K, seed: int = 0):
        self.k, self.seed, self.n, self.levels = k, seed, 0, [Compactor(k)]

    def update(self, values: np.ndarray) -> Sketch:
        """Add values; NaN must have been left out."""
        at, step = 0, self.levels[0].capacity()
        while at < len(values):
            room = max(1, min(step, self.levels[0].capacity() - len(self.levels[0])))
            part = np.array(values[at : at + room], dtype=float)
            self.levels[0].parts.append(part)
            self.n += len(part)
            at += room
            self._settle()
        return self

    def merge(self, other: Sketch) -> Sketch:
        """Add the values another sketch stands for."""
        while len(self.levels) < len(other.levels):
            self.levels.append(Compactor(self.k))
        for mine, theirs in zip(self.levels, other.levels):
            mine.parts += theirs.parts
            mine.state |= theirs.state
            if theirs.sections > mine.sections:
                mine.sections, mine.size = theirs.sections, theirs.size
        self.n += other.n
        self._settle()
        return self

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) >= self.levels[h].capacity():
                if h + 1 == len(self.levels):
                    self.levels.append(Compactor(self.k))
                self.levels[h + 1].parts.append(self.levels[h].compact(self.seed + h))
            h += 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """The values in order and the number of rows up to each."""
        values = np.concatenate([p for level in self.levels for p in level.parts] or [np.empty(0)])
        weights = np.concatenate([np.full(len(p), 1 << h, np.int64) for h, level in enumerate(self.levels) for p in level.parts] or [np.empty(0, np.int64)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def quantiles(self, qs: list[float]) -> list[float | None]:
        """For each q the least value with at least ceil(q * n) rows (1 at least) up to it, as far as the sketch can tell."""
        values, upto = self.weighted()
        if not len(values):
            return [None] * len(qs)
        ranks = [max(1, math.ceil(q * self.n - 1e-9)) for q in qs]
        return values[np.minimum(np.searchsorted(upto, ranks), len(values) - 1)].tolist()

    def rank(self, x: float) -> int:
        values, upto = self.weighted()
        at = int(np.searchsorted(values, x, side="right"))
        return int(upto[at - 1]) if at else 0


_STATE = pa.schema([("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("states", pa.list_(pa.int64())), ("sections", pa.list_(pa.int64())), ("widths", pa.list_(pa.float64())), ("items", pa.list_(pa.float64()))])
_STATE_SQL = "n long, sizes array<long>, states array<long>, sections array<long>, widths array<double>, items array<double>"


def pack(s: Sketch) -> tuple:
    parts = [np.concatenate(level.parts) if level.parts else np.empty(0) for level in s.levels]
    return s.n, [len(p) for p in parts], [level.state for level in s.levels], [level.sections for level in s.levels], [level.size for level in s.levels], np.concatenate(parts)


def unpack(n: int, sizes: list, states: list, sections: list, widths: list, items: np.ndarray, k: int, seed: int) -> Sketch:
    s, at = Sketch(k, seed), 0
    s.n, s.levels = n, []
    for size, state, count, width in zip(sizes, states, sections, widths):
        s.levels.append(Compactor(width, np.array(items[at : at + size], dtype=float), state, count))
        at += size
    return s


def _batch(keys: list[tuple], sketches: list[Sketch], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*[key + pack(s) for key, s in zip(keys, sketches)]))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def _seed(key: tuple, part: int) -> int:
    """The same when a task is run again: hashes of numbers don't depend on the process."""
    return hash((*(LEAST if v is None else v for v in key), part)) & 0xFFFF


def build_sketches(df: DataFrame, keys: list[str], values: list[str], k: int = K) -> DataFrame:
    """Sketches of each of ``values`` per ``keys`` (whole numbers), one row per key, field and partition of ``df``; to be merged.

    Columns ``keys`` (long), ``field_name``, ``part``, then the sketch. Rows are sketched where they are: nothing but sketches is shuffled,
    so a key that holds a third of all rows is worked on by all tasks. Sketches are given out when more than ``HELD`` are open; a key and part may
    then have several. Coins are thrown by key and partition, so that errors of parts cancel. Nulls and NaN are left out; null keys form a group of
    their own.
    """
    schema = pa.schema([*[(c, pa.int64()) for c in keys], ("field_name", pa.string()), ("part", pa.int32()), *_STATE])

    def add(held: dict[tuple, Sketch], rows: list[pa.RecordBatch], part: int) -> None:
        table = pa.Table.from_batches(rows)
        key_cols = [np.where(table.column(c).is_null().to_numpy(), LEAST, table.column(c).fill_null(0).to_numpy()) for c in keys]
        order = np.lexsort(key_cols[::-1])
        sorted_keys = [c[order] for c in key_cols]
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in sorted_keys:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        heads = list(zip(*[c[starts].tolist() for c in sorted_keys]))
        for f in values:
            x = table.column(f).to_numpy().astype(float)[order]
            good = ~np.isnan(x)
            x, ends = x[good], np.cumsum(np.bincount(group[good], minlength=len(starts)))
            at = 0
            for head, end in zip(heads, ends.tolist()):
                if end > at:
                    sketch = held.get((*head, f))
                    if sketch is None:
                        sketch = held[(*head, f)] = Sketch(k, _seed(head, part))
                    sketch.update(x[at:end])
                at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        rows: list[pa.RecordBatch] = []
        part = n = 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            rows.append(b)
            n += b.num_rows
            if n >= TOGETHER:
                add(held, rows, part)
                rows, n = [], 0
                if len(held) > HELD:
                    yield from given_out(held, part)
                    held = {}
        if rows:
            add(held, rows, part)
        yield from given_out(held, part)

    def given_out(held: dict[tuple, Sketch], part: int) -> Iterator[pa.RecordBatch]:
        items = list(held.items())
        for at in range(0, len(items), 2000):
            some = items[at : at + 2000]
            yield _batch([(*(None if v == LEAST else v for v in key[:-1]), key[-1], part) for key, _ in some], [s for _, s in some], schema)

    flat = df.select(*[F.col(c).cast("long").alias(c) for c in keys], *[F.col(v).cast("double").alias(v) for v in values], F.spark_partition_id().alias("part"))
    return flat.mapInArrow(run, f"{', '.join(f'`{c}` long' for c in keys)}, field_name string, part int, {_STATE_SQL}")


def merge_sketches(sketches: DataFrame, keys: list[str], k: int = K, fan_in: int | None = None) -> DataFrame:
    """One sketch per ``keys`` and ``field_name``: columns ``keys``, ``field_name``, the sketch.

    Two stages, so that no task merges the sketches of all partitions of a key: first within about the square root of their number of
    parts, then these. ``keys`` may be fewer than the sketches were built for (days into all time).
    """
    fan_in = fan_in or max(1, math.isqrt(int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) + 1)
    by = [*keys, "field_name"]
    names = [f.name for f in _STATE]
    schema = pa.schema([*[(c, pa.int64()) for c in keys], ("field_name", pa.string()), ("part", pa.int32()), *_STATE])
    sql = f"{', '.join(f'`{c}` long' for c in keys)}, field_name string, part int, {_STATE_SQL}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merged, done = None, None, []
        for b in batches:
            heads = list(zip(*[b.column(c).to_pylist() for c in [*by, "part"]]))
            cols = {c: b.column(c) for c in names}
            lists = {c: cols[c].to_pylist() for c in names if c != "items"}
            offsets, items = np.asarray(cols["items"].offsets), cols["items"].values.to_numpy()
            for i, head in enumerate(heads):
                one = unpack(lists["n"][i], lists["sizes"][i], lists["states"][i], lists["sections"][i], lists["widths"][i], items[offsets[i] : offsets[i + 1]], k, _seed(head[: len(keys)], head[-1]))
                if head == now:
                    merged.merge(one)
                    continue
                if merged is not None:
                    done.append((now, merged))
                now, merged = head, one
                if len(done) >= 2000:
                    yield _batch([h for h, _ in done], [s for _, s in done], schema)
                    done = []
        if merged is not None:
            done.append((now, merged))
        if done:
            yield _batch([h for h, _ in done], [s for _, s in done], schema)

    def stage(df: DataFrame, part) -> DataFrame:
        df = df.select(*by, part.cast("int").alias("part"), *names)
        return df.repartition(*by, "part").sortWithinPartitions(*by, "part", "n", F.xxhash64("items")).mapInArrow(run, sql)

    return stage(stage(sketches, F.pmod("part", F.lit(fan_in))), F.lit(0)).drop("part")


def sketch_quantiles(sketches: DataFrame, keys: list[str], qs: list[float], k: int = K) -> DataFrame:
    """The quantiles ``qs`` of each sketch: ``keys``, ``field_name``, ``n``, and ``values`` (a list in the order of ``qs``)."""
    out = pa.schema([*[(c, pa.int64()) for c in keys], ("field_name", pa.string()), ("n", pa.int64()), ("values", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            values = [unpack(r["n"], r["sizes"], r["states"], r["sections"], r["widths"], r["items"], k, 0).quantiles(qs) for r in rows]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in [*keys, "field_name", "n"]], pa.array(values, type=pa.list_(pa.float64()))], schema=out)

    return sketches.mapInArrow(run, f"{', '.join(f'`{c}` long' for c in keys)}, field_name string, n long, values array<double>")
