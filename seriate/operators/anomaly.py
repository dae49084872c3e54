"""Implausible readings per source: robust autoregression with outlier and level-shift tests, stuck runs and physical limits.

The series of a source are its readings in time order. Rows are range-partitioned by source, those of long series also by time and id, so a source that holds a
third of all rows is spread over many tasks, each holding a stretch of its series. A stretch is processed as arrays; a source that lies in several
is fitted over all of them (``_spread_cases``), so that the result does not depend on where the stretches are cut:

* normal level: the median of the source's positive readings (exact, over all its stretches);
* scale: the lesser of the median absolute deviation from it and that of the steps between readings (over the root of 2), which level shifts do not widen;
* level shifts: the largest jumps between the windows before and after a place, taken out if they are significant, until none is left;
* model of what remains, ``y[t] = phi * y[t-1] + e[t]``, phi by iterated Huber weights;
* additive outliers: ``|e[t]|`` over ``THRESHOLD`` scales; they are replaced by their prediction and the model is fitted again.
  Readings that are outliers by the normal level but not by the shifted one are reported as ``level_shift``;
* stuck runs: equal positive consecutive readings; runs over the edge of a stretch are put together from the edges alone;
* physical limits, given per field.

``spike`` and ``level_shift`` are the model's decisions, by its own scale alone. The rule of so many times the level (``far``) is another matter: its candidates
are the readings whose residual from the model is over the threshold or over ``CANDIDATE`` levels, whichever is less, and the rule is then checked exactly. Since a
prediction is at most ``PHI_CAP * CLEAN_CAP`` levels, no reading of ``LEVEL_GUARANTEE`` or more levels is missed, however noisy the source is; so the
rule decides alone which of the candidates are far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from seriate.session import materialize

#: Most autocorrelation; deviations are clipped at so many levels before they predict others; scales of an outlier.
PHI_CAP, CLEAN_CAP, THRESHOLD = 0.95, 4.0, 6.0
#: A reading of 10 levels deviates by 9, and its residual is at least 9 - PHI_CAP * CLEAN_CAP = 5.2 levels.
CANDIDATE, LEVEL_GUARANTEE = 5.0, 10.0
SHIFT_WINDOW, FIT_ROUNDS = 20, 3


@dataclass(frozen=True)
class Reading:
    """A field of measurements. ``stuck``: look for stuck runs; ``per_hour``: most units an hour between the two times;
    ``scale_floor``: least scale of the noise, as a share of the normal level."""

    name: str
    stuck: bool = True
    per_hour: float | None = None
    scale_floor: float = 0.25


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)


def segment_median(values: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """Median of the values of each group 0..n_groups-1; NaN for a group without values."""
    out = np.full(n_groups, np.nan)
    if not len(values):
        return out
    order = np.lexsort((values, group))
    v, count = values[order], np.bincount(group, minlength=n_groups)
    first = np.cumsum(count) - count
    has = count > 0
    low, high = first[has] + (count[has] - 1) // 2, first[has] + count[has] // 2
    out[has] = (v[low] + v[high]) / 2
    return out


def _lag(z: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty_like(z)
    out[1:], out[:1] = z[:-1], 0
    out[starts] = 0
    return out


def _jumps(rest: np.ndarray, cap: np.ndarray, scale: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``places`` at which the level of ``rest`` moves significantly, and by how much.

    A place is found by window means of values clipped at ``cap``, so that no spike makes a shift; how far the level moved is the difference
    of the windows' medians, which has to be significant too. Of places within ``SHIFT_WINDOW`` of each other the most significant is taken.
    """
    w, t = SHIFT_WINDOW, places
    c = np.r_[0, np.cumsum(np.clip(rest, -cap, cap))]
    least = THRESHOLD * scale[t] * np.sqrt(2 / w)
    # Rounded, so that ties are settled by place however the sums were made.
    size = np.round(np.abs(c[t + w] - 2 * c[t] + c[t - w]) / w / least, 6)
    near = size > 1
    t, size, least = t[near], size[near], least[near]
    around, step = np.arange(w), np.empty(len(t))
    for a in range(0, len(t), 10_000):
        p = t[a : a + 10_000, None]
        step[a : a + 10_000] = np.median(rest[p + around], axis=1) - np.median(rest[p - 1 - around], axis=1)
    real = np.abs(step) > least
    t, size, step = t[real], size[real], step[real]
    sizes = np.zeros(len(rest) + 2 * w)
    sizes[t + w] = size
    best = np.ones(len(t), bool)
    for k in range(1, w + 1):
        best &= (size > sizes[t + w - k]) & (size >= sizes[t + w + k])
    return t[best], step[best]


def _shift(y: np.ndarray, cap: np.ndarray, group: np.ndarray, starts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The level of each reading after significant shifts, 0 where there is none.

    Each round takes out all jumps of a series that are not beside a larger one, until none is left. A place is taken at most once, so it ends.
    """
    n, w = len(y), SHIFT_WINDOW
    level = np.zeros(n)
    first, last = starts[group], np.r_[starts[1:], n][group]
    at = np.arange(n)
    open_ = (at - first >= w) & (last - at >= w)
    rows = at
    while len(rows):
        own = group[rows]
        t, steps = _jumps(y[rows] - level[rows], cap[rows], scale[own], np.flatnonzero(open_[rows]))
        open_[rows[t]] = False
        step = np.zeros(len(rows))
        step[t] = steps
        c = np.cumsum(step)
        first_row = _starts(own)
        before = np.repeat((c - step)[first_row], np.diff(np.r_[first_row, len(rows)]))
        level[rows] += c - before
        # Series without a jump are done.
        rows = rows[np.isin(own, own[t])]
    return level


def _limits(m: np.ndarray, mad: np.ndarray, scale_floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The outlier threshold and the cap of deviations, from normal levels (0: none) and median absolute deviations."""
    floor = np.maximum(scale_floor * m, 1e-9)
    return np.maximum(THRESHOLD * np.maximum(1.4826 * mad, floor), 1e-9), CLEAN_CAP * np.maximum(m, floor)


def _step_sizes(y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Absolute steps from the reading before, over the root of 2, and where they are: not at the starts of series."""
    at = np.delete(np.arange(len(y)), starts)
    return np.abs(y[at] - y[at - 1]) / np.sqrt(2), at


def _widened(limit: np.ndarray | float, shift: np.ndarray, level: np.ndarray | float) -> np.ndarray:
    """The threshold at a shifted level: the noise of a higher level is larger in proportion."""
    return limit * np.maximum(1.0, 1.0 + shift / np.where(np.asarray(level) > 0, level, np.inf))


def _clean(y: np.ndarray, pred: np.ndarray, limit: np.ndarray, cap: np.ndarray) -> np.ndarray:
    return np.clip(np.where(np.abs(y - pred) > limit, pred, y), -cap, cap)


def _moments(y: np.ndarray, z: np.ndarray, before: np.ndarray, pred: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the next phi is the quotient of the sums of, per reading."""
    weight = np.minimum(1, limit / np.maximum(np.abs(y - pred), 1e-12))
    return weight * z * before, weight * before * before


def fit_series(x: np.ndarray, group: np.ndarray, level: np.ndarray, scale_floor: float = 0.25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of readings ``x`` of the groups (sorted, 0..G-1) against each group's normal ``level``.

    Returns the residual of each reading in units of its outlier threshold (over 1: an outlier), before and after level shifts, and that before
    in units of the threshold of candidates.
    """
    starts = _starts(group)
    m = np.where(np.isfinite(level), level, 0.0)
    y = x - m[group]
    steps, at = _step_sizes(y, starts)
    mad = np.fmin(segment_median(np.abs(y), group, len(m)), segment_median(steps, group[at], len(m)))
    limits, caps = _limits(m, mad, scale_floor)
    limit, cap = limits[group], caps[group]
    shift = _shift(y, cap, group, starts, limits / THRESHOLD)
    rest, wide = y - shift, _widened(limit, shift, m[group])
    z = np.clip(rest, -cap, cap)
    pred = np.zeros_like(y)
    for _ in range(FIT_ROUNDS):
        before = _lag(z, starts)
        num, den = (np.add.reduceat(v, starts) for v in _moments(rest, z, before, pred, wide))
        phi = np.clip(np.divide(num, den, out=np.zeros_like(num), where=den > 0), -PHI_CAP, PHI_CAP)
        pred = phi[group] * before
        z = _clean(rest, pred, wide, cap)
    pred = phi[group] * _lag(z, starts)
    return _scores(y, pred, shift, limit, m[group])


def _scores(y: np.ndarray, pred: np.ndarray, shift: np.ndarray, limit: np.ndarray, level: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    residual = np.abs(y - pred)
    raw = residual / limit
    return raw, np.where(shift != 0, np.abs(y - pred - shift) / _widened(limit, shift, level), raw), residual / np.minimum(limit, np.maximum(CANDIDATE * level, 1e-9))


_OUT = pa.schema([
    ("id", pa.int64()), ("field", pa.int32()), ("source", pa.int64()), ("kinds", pa.int32()), ("ratio", pa.float64()),
    ("pid", pa.int64()), ("side", pa.int32()), ("run", pa.int64()), ("value", pa.float64()),
])
_OUT_SQL = "id long, field int, source long, kinds int, ratio double, pid long, side int, run long, value double"
NEGATIVE, TOO_FAST, STUCK, SPIKE, SHIFT, FAR = 1, 2, 4, 8, 16, 32
HEAD, TAIL, BOTH = 0, 1, 2


def _model_kinds(raw_score: np.ndarray, score: np.ndarray, candidate: np.ndarray, x: np.ndarray, far_from: np.ndarray | float) -> np.ndarray:
    kinds = np.zeros(len(x), np.int32)
    kinds[score > 1] |= SPIKE
    kinds[(score <= 1) & (raw_score > 1)] |= SHIFT
    # The exact check of the candidates that the model gave.
    kinds[(candidate > 1) & (x >= far_from)] |= FAR
    return kinds


def _chunk(fields: list[Reading], run_length: int, ratio: float, cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Cases and run edges of one stretch, sorted by source, time and id."""
    source, pid = cols["source"], int(cols["pid"][0])
    out: list[dict[str, np.ndarray]] = []
    for k, f in enumerate(fields):
        raw = cols[f"x{k}"]
        has = np.flatnonzero(~np.isnan(raw))
        if not len(has):
            continue
        x, ids, src = raw[has], cols["id"][has], source[has]
        starts = _starts(src)
        group = np.cumsum(np.isin(np.arange(len(x)), starts, assume_unique=True)) - 1 if len(starts) > 1 else np.zeros(len(x), np.int64)
        n_groups = len(starts)
        positive = x > 0
        level = segment_median(x[positive], group[positive], n_groups)
        given = cols[f"m{k}"][has][starts]
        split = cols["split"][has][starts].astype(bool)
        level = np.where(split, given, level)
        times = np.divide(x, level[group], out=np.zeros_like(x), where=level[group] > 0)
        kinds = np.zeros(len(x), np.int32)
        # Series that go on in another stretch are fitted over all their stretches, by _spread_cases.
        whole = ~split[group]
        if whole.any():
            own = np.cumsum(~split)[group[whole]] - 1
            kinds[whole] = _model_kinds(*fit_series(x[whole], own, level[~split], f.scale_floor), x[whole], ratio * level[group[whole]])
        kinds[x < 0] |= NEGATIVE
        if f.per_hour:
            seconds = cols["seconds"][has]
            kinds[(seconds > 0) & (x * 3600 > f.per_hour * seconds)] |= TOO_FAST
        edges = []
        if f.stuck:
            run_start = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (x[1:] != x[:-1])])
            length = np.diff(np.r_[run_start, len(x)])
            per_row = np.repeat(length, length)
            kinds[(per_row >= run_length) & positive] |= STUCK
            # Runs at the edges of a series that goes on in another stretch.
            last_start = np.r_[run_start[1:], len(x)]
            first_of_source = np.isin(run_start, starts)
            last_of_source = np.isin(last_start, np.r_[starts[1:], len(x)])
            for i in np.flatnonzero(split[group[run_start]] & (first_of_source | last_of_source)):
                side = BOTH if first_of_source[i] and last_of_source[i] else HEAD if first_of_source[i] else TAIL
                a, b = run_start[i], last_start[i]
                # Only the readings of short runs are still open; a long one needs to be known by its length alone.
                rows = np.arange(a, b if length[i] < run_length else a + 1)
                edges.append((rows, side, length[i]))
        hit = np.flatnonzero(kinds)
        none = np.full(len(hit), -1)
        out.append({"id": ids[hit], "field": np.full(len(hit), k), "source": src[hit], "kinds": kinds[hit], "ratio": times[hit], "pid": none, "side": none, "run": none, "value": x[hit]})
        for rows, side, n in edges:
            c = len(rows)
            out.append({"id": ids[rows], "field": np.full(c, k), "source": src[rows], "kinds": np.zeros(c), "ratio": times[rows], "pid": np.full(c, pid), "side": np.full(c, side), "run": np.full(c, n), "value": x[rows]})
    return {n: np.concatenate([o[n] for o in out]) if out else np.empty(0) for n in _OUT.names}


def _by_stretch(work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: pa.Schema):
    """``work`` on the columns of each stretch, whose rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            cols = {}
            for name in table.column_names:
                c = table.column(name)
                if name in ("start", "end"):
                    continue
                if pa.types.is_floating(c.type):
                    cols[name] = c.combine_chunks().to_numpy(zero_copy_only=False).astype(float)
                else:
                    cols[name] = c.to_numpy()
            got = work(cols)
            if len(got[schema.names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name]).cast(f.type, safe=False) for f in schema], schema=schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            pids = batch.column("pid").to_numpy()
            cut = [0, *(np.flatnonzero(pids[1:] != pids[:-1]) + 1).tolist(), len(pids)]
            for a, b in zip(cut, cut[1:]):
                part = batch.slice(a, b - a)
                if held and held[0].column("pid")[0].as_py() != pids[a]:
                    yield from done(held)
                    held = []
                held.append(part)
        if held:
            yield from done(held)

    return run


#: Rows of a stretch with what the model needs of a series that goes on elsewhere: where its readings stand in the series, then the readings before the stretch, of it, and after it.
PLACE, BEFORE, OWN, AFTER = 0, 1, 2, 3
#: A place within SHIFT_WINDOW of the stretch needs a window on either side; the lag needs FIT_ROUNDS + 1 readings, which are fewer.
HALO = 2 * SHIFT_WINDOW

_ENDS = pa.schema([("source", pa.int64()), ("field", pa.int32()), ("pid", pa.int64()), ("n", pa.int64()), ("head", pa.list_(pa.float64())), ("tail", pa.list_(pa.float64()))])
_ENDS_SQL = "source long, field int, pid long, n long, head array<double>, tail array<double>"
_SPANS = pa.schema([("source", pa.int64()), ("field", pa.int32()), ("value", pa.float64())])
_SPANS_SQL = "source long, field int, value double"
_SUMS = pa.schema([("source", pa.int64()), ("field", pa.int32()), ("num", pa.float64()), ("den", pa.float64())])
_SUMS_SQL = "source long, field int, num double, den double"
_STEPS = pa.schema([("source", pa.int64()), ("field", pa.int32()), ("at", pa.int64()), ("step", pa.float64())])
_STEPS_SQL = "source long, field int, at long, step double"


def _columns(rows: list[tuple], schema: pa.Schema) -> dict[str, list]:
    return dict(zip(schema.names, zip(*rows))) if rows else {n: [] for n in schema.names}


def _ends(n_fields: int):
    """Of each series of a stretch: how many readings it has there, and its first and last ones."""

    def work(cols: dict[str, np.ndarray]) -> dict[str, list]:
        rows, starts = [], _starts(cols["source"])
        for a, b in zip(starts, np.r_[starts[1:], len(cols["source"])]):
            for k in range(n_fields):
                x = cols[f"x{k}"][a:b]
                x = x[~np.isnan(x)]
                if len(x):
                    rows.append((cols["source"][a], k, cols["pid"][a], len(x), x[:HALO], x[-HALO:]))
        return _columns(rows, _ENDS)

    return work


@dataclass
class _Series:
    """The readings of one series in a stretch, those around it included: own ones are ``a`` to ``b``, the first of all is reading ``at`` of the series."""

    source: int
    field: int
    y: np.ndarray
    a: int
    b: int
    at: int
    rows: np.ndarray
    level: float
    limit: float
    cap: float
    phis: list[float]

    @property
    def normal(self) -> float:
        return self.level if np.isfinite(self.level) else 0.0

    def fitted(self, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cleaned deviations from the shifted level, those one reading before, and the last prediction; right from FIT_ROUNDS + 1 readings after the first on."""
        start, rest = np.zeros(1, np.int64), self.y - shift
        z, pred = np.clip(rest, -self.cap, self.cap), np.zeros_like(rest)
        for phi in self.phis:
            pred = phi * _lag(z, start)
            z = _clean(rest, pred, _widened(self.limit, shift, self.normal), self.cap)
        return z, _lag(z, start), pred

    def shifts(self, steps: dict) -> tuple[np.ndarray, np.ndarray]:
        """The level of the readings after the shifts taken out so far, and where those are."""
        places, upto = steps.get((self.source, self.field), (np.empty(0, np.int64), np.zeros(1)))
        i, j = np.searchsorted(places, (self.at, self.at + len(self.y)))
        return upto[np.searchsorted(places, self.at + np.arange(len(self.y)), "right")], places[i:j] - self.at


def _series(fields: list[Reading], rounds: int, cols: dict[str, np.ndarray]) -> Iterator[_Series]:
    starts = _starts(cols["source"])
    for a, b in zip(starts, np.r_[starts[1:], len(cols["source"])]):
        role = cols["role"][a:b]
        for k, f in enumerate(fields):
            x = cols[f"x{k}"][a:b]
            rows = np.flatnonzero(~np.isnan(x) & (role != PLACE))
            own = np.flatnonzero(role[rows] == OWN)
            if not len(own):
                continue
            level, mad = cols[f"m{k}"][a], cols[f"d{k}"][a] if f"d{k}" in cols else 0.0
            m = level if np.isfinite(level) else 0.0
            limit, cap = _limits(np.array(m), np.array(mad), f.scale_floor)
            at = int(x[np.flatnonzero((role == PLACE) & ~np.isnan(x))[0]]) - own[0]
            yield _Series(int(cols["source"][a]), k, x[rows] - m, own[0], own[-1] + 1, int(at), a + rows, level, float(limit), float(cap), [cols[f"p{k}_{r}"][a] for r in range(rounds)])


def _spans(fields: list[Reading]):
    """Deviations from the level, and steps from the reading before as further fields."""

    def work(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        parts = []
        for s in _series(fields, 0, cols):
            steps, _ = _step_sizes(s.y, np.zeros(1, np.int64))
            # Step i leads to reading i + 1.
            for field, value in ((s.field, np.abs(s.y[s.a : s.b])), (s.field + len(fields), steps[max(0, s.a - 1) : s.b - 1])):
                parts.append((np.full(len(value), s.source), np.full(len(value), field), value))
        return dict(zip(_SPANS.names, map(np.concatenate, zip(*parts)))) if parts else {n: np.empty(0) for n in _SPANS.names}

    return work


def _sums(fields: list[Reading], rounds: int, steps):
    def work(cols: dict[str, np.ndarray]) -> dict[str, list]:
        rows = []
        for s in _series(fields, rounds, cols):
            shift = s.shifts(steps.value)[0]
            z, before, pred = s.fitted(shift)
            num, den = _moments(s.y - shift, z, before, pred, _widened(s.limit, shift, s.normal))
            rows.append((s.source, s.field, num[s.a : s.b].sum(), den[s.a : s.b].sum()))
        return _columns(rows, _SUMS)

    return work


def _new_steps(fields: list[Reading], steps, active):
    """Jumps of one round of ``_shift`` whose places are in the stretch."""

    def work(cols: dict[str, np.ndarray]) -> dict[str, list]:
        rows, w = [], SHIFT_WINDOW
        for s in _series(fields, 0, cols):
            if active.value is not None and (s.source, s.field) not in active.value:
                continue
            level, taken = s.shifts(steps.value)
            n = len(s.y)
            open_ = np.zeros(n, bool)
            open_[max(w, s.a - w) : max(0, min(n - w, s.b + w) + 1)] = True
            open_[taken] = False
            t, size = _jumps(s.y - level, np.full(n, s.cap), np.full(n, s.limit / THRESHOLD), np.flatnonzero(open_))
            rows += [(s.source, s.field, s.at + i, d) for i, d in zip(t, size) if s.a <= i < s.b]
        return _columns(rows, _STEPS)

    return work


def _spread_kinds(fields: list[Reading], ratio: float, steps):
    def work(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = []
        for s in _series(fields, FIT_ROUNDS, cols):
            own = slice(s.a, s.b)
            shift = s.shifts(steps.value)[0]
            pred = s.phis[-1] * s.fitted(shift)[1]
            x = cols[f"x{s.field}"][s.rows]
            kinds = _model_kinds(*(v[own] for v in _scores(s.y, pred, shift, s.limit, s.normal)), x[own], ratio * s.level)
            hit = np.flatnonzero(kinds)
            none, at = np.full(len(hit), -1), s.rows[own][hit]
            times = x[own][hit] / s.level if s.level > 0 else np.zeros(len(hit))
            out.append({"id": cols["id"][at], "field": np.full(len(hit), s.field), "source": np.full(len(hit), s.source), "kinds": kinds[hit], "ratio": times, "pid": none, "side": none, "run": none, "value": x[own][hit]})
        return {n: np.concatenate([o[n] for o in out]) if out else np.empty(0) for n in _OUT.names}

    return work


def _with_surroundings(rows: DataFrame, n_fields: int) -> DataFrame:
    """``rows`` of series that go on in other stretches, by stretch and source, with their places and the readings around them as further rows."""
    only = lambda k, value: [F.when(F.col("field") == k, F.col(value)).alias(f"x{k}")]
    # At most two series of a stretch go on elsewhere: a few rows a stretch.
    ends = materialize(rows.mapInArrow(_by_stretch(_ends(n_fields), _ENDS), _ENDS_SQL), "ends")
    line = W.Window.partitionBy("source", "field").orderBy("pid")
    # Each stretch in between has at least one reading, so HALO stretches hold enough.
    near = ends.select(
        "source", "field", "pid", F.coalesce(F.sum("n").over(line.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).cast("double").alias("place"),
        F.slice(F.reverse(F.flatten(F.collect_list("tail").over(line.rowsBetween(-HALO, -1)))), 1, HALO).alias("before"),
        F.slice(F.flatten(F.collect_list("head").over(line.rowsBetween(1, HALO))), 1, HALO).alias("after"),
    )
    place = near.select("source", "pid", "field", F.lit(PLACE).alias("role"), F.lit(0).alias("ord"), F.col("place").alias("value"))
    before = near.select("source", "pid", "field", F.lit(BEFORE).alias("role"), F.posexplode("before").alias("o", "value")).withColumn("o", -F.col("o"))
    after = near.select("source", "pid", "field", F.lit(AFTER).alias("role"), F.posexplode("after").alias("o", "value"))
    extra = place.unionByName(before.withColumnRenamed("o", "ord")).unionByName(after.withColumnRenamed("o", "ord"))
    start = rows.schema["start"].dataType
    extra = extra.select("pid", "source", "role", "ord", F.lit(None).cast(start).alias("start"), F.lit(-1).cast("long").alias("id"), *[c for k in range(n_fields) for c in only(k, "value")])
    own = rows.select("pid", "source", F.lit(OWN).alias("role"), F.lit(0).alias("ord"), "start", "id", *[f"x{k}" for k in range(n_fields)])
    both = own.unionByName(extra).repartition("pid").sortWithinPartitions("pid", "source", "role", "ord", "start", "id")
    return materialize(both, "series", by="pid")


def _spread_cases(stretch: DataFrame, known: DataFrame, fields: list[Reading], ratio: float) -> DataFrame:
    """The model's cases of series that go on in several stretches, the same as if each were fitted as one.

    ``known`` has their levels. Scale and phi come from sums over all stretches; lags, windows and places near an edge see the readings beyond it;
    shifts found in a round hold for all later readings of the series. What a task needs of them is broadcast: two numbers a shift.
    """
    spark, n = stretch.sparkSession, len(fields)
    rows = _with_surroundings(stretch.join(F.broadcast(known.select("source")), "source", "left_semi"), n)
    spans = rows.join(F.broadcast(known), "source").mapInArrow(_by_stretch(_spans(fields), _SPANS), _SPANS_SQL)
    medians = exact_medians(spans, ["source", "field"], "value").select("source", F.pmod("field", F.lit(n)).alias("field"), "median")
    wide = lambda df, value, name, f=F.max: df.groupBy("source").agg(*[f(F.when(F.col("field") == k, F.col(value))).alias(name(k)) for k in range(n)])
    known = materialize(known.join(wide(medians, "median", "d{}".format, F.min), "source", "left"), "scales")
    scaled = rows.join(F.broadcast(known), "source")

    found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    steps, active, open_rows = spark.sparkContext.broadcast({}), spark.sparkContext.broadcast(None), scaled
    while True:
        new: dict[tuple[int, int], list] = {}
        for s in open_rows.mapInArrow(_by_stretch(_new_steps(fields, steps, active), _STEPS), _STEPS_SQL).collect():
            new.setdefault((s[0], s[1]), []).append((s[2], s[3]))
        if not new:
            break
        for key, more in new.items():
            at, upto = found.get(key, (np.empty(0, np.int64), np.zeros(1)))
            at, step = np.r_[at, [a for a, _ in more]].astype(np.int64), np.r_[np.diff(upto), [d for _, d in more]]
            order = np.argsort(at)
            found[key] = at[order], np.r_[0, np.cumsum(step[order])]
        steps, active = spark.sparkContext.broadcast(found), spark.sparkContext.broadcast(set(new))
        # Series without a jump are done.
        open_rows = scaled.join(F.broadcast(spark.createDataFrame([(s,) for s in {s for s, _ in new}], "source long")), "source", "left_semi")
    for r in range(FIT_ROUNDS):
        sums = rows.join(F.broadcast(known), "source").mapInArrow(_by_stretch(_sums(fields, r, steps), _SUMS), _SUMS_SQL).groupBy("source", "field").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
        phi = sums.withColumn("phi", F.when(F.col("den") > 0, F.greatest(F.least(F.col("num") / F.col("den"), F.lit(PHI_CAP)), F.lit(-PHI_CAP))).otherwise(0.0))
        known = materialize(known.join(wide(phi, "phi", lambda k, r=r: f"p{k}_{r}"), "source", "left"), "phi")
    fitted = rows.join(F.broadcast(known), "source")
    return fitted.mapInArrow(_by_stretch(_spread_kinds(fields, ratio, steps), _OUT), _OUT_SQL)


#: Rank error of the quantiles between which a median is searched, as a share of a key's rows.
BRACKET = 1e-4
BROADCAST_KEYS = 200_000


def exact_medians(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median (mean of the two middle values for an even number) of ``value`` per ``keys``, as column ``median``.

    Approximate quantiles a little below and above the middle, which combine on the map side, narrow each key down to a few ten-thousandths
    of its rows; the rows below are counted and only those between are sorted, equal values counted first. So no task sorts a hot key. Null
    values are skipped; a key without values has no row.
    """
    there = values.where(F.col(value).isNotNull())
    around = F.percentile_approx(value, [0.5 - 5 * BRACKET, 0.5 + 5 * BRACKET], int(1 / BRACKET))
    brackets = materialize(there.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"), around.alias("__q")).select(*keys, "__all", F.col("__q")[0].alias("__from"), F.col("__q")[1].alias("__to")), "brackets")
    same = None
    for k in keys:
        cond = F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = cond if same is None else same & cond
    # A row of a few numbers a key; more keys than this are joined by a shuffle, where AQE splits a hot one.
    few = brackets.count() <= BROADCAST_KEYS
    inside = there.alias("v").join((F.broadcast(brackets) if few else brackets).alias("b"), same).select(*[F.col(f"v.{k}").alias(k) for k in keys], F.col(f"v.{value}").alias("__x"), "__all", "__from", "__to")
    # Values up to the lower quantile count for it, so that its own copies are among the sorted ones.
    place = F.when(F.col("__x") < F.col("__from"), F.lit(None)).when(F.col("__x") <= F.col("__to"), F.col("__x")).otherwise(F.lit(float("inf")))
    counts = inside.groupBy(*keys, "__all", place.alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    w = W.Window.partitionBy(*keys).orderBy("__x")
    upto = counts.withColumn("__upto", F.sum("__n").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    middle = upto.where((F.col("__upto") >= low) & (F.col("__upto") - F.col("__n") < high))
    # The middle values: one or two distinct values. A null or infinite one is outside the bracket: the quantiles were further off than they promise.
    safe = F.raise_error(F.lit("the middle values are not between the approximate quantiles"))
    median = (F.min("__x") + F.max("__x")) / 2
    return middle.groupBy(*keys).agg(F.when((F.count("__x") == F.count(F.lit(1))) & (F.max("__x") < float("inf")), median).otherwise(safe).alias("median"))


def implausible_readings(
    df: DataFrame, source: str, time: str, row_id: str, fields: list[Reading], end_time: str | None = None, run_length: int = 8, ratio: float = 10.0,
    stretch_rows: int = 1_000_000,
) -> DataFrame:
    """Readings of ``fields`` that are impossible, stuck or far from their source's normal, one row per row id and field.

    Result: ``row_id``, ``field_name``, ``source_id`` (long), booleans ``negative, too_fast, stuck, spike, level_shift, far`` and ``level_ratio``
    (reading / median of the source's positive readings; 0 without one). ``spike``/``level_shift`` are the model's tests, ``far`` its candidates that
    reach ``ratio`` times the level. Rows repeated with the same id count once; extra columns are ignored.

    Null readings are passed over; rows with a null source, time or id take no part. NaN is taken as null. Infinite readings are not supported.
    A source with no positive reading has no level, so only limits apply. An empty table gives an empty result.
    """
    if ratio < LEVEL_GUARANTEE:
        raise ValueError(f"ratio must be at least {LEVEL_GUARANTEE}: below it a reading need not be a candidate")
    names = [f.name for f in fields]
    needed = list(dict.fromkeys([source, time, row_id, *([end_time] if end_time else []), *names]))
    rows = df.where(F.col(source).isNotNull() & F.col(time).isNotNull() & F.col(row_id).isNotNull()).select(*needed)
    seconds = F.expr(f"timestampdiff(SECOND, `{time}`, `{end_time}`)") if end_time else F.lit(None)
    flat = rows.select(
        F.col(source).cast("long").alias("source"), F.col(time).alias("start"), F.col(row_id).cast("long").alias("id"),
        seconds.cast("double").alias("seconds"), *[F.nanvl(F.col(f.name).cast("double"), F.lit(None).cast("double")).alias(f"x{k}") for k, f in enumerate(fields)],
    )
    # Only sources with more rows than a stretch holds are divided among partitions; there can't be many, so they are looked up in a broadcast. Copies of a row
    # have the same key and so meet in one range partition; there they lie side by side. A partition is cut into stretches of bounded size, each a file.
    long = flat.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > stretch_rows).select("source", F.lit(True).alias("long"))
    ranged = flat.join(F.broadcast(long), "source", "left").repartitionByRange("source", F.when(F.col("long"), F.col("start")), F.when(F.col("long"), F.col("id")))
    parted = ranged.drop("long").sortWithinPartitions("source", "start", "id")
    parted = parted.withColumn("pid", F.spark_partition_id().cast("long"))
    stretch = materialize(parted.mapInArrow(_cut(stretch_rows), parted.schema), "stretches", whole_files=stretch_rows)

    spread = stretch.groupBy("source").agg(F.min("pid").alias("a"), F.max("pid").alias("b")).where("a < b").select("source")
    # A stretch has at most two sources that go on elsewhere, so this side is bounded by twice the number of stretches.
    spread = materialize(spread, "spread")
    lines = stretch.join(F.broadcast(spread), "source").select("source", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"x{k}").alias("value")) for k in range(len(fields))])).alias("r"))
    medians = exact_medians(lines.select("source", "r.field", "r.value").where(F.col("value") > 0), ["source", "field"], "value")
    per_source = medians.groupBy("source").agg(*[F.max(F.when(F.col("field") == k, F.col("median"))).alias(f"m{k}") for k in range(len(fields))])
    known = materialize(spread.join(per_source, "source", "left").withColumn("split", F.lit(True)), "levels")
    given = stretch.join(F.broadcast(known), "source", "left").withColumn("split", F.coalesce("split", F.lit(False)).cast("int"))
    given = given.select("pid", "source", "id", "seconds", "split", *[f"x{k}" for k in range(len(fields))], *[f"m{k}" for k in range(len(fields))])
    found = materialize(given.mapInArrow(_by_stretch(lambda cols: _chunk(fields, run_length, ratio, cols), _OUT), _OUT_SQL), "readings")
    if not spread.isEmpty():
        found = found.unionByName(materialize(_spread_cases(stretch, known.drop("split"), fields, ratio), "spread_cases"))

    # Runs over the edges of stretches: a few rows per stretch, in the order of stretches.
    edges = found.where("pid >= 0")
    line = W.Window.partitionBy("source", "field").orderBy("pid", "side")
    runs = edges.select("source", "field", "pid", "side", "run", "value").distinct()
    joins = (F.col("pid") != F.lag("pid").over(line)) & (F.col("value") == F.lag("value").over(line)) & F.lag("side").over(line).isin(TAIL, BOTH) & F.col("side").isin(HEAD, BOTH)
    runs = runs.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("no", F.sum("new").over(line))
    long_run = F.sum("run").over(W.Window.partitionBy("source", "field", "no")) >= run_length
    stuck_edges = runs.withColumn("long", long_run).where("long and value > 0").select("source", "field", "pid", "side")
    late = edges.join(stuck_edges, ["source", "field", "pid", "side"], "left_semi").withColumn("kinds", F.lit(STUCK))
    cases = found.where("pid < 0").unionByName(late).groupBy("id", "field").agg(F.bit_or("kinds").alias("kinds"), F.max("source").alias("source"), F.max("ratio").alias("ratio"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("field") + 1)
    bit = lambda b: F.col("kinds").bitwiseAND(F.lit(b)) > 0
    return cases.select(
        F.col("id").alias(row_id), name.alias("field_name"), F.col("source").alias("source_id"), bit(NEGATIVE).alias("negative"), bit(TOO_FAST).alias("too_fast"),
        bit(STUCK).alias("stuck"), bit(SPIKE).alias("spike"), bit(SHIFT).alias("level_shift"), bit(FAR).alias("far"), F.col("ratio").alias("level_ratio"),
    )


def _cut(stretch_rows: int):
    """Drop copies of sorted rows and number the stretches of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, written = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, src = batch.column("id").to_numpy(), batch.column("source").to_numpy()
            keep = np.r_[last is None or (src[0], ids[0]) != last, (ids[1:] != ids[:-1]) | (src[1:] != src[:-1])]
            last = (src[-1], ids[-1])
            if not keep.all():
                batch = batch.filter(pa.array(keep))
            n = batch.num_rows
            if not n:
                continue
            pid = (batch.column("pid").to_numpy() << 24) + (written + np.arange(n)) // stretch_rows
            written += n
            at = batch.schema.get_field_index("pid")
            yield batch.set_column(at, batch.schema.field(at), pa.array(pid))

    return run
