"""A random forest that learns as rows arrive, as a module for programs.

Each tree sees a row as many times as a Poisson draw says (mean 6) and keeps a window of its latest different rows, from which it is grown. The window widens while
the tree's accuracy on new rows holds, and narrows when it falls; the tree's height is bounded by the logarithm of the window. Before a batch is
learned, trees are tried on it: if the forest does significantly worse than before (a t-test), its worst trees are begun anew.

A tree keeps at most ``WINDOW`` rows, several batches. A call of ``fit`` or ``fit_inc`` learns from at most ``LEARNED`` rows, those with the least hashes of their
places; rows are found and counted on the executors, and no more than these come to the driver. Prediction runs on the executors, in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from seriate.plans.modules import module_function

WINDOW, LEAST_WINDOW, BAGGING, BATCH, LEARNED = 8192, 64, 6.0, 2048, 32_768
IMPURITY = {0: "gini", 1: "entropy"}


def student_t_tail(t: float, df: float) -> float:
    """Probability that a Student t variable with ``df`` degrees of freedom exceeds ``t`` (by the continued fraction of the incomplete beta)."""
    if df <= 0:
        return 0.5
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 200):
            for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + n * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + n / (c if abs(c) > 1e-300 else 1e-300)
                h *= d * c
            if abs(d * c - 1) < 1e-12:
                break
        return h

    if x >= 1:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    beta = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return beta / 2 if t > 0 else 1 - beta / 2


class Tree:
    """A decision tree over its window of rows."""

    def __init__(self, classes: int, impurity: str, seed: int):
        self.classes, self.impurity = classes, impurity
        self.random = np.random.default_rng(seed)
        self.x, self.y, self.times = None, None, None
        self.retain, self.accuracy = LEAST_WINDOW, None
        self.nodes: list[tuple] = []

    def _impurity(self, counts: np.ndarray) -> np.ndarray:
        p = counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)
        if self.impurity == "gini":
            return 1 - (p * p).sum(axis=-1)
        return -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=-1)

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        if self.nodes:
            now = float((self.predict(x) == y).mean())
            worse = self.accuracy is not None and now < self.accuracy - 0.05
            self.retain = max(LEAST_WINDOW, self.retain // 2) if worse else min(WINDOW, self.retain * 2)
            self.accuracy = now if self.accuracy is None else 0.7 * self.accuracy + 0.3 * now
        else:
            self.retain = min(WINDOW, max(self.retain, 2 * len(y)))
        times = self.random.poisson(BAGGING, len(y))
        drawn = np.flatnonzero(times)
        x, y, times = x[drawn], y[drawn], times[drawn]
        if self.x is not None:
            x, y, times = np.concatenate([self.x, x]), np.concatenate([self.y, y]), np.concatenate([self.times, times])
        self.x, self.y, self.times = x[-self.retain :], y[-self.retain :], times[-self.retain :]
        self.nodes = []
        self._grow(np.arange(len(self.y)), max(1, int(math.log2(max(2, self.retain)))))

    def _grow(self, rows: np.ndarray, height: int) -> int:
        at = len(self.nodes)
        counts = np.bincount(self.y[rows], self.times[rows], self.classes)
        n = counts.sum()
        self.nodes.append((-1, 0.0, 0, 0, int(counts.argmax())))
        if height == 0 or n < 4 or counts.max() == n:
            return at
        n_features = self.x.shape[1]
        best = None
        for f in self.random.permutation(n_features)[: max(1, math.isqrt(n_features) + 1)]:
            order = np.argsort(self.x[rows, f], kind="stable")
            v, classes = self.x[rows, f][order], self.y[rows][order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            left = np.cumsum(np.eye(self.classes)[classes] * self.times[rows][order, None], axis=0)[cuts]
            right = counts - left
            score = (self._impurity(left) * left.sum(axis=1) + self._impurity(right) * right.sum(axis=1)) / n
            k = int(score.argmin())
            if best is None or score[k] < best[0]:
                best = (score[k], f, (v[cuts[k]] + v[cuts[k] + 1]) / 2)
        if best is None or best[0] >= self._impurity(counts) - 1e-9:
            return at
        goes_left = self.x[rows, best[1]] <= best[2]
        left, right = self._grow(rows[goes_left], height - 1), self._grow(rows[~goes_left], height - 1)
        self.nodes[at] = (int(best[1]), float(best[2]), left, right, int(counts.argmax()))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, label = (np.array(c) for c in zip(*self.nodes))
        at = np.zeros(len(x), dtype=int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return label[at]
            n = at[inner]
            at[inner] = np.where(x[inner, feature[n]] <= cut[n], left[n], right[n])


class Forest:
    """Trees that vote."""

    def __init__(self, trees: int, features: int, forget: float, classes: int, impurity: str, seed: int = 7):
        self.features, self.forget, self.classes, self.impurity, self.seed = features, forget, classes, impurity, seed
        self.made = trees
        self.trees = [Tree(classes, impurity, seed + i) for i in range(trees)]
        self.history: list[float] = []

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        if not len(y):
            return
        if x.shape[1] != self.features:
            raise ValueError(f"rows have {x.shape[1]} features, the forest {self.features}")
        if y.min() < 0 or y.max() >= self.classes:
            raise ValueError(f"classes go from 0 to {self.classes - 1}")
        if self.trees[0].nodes:
            right = np.array([(t.predict(x) == y).mean() for t in self.trees])
            now = float((self.predict(x) == y).mean())
            if len(self.history) >= 3:
                past = np.array(self.history[-20:])
                spread = max(past.std(ddof=1), 1e-3)
                t = (past.mean() - now) / (spread * math.sqrt(1 + 1 / len(past)))
                if t > 0 and student_t_tail(t, len(past) - 1) < 0.05:
                    for i in np.argsort(right)[: max(1, int(self.forget * len(self.trees)))]:
                        self.trees[i] = Tree(self.classes, self.impurity, self.seed + self.made)
                        self.made += 1
                    self.history = []
            self.history.append(now)
        for t in self.trees:
            t.learn(x, y)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0, int)
        votes = np.zeros((len(x), self.classes), int)
        for t in self.trees:
            votes[np.arange(len(x)), t.predict(x)] += 1
        return votes.argmax(axis=1)


_STATE: dict[str, object] = {"forest": None, "seen": 0}


def _forest() -> Forest:
    if _STATE["forest"] is None:
        raise ValueError("no forest: call newtree first")
    return _STATE["forest"]


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    good = [r for r in rows if r[0] is not None and r[1] is not None and all(v is not None for v in r[0])]
    return np.array([r[0] for r in good], dtype=float).reshape(len(good), -1), np.array([r[1] for r in good], dtype=int)


@module_function("frame")
def newtree(df: DataFrame | None, trees: int, features: int, forget: float, classes: int, impurity: int = 0) -> bool:
    """Begin a forest. A column argument (which features are sparse) is counted and must name each feature; the trees treat all alike."""
    if df is not None and df.count() != features:
        return False
    _STATE.update(forest=Forest(int(trees), int(features), float(forget), int(classes), IMPURITY[int(impurity)]), seen=0)
    return True


@module_function("frame")
def fit(df: DataFrame) -> bool:
    """Learn from rows of features and class in a batch: at most ``WINDOW`` of them, those with the least hashes."""
    x, y = _arrays(df.orderBy(F.xxhash64(*df.columns)).limit(WINDOW).collect())
    _forest().learn(x, y)
    return True


def _numbered(df: DataFrame) -> DataFrame:
    """With each row's place in the frame, ``__place``: a number per partition, and the rows of the partitions before."""
    there = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.call_function("shiftright", "__id", F.lit(33))
    sizes = there.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(W.Window.orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    joined = there.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn("__place", F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__start")


@module_function("frame")
def fit_inc(df: DataFrame) -> bool:
    """Learn from the rows after those already seen, in batches; false if there are none.

    Rows are counted in the order of the frame, which has to give its earlier rows first (as tables do that are appended to). Of more than ``LEARNED`` new
    rows so many are learned from, in their order. A table that has become shorter is seen from its start again.
    """
    n = df.count()
    if _STATE["seen"] > n:
        _STATE["seen"] = 0
    if _STATE["seen"] == n:
        return False
    new = _numbered(df).where(F.col("__place") >= _STATE["seen"])
    rows = sorted(new.orderBy(F.xxhash64("__place")).limit(LEARNED).collect(), key=lambda r: r["__place"])
    for at in range(0, len(rows), BATCH):
        _forest().learn(*_arrays(rows[at : at + BATCH]))
    _STATE["seen"] = n
    return True


@module_function("rows")
def predict():
    """The class of each row of features, by the forest as it is when the query is planned; null for rows with missing features."""
    forest = _forest() if _STATE["forest"] is not None else None

    def run(x: pd.Series) -> pd.Series:
        if forest is None:
            raise ValueError("no forest: call newtree first")
        good = np.array([v is not None and all(e is not None and e == e for e in v) for v in x], dtype=bool)
        out = pd.Series([None] * len(x), dtype="Int32")
        if good.any():
            out[good] = forest.predict(np.stack([np.asarray(v, float) for v in x[good]]))
        return out

    return run


@module_function("frame")
def test(df: DataFrame) -> float:
    """Mean squared difference of predicted and true class, computed where the rows are."""
    features, label = df.columns
    guess = F.pandas_udf(predict(), "int")
    return df.select(F.avg(F.pow(guess(F.col(features)) - F.col(label), 2)).alias("e")).first()[0]
