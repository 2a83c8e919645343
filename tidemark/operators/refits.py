"""Models of many cutoffs, fitted side by side in a few passes over the history.

The history is cut into periods; the model of period ``k`` sees the rows of the periods before ``k``. Rows that are alike
in period and features count once, with their number.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = "__period"


def _features(features: list[str], fill: float) -> list[Column]:
    """The features as doubles ``__x0``, ``__x1``, ..., NULL and NaN as ``fill``."""
    c = [F.col(f).cast("double") for f in features]
    return [F.when(x.isNull() | F.isnan(x), F.lit(fill)).otherwise(x).alias(f"__x{k}") for k, x in enumerate(c)]


def _arrays(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _collected(df: DataFrame, names: list[str], order: str) -> list[np.ndarray]:
    """Columns of ``df`` as arrays on the driver, without objects for rows, sorted by ``order``."""
    t = df.select(*names).toArrow()
    at = np.argsort(t.column(order).to_numpy(), kind="stable")
    return [t.column(n).to_numpy()[at] for n in names]


def predict(df: DataFrame, features: list[str], models: dict[int, Any], of: Callable[[Any, np.ndarray], np.ndarray], out: str, fill: float = -1.0) -> DataFrame:
    """``df`` without PERIOD and with ``out``: ``of(model, features)`` by the model of the row's period."""
    kept = [c for c in df.columns if c != PERIOD]
    xs = [f"__x{k}" for k in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            period, *x = _arrays(b, [PERIOD, *xs])
            x, got = np.column_stack(x), np.zeros(len(period))
            for k in np.unique(period).tolist():
                at = period == k
                got[at] = of(models[k], x[at])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in range(len(kept))), pa.array(got)], names=[*kept, out])

    schema = df.select(*kept, F.lit(0.0).alias(out)).schema
    return df.select(*kept, PERIOD, *_features(features, fill)).mapInArrow(run, schema)


# ---------------------------------------------------------------- Poisson regression

#: Ridge, tolerance, iterations and least mean of pyspark.ml's regression as ``Poisson`` sets it.
RIDGE, TOLERANCE, ITERATIONS, LEAST_MEAN = 1e-6, 1e-6, 25, 1e-16


def rate(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.exp(beta[0] + x @ beta[1:]), LEAST_MEAN, np.finfo(float).max)


def _normal_equations(cells: DataFrame, width: int, betas: dict[int, np.ndarray | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each period, the weighted normal equations around its ``betas`` (None: of the logarithms of the labels)."""
    ks = sorted(betas)
    up = np.triu_indices(width + 1)
    names = [PERIOD, *(f"__x{k}" for k in range(width)), "n", "y", "log_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ks), len(up[0]) + width + 1))
        for b in batches:
            period, *x, n, y, log_y = _arrays(b, names)
            order = np.argsort(period, kind="stable")
            x = np.column_stack([np.ones(len(n)), *x])[order]
            n, y, log_y = n[order].astype(float), y[order], log_y[order]
            products = x[:, up[0]] * x[:, up[1]]
            for j, end in enumerate(np.searchsorted(period[order], ks, "left").tolist()):
                if not end:
                    continue
                beta = betas[ks[j]]
                if beta is None:
                    w, wz = n[:end], log_y[:end]
                else:
                    w = n[:end] * rate(beta, x[:end, 1:])
                    wz = w * (x[:end] @ beta) + y[:end] - w
                total[j] += np.concatenate([w @ products[:end], wz @ x[:end]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = cells.mapInArrow(run, "sums binary").collect()
    total = sum(np.frombuffer(r["sums"]).reshape(len(ks), -1) for r in parts)
    out = {}
    for k, row in zip(ks, total, strict=True) if len(parts) else ():
        g = np.zeros((width + 1, width + 1))
        g[up] = row[: len(up[0])]
        out[k] = g + np.triu(g, 1).T, row[len(up[0]) :]
    return out


def fit_poisson(df: DataFrame, features: list[str], label: str, periods: list[int], fill: float = -1.0) -> dict[int, np.ndarray]:
    """(intercept, coefficients) of the Poisson regression of each period that has labels before it, by iteratively reweighted least squares.

    Steps, ridge and end are those of pyspark.ml; a step is one pass over the cells for all periods that go on, and each
    task hands one small matrix per period to the driver.
    """
    y = F.col(label).cast("double")
    y = F.when(y < 0, F.raise_error(F.lit(f"{label} has negative values")).cast("double")).otherwise(y)
    seen = df.filter(F.col(label).isNotNull() & (F.col(PERIOD) < max(periods, default=0))).select(PERIOD, *_features(features, fill), y.alias("y"))
    xs = [f"__x{k}" for k in range(len(features))]
    cells = seen.groupBy(PERIOD, *xs).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.log(F.greatest("y", F.lit(0.1)))).alias("log_y")).persist()
    betas: dict[int, np.ndarray] = {}
    active: dict[int, np.ndarray | None] = dict.fromkeys(periods)
    for _ in range(ITERATIONS + 1):
        if not active:
            break
        steps = {}
        for k, (g, r) in _normal_equations(cells, len(features), active).items():
            if g[0, 0] <= 0:
                continue  # no label before this period
            ridge = np.diag([0.0, *[RIDGE] * len(features)])
            betas[k] = np.linalg.lstsq(g / g[0, 0] + ridge, r / g[0, 0], rcond=None)[0]
            if active[k] is None or np.abs(betas[k] - active[k]).max() >= TOLERANCE:
                steps[k] = betas[k]
        active = steps
    cells.unpersist()
    return betas


# ---------------------------------------------------------------- boosted trees

#: Bins and step size of pyspark.ml's boosted trees by default.
BINS, STEP = 32, 0.1


@dataclass
class Tree:
    """A node splits on ``feature`` (-1: leaf) at ``threshold``; node j's children are 2j + 1 and 2j + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            right = x[rows, np.maximum(self.feature[at], 0)] > self.threshold[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return self.value[at]


def start_probability(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    margin = trees[0](x) + STEP * sum((t(x) for t in trees[1:]), np.zeros(len(x)))
    return 1 / (1 + np.exp(-2 * margin))


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Candidate thresholds of a feature as pyspark.ml finds them, over sorted distinct values with the counts of all rows."""
    total = counts.sum()
    most = min(bins, int(total)) - 1
    if len(values) - 1 <= most:
        return (values[:-1] + values[1:]) / 2
    stride = total / (most + 1)
    out, at, target = [], counts[0], stride
    for k in range(1, len(values)):
        before, at = at, at + counts[k]
        if abs(before - target) < abs(at - target):
            out.append((values[k - 1] + values[k]) / 2)
            target += stride
    return np.array(out)


def _grow(bins: np.ndarray, n: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], depth: int) -> tuple[Tree, np.ndarray]:
    """A regression tree by variance over cells of binned features, and the cells' values."""
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
    got = np.zeros(len(n))
    impurity = lambda w, s, q: (q - s * s / w) / w
    todo = [(0, np.arange(len(n)))]
    while todo:
        node, rows = todo.pop()
        w, t, b = n[rows], target[rows], bins[rows]
        wt = w * t
        wtt = wt * t
        sw, s, q = w.sum(), wt.sum(), wtt.sum()
        tree.value[node] = s / sw
        best, where, own = 0.0, None, impurity(sw, s, q)
        if node < 2**depth - 1 and abs(own) >= np.finfo(float).eps:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                lw, ls, lq = (np.cumsum(np.bincount(b[:, f], v, len(cut) + 1))[:-1] for v in (w, wt, wtt))
                rw = sw - lw
                ok = np.flatnonzero((lw > 0) & (rw > 0))
                if not len(ok):
                    continue
                lw, ls, lq, rw = lw[ok], ls[ok], lq[ok], rw[ok]
                gain = own - lw / sw * impurity(lw, ls, lq) - rw / sw * impurity(rw, s - ls, q - lq)
                if gain.max() > best:
                    best, where = gain.max(), (f, ok[np.argmax(gain)])
        if where is None:
            got[rows] = tree.value[node]
            continue
        f, c = where
        tree.feature[node], tree.threshold[node] = f, cuts[f][c]
        left = b[:, f] <= c
        todo += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]
    return tree, got


def boost(bins: np.ndarray, n: np.ndarray, label: np.ndarray, cuts: list[np.ndarray], rounds: int, depth: int) -> list[Tree]:
    """Gradient-boosted trees by log loss over cells of binned features; labels are 0 and 1."""
    n, y = n.astype(float), 2.0 * label - 1
    tree, margin = _grow(bins, n, y, cuts, depth)
    trees = [tree]
    for _ in range(rounds - 1):
        tree, got = _grow(bins, n, 4 * y / (1 + np.exp(2 * y * margin)), cuts, depth)
        trees.append(tree)
        margin = margin + STEP * got
    return trees


#: Tasks that fit boosted trees at most: each reads the cells that its cutoffs see. Cells that a task holds before it adds them up.
TASKS, HELD = 8, 200_000


def fit_boosted(df: DataFrame, features: list[str], label: str, periods: list[int], rounds: int, depth: int, fill: float = -1.0) -> dict[int, list[Tree]] | None:
    """Boosted trees of each period that has labels before it, as pyspark.ml grows them, but with thresholds from all rows before the period.

    The driver holds the counts of each period's distinct values by feature and the trees. A task adds up the cells of each
    of its cutoffs by the cutoff's own bins (a number for each combination that occurs). None if bins are too many for one number.
    """
    y = F.col(label).cast("double")
    y = F.when(y.isin(0.0, 1.0), y).otherwise(F.raise_error(F.lit(f"{label} has values other than 0 and 1")).cast("double")).cast("int")
    seen = df.filter(F.col(label).isNotNull() & (F.col(PERIOD) < max(periods, default=0))).select(PERIOD, *_features(features, fill), y.alias("y"))
    xs = [f"__x{k}" for k in range(len(features))]
    cells = seen.groupBy(PERIOD, *xs, "y").agg(F.count("*").alias("n")).persist()
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(x).alias("v")) for k, x in enumerate(xs)])).alias("e")
    of, value, p, n = _collected(cells.select(PERIOD, "n", each).groupBy("e.f", "e.v", PERIOD).agg(F.sum("n").alias("n")), ["f", "v", PERIOD, "n"], PERIOD)
    cuts: dict[int, list[np.ndarray]] = {k: [] for k in sorted(periods) if len(p) and k > p[0]}
    for f in range(len(xs)):
        p_f, n_f = p[of == f], n[of == f]
        values, at = np.unique(value[of == f], return_inverse=True)
        for k, own in cuts.items():
            end = np.searchsorted(p_f, k, "left")
            got = np.bincount(at[:end], n_f[:end], len(values))
            own.append(thresholds(values[got > 0], got[got > 0]))
    if not cuts:
        cells.unpersist()
        return {}
    fine = [np.unique(np.concatenate([own[f] for own in cuts.values()])) for f in range(len(xs))]
    spans = [len(t) + 1 for t in fine]
    if 2 * math.prod(spans) >= 2**63:
        cells.unpersist()
        return None
    groups = [g.tolist() for g in np.array_split(list(cuts), min(TASKS, len(cuts), max(1, df.sparkSession.sparkContext.defaultParallelism)))]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            period, *x, y, n = _arrays(b, [PERIOD, *xs, "y", "n"])
            c = y.astype(np.int64)
            for v, t in zip(x, fine, strict=True):
                c = c * (len(t) + 1) + np.searchsorted(t, v, "left")
            yield pa.RecordBatch.from_arrays([pa.array(period), pa.array(c), pa.array(n)], names=[PERIOD, "c", "n"])

    def own_bins(k: int, c: np.ndarray) -> np.ndarray:
        out, scale = np.zeros(len(c), dtype=np.int64), 1
        for f in reversed(range(len(xs))):
            out += scale * np.searchsorted(cuts[k][f], np.append(fine[f], np.inf), "left")[c % spans[f]]
            c, scale = c // spans[f], scale * (len(cuts[k][f]) + 1)
        return out + scale * c

    def fit(k: int, kinds: np.ndarray, n: np.ndarray) -> list[Tree]:
        bins = np.empty((len(kinds), len(xs)), dtype=np.int64)
        for f in reversed(range(len(xs))):
            bins[:, f], kinds = kinds % (len(cuts[k][f]) + 1), kinds // (len(cuts[k][f]) + 1)
        return boost(bins, n, kinds, cuts[k], rounds, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[list[np.ndarray]] = []

        def add_up() -> None:
            g, period, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for j, k in ((j, k) for j in np.unique(g).tolist() for k in groups[j]):
                at = (g == j) & (period < k)
                kinds, counts = sums.get(k, (np.zeros(0, dtype=np.int64), np.zeros(0)))
                kinds, where = np.unique(np.concatenate([kinds, own_bins(k, c[at])]), return_inverse=True)
                sums[k] = kinds, np.bincount(where, np.concatenate([counts, n[at]]), len(kinds))

        for b in batches:
            held.append(_arrays(b, ["g", PERIOD, "c", "n"]))
            if sum(len(h[0]) for h in held) >= HELD:
                add_up()
        if held:
            add_up()
        for k, (kinds, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(fit(k, kinds, n))], pa.binary())], names=["k", "trees"])

    binned = cells.mapInArrow(code, cells.select(PERIOD, F.col("n").alias("c"), "n").schema).groupBy(PERIOD, "c").agg(F.sum("n").alias("n"))
    dealt = F.explode(F.filter(F.array(*[F.when(F.col(PERIOD) < ks[-1], F.lit(j)) for j, ks in enumerate(groups)]), lambda g: g.isNotNull()))
    got = binned.withColumn("g", dealt).repartition(2 * len(groups), "g").mapInArrow(run, "k long, trees binary").collect()
    cells.unpersist()
    return {r["k"]: pickle.loads(r["trees"]) for r in got}
