"""Statistics of paired differences and forecasts. Data is aggregated in Spark; what is computed here on the
driver has one value per cell, lag or bin."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine.scale import one_row


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    p = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return p if t >= 0 else 1 - p


def paired_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Inner join 1:1 on the keys with the difference a - b; NULL if either is."""
    left = a.select(*keys, F.col(value).alias("value_a"))
    right = b.select(*keys, F.col(value).alias("value_b"))
    return left.join(right, keys).withColumn("diff", F.col("value_a") - F.col("value_b"))


def cell_means(diffs: DataFrame, cell: list[str], value: str) -> DataFrame:
    return diffs.groupBy(*cell).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def t_test(cells: DataFrame, value: str = "mean") -> tuple[int, float, float, float]:
    """One-sided t-test that the mean of the cells is above 0: (n, mean, t, p); NaN with fewer than two cells."""
    r = cells.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).first()
    if r.n < 2 or not r.s:
        return r.n, r.m if r.m is not None else math.nan, math.nan, math.nan
    t = r.m / (r.s / math.sqrt(r.n))
    return r.n, r.m, t, t_sf(t, r.n - 1)


def newey_west(series: DataFrame, order: str, value: str, lag: int) -> tuple[int, float, float]:
    """(n, mean, variance of the mean) with Bartlett weights. The lagged products are one window over the
    ordered cluster means (one value per cluster)."""
    w = Window.orderBy(order)
    m = F.avg(value).over(Window.partitionBy())
    x = series.withColumn("__d", F.col(value) - m)
    parts = x.select("__d", *[(F.col("__d") * (F.lag("__d", k).over(w) if k else F.col("__d"))).alias(f"p{k}") for k in range(lag + 1)])
    r = parts.agg(F.count("*").alias("n"), *[F.sum(f"p{k}").alias(f"g{k}") for k in range(lag + 1)]).first()
    mean = series.agg(F.avg(value).alias("m")).first().m
    if not r.n:
        return 0, math.nan, math.nan
    g = [(r[f"g{k}"] or 0.0) / r.n for k in range(lag + 1)]
    var = g[0] + 2 * sum((1 - k / (lag + 1)) * g[k] for k in range(1, lag + 1))
    return r.n, mean, var / r.n


def diebold_mariano(losses: DataFrame, cluster: str, loss_a: str, loss_b: str, lag: int) -> tuple[int, float, float, float]:
    """(clusters, mean difference, statistic with the small-sample correction, two-sided p) on cluster means."""
    d = losses.groupBy(cluster).agg(F.avg(F.col(loss_a) - F.col(loss_b)).alias("d")).filter("d is not null")
    n, mean, var = newey_west(d, cluster, "d", lag)
    if n < 2 or not var > 0:
        return n, mean, math.nan, math.nan
    k = lag + 1
    factor = (n + 1 - 2 * k + k * (k - 1) / n) / n
    stat = mean / math.sqrt(var) * math.sqrt(max(factor, 0.0))
    return n, mean, stat, 2 * t_sf(abs(stat), n - 1)


def block_bootstrap(
    cells: DataFrame, group: str, order: str, value: str, block: int, n_boot: int, seed: int = 0, ci: float = 0.8
) -> DataFrame:
    """Circular block bootstrap within groups: one row (mean, ci_low, ci_high, p_not_above_0, n_boot).

    Every replicate draws, per group of n cells, ceil(n / block) block starts by a hash of (seed, replicate, group,
    draw) and takes the first n cells. Replicates are spread over the cluster; each joins the
    cells of its group by position, an equi-join whose inner side is the (pre-averaged) cells.
    """
    spark = cells.sparkSession
    w = Window.partitionBy(group).orderBy(order)
    pos = cells.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.row_number().over(w).alias("i"), F.col(value).alias("v"))
    pos = pos.withColumn("i", F.col("i") - 1)
    sizes = pos.groupBy("g").agg(F.count("*").alias("n"))
    reps = spark.range(n_boot).withColumnRenamed("id", "rep")
    groups = one_row(sizes.agg(F.collect_list(F.struct("g", "n")).alias("groups")))["groups"]  # an entry per group
    draws = reps.select("rep", F.explode(groups).alias("s")).select("rep", "s.g", "s.n")
    draws = draws.select("rep", "g", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("k"))
    draws = draws.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "rep", "g", "k"), F.col("n")))
    draws = draws.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).filter(F.col("k") * block + F.col("o") < F.col("n"))
    draws = draws.withColumn("i", ((F.col("start") + F.col("o")) % F.col("n")).cast("int"))
    means = draws.join(pos, ["g", "i"]).groupBy("rep").agg(F.avg("v").alias("m"))
    lo, hi = (1 - ci) / 2, 1 - (1 - ci) / 2
    out = means.agg(
        F.percentile("m", F.lit(lo)).alias("ci_low"), F.percentile("m", F.lit(hi)).alias("ci_high"),
        F.avg((F.col("m") <= 0).cast("double")).alias("p_not_above_0"), F.count("*").alias("n_boot"),
    )
    return out.select(one_row(pos.agg(F.avg("v").alias("mean")))["mean"].alias("mean"), *out.columns)


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, standard error of the slope and n, over complete pairs."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    a = d.agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"),
        F.avg(F.col("x") - F.col("y")).alias("bias"),
    )
    rss = F.col("syy") - F.col("slope") * F.col("sxy")
    se = F.when(F.col("n") > 2, F.sqrt(F.greatest(F.lit(0.0), rss) / (F.col("n") - 2) / F.col("sxx")))
    return a.select("n", "slope", "intercept", se.alias("slope_se"), "bias")


def brier_parts(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Reliability − resolution + uncertainty over equal-width bins: one row."""
    b = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("__b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    g = b.groupBy("__b").agg(F.count("*").alias("n"), F.avg(p).alias("pm"), F.avg(y).alias("ym"))
    t = one_row(g.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("ym")) / F.sum("n")).alias("base")))
    j = g.withColumn("total", t["total"]).withColumn("base", t["base"])
    return j.groupBy("total", "base").agg(
        (F.sum(F.col("n") * F.pow(F.col("pm") - F.col("ym"), 2)) / F.col("total")).alias("reliability"),
        (F.sum(F.col("n") * F.pow(F.col("ym") - F.col("base"), 2)) / F.col("total")).alias("resolution"),
    ).select(F.col("total").alias("n"), "reliability", "resolution", (F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def reliability_table(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    b = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("mean_actual"))


def error_metrics(pred: Column, actual: Column, weight: Column | None = None) -> list[Column]:
    """MSE and MAE (weighted if asked); NULL for an empty input."""
    w = weight if weight is not None else F.lit(1.0)
    known = pred.isNotNull() & actual.isNotNull()
    ww = F.sum(F.when(known, w))
    return [(F.sum(w * F.pow(pred - actual, 2)) / ww).alias("mse"), (F.sum(w * F.abs(pred - actual)) / ww).alias("mae")]


def pav(x: Sequence[float], y: Sequence[float], w: Sequence[float]) -> list[tuple[float, float]]:
    """Weighted pool-adjacent-violators on points sorted by x: breakpoints (x, fitted)."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            tot = a[1] + b[1]
            a[0], a[1], a[3] = (a[0] * a[1] + b[0] * b[1]) / tot, tot, b[3]
    out: list[tuple[float, float]] = []
    for fit, _, lo, hi in blocks:
        out.append((lo, fit))
        if hi > lo:
            out.append((hi, fit))
    return out


def isotonic(df: DataFrame, pred: str, outcome: str, bins: int = 200, weight: str | None = None) -> list[tuple[float, float]]:
    """Breakpoints of an isotonic fit on at most ``bins`` equal-count bins of positive predictions.

    Bin edges are exact percentiles; the bins' means (at most ``bins`` rows) are pooled on the
    driver. Values are rounded to six digits. Empty input gives no breakpoints.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = df.filter((F.col(pred) > 0) & F.col(outcome).isNotNull()).select(F.col(pred).cast("double").alias("p"), F.col(outcome).cast("double").alias("y"), w.alias("w"))
    edges = d.agg(F.percentile("p", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("e")).first().e
    if not edges:
        return []
    cut = sorted(set(edges))
    b = d.withColumn("b", F.size(F.filter(F.array(*[F.lit(c) for c in cut]), lambda e: e < F.col("p"))))
    rows = b.groupBy("b").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("x"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("w")).orderBy("x").collect()
    return [(round(x, 6), round(y, 6)) for x, y in pav([r.x for r in rows], [r.y for r in rows], [r.w for r in rows])]


def platt(df: DataFrame, p: str, y: str, steps: int = 25) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on logit(p) by Newton steps; each step is one aggregation."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).select(F.log(q / (1 - q)).alias("x"), F.col(y).cast("double").alias("y")).persist()
    a, b = 1.0, 0.0
    for _ in range(steps):
        m = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        v = m * (1 - m)
        r = d.agg(F.sum((F.col("y") - m) * F.col("x")), F.sum(F.col("y") - m), F.sum(v * F.col("x") * F.col("x")), F.sum(v * F.col("x")), F.sum(v)).first()
        if r[0] is None:
            break
        h = np.array([[r[2] + 1e-9, r[3]], [r[3], r[4] + 1e-9]])
        da, db = np.linalg.solve(h, np.array([r[0], r[1]]))
        a, b = a + float(da), b + float(db)
        if abs(da) + abs(db) < 1e-10:
            break
    d.unpersist()
    return a, b


def linear_by_group(df: DataFrame, by: str, x1: str, x2: str, y: str, w: str | None = None) -> DataFrame:
    """Weighted least squares y ≈ a·x1 + b·x2 per group from sums of products and the closed 2×2 solution."""
    ww = F.col(w).cast("double") if w else F.lit(1.0)
    c = lambda n: F.col(n).cast("double")
    s = df.filter(F.col(x1).isNotNull() & F.col(x2).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(
        F.sum(ww * c(x1) * c(x1)).alias("a11"), F.sum(ww * c(x1) * c(x2)).alias("a12"), F.sum(ww * c(x2) * c(x2)).alias("a22"),
        F.sum(ww * c(x1) * c(y)).alias("b1"), F.sum(ww * c(x2) * c(y)).alias("b2"),
    )
    det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
    ok = F.abs(det) > 1e-12
    return s.select(by, F.when(ok, (F.col("b1") * F.col("a22") - F.col("b2") * F.col("a12")) / det).alias("coef1"), F.when(ok, (F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1")) / det).alias("coef2"))


def shift_to_sum(df: DataFrame, by: list[str], p: str, target: float, bound: float = 5.0) -> DataFrame:
    """One logit shift per group so that Σ p reaches the target (bisection, bounded shift): adds ``shifted``."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf[p].clip(1e-9, 1 - 1e-9).to_numpy(dtype=float)
        x = np.log(q / (1 - q))
        lo, hi = -bound, bound
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (1 / (1 + np.exp(-(x + mid)))).sum() < target else (lo, mid)
        return pdf.assign(shifted=1 / (1 + np.exp(-(x + (lo + hi) / 2))))

    schema = T.StructType([*df.schema.fields, T.StructField("shifted", T.DoubleType())])
    return df.groupBy(*by).applyInPandas(fit, schema)


def deflated_mean(mean: float, ci_low: float, ci_high: float, n_variants: int, z: float) -> float:
    """Mean minus its standard error times √(2 ln N): the haircut for the best of N tries."""
    se = (ci_high - ci_low) / (2 * z)
    return mean - se * math.sqrt(2 * math.log(max(1, n_variants)))


def t_critical(alpha: float, df: float) -> float:
    """The t with upper tail ``alpha``."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf(mid, df) > alpha else (lo, mid)
    return (lo + hi) / 2


def null_size(cells: DataFrame, group: str, order: str, value: str, block: int, alphas: list[float], n_rep: int, seed: int = 0) -> DataFrame:
    """Empirical size of the one-sided t-test on means of ``block``-cell windows when there is no effect.

    Values are centred; each replicate flips the signs of whole windows by a hash, so that the
    windows' dependence stays. Result: alpha, rejected (share of replicates), windows.
    """
    spark = cells.sparkSession
    w = Window.partitionBy(group).orderBy(order)
    x = cells.filter(F.col(value).isNotNull()).withColumn("__w", F.floor((F.row_number().over(w) - 1) / block))
    wm = x.groupBy(F.col(group).alias("g"), "__w").agg(F.avg(value).alias("m"))
    wm = wm.withColumn("m", F.col("m") - F.avg("m").over(Window.partitionBy()))  # one row per window
    n = wm.count()
    if n < 2:
        return spark.createDataFrame([], "alpha double, rejected double, windows long")
    windows = one_row(wm.agg(F.collect_list(F.struct("g", "__w", "m")).alias("ws")))["ws"]
    reps = spark.range(n_rep).select(F.col("id").alias("rep"), F.explode(windows).alias("s"))
    flip = F.when(F.pmod(F.xxhash64(F.lit(seed), "rep", "s.g", "s.__w"), F.lit(2)) == 0, 1).otherwise(-1)
    t = reps.groupBy("rep").agg((F.avg(F.col("s.m") * flip) / (F.stddev_samp(F.col("s.m") * flip) / math.sqrt(n))).alias("t"))
    parts = [F.struct(F.lit(a).alias("alpha"), F.avg((F.col("t") > t_critical(a, n - 1)).cast("double")).alias("rejected")) for a in alphas]
    return t.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.alpha", "p.rejected", F.lit(n).cast("long").alias("windows"))
