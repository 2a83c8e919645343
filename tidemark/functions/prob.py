"""Probability and scoring functions as JVM expressions (higher-order functions where a loop is needed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elo_expected(home: Column, away: Column, advantage: float = 60.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(home + F.lit(advantage) - away) / 400))


def goal_multiplier(diff: Column) -> Column:
    d = F.abs(diff)
    return F.when(d <= 1, 1.0).when(d == 2, 1.5).otherwise((d + 11) / 8)


def overround_shares(prices: list[Column]) -> list[Column]:
    """(1 / price) / Σ (1 / price); NULL if a price is NULL or not above 0."""
    ok = F.lit(True)
    for p in prices:
        ok = ok & F.coalesce(p > 0, F.lit(False))
    total = sum((1 / p for p in prices[1:]), 1 / prices[0])
    return [F.when(ok, (1 / p) / total) for p in prices]


def _bisect(lo: Column, hi: Column, above, steps: int) -> Column:
    """Midpoint after ``steps`` halvings towards the point where ``above(mid)`` turns false."""
    start = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = above(mid)
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)


def _array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def devig_power(prices: Column, steps: int = 60) -> Column:
    """Probabilities (1 / price)^k with k from bisection so that they sum to 1, renormalised: the largest of n powers is at least
    1 / n of the sum, so k is at most ln n / ln(lowest price). NULL unless all prices of the array are above 1."""
    p = F.transform(prices, lambda o: 1.0 / o)
    valid = (F.size(prices) > 1) & F.forall(prices, lambda o: F.coalesce(o > 1, F.lit(False)))
    highest = F.log(F.size(prices).cast("double")) / F.log(F.array_min(prices)) + 1e-9
    k = _bisect(F.lit(0.0), highest, lambda mid: _array_sum(F.transform(p, lambda x: F.pow(x, mid))) > 1, steps)
    q = F.get(F.transform(F.array(k), lambda kk: F.transform(p, lambda x: F.pow(x, kk))), F.lit(0))
    return F.when(valid, F.get(F.transform(F.array(q), lambda qq: F.transform(qq, lambda x: x / _array_sum(qq))), F.lit(0)))


def devig_shin(prices: Column, steps: int = 60) -> Column:
    """Shin's insider share z from bisection on [0, 1) so that the probabilities sum to 1; without a margin
    the prices are taken in proportion. NULL unless all prices are above 1."""
    p = F.transform(prices, lambda o: 1.0 / o)
    total = _array_sum(p)
    valid = (F.size(prices) > 1) & F.forall(prices, lambda o: F.coalesce(o > 1, F.lit(False)))

    def probs(z: Column, b: Column) -> Column:
        return F.transform(p, lambda x: (F.sqrt(z * z + 4 * (1 - z) * x * x / b) - z) / (2 * (1 - z)))

    z = _bisect(F.lit(0.0), F.lit(0.999999), lambda mid: _array_sum(probs(mid, total)) > 1, steps)
    shin = F.get(F.transform(F.array(F.struct(z.alias("z"), total.alias("b"))), lambda s: probs(s["z"], s["b"])), F.lit(0))
    plain = F.transform(p, lambda x: x / total)
    return F.when(valid, F.when(total <= 1, plain).otherwise(shin))


def poisson_pmf(rate: Column, cap: int) -> Column:
    """Array p(0..cap) by the recursion p(n) = p(n - 1) · rate / n."""
    start = F.array(F.exp(-rate))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(cap)), start, lambda a, n: F.concat(a, F.array(F.element_at(a, -1) * rate / n))
    )


def poisson_expected_floor(rate: Column, k: int, cap: int = 40) -> Column:
    """E[floor(N / k)] for N ~ Poisson(rate), summed up to ``cap``."""
    pmf = poisson_pmf(rate, cap)
    return _array_sum(F.transform(pmf, lambda p, n: p * F.floor(n / F.lit(k))))


def negbin_tail(mean: Column, r: float, k: int) -> Column:
    """P(X ≥ k) of a negative binomial with the given mean and size r, by the recursion of its terms."""
    q = F.lit(r) / (F.lit(r) + mean)
    if k <= 0:
        return F.when(mean.isNotNull(), F.lit(1.0))
    start = F.struct(F.pow(q, F.lit(r)).alias("p"), F.pow(q, F.lit(r)).alias("s"))

    def step(s: Column, n: Column) -> Column:
        p = s["p"] * (F.lit(r) + n - 1) / n * (1 - q)
        return F.struct(p.alias("p"), (s["s"] + p).alias("s"))

    below = F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), start, step, lambda s: s["s"]) if k > 1 else F.pow(q, F.lit(r))
    return F.greatest(F.lit(0.0), 1 - below)


def poisson_log_likelihood(rate: Column, count: Column) -> Column:
    """k · log λ − λ − log k!"""
    log_fact = F.when(count <= 1, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(2), F.greatest(count.cast("int"), F.lit(2))), F.lit(0.0), lambda s, n: s + F.log(n.cast("double")))
    )
    return count * F.log(rate) - rate - log_fact


def poisson_binomial_tail(q: Column, k: int) -> Column:
    """P(at least k successes) of independent trials with the probabilities in array ``q`` (terms 0..k-1 by DP)."""
    zero = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    dist = F.aggregate(
        q, zero, lambda a, p: F.transform(a, lambda x, i: x * (1 - p) + F.when(i > 0, F.get(a, i - 1)).otherwise(0.0) * p)
    )
    return 1 - _array_sum(dist)


def dixon_coles(home: Column, away: Column, rho: float = -0.03, cap: int = 10) -> Column:
    """Score probabilities as an array of (cap+1)² values (home goals major): truncated Poissons, corrected in the four
    low scores, clipped at 0 and renormalised."""
    h, a = poisson_pmf(home, cap), poisson_pmf(away, cap)
    n = cap + 1

    def cell(i: Column, hp: Column, ap: Column, lh: Column, la: Column) -> Column:
        x, y = F.floor(i / F.lit(n)).cast("int"), (i % n).cast("int")
        tau = (
            F.when((x == 0) & (y == 0), 1 - lh * la * rho)
            .when((x == 0) & (y == 1), 1 + lh * rho)
            .when((x == 1) & (y == 0), 1 + la * rho)
            .when((x == 1) & (y == 1), F.lit(1 - rho))
            .otherwise(F.lit(1.0))
        )
        return F.greatest(F.lit(0.0), F.get(hp, x) * F.get(ap, y) * tau)

    bound = F.array(F.struct(h.alias("h"), a.alias("a"), home.cast("double").alias("lh"), away.cast("double").alias("la")))
    raw = F.get(
        F.transform(bound, lambda s: F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: cell(i, s["h"], s["a"], s["lh"], s["la"]))),
        F.lit(0),
    )
    return F.get(F.transform(F.array(raw), lambda m: F.transform(m, lambda x: x / _array_sum(m))), F.lit(0))


def outcome_probabilities(matrix: Column, cap: int = 10) -> list[Column]:
    """Home win, draw, away win of a score matrix as made by ``dixon_coles``."""
    n = cap + 1
    part = lambda keep: _array_sum(F.transform(matrix, lambda p, i: F.when(keep(F.floor(i / F.lit(n)), i % n), p).otherwise(0.0)))
    return [part(lambda x, y: x > y), part(lambda x, y: x == y), part(lambda x, y: x < y)]


def p_at_least_one(expected: Column, p_play: Column) -> Column:
    """p · (1 − exp(−e / p)); 0 if p is 0."""
    return F.when(p_play > 0, p_play * (1 - F.exp(-expected / p_play))).when(p_play == 0, 0.0)


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear through the points (sorted xs), flat beyond the ends."""
    n = F.size(xs)
    i = F.size(F.filter(xs, lambda v: v <= x))  # points at or left of x

    def at(k: Column) -> Column:
        x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
        return y0 + (x - x0) * (y1 - y0) / (x1 - x0)

    return F.when(n == 0, None).when(i == 0, F.get(ys, F.lit(0))).when(i == n, F.get(ys, n - 1)).otherwise(at(i))


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def ordinal_log_loss(probs: Column, cls: Column, eps: float = 1e-12) -> Column:
    return -F.log(F.greatest(F.get(probs, cls.cast("int")), F.lit(eps)))


def ranked_probability_score(probs: Column, cls: Column) -> Column:
    """Σ of squared differences of the cumulative distributions over the first classes, divided by their number."""
    n = F.size(probs)
    cum = F.transform(probs, lambda p, i: _array_sum(F.slice(probs, F.lit(1), i + 1)))
    sq = F.transform(F.slice(cum, F.lit(1), n - 1), lambda c, i: F.pow(c - F.when(i >= cls, 1.0).otherwise(0.0), 2))
    return _array_sum(sq) / (n - 1)


def wilson(successes: Column, n: Column, z: float = 1.6448536269514722) -> tuple[Column, Column]:
    """Wilson interval (90% by default); NULL without trials."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def handicap_shares(line: float, cap: int = 10) -> list[tuple[int, float, float]]:
    """(index of the score, share of the stake won, share lost) of a home bet at a whole, half or quarter
    line; a quarter line is two half stakes at ±0.25 (fixed table for a given line)."""
    if round(line * 4) != line * 4:
        raise ValueError("lines are multiples of 0.25")
    lines = [line] if round(line * 2) == line * 2 else [line - 0.25, line + 0.25]
    out = []
    for h in range(cap + 1):
        for a in range(cap + 1):
            won = sum((h + x - a) > 0 for x in lines) / len(lines)
            lost = sum((h + x - a) < 0 for x in lines) / len(lines)
            out.append((h * (cap + 1) + a, won, lost))
    return out


def handicap_probability(matrix: Column, line: float, cap: int = 10) -> Column:
    """W / (W + L): the home side's probability at the line, pushes left out."""
    shares = handicap_shares(line, cap)
    won = F.array(*[F.lit(float(w)) for _, w, _ in shares])
    lost = F.array(*[F.lit(float(x)) for _, _, x in shares])
    w = _array_sum(F.zip_with(matrix, won, lambda p, s: p * s))
    x = _array_sum(F.zip_with(matrix, lost, lambda p, s: p * s))
    return w / (w + x)
