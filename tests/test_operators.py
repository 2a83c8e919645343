"""Relational operators, folds, functions and statistics against brute force."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import prob as P
from tidemark.functions import stats as St
from tidemark.functions import strings as S
from tidemark.functions import times as T
from tidemark.operators import folds
from tidemark.operators import relational as R


def test_checked_join_raises_on_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    b = spark.createDataFrame([(1, 2)], "k long, v long")
    assert R.checked_join(a, b, ["k"], "left", "m:1").count() == 3
    with pytest.raises(R.CardinalityError):
        R.checked_join(a, b, ["k"], "inner", "1:1")


def test_null_aware_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 10), ("a", None, 20), ("b", 2.0, 5), ("c", None, 1), ("d", float("nan"), 1)], "g string, x double, w long")
    got = {r.g: r for r in df.groupBy("g").agg(R.strict_sum("x").alias("s"), R.sum_min_count("x").alias("m"), R.rate_per("x", "w", 10.0).alias("r"), R.strict_product(F.col("x")).alias("p")).collect()}
    assert (got["a"].s, got["a"].m, got["a"].r, got["a"].p) == (None, 1.0, 1.0, None)
    assert (got["b"].s, got["b"].p, got["c"].m, got["c"].r, got["d"].p) == (2.0, 2.0, None, None, None)


def test_bands_islands_runs_and_blocks(spark, rows):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 0, 3, 0, None, 5, 5])], "g long, i long, v long")
    assert [r[1] for r in rows(R.islands(df, ["g"], ["i"], "v"), "i", "island")] == [1, 1, 2, 3, 4, 5, 5]
    assert [r[1] for r in rows(R.absence_runs(df, ["g"], ["i"], F.col("v") == 0, "run"), "i", "run")] == [0, 1, 2, 0, 1, 0, 0]
    x = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.9, 1.0, 3.0, 9.0, None)], "v double")
    assert [r[1] for r in rows(x.withColumn("b", R.band(F.col("v"), [0.0, 1.0, 2.0, 3.0])), "v", "b")] == [0, 0, 0, 1, 2, 2, None]
    blocks = spark.createDataFrame([("p", 1, 10), ("p", 2, 20), ("p", 2, 21), ("p", 3, 30)], "g string, b long, v long")
    assert rows(R.block_frame(blocks, ["g"], "b", "v", 3), "b", "n", "total") == [(1, 0, None), (2, 1, 10.0), (3, 3, 51.0)]
    assert R.islands(df.filter("false"), ["g"], ["i"], "v").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.one_of(st.none(), st.integers(0, 4)), st.integers(0, 4)), max_size=14))
def test_skyline_equals_brute_force(spark, rows, data):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "k long, g long, lo long, hi long")
    ok = lambda d: None not in d
    dom = lambda x, y: ok(x) and ok(y) and x[0] == y[0] and x[1] <= y[1] and x[2] >= y[2] and (x[1] < y[1] or x[2] > y[2])
    want = [(i,) for i, y in enumerate(data) if not any(dom(x, y) for x in data)]
    assert rows(R.skyline(df, ["g"], "k", ["lo"], ["hi"]), "k") == want


def test_compare_tables_and_grid(spark, rows):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), None), (3, 1.0, "z")], "k long, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "y"), (2, float("nan"), None), (4, 1.0, "z")], "k long, v double, s string")
    assert rows(R.compare_tables(a, b, ["k"])) == [(1, "s", "value"), (3, "*", "only_a"), (4, "*", "only_b")]
    g = R.dense_grid(a.select("k"), spark.createDataFrame([(7,), (8,)], "h long"), spark.createDataFrame([(1, 7, 5)], "k long, h long, n long"), ["k", "h"], {"n": 0})
    assert rows(g, "k", "h", "n") == [(1, 7, 5), (1, 8, 0), (2, 7, 0), (2, 8, 0), (3, 7, 0), (3, 8, 0)]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(0, 3)), max_size=14))
def test_greedy_match_equals_sequential_pass(spark, rows, data):
    best = {}
    for a, b, s in data:
        best[a, b] = max(s, best.get((a, b), -1))
    want, ua, ub = [], set(), set()
    for (a, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a not in ua and b not in ub:
            want.append((a, b))
            ua.add(a)
            ub.add(b)
    got = folds.greedy_match(spark.createDataFrame(data, "a long, b long, s long"), "a", "b", ["s"])
    assert rows(got, "a", "b") == sorted(want)


def test_overrides_and_acceptance(spark, rows):
    m = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a long, b long")
    o = spark.createDataFrame([(1, None), (2, 30)], "a long, b long")
    assert rows(folds.apply_overrides(m, o, "a", "b")) == [(2, 30, "override")]
    p = spark.createDataFrame([(1, 0.9, 3, 60.0), (2, 0.6, 1, 90.0), (3, 0.1, 1, 96.0), (4, 0.9, 5, 40.0), (5, 0.1, 0, 99.0)], "k long, overlap double, shared long, name_score double")
    assert rows(folds.accept(p, [{"overlap": 0.8, "shared": 3}, {"overlap": 0.5, "name_score": 85}, {"shared": 1, "name_score": 95}], {"name_score": 50}), "k") == [(1,), (2,), (3,)]


def test_elo_fold_equals_plain_loop(spark, rows):
    rnd = random.Random(6)
    games = [("L", 2020 + i // 30, i, i * 10, *rnd.sample(range(1 + i // 30, 7 + i // 30), 2), rnd.randint(0, 6), rnd.randint(0, 3)) for i in range(60)]
    df = spark.createDataFrame([*games, ("L", 2020, 99, None, 1, 2, 1, 1)], "league string, season long, fixture_key long, kickoff_us long, home long, away long, home_goals long, away_goals long")
    now, active, want = {}, set(), []
    for season in (2020, 2021):
        clubs = {c for x in games if x[1] == season for c in x[4:6]}
        gone = [now[c] for c in active - clubs]
        now |= {c: sum(gone) / len(gone) if gone else 1500.0 for c in clubs - active}
        active = clubs
        for g in (x for x in games if x[1] == season):
            h, a, d = now[g[4]], now[g[5]], g[6] - g[7]
            by = 1 if abs(d) <= 1 else 1.5 if abs(d) == 2 else (11 + abs(d)) / 8
            move = 20 * by * ((d > 0) + 0.5 * (d == 0) - 1 / (1 + 10 ** (-(h + 60 - a) / 400)))
            want.append((g[2], round(h, 6), round(move, 6)))
            now[g[4]], now[g[5]] = h + move, a - move
    got = folds.elo(df).select("fixture_key", F.round("home_before", 6), F.round("move", 6))
    assert rows(got) == sorted(want)
    assert sum(now[c] for c in active) == pytest.approx(1500 * len(active), abs=1e-6)


# ---------------------------------------------------------------- functions


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_probability_functions(spark):
    r = one(spark, P.devig_power(F.array(F.lit(2.0), F.lit(3.5), F.lit(4.0))), P.devig_shin(F.array(F.lit(2.0), F.lit(3.5), F.lit(4.0))), P.devig_power(F.array(F.lit(1.0), F.lit(2.0))), P.devig_shin(F.array(F.lit(2.5), F.lit(2.5))))
    assert sum(r.c0) == pytest.approx(1) and sum(r.c1) == pytest.approx(1, abs=1e-6) and r.c2 is None and r.c3 == [0.5, 0.5]
    assert r.c0[0] > r.c0[1] > r.c0[2] and r.c1[0] > 1 / 2.0 / (1 / 2 + 1 / 3.5 + 1 / 4) - 1e-9
    m = one(spark, P.dixon_coles(F.lit(1.4), F.lit(1.1)))
    grid = np.array(m.c0).reshape(11, 11)
    assert grid.sum() == pytest.approx(1) and grid[0, 0] / grid[0, 1] == pytest.approx((1 + 0.03 * 1.54) / (1.1 * (1 - 0.03 * 1.4)), rel=1e-9)
    q = [0.2, 0.5, 0.9]
    tail = sum(math.prod(p if x else 1 - p for p, x in zip(q, w, strict=True)) for w in itertools.product([0, 1], repeat=3) if sum(w) >= 2)
    assert one(spark, P.poisson_binomial_tail(F.array(*map(F.lit, q)), 2)).c0 == pytest.approx(tail)
    assert one(spark, P.interpolate(F.lit(0.3), F.array(F.lit(0.1), F.lit(0.5)), F.array(F.lit(1.0), F.lit(2.0)))).c0 == pytest.approx(1.5)
    assert one(spark, P.p_at_least_one(F.lit(0.5), F.lit(0.0)), P.p_at_least_one(F.lit(0.5), F.lit(0.5))).c1 == pytest.approx(0.5 * (1 - math.exp(-1)))
    h = P.handicap_shares(-0.25)
    assert {(w, x) for i, w, x in h if i == 0} == {(0.0, 0.5)}
    with pytest.raises(ValueError):
        P.handicap_shares(0.3)


def test_strings(spark):
    df = spark.createDataFrame([("José &amp; Ñandú-Łopez", "ana maria", "maria ana b"), (None, None, "x"), ("", "", "x")], "a string, b string, c string")
    got = df.select(S.normalise_name(F.col("a")).alias("n"), S.token_set_ratio("b", "c").alias("r"), S.html_unescape("a").alias("h")).collect()
    assert [r.n for r in got] == ["jose nandu lopez", None, ""]
    assert got[0].r == 100.0 and got[2].r == 0.0 and got[0].h.startswith("José & ")
    assert S.token_set_similarity(None, "a") is None
    assert S.parse_specs("template@1,random:5@2") == [("template", 1, 1), ("random", 5, 2)]
    assert S.parse_options("greedy:v1:k=2,m=x") == ("greedy", ["v1"], {"k": "2", "m": "x"})
    assert "".join(S.split_message("ab\ncd\nef", 3)) == "abcdef" and all(len(p) <= 3 for p in S.split_message("abcdefgh", 3))
    with pytest.raises(ValueError):
        S.parse_specs("a b")


def test_times(spark):
    def t(s):
        return F.lit(s).cast("timestamp")

    r = one(spark, T.lockdown_time(t("2022-10-29 19:00:00")), T.lockdown_time(t("2022-10-30 23:30:00")), T.season_start_year(t("2022-06-30 00:00:00")), T.collection_time(t("2022-08-10 19:00:00")), T.collection_time(t("2022-08-12 14:30:00")))
    hour = [x.astimezone(dt.UTC) if x.tzinfo else x for x in (r.c0, r.c1, r.c3, r.c4)]
    assert [h.strftime("%d %H:%M") for h in hour] == ["30 09:00", "31 09:00", "09 14:00", "12 13:30"]
    assert r.c2 == 2021
    d = one(spark, T.rolled_date(F.lit("Knock - Expected back 03 Jan"), t("2022-12-20 00:00:00"), T.RETURN_DATE), T.rolled_date(F.lit("fit"), t("2022-12-20 00:00:00"), T.RETURN_DATE))
    assert d.c0 == dt.date(2023, 1, 3) and d.c1 is None


def test_statistics(spark):
    assert St.t_sf(0, 5) == pytest.approx(0.5) and St.t_sf(2.015048, 5) == pytest.approx(0.05, abs=1e-6) and St.t_sf(-1, 3) > 0.5
    pts = St.pav([1, 2, 3, 4], [1, 3, 2, 5], [1, 1, 1, 1])
    assert [y for _, y in pts] == [1, 2.5, 2.5, 5]
    rnd = random.Random(7)
    cells = spark.createDataFrame([(g, i, rnd.gauss(1, 1)) for g in (1, 2) for i in range(20)], "g long, i long, v double")
    b = St.block_bootstrap(cells, "g", "i", "v", 4, 400, seed=3).first()
    assert b.ci_low < b.mean < b.ci_high and b.n_boot == 400 and 0 <= b.p_not_above_0 < 0.05
    again = St.block_bootstrap(cells.repartition(3), "g", "i", "v", 4, 400, seed=3).first()
    assert again.ci_low == pytest.approx(b.ci_low)
    x = np.array([r.v for r in cells.orderBy("g", "i").collect()])
    d = x - x.mean()
    g = [float((d[k:] * d[: len(d) - k]).mean() * (len(d) - k) / len(d)) for k in range(3)]
    series = cells.withColumn("o", F.col("g") * 100 + F.col("i"))
    n, mean, var = St.newey_west(series, "o", "v", 2)
    assert (n, mean) == (40, pytest.approx(x.mean())) and var == pytest.approx((g[0] + 2 * (2 / 3 * g[1] + 1 / 3 * g[2])) / 40)
    assert St.t_test(cells.filter("false"), "v")[0] == 0
    assert St.deflated_mean(1.0, 0.5, 1.5, 1, 1.28) == 1.0 and St.deflated_mean(1.0, 0.5, 1.5, 10, 1.28) < 1
    p = spark.createDataFrame([(i % 10 / 10 + 0.05, float(rnd.random() < (i % 10 / 10 + 0.05))) for i in range(2000)], "p double, y double")
    a, c = St.platt(p, "p", "y")
    assert a == pytest.approx(1, abs=0.25) and c == pytest.approx(0, abs=0.2)
    iso = St.isotonic(p, "p", "y", 10)
    assert all(u[1] <= v[1] for u, v in itertools.pairwise(iso)) and St.isotonic(p.filter("false"), "p", "y") == []


def test_market_rates_recover_known_rates(spark):
    from tidemark.functions.market import implied, market_rates, solve

    lh, la = np.array([0.6, 1.4, 2.8]), np.array([1.9, 1.1, 0.5])
    x, r = solve(implied(lh, la))
    assert np.exp(x) == pytest.approx(np.stack([lh, la], axis=1), rel=1e-3) and r.max() < 1e-5
    df = spark.createDataFrame([(0.5, 0.25, 0.25, None), (None, 0.3, 0.3, 0.5)], "h double, d double, a double, o double")
    got = [row.r for row in df.select(market_rates("h", "d", "a", "o").alias("r")).collect()]
    assert got[0].home > got[0].away > 0 and (got[1].home is None or math.isnan(got[1].home))


def test_resolver_rollup_contribution_and_takers(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, h long")
    m = spark.createDataFrame([("a", 10), ("b", 20)], "k string, id long")
    assert rows(R.resolve(df, m, ["k"], "id"), "h", "id") == [(1, 10), (2, 20), (3, None)]
    with pytest.raises(LookupError):
        R.resolve(df, m.filter("k = 'a'"), ["k"], "id")
    with pytest.raises(R.CardinalityError):
        R.resolve(df, m.unionByName(m), ["k"], "id")
    assert rows(R.pooled_rollup(df, "h", {"2+": F.col("h") >= 2}, [F.count("*").alias("n")])) == [("1", 1), ("2", 1), ("2+", 2), ("3", 1)]
    c = rows(R.contribution(spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", -1.0), ("y", None)], "g string, d double"), ["g"], "d"))
    assert c == [("x", 2, 2.0, pytest.approx(4 / 3)), ("y", 1, -1.0, pytest.approx(-1 / 3))]
    t = spark.createDataFrame([("g", 1, 0.5, 1.0), ("g", 2, 0.4, 0.5), ("g", 3, None, 1.0)], "g string, r long, q double, on double")
    assert [r[1] for r in rows(R.ranked_takers(t, ["g"], "r", "q", "on"), "r", "p")] == [0.5, pytest.approx(0.1), 0.0]


def test_hash_noise_is_reproducible_and_normal(spark):
    from tidemark.functions.random import hash_normal, hash_uniform

    df = spark.range(20_000).select("id", hash_normal(3, "id").alias("z"), hash_uniform(3, "id").alias("u"))
    s = df.agg(F.avg("z"), F.stddev("z"), F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(s[0]) < 0.03 and abs(s[1] - 1) < 0.03 and abs(s[2] - 0.5) < 0.01 and 0 < s[3] and s[4] < 1
    assert df.orderBy("id").limit(5).collect() == df.repartition(7).orderBy("id").limit(5).collect()


def test_null_size_is_near_its_level(spark):
    rnd = random.Random(8)
    cells = spark.createDataFrame([(g, i, rnd.gauss(0, 1)) for g in range(5) for i in range(24)], "g long, i long, v double")
    got = {r.alpha: r.rejected for r in St.null_size(cells, "g", "i", "v", 4, [0.05, 0.2], 600, 1).collect()}
    assert 0.01 < got[0.05] < 0.12 and 0.1 < got[0.2] < 0.3
    assert St.t_sf(St.t_critical(0.05, 7), 7) == pytest.approx(0.05, abs=1e-9)
