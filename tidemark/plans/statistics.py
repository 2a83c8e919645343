"""Paired statistics, forecast evaluation, fits, folds and matching."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.engine.session import micros, table
from tidemark.functions import stats as St
from tidemark.functions import strings as S
from tidemark.operators import folds
from tidemark.plans.registry import collector

QUERIES, query = collector()


def _scored(spark, d):
    """Forecasts made from line items: p in (0, 1) from the quantity, the outcome from the return flag."""
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_suppkey", ((F.col("l_quantity") + 0.5) / 51.0).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("y"), F.month("l_shipdate").cast("long").alias("m"), F.year("l_shipdate").cast("long").alias("yr"))


_SC = "with s as (select l_orderkey, l_suppkey, (l_quantity + 0.5) / 51.0 p, (l_returnflag = 'R')::int::double y, month(l_shipdate)::bigint m, year(l_shipdate)::bigint yr from lineitem)"


@query(_SC + " select yr, round(avg(pow(p - y, 2)), 8) as mse, round(avg(abs(p - y)), 8) as mae, count(*) as n from s group by yr")
def error_metrics(spark, d):
    return _scored(spark, d).groupBy("yr").agg(*[F.round(c, 8).alias(n) for c, n in zip(St.error_metrics(F.col("p"), F.col("y")), ("mse", "mae"), strict=True)], F.count("*").alias("n"))


@query(_SC + """, b as (select least(floor(p * 10), 9) b, count(*) n, avg(p) pm, avg(y) ym from s group by b), t as (select sum(n) tn, sum(n * ym) / sum(n) base from b)
select tn::bigint as n, round(sum(n * pow(pm - ym, 2)) / tn, 8) as reliability, round(sum(n * pow(ym - base, 2)) / tn, 8) as resolution, round(base * (1 - base), 8) as uncertainty from b, t group by tn, base""")
def brier_decomposition(spark, d):
    b = St.brier_parts(_scored(spark, d), "p", "y")
    return b.select("n", *[F.round(c, 8).alias(c) for c in ("reliability", "resolution", "uncertainty")])


@query(_SC + " select least(floor(p * 10), 9)::bigint as bin, count(*) as n, round(avg(p), 8) as mean_pred, round(avg(y), 8) as mean_actual from s group by 1")
def reliability_table(spark, d):
    t = St.reliability_table(_scored(spark, d), "p", "y")
    return t.select(F.col("bin").cast("long"), "n", F.round("mean_pred", 8).alias("mean_pred"), F.round("mean_actual", 8).alias("mean_actual"))


@query(_SC + " select count(*) as n, round(regr_slope(y, p), 6) as slope, round(regr_intercept(y, p), 6) as intercept, round(sqrt((regr_syy(y, p) - regr_slope(y, p) * regr_sxy(y, p)) / (count(*) - 2) / regr_sxx(y, p)), 6) as slope_se, round(avg(p - y), 6) as bias from s")
def forecast_slope(spark, d):
    o = St.ols(_scored(spark, d), "p", "y")
    return o.select("n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "slope_se", "bias")])


@query("""with a as (select o_custkey, year(o_orderdate)::bigint yr, sum(o_totalprice) v from orders where o_orderkey % 2 = 0 group by all), b as (select o_custkey, year(o_orderdate)::bigint yr, sum(o_totalprice) v from orders where o_orderkey % 2 = 1 group by all)
select yr, count(*) as n, round(avg(a.v - b.v), 4) as mean from a join b using (o_custkey, yr) group by yr""")
def paired_cell_means(spark, d):
    """Two variants paired 1:1 on (customer, year), then means per cell."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("yr"), "o_totalprice")
    half = lambda r: o.filter(F.col("o_orderkey") % 2 == r).groupBy("o_custkey", "yr").agg(F.sum("o_totalprice").alias("v"))
    c = St.cell_means(St.paired_differences(half(0), half(1), ["o_custkey", "yr"], "v"), ["yr"], "diff")
    return c.select("yr", "n", F.round("mean", 4).alias("mean"))


def _monthly(spark, d):
    s = _scored(spark, d)
    return s.groupBy("yr", "m").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2) - F.pow(0.5 - F.col("y"), 2)).alias("diff")).withColumn("i", F.col("yr") * 12 + F.col("m"))


_MO = _SC + ", c as (select yr * 12 + m i, avg(pow(p - y, 2) - pow(0.5 - y, 2)) diff from s group by yr, m)"


@query(_MO + " select count(*) as n, round(avg(diff), 8) as mean, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 6) as t from c")
def t_test(spark, d):
    n, m, t, _ = St.t_test(_monthly(spark, d), "diff")
    return spark.createDataFrame([(n, round(m, 8), round(t, 6))], "n long, mean double, t double")


@query(_MO + """, x as (select i, diff - (select avg(diff) from c) e, row_number() over (order by i) r from c), g as (select k, sum(a.e * b.e) / (select count(*) from x) g from range(0, 4) t(k), x a join x b on b.r = a.r - k group by k)
select (select count(*) from x) as n, round((select avg(diff) from c), 8) as mean, round((select sum(case when k = 0 then g else 2 * (1 - k / 4.0) * g end) from g) / (select count(*) from x) * 1e6, 6) as variance_e6""".replace("x a join x b on b.r = a.r - k group by k", "x a, x b where b.r = a.r - k group by k"))
def newey_west_variance(spark, d):
    n, m, v = St.newey_west(_monthly(spark, d), "i", "diff", 3)
    return spark.createDataFrame([(n, round(m, 8), round(v * 1e6, 6))], "n long, mean double, variance_e6 double")


@query()
def diebold_mariano(spark, d):
    """Forecast p against a constant half, clustered by month."""
    s = _scored(spark, d).withColumn("i", F.col("yr") * 12 + F.col("m"))
    s = s.withColumn("la", F.pow(F.col("p") - F.col("y"), 2)).withColumn("lb", F.pow(0.5 - F.col("y"), 2))
    n, m, stat, p = St.diebold_mariano(s, "i", "la", "lb", 3)
    return spark.createDataFrame([(n, round(m, 8), round(stat, 6), round(p, 8))], "n long, mean double, statistic double, p double")


@query()
def block_bootstrap(spark, d):
    """Circular blocks of three months within each year, 2000 replicates by a hash of the seed."""
    b = St.block_bootstrap(_monthly(spark, d), "yr", "i", "diff", 3, 2000, seed=11)
    return b.select(*[F.round(c, 8).alias(c) for c in ("mean", "ci_low", "ci_high", "p_not_above_0")], "n_boot")


@query()
def isotonic_fit(spark, d):
    pts = St.isotonic(_scored(spark, d), "p", "y", 50)
    return spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double")


@query()
def platt_fit(spark, d):
    a, b = St.platt(_scored(spark, d), "p", "y")
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "slope double, intercept double")


@query(_SC + """, a as (select yr, sum(p * p) a11, sum(p) a12, count(*) a22, sum(p * y) b1, sum(y) b2 from s group by yr)
select yr, round((b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12), 6) as coef1, round((a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12), 6) as coef2 from a""")
def linear_by_group(spark, d):
    s = _scored(spark, d).withColumn("one", F.lit(1.0))
    c = St.linear_by_group(s, "yr", "p", "one", "y")
    return c.select("yr", F.round("coef1", 6).alias("coef1"), F.round("coef2", 6).alias("coef2"))


@query()
def logit_shift_to_sum(spark, d):
    """Start probabilities per fixture and side shifted so that they sum to eleven."""
    from tidemark.plans.relational import current_matches

    m = current_matches(spark, d).select("fixture_key", "team_key", "player_key", F.least(F.lit(0.98), F.greatest(F.lit(0.02), F.col("minutes") / 95.0)).alias("p"))
    s = St.shift_to_sum(m, ["fixture_key", "team_key"], "p", 11.0)
    return s.select("fixture_key", "team_key", "player_key", F.round("shifted", 6).alias("p"))


# ---------------------------------------------------------------- folds and matching


@query()
def elo_ratings(spark, d):
    f = table(spark, d, "fixture").filter("finished and home_goals is not null and away_goals is not null and kickoff_time is not null")
    f = f.groupBy("fixture_key").agg(F.max_by(F.struct("season", "kickoff_time", "home_team_key", "away_team_key", "home_goals", "away_goals"), "available_at").alias("f"))
    m = f.select(F.lit("league").alias("league"), "f.season", "fixture_key", micros("f.kickoff_time").alias("kickoff_us"), F.col("f.home_team_key").alias("home"), F.col("f.away_team_key").alias("away"), "f.home_goals", "f.away_goals")
    r = folds.elo(m)
    return r.select("season", "fixture_key", "home", "away", *[F.round(c, 6).alias(c) for c in ("home_before", "away_before", "move", "expected")])


@query("""with cur as (select * from player_match qualify row_number() over (partition by player_key, fixture_key order by available_at desc) = 1),
r as (select player_key, season, fixture_key, gw, yellow_cards, sum(yellow_cards) over w t from cur window w as (partition by player_key, season order by kickoff_time, fixture_key rows unbounded preceding)),
h as (select r.*, u.t0, u.p from r, (values (5, 1), (10, 2), (15, 3)) u(t0, p) where t - yellow_cards < t0 and t >= t0)
select player_key, season, fixture_key, t0::bigint as threshold, p::bigint as penalty from h where (t0 = 5 and gw <= 19) or (t0 = 10 and gw <= 32) or t0 = 15""")
def threshold_crossings(spark, d):
    """Matches at which a season's running total of cards first reaches a threshold in time."""
    from tidemark.plans.relational import current_matches

    m = current_matches(spark, d).select("player_key", "season", "fixture_key", "gw", "kickoff_time", "yellow_cards")
    c = folds.crossings(m, ["player_key", "season"], ["kickoff_time", "fixture_key"], "yellow_cards", [(5, 1, F.col("gw") <= 19), (10, 2, F.col("gw") <= 32), (15, 3, None)])
    return c.select("player_key", "season", "fixture_key", F.col("threshold").cast("long"), F.col("penalty").cast("long"))


# When two names of a club are taken for the same one (share of common fixtures, their number, name score), and
# the least name score of all.
MATCH_RULES = [{"overlap": 0.8, "shared": 3, "name_score": 0}, {"overlap": 0.5, "name_score": 85}, {"shared": 1, "name_score": 95}]
MATCH_FLOOR = {"name_score": 50}


@query()
def entity_match(spark, d):
    """Clubs under two sources' names: pairs with fixtures on the same days, scored over all name variants, accepted by rules,
    chosen one to one, and overridden where a club's own identifier says so."""
    t = table(spark, d, "team_dim")
    f = table(spark, d, "fixture").filter("finished and kickoff_time is not null")
    days = f.select(F.explode(F.array("home_team_key", "away_team_key")).alias("team"), F.to_date("kickoff_time").alias("day")).distinct()
    played = days.groupBy("team").agg(F.count("*").alias("days"))
    names = lambda *cs: F.array_compact(F.array(*[S.normalise_name(F.col(c)) for c in cs]))
    a = t.select("team_key", F.explode(names("football_data_name", "fpl_names")).alias("an")).distinct()
    b = t.filter("odds_api_name is not null").select(F.col("team_key").alias("other_key"), F.explode(names("odds_api_name", "understat_name")).alias("bn")).distinct()
    token = lambda x, c: x.select("*", F.explode(F.array_distinct(F.split(c, " "))).alias("tok"))
    pairs = token(a, "an").join(token(b, "bn"), "tok").select("team_key", "other_key", "an", "bn").distinct()
    pairs = pairs.groupBy("team_key", "other_key").agg(F.max(F.round(S.token_set_ratio("an", "bn"), 4)).alias("name_score"))
    x = days.select(F.col("team").alias("team_key"), "day").join(pairs, "team_key")
    common = x.join(days.select(F.col("team").alias("other_key"), "day"), ["other_key", "day"]).groupBy("team_key", "other_key").agg(F.count("*").alias("shared"))
    pairs = pairs.join(common, ["team_key", "other_key"], "left").join(played.withColumnRenamed("team", "team_key"), "team_key", "left")
    pairs = pairs.select("team_key", "other_key", "name_score", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce(F.col("shared") / F.col("days"), F.lit(0.0)).alias("overlap"))
    good = folds.accept(pairs, MATCH_RULES, MATCH_FLOOR).select("team_key", "other_key", F.col("name_score").alias("score"))
    matched = folds.greedy_match(good, "team_key", "other_key", ["score"])
    own = t.filter("odds_api_name is null").select("team_key", F.lit(None).cast("long").alias("other_key"))  # known to be absent there
    return folds.apply_overrides(matched, own, "team_key", "other_key")
