"""Further queries: SQL views, resolvers, roll-ups, noise, market rates, and views that combine operators."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.engine.catalog import Catalog
from tidemark.engine.scale import current_rows
from tidemark.engine.session import micros, table
from tidemark.engine.sqlviews import register_asof_views, register_functions, register_views
from tidemark.functions import stats as St
from tidemark.functions.market import market_rates
from tidemark.functions.random import hash_uniform, jitter
from tidemark.operators import folds
from tidemark.operators import relational as R
from tidemark.operators.asof_join import asof_join
from tidemark.plans.registry import collector
from tidemark.plans.relational import current_matches
from tidemark.plans.views import CUT, CUT_SQL, known_matches, player_pool, view

QUERIES, query = collector()


@query("select n_name, count(*) as customers, round(sum(c_acctbal), 2) as bal from customer join nation on c_nationkey = n_nationkey group by n_name having count(*) > 3")
def sql_over_views(spark, d):
    register_views(spark, d, ["customer", "nation"], "tm_")
    return spark.sql("select n_name, count(*) as customers, round(sum(c_acctbal), 2) as bal from tm_customer join tm_nation on c_nationkey = n_nationkey group by n_name having count(*) > 3")


@query(f"select season, gw, count(*) as n from player_match where available_at < {CUT_SQL} group by season, gw")
def sql_over_asof_views(spark, d):
    """Plain SQL that cannot see the future: the views are cut at the deadline."""
    cat = Catalog(spark, d)
    cat.specs = {k: v for k, v in cat.specs.items() if k == "player_match"}
    register_asof_views(spark, cat, CUT, "known_")
    return spark.sql("select season, gw, count(*) as n from known_player_match group by season, gw")


@query("""select distinct fixture_key, (year(kickoff_time at time zone 'UTC') - case when month(kickoff_time at time zone 'UTC') < 7 then 1 else 0 end)::bigint as s, round(1 / (1 + pow(10.0, -(1500.0 + 60 - (1400 + home_team_key % 100)) / 400.0)), 6) as e from fixture where kickoff_time is not null""")
def sql_functions(spark, d):
    register_functions(spark)
    register_views(spark, d, ["fixture"], "tm_")
    return spark.sql("select distinct fixture_key, cast(season_start(kickoff_time) as bigint) as s, round(elo_expected(1500D, cast(1400 + home_team_key % 100 as double)), 6) as e from tm_fixture where kickoff_time is not null")


@query("with recursive t(n, f) as (select 1, 1::bigint union all select n + 1, f * 2 from t where n < 20) select n::bigint as n, f from t")
def recursive_query(spark, d):
    return spark.sql("with recursive t(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * 2 from t where n < 20) select cast(n as bigint) as n, f from t")


@query("select o_orderkey from orders o where o_totalprice > (select 1.5 * avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)")
def correlated_subquery(spark, d):
    """The correlated average becomes one aggregation and a join (Catalyst decorrelates it)."""
    register_views(spark, d, ["orders"], "tm_")
    return spark.sql("select o_orderkey from tm_orders o where o_totalprice > (select 1.5 * avg(o_totalprice) from tm_orders i where i.o_custkey = o.o_custkey)")


@query("select f.fixture_key, t.short_name from (select distinct fixture_key, home_team_key from fixture) f join team_dim t on t.team_key = f.home_team_key")
def resolved_dimension(spark, d):
    f = table(spark, d, "fixture").select("fixture_key", F.col("home_team_key").alias("team_key")).distinct()
    return R.resolve(f, table(spark, d, "team_dim"), ["team_key"], "short_name").select("fixture_key", "short_name")


@query("""with x as (select l_linenumber::bigint h, l_discount e from lineitem), l as (select h::varchar horizon, e from x union all select '2-5', e from x where h between 2 and 5 union all select 'all', e from x)
select horizon, count(*) as n, round(avg(e), 6) as mean from l group by horizon""")
def pooled_rollup(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("horizon"), "l_discount")
    return R.pooled_rollup(x, "horizon", {"2-5": F.col("horizon").between(2, 5), "all": F.lit(True)}, [F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean")])


@query("select l_returnflag, count(*) as n, round(avg(l_discount - l_tax), 6) as mean, round(sum(l_discount - l_tax) / (select count(*) from lineitem), 6) as part from lineitem group by l_returnflag")
def gap_attribution(spark, d):
    li = table(spark, d, "lineitem").withColumn("diff", F.col("l_discount") - F.col("l_tax"))
    return R.contribution(li, ["l_returnflag"], "diff").select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("part", 6).alias("part"))


@query("""with x as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) r, 0.3::double + (p_size % 5) * 0.1::double q from part)
select p_partkey, round(q * coalesce(exp(sum(ln(1 - q)) over (partition by p_brand order by r rows between unbounded preceding and 1 preceding)), 1), 6) as p from x""")
def ranked_takers(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    x = table(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("r"), (0.3 + (F.col("p_size") % 5) * 0.1).alias("q"), F.lit(1.0).alias("on"))
    return R.ranked_takers(x, ["p_brand"], "r", "q", "on").select("p_partkey", F.round("p", 6).alias("p"))


@query()
def seeded_noise(spark, d):
    """Multiplicative noise that depends on key and seed alone."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(jitter(F.col("p_retailprice"), 0.1, 5, "p_partkey"), 6).alias("noisy"), F.round(hash_uniform(5, "p_partkey"), 9).alias("u"))


@query()
def implied_goal_rates(spark, d):
    """Goal rates that fit match probabilities, solved in Arrow batches."""
    p = table(spark, d, "part").select((F.col("p_size") % 7).alias("a"), (F.col("p_size") % 5).alias("b")).distinct()
    p = p.withColumn("h", 0.25 + F.col("a") * 0.05).withColumn("x", 0.22 + F.col("b") * 0.01)
    p = p.withColumn("r", market_rates("h", "x", 1 - F.col("h") - F.col("x"), F.lit(None).cast("double")))
    return p.select("a", "b", F.round("r.home", 4).alias("home"), F.round("r.away", 4).alias("away"), F.round("r.residual", 6).alias("residual"))


@query()
def null_size(spark, d):
    """How often the window t-test rejects when signs are random."""
    li = table(spark, d, "lineitem")
    c = li.groupBy(F.year("l_shipdate").cast("long").alias("yr"), F.month("l_shipdate").cast("long").alias("m")).agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("diff"))
    return St.null_size(c, "yr", "m", "diff", 3, [0.05, 0.1], 500, 3)


@query()
def approximate_aggregates(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5, 1000).alias("median"))


# ---------------------------------------------------------------- entity tables and views


@query("select code, arg_max(web_name, captured_at) as web_name from bootstrap_element where code is not null and web_name is not null group by code")
def build_player_names(spark, d):
    """The newest name per player code."""
    b = table(spark, d, "bootstrap_element").filter("code is not null and web_name is not null")
    return b.groupBy("code").agg(F.max_by("web_name", "captured_at").alias("web_name"))


@query("""with f as (select * from fixture qualify row_number() over (partition by fixture_key order by available_at desc) = 1), played as (select * from f where finished), open as (select * from f where not finished and fixture_key not in (select fixture_key from played))
select fixture_key, home_team_key, away_team_key, true as played from played union all select fixture_key, home_team_key, away_team_key, false from open""")
def build_club_match(spark, d):
    """Played matches and those still scheduled."""
    cols = ["fixture_key", "home_team_key", "away_team_key", "finished", "available_at"]
    f = current_rows(table(spark, d, "fixture").select(*cols), ["fixture_key"], [F.desc("available_at")])
    played = f.filter("finished")
    still = f.filter("not finished").join(played, "fixture_key", "left_anti")
    pick = lambda x, p: x.select("fixture_key", "home_team_key", "away_team_key", F.lit(p).alias("played"))
    return pick(played, True).unionByName(pick(still, False))


@query(f"""with ks as (select * from player_snapshot where available_at < {CUT_SQL} and season = 2022)
select player_key, round(selected_by_percent, 4) as ownership from ks where selected_by_percent is not null and not isnan(selected_by_percent) qualify row_number() over (partition by player_key order by snapshot_at desc, (source = 'fpl') desc, available_at desc) = 1""")
def ownership(spark, d):
    v = view(spark, d)
    s = v.table("player_snapshot", ["season", "player_key", "snapshot_at", "source", "available_at", "selected_by_percent"]).filter("season = 2022 and selected_by_percent is not null and not isnan(selected_by_percent)")
    s = current_rows(s, ["player_key"], [F.desc("snapshot_at"), F.desc(F.col("source") == "fpl"), F.desc("available_at")])
    return s.select("player_key", F.round("selected_by_percent", 4).alias("ownership"))


@query(f"""with km as (select * from player_match where available_at < {CUT_SQL} qualify row_number() over (partition by player_key, fixture_key order by available_at desc) = 1),
r as (select *, row_number() over (partition by player_key order by kickoff_time desc, fixture_key desc) r from km),
ks as (select * from player_snapshot where available_at < {CUT_SQL} and season = 2022), np as (select distinct player_key from ks where snapshot_at = (select max(snapshot_at) from ks)),
f as (select player_key, avg(minutes) filter (r <= 5) m5, avg(coalesce(starts, 0)) filter (r <= 5) s5, count(*) n, epoch_us(max(kickoff_time)) last_us from r group by player_key)
select np.player_key as player_key, round(m5, 6) as minutes_l5, round(s5, 6) as start_rate_l5, coalesce(n, 0) as matches_before, last_us from np left join f on f.player_key = np.player_key""")
def prediction_frame(spark, d):
    """One query row per pool player after all visible rows, with the same lags as the training frame's."""
    m = known_matches(view(spark, d), ["kickoff_time", "minutes", "starts"])
    w = Window.partitionBy("player_key").orderBy(F.desc("kickoff_time"), F.desc("fixture_key"))
    m = m.withColumn("r", F.row_number().over(w))
    last = lambda c: F.avg(F.when(F.col("r") <= 5, c))
    f = m.groupBy("player_key").agg(last(F.col("minutes")).alias("m5"), last(F.coalesce("starts", F.lit(0))).alias("s5"), F.count("*").alias("n"), micros(F.max("kickoff_time")).alias("last_us"))
    j = player_pool(spark, d).select("player_key").join(f, "player_key", "left")
    return j.select("player_key", F.round("m5", 6).alias("minutes_l5"), F.round("s5", 6).alias("start_rate_l5"), F.coalesce("n", F.lit(0)).alias("matches_before"), "last_us")


@query()
def team_strength(spark, d):
    """Both sides' newest rating before each later fixture, by a backward as-of join on the rating history."""
    f = table(spark, d, "fixture").filter("kickoff_time is not null and gw is not null")
    f = current_rows(f, ["fixture_key"], [F.desc("available_at")]).withColumn("kickoff_us", micros("kickoff_time"))
    m = f.filter("finished and home_goals is not null").select(F.lit("league").alias("league"), "season", "fixture_key", "kickoff_us", F.col("home_team_key").alias("home"), F.col("away_team_key").alias("away"), "home_goals", "away_goals")
    r = folds.elo(m).join(f.select("fixture_key", "kickoff_us"), "fixture_key")
    after = R.unpivot_sides(r.withColumn("ha", F.col("home_before") + F.col("move")).withColumn("aa", F.col("away_before") - F.col("move")), ["kickoff_us"], {"team_key": "home", "rating": "ha"}, {"team_key": "away", "rating": "aa"})
    later = f.filter(F.col("kickoff_us") > int(CUT.timestamp() * 1e6))
    sides = R.unpivot_sides(later, ["fixture_key", "kickoff_us"], {"team_key": "home_team_key"}, {"team_key": "away_team_key"})
    known = after.filter(F.col("kickoff_us") + 7_200_000_000 < int(CUT.timestamp() * 1e6)).withColumnRenamed("kickoff_us", "rated_us")
    j = asof_join(sides, known, "kickoff_us", "rated_us", ["team_key"], ["rating"])
    return j.select("fixture_key", "team_key", "is_home", F.round("rating", 4).alias("rating"))


@query("""with cur as (select * from player_match qualify row_number() over (partition by player_key, fixture_key order by available_at desc) = 1), c as (select season, gw, player_key, total_points from cur)
select season, gw, count(*) as n, round(quantile_cont(total_points, 0.5), 4) as median, round(quantile_cont(total_points, 0.9), 4) as p90, max(total_points) as best from c group by season, gw""")
def gain_distribution(spark, d):
    m = current_matches(spark, d)
    return m.groupBy("season", "gw").agg(F.count("*").alias("n"), F.round(F.percentile("total_points", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("total_points", F.lit(0.9)), 4).alias("p90"), F.max("total_points").alias("best"))


@query("""with g as (select season, gw, deadline_time t from gameweek), r as (select g.*, (select count(distinct p.player_key) from player_match p where p.season = g.season and p.gw < g.gw) seen from g) select season, gw, seen from r""")
def cumulative_distinct(spark, d):
    """Players seen in earlier rounds of the season: each counts from its first round on."""
    first = table(spark, d, "player_match").groupBy("season", "player_key").agg(F.min("gw").alias("gw"))
    new = first.groupBy("season", "gw").agg(F.count("*").alias("n"))
    g = table(spark, d, "gameweek").select("season", "gw").join(new, ["season", "gw"], "left")
    w = Window.partitionBy("season").orderBy("gw").rowsBetween(Window.unboundedPreceding, -1)
    return g.select("season", "gw", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("seen"))


