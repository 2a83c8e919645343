"""Entity tables and feature views over the domain tables, as of a cutoff."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.engine.asof import AsOfView
from tidemark.engine.catalog import Catalog
from tidemark.engine.scale import broadcast_if_small, current_rows, one_row
from tidemark.engine.session import micros, table
from tidemark.operators import relational as R
from tidemark.operators.asof_join import asof_join
from tidemark.plans.registry import collector

QUERIES, query = collector()

CUT = dt.datetime(2023, 1, 10, tzinfo=dt.UTC)
CUT_SQL = "timestamptz '2023-01-10 00:00:00+00'"


def view(spark, d) -> AsOfView:
    return AsOfView.at(Catalog(spark, d), CUT)


def known_matches(v: AsOfView, columns: list[str]) -> DataFrame:
    """The latest delivery known at the cutoff of each match row."""
    cols = list(dict.fromkeys(["player_key", "fixture_key", *columns, "available_at"]))
    return current_rows(v.table("player_match", cols), ["player_key", "fixture_key"], [F.desc("available_at")])


_KM = f"km as (select * from player_match where available_at < {CUT_SQL} qualify row_number() over (partition by player_key, fixture_key order by available_at desc) = 1)"
_KS = f"ks as (select * from player_snapshot where available_at < {CUT_SQL} and season = 2022), nw as (select max(snapshot_at) mat from ks), np as (select ks.* from ks, nw where snapshot_at = mat qualify row_number() over (partition by player_key order by (source = 'fpl') desc, available_at desc) = 1)"


# ---------------------------------------------------------------- entity tables


@query("""with f as (select * from fixture qualify row_number() over (partition by fixture_key order by available_at desc) = 1)
select fixture_key, season, gw, home_team_key, away_team_key, epoch_us(kickoff_time) as kickoff_us, dense_rank() over (partition by season order by gw) as gw_order from f where gw is not null""")
def build_schedule(spark, d):
    """The final fixture list with results dropped and a dense round index."""
    cols = ["fixture_key", "season", "gw", "home_team_key", "away_team_key", "kickoff_time", "available_at"]
    f = current_rows(table(spark, d, "fixture").select(*cols), ["fixture_key"], [F.desc("available_at")]).filter("gw is not null")
    rounds = f.select("season", "gw").distinct().withColumn("gw_order", F.dense_rank().over(Window.partitionBy("season").orderBy("gw")).cast("long"))
    return f.join(broadcast_if_small(rounds), ["season", "gw"]).select("fixture_key", "season", "gw", "home_team_key", "away_team_key", micros("kickoff_time").alias("kickoff_us"), "gw_order")


@query("""with f as (select * from fixture qualify row_number() over (partition by fixture_key order by available_at desc) = 1)
select f.season, f.gw, min(coalesce(epoch_us(g.deadline_time), -1)) as deadline_us, epoch_us(min(kickoff_time) - interval 90 minute) as approx_us from f left join gameweek g using (season, gw) where f.gw is not null group by all""".replace("select f.season, f.gw,", "select season, gw,").replace("where f.gw is not null", "where gw is not null"))
def build_gameweek(spark, d):
    """Deadlines: the listed one beside the approximation from the first kickoff."""
    f = current_rows(table(spark, d, "fixture").select("fixture_key", "season", "gw", "kickoff_time", "available_at"), ["fixture_key"], [F.desc("available_at")]).filter("gw is not null")
    a = f.groupBy("season", "gw").agg(micros(F.min("kickoff_time") - F.expr("interval 90 minute")).alias("approx_us"))
    g = broadcast_if_small(table(spark, d, "gameweek").select("season", "gw", micros("deadline_time").alias("dl")))
    return a.join(g, ["season", "gw"], "left").select("season", "gw", F.coalesce("dl", F.lit(-1).cast("long")).alias("deadline_us"), "approx_us")


@query("""select player_key, season, min(element_id)::bigint as element_id, epoch_us(min(available_at)) as first_visible_us from player_snapshot group by player_key, season""")
def build_player_season(spark, d):
    return table(spark, d, "player_snapshot").groupBy("player_key", "season").agg(F.min("element_id").alias("element_id"), micros(F.min("available_at")).alias("first_visible_us"))


@query("""with cur as (select * from player_match qualify row_number() over (partition by player_key, fixture_key order by available_at desc) = 1)
select fixture_key, team_key, sum(goals_scored)::bigint as goals, round(case when count(*) filter (minutes > 0) = count(us_xg) filter (minutes > 0) then sum(us_xg) filter (minutes > 0) end, 6) as us_xg, round(sum(fpl_xa) filter (minutes > 0 and fpl_xa between 0 and 5 and not isnan(fpl_xa)), 6) as fpl_xa from cur group by all""")
def build_team_match(spark, d):
    """Two rows per fixture with sums of several sources side by side; one strict, one lenient."""
    from tidemark.plans.relational import current_matches

    m = current_matches(spark, d).withColumn("x", F.when(F.col("minutes") > 0, F.col("us_xg"))).withColumn("on", (F.col("minutes") > 0).cast("int"))
    strict = F.when(F.sum("on") == F.count("x"), F.sum("x"))
    xa = F.sum(F.when((F.col("minutes") > 0) & F.col("fpl_xa").between(0, 5), F.col("fpl_xa")))
    return m.groupBy("fixture_key", "team_key").agg(F.sum("goals_scored").alias("goals"), F.round(strict, 6).alias("us_xg"), F.round(xa, 6).alias("fpl_xa"))


@query(f"""with {_KM}, l as (select player_key, season, min(available_at) listed from player_snapshot group by all)
select km.player_key, km.fixture_key, epoch_us(greatest(g.lockdown_time, l.listed)) as available_us from km join gameweek g using (season, gw) left join l using (player_key, season)""")
def build_availability_rule(spark, d):
    """A result is known at the round's lockdown, but not before its player's first listing."""
    v = view(spark, d)
    m = known_matches(v, ["season", "gw"])
    g = broadcast_if_small(table(spark, d, "gameweek").select("season", "gw", "lockdown_time"))
    first = table(spark, d, "player_snapshot").groupBy("player_key", "season").agg(F.min("available_at").alias("listed"))
    return m.join(g, ["season", "gw"]).join(first, ["player_key", "season"], "left").select("player_key", "fixture_key", micros(F.greatest("lockdown_time", "listed")).alias("available_us"))


@query("""with s as (select player_key, season, team_key, epoch_us(snapshot_at) t from player_snapshot group by all), x as (select *, case when lag(team_key) over w is distinct from team_key then 1 else 0 end c from s window w as (partition by player_key, season order by t, team_key)),
y as (select *, sum(c) over (partition by player_key, season order by t, team_key) i from x) select player_key, season, team_key, min(t) as from_us, max(t) as to_us from y group by player_key, season, team_key, i""")
def registration_stints(spark, d):
    """Islands of snapshots with the same club."""
    s = table(spark, d, "player_snapshot").select("player_key", "season", "team_key", micros("snapshot_at").alias("t")).distinct()
    i = R.islands(s, ["player_key", "season"], ["t", "team_key"], "team_key", "i")
    return i.groupBy("player_key", "season", "team_key", "i").agg(F.min("t").alias("from_us"), F.max("t").alias("to_us")).drop("i")


@query("""with s as (select player_key, season, epoch_us(snapshot_at) t, arg_max(now_cost, (source = 'fpl')::int * 1e18::bigint + epoch_us(available_at)) c from player_snapshot group by all),
e as (select g.season, g.gw, epoch_us(g.deadline_time) - 3600000000 at_us, p.player_key from gameweek g join (select distinct season, player_key from player_snapshot) p using (season)),
j as (select e.*, s.c, row_number() over (partition by e.season, gw, e.player_key order by s.t desc) r from e left join s on s.player_key = e.player_key and s.season = e.season and s.t <= e.at_us)
select season, gw, player_key, c as now_cost from j where r = 1""")
def build_player_gw(spark, d):
    """Price one hour before each deadline: an inclusive backward as-of join of a players × rounds grid."""
    ps = table(spark, d, "player_snapshot")
    rank = (F.col("source") == "fpl").cast("long") * F.lit(10**18) + micros("available_at")
    s = ps.groupBy("player_key", "season", micros("snapshot_at").alias("t")).agg(F.max_by("now_cost", rank).alias("now_cost"))
    g = broadcast_if_small(table(spark, d, "gameweek").select("season", "gw", (micros("deadline_time") - 3_600_000_000).alias("at_us")))
    e = ps.select("season", "player_key").distinct().join(g, "season")
    return asof_join(e, s, "at_us", "t", ["player_key", "season"], ["now_cost"]).select("season", "gw", "player_key", "now_cost")


# ---------------------------------------------------------------- feature views


@query(f"with {_KS} select player_key, element_type, team_key, now_cost as price, source from np")
def player_pool(spark, d):
    """Players in the newest whole list before the cutoff; the absent have left."""
    v = view(spark, d)
    s = v.table("player_snapshot", ["season", "player_key", "snapshot_at", "source", "available_at", "element_type", "team_key", "now_cost"]).filter("season = 2022")
    s = s.filter(F.col("snapshot_at") == one_row(s.agg(F.max("snapshot_at").alias("at")))["at"])
    p = current_rows(s, ["player_key"], [F.desc(F.col("source") == "fpl"), F.desc("available_at")])
    return p.select("player_key", "element_type", "team_key", F.col("now_cost").alias("price"), "source")


@query(f"with {_KS} select team_key, element_type, count(*) as players, round(median(now_cost), 4) as median_price from np group by all")
def pool_coverage(spark, d):
    return player_pool(spark, d).groupBy("team_key", "element_type").agg(F.count("*").alias("players"), F.round(F.median("price"), 4).alias("median_price"))


@query(f"""with {_KS}, la as (select player_key, lower(trim(status)) status, chance_of_playing_next_round ch from ks qualify row_number() over (partition by player_key order by snapshot_at desc, (source = 'fpl') desc, available_at desc) = 1)
select np.player_key, status, ch as chance from np left join la using (player_key)""".replace("select np.player_key,", "select player_key,").replace("lower(trim(status)) status, chance", "lower(trim(status)) st, chance").replace("player_key, status, ch as", "player_key, st as status, ch as"))
def availability(spark, d):
    """Pool ⟕ each player's newest report."""
    v = view(spark, d)
    s = v.table("player_snapshot", ["season", "player_key", "snapshot_at", "source", "available_at", "status", "chance_of_playing_next_round"]).filter("season = 2022")
    last = current_rows(s, ["player_key"], [F.desc("snapshot_at"), F.desc(F.col("source") == "fpl"), F.desc("available_at")])
    last = last.select("player_key", F.lower(F.trim("status")).alias("status"), F.col("chance_of_playing_next_round").alias("chance"))
    return player_pool(spark, d).select("player_key").join(last, "player_key", "left")


@query(f"""with {_KM}, r as (select *, row_number() over (partition by player_key order by kickoff_time desc, fixture_key desc) r from km)
select player_key, count(*) filter (r <= 5) as matches_last5, sum(minutes) filter (r <= 5)::bigint as minutes_last5, sum(total_points) filter (r <= 5)::bigint as points_last5, sum(minutes)::bigint as minutes_season, sum(goals_scored)::bigint as goals_season,
round(case when sum(minutes) > 0 then sum(bps) / sum(minutes)::double * 90 end, 6) as bps_per90 from r where season = 2022 group by player_key""")
def recent_form(spark, d):
    """Last five and season in one conditional aggregation."""
    m = known_matches(view(spark, d), ["season", "kickoff_time", "minutes", "total_points", "goals_scored", "bps"]).filter("season = 2022")
    w = Window.partitionBy("player_key").orderBy(F.desc("kickoff_time"), F.desc("fixture_key"))
    m = m.withColumn("r", F.row_number().over(w))
    last = lambda c: F.sum(F.when(F.col("r") <= 5, F.col(c)))
    return m.groupBy("player_key").agg(
        F.count(F.when(F.col("r") <= 5, 1)).alias("matches_last5"), last("minutes").alias("minutes_last5"), last("total_points").alias("points_last5"),
        F.sum("minutes").alias("minutes_season"), F.sum("goals_scored").alias("goals_season"), F.round(R.rate_per("bps", "minutes", 90.0), 6).alias("bps_per90"),
    )


@query(f"""with g as (select gw, gw_index from gameweek where season = 2022 and deadline_time >= {CUT_SQL} qualify row_number() over (order by deadline_time) <= 6),
f as (select * from fixture where available_at < timestamptz '2100-01-01 00:00:00+00' and season = 2022 qualify row_number() over (partition by fixture_key order by available_at desc) = 1),
s as (select home_team_key team_key, gw, fixture_key from f union all select away_team_key, gw, fixture_key from f), t as (select distinct home_team_key team_key from f)
select t.team_key, g.gw, count(s.fixture_key) as n_fixtures from t cross join g left join s on s.team_key = t.team_key and s.gw = g.gw group by all""")
def upcoming_fixtures(spark, d):
    """Club × next six rounds with blanks (0) and doubles (2)."""
    g = table(spark, d, "gameweek").filter((F.col("season") == 2022) & (F.col("deadline_time") >= F.lit(CUT))).orderBy("deadline_time").limit(6).select("gw")
    f = table(spark, d, "fixture").filter((F.col("season") == 2022) & (F.col("available_at") < F.lit(dt.datetime(2100, 1, 1, tzinfo=dt.UTC))))
    f = current_rows(f.select("fixture_key", "gw", "home_team_key", "away_team_key", "available_at"), ["fixture_key"], [F.desc("available_at")])
    sides = R.unpivot_sides(f, ["fixture_key", "gw"], {"team_key": "home_team_key"}, {"team_key": "away_team_key"})
    n = sides.groupBy("team_key", "gw").agg(F.count("*").alias("n_fixtures"))
    return R.dense_grid(f.select(F.col("home_team_key").alias("team_key")).distinct(), g, n, ["team_key", "gw"], {"n_fixtures": 0})


@query(f"""with {_KM}, x as (select player_key, fixture_key, season, kickoff_time, minutes, starts, season * 100 + gw b from km), bl as (select player_key, b, sum(minutes)::double m, sum(coalesce(starts, 0))::double s, count(*)::double c from x group by all),
w as (select player_key, b, sum(m) over w1 / nullif(sum(c) over w1, 0) m1, sum(m) over w5 / nullif(sum(c) over w5, 0) m5, sum(s) over w5 / nullif(sum(c) over w5, 0) s5, coalesce(sum(c) over wa, 0) n from bl
window w1 as (partition by player_key order by b rows between 1 preceding and 1 preceding), w5 as (partition by player_key order by b rows between 5 preceding and 1 preceding), wa as (partition by player_key order by b rows between unbounded preceding and 1 preceding))
select x.player_key, x.fixture_key, round(m1, 6) as minutes_l1, round(m5, 6) as minutes_l5, round(s5, 6) as start_rate_l5, n::bigint as matches_before from x join w on w.player_key = x.player_key and w.b = x.b""")
def training_frame(spark, d):
    """One row per match with lag features over *earlier* rounds: matches of one round share their history."""
    m = known_matches(view(spark, d), ["season", "gw", "minutes", "starts"]).withColumn("b", F.col("season") * 100 + F.col("gw"))
    bl = m.groupBy("player_key", "b").agg(F.sum("minutes").cast("double").alias("m"), F.sum(F.coalesce("starts", F.lit(0))).cast("double").alias("s"), F.count("*").cast("double").alias("c"))
    w = Window.partitionBy("player_key").orderBy("b")
    mean = lambda c, k: F.sum(c).over(w.rowsBetween(-k, -1)) / F.nullif(F.sum("c").over(w.rowsBetween(-k, -1)), F.lit(0.0))
    bl = bl.select(
        "player_key", "b", mean("m", 1).alias("m1"), mean("m", 5).alias("m5"), mean("s", 5).alias("s5"),
        F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("n"),
    )
    j = m.join(bl, ["player_key", "b"])
    return j.select("player_key", "fixture_key", F.round("m1", 6).alias("minutes_l1"), F.round("m5", 6).alias("minutes_l5"), F.round("s5", 6).alias("start_rate_l5"), F.col("n").cast("long").alias("matches_before"))


@query(f"""with s as (select distinct fixture_key, season, kickoff_time, home_team_key, away_team_key from fixture where kickoff_time is not null and gw is not null), sd as (select distinct fixture_key, kickoff_time, home_team_key t from s union select distinct fixture_key, kickoff_time, away_team_key from s)
select fixture_key, t as team_key, round((epoch_us(kickoff_time) - epoch_us(lag(kickoff_time) over w)) / 86400000000.0, 6) as rest_days, round((epoch_us(lead(kickoff_time) over w) - epoch_us(kickoff_time)) / 86400000000.0, 6) as next_days from sd window w as (partition by t order by kickoff_time, fixture_key)""")
def congestion(spark, d):
    """Days since a club's previous and until its next match, from one calendar."""
    f = table(spark, d, "fixture").filter("kickoff_time is not null and gw is not null")
    s = R.unpivot_sides(f, ["fixture_key", "kickoff_time"], {"team_key": "home_team_key"}, {"team_key": "away_team_key"}).drop("is_home").distinct()
    w = Window.partitionBy("team_key").orderBy("kickoff_time", "fixture_key")
    t = s.withColumn("t", micros("kickoff_time"))
    return t.select("fixture_key", "team_key", F.round((F.col("t") - F.lag("t").over(w)) / 86_400_000_000.0, 6).alias("rest_days"), F.round((F.lead("t").over(w) - F.col("t")) / 86_400_000_000.0, 6).alias("next_days"))


@query(f"""with {_KM}, r as (select player_key, total_points, row_number() over (partition by player_key order by kickoff_time desc, fixture_key desc) r from km), m as (select player_key, avg(total_points) p from r where r <= 5 group by player_key),
h as (select unnest([0, 1, 2, 3]) h) select player_key, round(sum(pow(0.5, h) * p), 6) as horizon_points from m, h group by player_key""")
def horizon_decay(spark, d):
    """Σ decay^h × rolling mean over a horizon of four rounds."""
    m = known_matches(view(spark, d), ["kickoff_time", "total_points"])
    m = R.top_n(m, ["player_key"], [F.desc("kickoff_time"), F.desc("fixture_key")], 5).groupBy("player_key").agg(F.avg("total_points").alias("p"))
    h = m.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return h.groupBy("player_key").agg(F.round(F.sum(F.pow(F.lit(0.5), F.col("h")) * F.col("p")), 6).alias("horizon_points"))


@query(f"""with {_KM}, g as (select player_key, gw, sum(total_points)::bigint p from km where season = 2022 group by all)
select player_key, max(case when gw = 1 then p end) as gw1, max(case when gw = 2 then p end) as gw2, max(case when gw = 3 then p end) as gw3 from g where gw <= 3 group by player_key""")
def pivot_to_matrix(spark, d):
    m = known_matches(view(spark, d), ["season", "gw", "total_points"]).filter("season = 2022 and gw <= 3")
    p = m.groupBy("player_key").pivot("gw", [1, 2, 3]).agg(F.sum("total_points"))
    return p.select("player_key", *[F.col(str(i)).alias(f"gw{i}") for i in (1, 2, 3)])


@query(f"""with {_KM}, g as (select season, player_key, 'gw' || gw as gw, total_points from km where gw is not null)
select * from (pivot g on gw using sum(total_points)::bigint group by season, player_key)""")
def pivot_all_rounds(spark, d):
    """A row per season and player, a column per round that was played in any season."""
    m = known_matches(view(spark, d), ["season", "gw", "total_points"]).filter("gw is not null")
    rounds = sorted(r["gw"] for r in m.select("gw").distinct().collect())
    p = m.groupBy("season", "player_key").pivot("gw", rounds).agg(F.sum("total_points"))
    return p.select("season", "player_key", *[F.col(str(i)).alias(f"gw{i}") for i in rounds])


@query("""with g as (select season, gw, gw_index, sum(total_points)::double v from (select * from player_match qualify row_number() over (partition by player_key, fixture_key order by available_at desc) = 1) join gameweek using (season, gw) group by all)
select season, gw, max(v) over (partition by season order by gw_index rows between current row and unbounded following) as best_ahead from g""")
def suffix_maximum(spark, d):
    """For each round the best later round (reverse running maximum)."""
    from tidemark.plans.relational import current_matches

    g = current_matches(spark, d).groupBy("season", "gw").agg(F.sum("total_points").cast("double").alias("v"))
    g = g.join(broadcast_if_small(table(spark, d, "gameweek").select("season", "gw", "gw_index")), ["season", "gw"])
    return g.select("season", "gw", F.max("v").over(Window.partitionBy("season").orderBy("gw_index").rowsBetween(0, Window.unboundedFollowing)).alias("best_ahead"))
