"""Point-in-time reads and as-of joins over the domain tables and the event stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.engine.asof import AsOfView, latest_per_group, visible_per_cutoff
from tidemark.engine.catalog import Catalog
from tidemark.engine.leakcheck import check_leakage, corrupt_future, fingerprint, spread_deadlines
from tidemark.engine.session import micros, table
from tidemark.operators.asof_join import asof_join, range_join, running_count_before
from tidemark.plans.registry import collector

QUERIES, query = collector()

CUT = dt.datetime(2022, 12, 10, 11, tzinfo=dt.UTC)
CUT_SQL = "timestamptz '2022-12-10 11:00:00+00'"


def view(spark, d, cutoff=CUT) -> AsOfView:
    return AsOfView.at(Catalog(spark, d), cutoff)


@query(f"select player_key, fixture_key, minutes, epoch_us(available_at) as available_us from player_match where available_at < {CUT_SQL}")
def asof_filter(spark, d):
    t = view(spark, d).table("player_match", ["player_key", "fixture_key", "minutes", "available_at"])
    return t.select("player_key", "fixture_key", "minutes", micros("available_at").alias("available_us"))


@query(f"""select player_key, epoch_us(snapshot_at) as snapshot_us, source, now_cost from (
  select *, row_number() over (partition by player_key order by snapshot_at desc, (source = 'fpl') desc, available_at desc, now_cost) rn
  from (select distinct player_key, snapshot_at, source, now_cost, available_at from player_snapshot where available_at < {CUT_SQL})
  ) where rn = 1""")
def asof_latest_snapshot(spark, d):
    """Newest row per player before the cutoff, the preferred source first; of redelivered rows the last known."""
    t = view(spark, d).table("player_snapshot", ["player_key", "snapshot_at", "source", "now_cost", "available_at"]).distinct()
    best = F.struct("snapshot_at", (F.col("source") == "fpl").alias("own"), "available_at", (-F.col("now_cost")).alias("c"), "source", "now_cost")
    t = t.groupBy("player_key").agg(F.max(best).alias("b"))
    return t.select("player_key", micros("b.snapshot_at").alias("snapshot_us"), "b.source", "b.now_cost")


@query("select event_type, max(epoch_us(ts)) as ts_us from events where ts < timestamp '2024-01-15' group by event_type")
def asof_latest_null_group(spark, d):
    """NULL keys form a group (here none occur; the tests cover them)."""
    e = table(spark, d, "events").filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return latest_per_group(e, ["event_type"], "ts").select("event_type", micros("ts").alias("ts_us"))


@query("select max(epoch_us(ts)) as ts_us from events")
def asof_latest_single_group(spark, d):
    return latest_per_group(table(spark, d, "events"), [], "ts").select(micros("ts").alias("ts_us"))


@query(f"""with inner_cut as (select * from player_match where available_at < timestamptz '2022-10-01 00:00:00+00')
select season, gw, count(*) as n from inner_cut where available_at < {CUT_SQL} group by season, gw""")
def asof_narrowed(spark, d):
    v = view(spark, d).earlier(dt.datetime(2022, 10, 1, tzinfo=dt.UTC))
    return v.table("player_match", ["season", "gw"]).groupBy("season", "gw").agg(F.count("*").alias("n"))


@query(f"""select g.gw, g.gw_index from gameweek g where g.deadline_time = (
  select min(deadline_time) from gameweek where deadline_time > {CUT_SQL})""")
def asof_gameweek_for_deadline(spark, d):
    cat = Catalog(spark, d)
    nxt = cat.load("gameweek").filter(F.col("deadline_time") > F.lit(CUT)).agg(F.min("deadline_time").alias("t")).first().t
    if nxt is None:  # no later deadline
        return cat.load("gameweek").select("gw", "gw_index").filter("false")
    deadline = nxt.astimezone(dt.UTC) if nxt.tzinfo else nxt.replace(tzinfo=dt.UTC)
    return AsOfView.at(cat, deadline, CUT).gameweek_for_deadline().select("gw", "gw_index")


@query(f"""select p.player_key, p.web_name from player_dim p
where p.player_key in (select player_key from player_match where available_at < {CUT_SQL} and minutes > 0)""")
def asof_lookup(spark, d):
    """A static table only for keys seen in visible rows of another table."""
    v = view(spark, d)
    keys = v.table("player_match", ["player_key", "minutes"]).filter("minutes > 0")
    return v.lookup("player_dim", keys).select("player_key", "web_name")


@query(f"""with s as (select * from player_snapshot where season = 2022 and available_at < {CUT_SQL}),
newest as (select max(snapshot_at) m from s)
select distinct s.element_id, s.player_key from s, newest where snapshot_at = m
union all select distinct element_id, player_key from player_match, newest where m is null and season = 2022 and available_at < {CUT_SQL}""")
def asof_snapshot_or_fallback(spark, d):
    v = view(spark, d)
    return v.with_fallback("player_snapshot", "player_match", 2022, ["element_id", "player_key"]).distinct()


@query("""select epoch_us(g.deadline_time) as cutoff_us, count(p.player_key) as visible
from gameweek g left join player_match p on p.available_at < g.deadline_time group by g.deadline_time""")
def asof_many_cutoffs(spark, d):
    """All deadlines as rows of one plan instead of one scan per deadline."""
    return visible_per_cutoff(table(spark, d, "player_match"), table(spark, d, "gameweek"), "available_at", "deadline_time")


@query(f"select count(*) as n, sum(case when available_at < {CUT_SQL} then minutes end)::bigint as minutes from player_match")
def asof_corrupt_future_keeps_past(spark, d):
    """Corrupting the future leaves past sums alone (ghosts add rows after the deadline, not here)."""
    pm = table(spark, d, "player_match").select("player_key", "fixture_key", "minutes", "available_at")
    c = corrupt_future(pm, CUT, ("player_key", "fixture_key"), ghost_fraction=0.0)
    return c.agg(F.count("*").alias("n"), F.sum(F.when(F.col("available_at") < F.lit(CUT), F.col("minutes"))).alias("minutes"))


@query("select 'corrupted' as variant, 0::bigint as leaks union all select 'truncated', 0::bigint")
def asof_leak_check(spark, d):
    """The leak checker over three registered views at two deadlines: no difference is expected."""
    cat = Catalog(spark, d, specs={s: Catalog(spark, d).specs[s] for s in ("player_match", "player_snapshot", "gameweek")})
    views = {
        "form": lambda v: v.table("player_match", ["player_key", "minutes"]).groupBy("player_key").agg(F.sum("minutes").alias("m")),
        "newest": lambda v: v.latest("player_snapshot", ["player_key"], ["player_key", "now_cost"]),
        "rounds": lambda v: v.table("player_match", ["season", "gw"]).distinct(),
    }
    found = check_leakage(cat, [CUT, dt.datetime(2023, 1, 15, tzinfo=dt.UTC)], views)
    rows = [(k, sum(f[2] == k for f in found)) for k in ("corrupted", "truncated")]
    return spark.createDataFrame(rows, "variant string, leaks long")


@query("select count(*) as n, 1::bigint as same from player_match")
def asof_fingerprint(spark, d):
    """Equal content gives equal fingerprints whatever the row order."""
    pm = table(spark, d, "player_match")
    a, b = fingerprint(pm), fingerprint(pm.orderBy("minutes", "player_key"))
    return spark.createDataFrame([(a[1], int(a == b))], "n long, same long")


@query("""with t as (select deadline_time, ntile(4) over (order by deadline_time) tile from (select distinct deadline_time from gameweek)),
r as (select *, row_number() over (partition by tile order by deadline_time) r, count(*) over (partition by tile) n from t)
select epoch_us(deadline_time) as deadline_us from r where r = (n + 1) // 2""")
def asof_spread_deadlines(spark, d):
    return spread_deadlines(table(spark, d, "gameweek"), "deadline_time", 4).select(micros("deadline_time").alias("deadline_us"))


# ---------------------------------------------------------------- as-of joins on the event stream


def _two(spark, d):
    e = table(spark, d, "events")
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", micros("ts").alias("ts"))
    views = e.filter("event_type = 'view'").select("user_id", micros("ts").alias("vts"), F.col("event_id").alias("view_id"), "value")
    return buys, views


_EV = "with b as (select event_id, user_id, epoch_us(ts) ts from events where event_type = 'purchase'), v as (select event_id view_id, user_id, epoch_us(ts) vts, value from events where event_type = 'view') "


def _asof_sql(cmp: str, order: str, extra: str = "") -> str:
    return _EV + (
        f"select b.event_id, v.view_id, round(v.value, 6) as value from b left join v on v.user_id = b.user_id and v.vts {cmp} b.ts {extra}"
        f" qualify row_number() over (partition by b.event_id order by v.vts {order} nulls last, v.view_id {'desc'}) = 1"
    )


def _joined(spark, d, **kw):
    b, v = _two(spark, d)
    j = asof_join(b, v, "ts", "vts", ["user_id"], ["view_id", "value"], **kw)
    return j.select("event_id", "view_id", F.round("value", 6).alias("value"))


@query(_asof_sql("<", "desc"))
def asof_join_backward_strict(spark, d):
    return _joined(spark, d, strict=True)


@query(_asof_sql("<=", "desc"))
def asof_join_backward(spark, d):
    return _joined(spark, d)


@query(_asof_sql(">=", "asc"))
def asof_join_forward(spark, d):
    return _joined(spark, d, direction="forward")


@query(_asof_sql(">", "asc"))
def asof_join_forward_strict(spark, d):
    return _joined(spark, d, direction="forward", strict=True)


@query(_asof_sql("<=", "desc", "and b.ts - v.vts <= 3600000000"))
def asof_join_tolerance(spark, d):
    return _joined(spark, d, tolerance=F.lit(3_600_000_000))


@query("""select fixture_key, home_team_key, count(o.fixture_key) as earlier from (select distinct fixture_key, season, home_team_key, gw_index from fixture where gw_index is not null) f
left join (select distinct fixture_key, season, home_team_key h, gw_index g from fixture where gw_index is not null) o(fixture_key2, season2, h, g)
on o.season2 = f.season and o.h = f.home_team_key and o.g < f.gw_index group by all""".replace("count(o.fixture_key)", "count(o.fixture_key2)"))
def asof_running_count(spark, d):
    """Composite-key as-of on an integer order: home matches of the club in earlier gameweeks."""
    f = table(spark, d, "fixture").filter("gw_index is not null").select("fixture_key", "season", "home_team_key", "gw_index").distinct()
    return f.select("fixture_key", "home_team_key", running_count_before(f, ["season", "home_team_key"], "gw_index").alias("earlier"))


@query(_EV + """select b.event_id, count(v.view_id) as near, min(abs(v.vts - b.ts)) as closest from b join v
on v.user_id = b.user_id and v.vts - b.ts between -21600000000 and 7200000000 group by b.event_id""")
def range_join_near_views(spark, d):
    """Band join: views from six hours before to two hours after each purchase."""
    b, v = _two(spark, d)
    j = range_join(b, v, ["user_id"], "ts", "vts", 21_600_000_000, 7_200_000_000, ["view_id", "vts"])
    return j.groupBy("event_id").agg(F.count("view_id_r").alias("near"), F.min(F.abs(F.col("vts_r") - F.col("ts"))).alias("closest"))


