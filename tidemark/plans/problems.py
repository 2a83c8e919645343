"""Queries p1 to p6: the general data problems, each through its operator."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine.scale import broadcast_if_small, current_rows
from tidemark.engine.session import DAY_US, ensure_checkpoint_dir, micros, table
from tidemark.operators.event_attributes import attributes_at_event
from tidemark.operators.history import scd2_merge
from tidemark.operators.impute import Level, fill_missing
from tidemark.operators.rolling import trailing_totals
from tidemark.operators.snapdiff import complete_deliveries, merkle_diff
from tidemark.operators.timenorm import normalise_times

# ---------------------------------------------------------------- problem 1

FIELDS = ["us_npxg", "us_xa", "fpl_xg"]
_HELPERS = ["us_xg", "us_shots", "us_goals", "us_npg", "us_key_passes", "fpl_xa"]

P1_LEVELS = [
    Level("us_xg,us_goals,us_npg", "us_npxg", ("us_xg", "us_goals", "us_npg")),
    Level("us_xg", "us_npxg", ("us_xg",)),
    Level("us_xg(2),us_goals,us_npg", "us_npxg", ("round(us_xg, 2)", "us_goals", "us_npg"), tolerance=0.012),
    Level("us_xg(1),us_goals,us_npg", "us_npxg", ("round(us_xg, 1)", "us_goals", "us_npg"), tolerance=0.06),
    Level("us_shots", "us_npxg", ("us_shots",)),
    Level("fpl_xa", "us_xa", ("fpl_xa",)),
    Level("us_key_passes", "us_xa", ("us_key_passes",)),
    Level("us_xg", "fpl_xg", ("us_xg",), tolerance=0.04),
    Level("us_xg(2)", "fpl_xg", ("round(us_xg, 2)",), tolerance=0.05),
    Level("us_xg(1)", "fpl_xg", ("round(us_xg, 1)",), tolerance=0.1),
    Level("us_shots", "fpl_xg", ("us_shots",), tolerance=0.04),
    *[Level("player_season", f, ("player_key", "season"), "group", "minutes") for f in FIELDS],
    *[Level("side", f, ("fixture_key", "team_key"), "group", "minutes") for f in FIELDS],
    *[Level("round", f, ("season", "gw"), "group", "minutes") for f in FIELDS],
]


def measured_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current player_match rows in which everything that is no measurement is NULL.

    A measurement is a number from 0 to 5; and where all of a side's valid values of a field
    are zero, that side was not measured in that field.
    """
    ids = ["player_key", "fixture_key", "team_key", "season", "gw", "minutes"]
    pm = table(spark, sf_dir, "player_match").select(*ids, *FIELDS, *_HELPERS, "available_at")
    cur = current_rows(pm, ["player_key", "fixture_key"], [F.desc_nulls_last("available_at")]).drop("available_at")
    value = lambda c: F.when(F.col(c).cast("double").between(0, 5), F.col(c).cast("double")).alias(c)
    cur = cur.select(*ids, *[value(f) for f in [*FIELDS, "us_xg", "fpl_xa"]], "us_shots", "us_goals", "us_npg", "us_key_passes")
    # read by the side rule, the mining and the filling: one sort of the deliveries instead of four
    cur = cur.persist(StorageLevel.MEMORY_AND_DISK)
    blank = (
        cur.groupBy("fixture_key", "team_key")
        .agg(*[(F.max(f) == 0).alias(f"z_{f}") for f in FIELDS])
        .filter(" or ".join(f"z_{f}" for f in FIELDS))
    )
    blank = broadcast_if_small(blank.withColumnRenamed("fixture_key", "zf").withColumnRenamed("team_key", "zt"))
    on = F.col("fixture_key").eqNullSafe(F.col("zf")) & F.col("team_key").eqNullSafe(F.col("zt"))
    cur = cur.join(blank, on, "left")
    return cur.select(
        *ids,
        *[F.when(~F.coalesce(F.col(f"z_{f}"), F.lit(False)), F.col(f)).alias(f) for f in FIELDS],
        "us_xg", "fpl_xa", "us_shots", "us_goals", "us_npg", "us_key_passes",
    )


def _filled(rows: DataFrame) -> DataFrame:
    return fill_missing(rows, ["player_key", "fixture_key"], FIELDS, P1_LEVELS, needs="minutes > 0", bounds=(0.0, 5.0))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = _filled(measured_matches(spark, sf_dir))
    return filled.filter(F.col("filled_by").isNotNull()).select("player_key", "fixture_key", "field")


def p1_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filled cell with its value, the level that filled it and its support."""
    return _filled(measured_matches(spark, sf_dir)).withColumn("value", F.round("value", 6))


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current rows of players on the pitch with every field filled and marked."""
    rows = measured_matches(spark, sf_dir).filter("minutes > 0")
    wide = _filled(rows).groupBy("player_key", "fixture_key").agg(
        *[F.max(F.when(F.col("field") == f, F.struct("value", "filled_by"))).alias(f"_{f}") for f in FIELDS]
    )
    out = rows.join(wide, ["player_key", "fixture_key"], "left")
    return out.select(
        "player_key", "fixture_key", "season", "gw", "team_key", "minutes",
        *[F.round(F.coalesce(F.col(f), F.col(f"_{f}.value")), 6).alias(f) for f in FIELDS],
        *[F.coalesce(F.col(f"_{f}.filled_by"), F.lit("measured")).alias(f"{f}_source") for f in FIELDS],
    )


P1_SQL = """
with cur as (
  select * from player_match
  qualify row_number() over (partition by player_key, fixture_key order by available_at desc) = 1),
v as (
  select player_key, fixture_key, team_key, minutes,
    case when us_npxg between 0 and 5 and not isnan(us_npxg) then us_npxg end a,
    case when us_xa between 0 and 5 and not isnan(us_xa) then us_xa end b,
    case when fpl_xg between 0 and 5 and not isnan(fpl_xg) then fpl_xg end c from cur),
side as (select fixture_key, team_key, max(a) = 0 za, max(b) = 0 zb, max(c) = 0 zc from v group by all),
j as (select v.*, za, zb, zc from v join side using (fixture_key, team_key) where minutes > 0)
select player_key, fixture_key, 'us_npxg' as field from j where a is null or za
union all select player_key, fixture_key, 'us_xa' from j where b is null or zb
union all select player_key, fixture_key, 'fpl_xg' from j where c is null or zc
"""

# ---------------------------------------------------------------- problem 2


def player_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = table(spark, sf_dir, "player_snapshot").select(
        "player_key",
        micros("snapshot_at").alias("snapshot_us"),
        (F.col("source") == "fpl").cast("int").alias("own"),
        micros("available_at").alias("available_us"),
        "now_cost",
        F.lower(F.trim("status")).alias("status"),
        "chance_of_playing_next_round",
    )
    attrs = ["now_cost", "status", "chance_of_playing_next_round"]
    how = ("player_key", "snapshot_us", attrs, ["own", "available_us"])
    # two deliveries, as a table that grows gets them: the second one meets the versions the first one left open
    edge = ps.agg(F.min("snapshot_us").alias("a"), F.max("snapshot_us").alias("b")).first()
    if edge.a is None:
        return scd2_merge(None, ps, *how)
    half = edge.a + (edge.b - edge.a) // 2
    ensure_checkpoint_dir(spark)
    first = scd2_merge(None, ps.filter(F.col("snapshot_us") <= half), *how).checkpoint()
    return scd2_merge(first, ps.filter(F.col("snapshot_us") > half), *how)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_history(spark, sf_dir).select(
        "player_key", "valid_from_us", F.coalesce("valid_to_us", F.lit(0).cast("long")).alias("valid_to_us")
    )


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_history(spark, sf_dir).select(
        "player_key", "now_cost", "status", "chance_of_playing_next_round",
        "valid_from_us", "valid_to_us",
        F.col("valid_to_us").isNull().alias("is_current"),
    )


_P2_CTE = """
with inst as (select snapshot_at, row_number() over (order by snapshot_at) k, lead(snapshot_at) over (order by snapshot_at) nxt
              from (select distinct snapshot_at from player_snapshot)),
st as (select player_key, snapshot_at, now_cost, lower(trim(status)) status, chance_of_playing_next_round ch
       from player_snapshot
       qualify row_number() over (partition by player_key, snapshot_at order by (source = 'fpl') desc, available_at desc) = 1),
f as (select st.*, k, nxt, case when lag(k) over w = k - 1 and lag(now_cost) over w = now_cost
        and lag(status) over w is not distinct from status and lag(ch) over w is not distinct from ch then 0 else 1 end brk
      from st join inst using (snapshot_at) window w as (partition by player_key order by k)),
g as (select *, sum(brk) over (partition by player_key order by k) isl from f),
v as (select player_key, isl, any_value(now_cost) now_cost, any_value(status) status, max(ch) ch,
        min(snapshot_at) a, max(k) kl, arg_max(nxt, k) b from g group by player_key, isl),
h as (select v.*, i.nxt b2 from v join inst i on i.k = v.kl)
"""
P2_SQL = _P2_CTE + "select player_key, epoch_us(a) as valid_from_us, coalesce(epoch_us(b2), 0) as valid_to_us from h"
P2_HISTORY_SQL = _P2_CTE + (
    "select player_key, now_cost, status, ch as chance_of_playing_next_round, epoch_us(a) as valid_from_us, epoch_us(b2) as valid_to_us,"
    " b2 is null as is_current from h"
)

# ---------------------------------------------------------------- problem 3


def raw_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_fixture_row")
    cell = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).alias("text"))
    cells = raw.select("row_id", "feed", F.explode(F.array(cell("kickoff"), cell("deadline_time"))).alias("c"))
    return normalise_times(cells.select("row_id", "feed", "c.field", "c.text"), table(spark, sf_dir, "feed"), "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_times(spark, sf_dir).filter("instant_us is not null").select("row_id", "field", "instant_us")


def p3_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with its instant, or why it names none."""
    return raw_times(spark, sf_dir)


# ---------------------------------------------------------------- problem 4


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = complete_deliveries(table(spark, sf_dir, "run_manifest")).select("season", "run_id", micros("captured_at").alias("at"))
    rows = table(spark, sf_dir, "bootstrap_element").select(
        "season", "run_id", "id", F.expr("try_cast(trim(now_cost) as decimal(18,4))").alias("cost")
    )
    return merkle_diff(rows, runs, ["season"], "run_id", "at", "id", "cost")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_changes(spark, sf_dir).select("season", "run_id", "id", "change")


def p4_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_changes(spark, sf_dir).select(
        "season", "run_id", "id", "change", F.col("old_value").cast("double").alias("old_cost"), F.col("new_value").cast("double").alias("new_cost")
    )


P4_SQL = """
with runs as (select season, run_id, row_number() over (partition by season order by captured_at) seq from run_manifest
              where len(failed) = 0 and list_sort(list_distinct(expected)) = list_sort(list_distinct(written))),
held as (select season, seq, id, max(try_cast(trim(now_cost) as decimal(18,4))) cost
         from bootstrap_element join runs using (season, run_id) where id is not null group by all),
cur as (select h.season, h.seq, h.id, h.cost from held h where h.seq > 1),
prev as (select h.season, h.seq + 1 as seq, h.id, h.cost from held h
         where h.seq < (select max(seq) from runs r where r.season = h.season)),
d as (select coalesce(c.season, p.season) season, coalesce(c.seq, p.seq) seq, coalesce(c.id, p.id) id,
        c.id is not null now, p.id is not null was, c.cost new_cost, p.cost old_cost
      from cur c full join prev p on c.season = p.season and c.seq = p.seq and c.id = p.id)
select d.season, runs.run_id, d.id, case when now and not was then 'added' when was and not now then 'removed' else 'changed' end as change{more}
from d join runs on runs.season = d.season and runs.seq = d.seq
where not (now and was and new_cost is not distinct from old_cost)
"""

# ---------------------------------------------------------------- problem 5


def prices_at_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pm = table(spark, sf_dir, "player_match")
    gw = broadcast_if_small(table(spark, sf_dir, "gameweek").select("season", "gw", micros("deadline_time").alias("at_us")))
    matches = (
        pm.groupBy("player_key", "fixture_key")
        .agg(F.max_by("season", "available_at").alias("season"), F.max_by("gw", "available_at").alias("gw"))
        .join(gw, ["season", "gw"])
        .select(F.lit("match").alias("event_kind"), "player_key", "season", F.col("fixture_key").alias("event_key"), "at_us")
    )
    bans = (
        table(spark, sf_dir, "ban_event")
        .select(F.lit("ban").alias("event_kind"), "player_key", "season", F.col("ban_key").alias("event_key"), micros("event_time").alias("at_us"))
        .distinct()
    )
    ps = table(spark, sf_dir, "player_snapshot").select(
        "player_key",
        "season",
        (micros("snapshot_at") * 2 + (F.col("source") == "fpl").cast("long")).alias("reading"),
        micros("available_at").alias("known_us"),
        "now_cost",
    )
    return attributes_at_event(ps, matches.unionByName(bans), ["player_key", "season"], "reading", "known_us", "now_cost", "at_us")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices_at_events(spark, sf_dir).select(
        "event_kind", "player_key", "event_key", F.floor(F.col("reading") / 2).alias("seen_us"), "now_cost"
    )


P5_SQL = """
with ev as (
  select 'match' as event_kind, player_key, season, fixture_key as event_key, deadline_time as t
  from (select player_key, fixture_key, arg_max(season, available_at) season, arg_max(gw, available_at) gw
        from player_match group by all) join gameweek using (season, gw)
  union all
  select distinct 'ban', player_key, season, ban_key, event_time from ban_event)
select event_kind, player_key, event_key, epoch_us(snapshot_at) as seen_us, now_cost from (
  select ev.*, s.snapshot_at, s.now_cost,
    row_number() over (partition by event_kind, ev.player_key, event_key
                       order by s.snapshot_at desc, (s.source = 'fpl') desc, s.available_at desc) rn
  from ev join player_snapshot s on s.player_key = ev.player_key and s.season = ev.season and s.available_at < ev.t)
where rn = 1
"""

# ---------------------------------------------------------------- problem 6


def daily_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pm = table(spark, sf_dir, "player_match").select(
        "player_key", "fixture_key", micros("kickoff_time").alias("kickoff_us"), "minutes", "starts", "available_at"
    )
    cur = current_rows(pm, ["player_key", "fixture_key"], [F.desc_nulls_last("available_at")])
    day = F.floor(F.col("kickoff_us") / DAY_US).cast("int")
    return cur.withColumn("day", day).groupBy("player_key", "day").agg(F.sum("minutes").alias("minutes"), F.sum("starts").alias("starts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trailing_totals(daily_minutes(spark, sf_dir), "player_key", "day", ["minutes", "starts"], [7, 30], ("minutes", 7, 225))
    return t.select(
        "player_key", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("day"), "minutes_7d", "minutes_30d"
    )


def p6_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player and day with totals and averages, days without a match included."""
    t = trailing_totals(daily_minutes(spark, sf_dir), "player_key", "day", ["minutes", "starts"], [7, 30])
    return t.withColumn("day", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd"))


_P6_CTE = """
with cur as (select player_key, fixture_key, minutes, starts, cast(kickoff_time at time zone 'UTC' as date) d from player_match
             qualify row_number() over (partition by player_key, fixture_key order by available_at desc) = 1),
daily as (select player_key, d, sum(minutes) m, sum(starts) s from cur group by all),
grid as (select player_key, cast(unnest(generate_series(min(d), max(d) + 29, interval 1 day)) as date) d from daily group by player_key),
x as (select g.player_key, g.d, coalesce(m, 0) m, coalesce(s, 0) s from grid g left join daily using (player_key, d)),
t as (select player_key, d, sum(m) over w7 m7, sum(m) over w30 m30, sum(s) over w7 s7, sum(s) over w30 s30 from x
      window w7 as (partition by player_key order by d rows 6 preceding), w30 as (partition by player_key order by d rows 29 preceding))
"""
P6_SQL = _P6_CTE + (
    "select player_key, strftime(d, '%Y-%m-%d') as day, cast(m7 as bigint) as minutes_7d, cast(m30 as bigint) as minutes_30d"
    " from t where m7 >= 225"
)
P6_ROLLING_SQL = _P6_CTE + (
    "select player_key, strftime(d, '%Y-%m-%d') as day, cast(m7 as bigint) as minutes_7d, cast(m30 as bigint) as minutes_30d,"
    " cast(s7 as bigint) as starts_7d, cast(s30 as bigint) as starts_30d, m7 / 7 as minutes_avg_7d, m30 / 30 as minutes_avg_30d,"
    " s7 / 7 as starts_avg_7d, s30 / 30 as starts_avg_30d from t"
)

QUERIES = {
    "p1_found": (p1_found, P1_SQL),
    "p1_fill": (p1_fill, None),
    "p1_table": (p1_table, None),
    "p2_found": (p2_found, P2_SQL),
    "p2_history": (p2_history, P2_HISTORY_SQL),
    "p3_found": (p3_found, None),
    "p3_verdicts": (p3_verdicts, None),
    "p4_found": (p4_found, P4_SQL.format(more="")),
    "p4_changes": (p4_changes, P4_SQL.format(more=", cast(old_cost as double) as old_cost, cast(new_cost as double) as new_cost")),
    "p5_found": (p5_found, P5_SQL),
    "p6_found": (p6_found, P6_SQL),
    "p6_rolling": (p6_rolling, P6_ROLLING_SQL),
}
