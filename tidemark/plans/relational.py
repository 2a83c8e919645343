"""Projections, joins, aggregates, windows, top-n and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.engine.scale import broadcast_if_small, one_row
from tidemark.engine.session import micros, table
from tidemark.operators import relational as R
from tidemark.plans.registry import collector

QUERIES, query = collector()

# ---------------------------------------------------------------- projections, filters, predicates


@query("select cast(l_orderkey as bigint) as l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(l_quantity as double) as q from lineitem order by l_orderkey, l_linenumber limit 1000")
def typed_projection_ordered(spark, d):
    """Exactly these columns and types in a stable order (a report of the first thousand)."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("double").alias("q"))
    return li.orderBy("l_orderkey", "l_linenumber").limit(1000)


@query("select cast(l_orderkey as bigint) as l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(l_quantity as double) as q from lineitem order by l_orderkey, l_linenumber, q")
def typed_projection_whole(spark, d):
    """Exactly these columns and types of every row; the keys repeat, so the quantity settles their order."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("double").alias("q"))
    return li.orderBy(*[F.asc_nulls_last(c) for c in ("l_orderkey", "l_linenumber", "q")])


@query("select season * 10000000 + fpl_fixture_id as composite_key, fixture_key from (select distinct season, fpl_fixture_id, fixture_key from fixture)")
def composite_rekey(spark, d):
    f = table(spark, d, "fixture").select("season", "fpl_fixture_id", "fixture_key").distinct()
    return f.select((F.col("season") * 10_000_000 + F.col("fpl_fixture_id")).alias("composite_key"), "fixture_key")


@query("select c_custkey, c_mktsegment from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def membership_filter(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(broadcast_if_small(n), "c_nationkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("select o_orderkey, case when o_totalprice < 50000 then 'low' when o_totalprice < 150000 then 'mid' else 'high' end as class from orders where o_totalprice between 20000 and 200000")
def between_and_conditional(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_totalprice").between(20000, 200000))
    c = F.when(F.col("o_totalprice") < 50000, "low").when(F.col("o_totalprice") < 150000, "mid").otherwise("high")
    return o.select("o_orderkey", c.alias("class"))


_CUR = "cur as (select * from player_match qualify row_number() over (partition by player_key, fixture_key order by available_at desc) = 1)"


def current_matches(spark, d):
    from tidemark.engine.scale import current_rows

    return current_rows(table(spark, d, "player_match"), ["player_key", "fixture_key"], [F.desc_nulls_last("available_at")])


@query(f"""with {_CUR}, v as (select player_key, fixture_key,
 case when us_xg between 0 and 5 and not isnan(us_xg) then us_xg end u, case when fpl_xg between 0 and 5 and not isnan(fpl_xg) then fpl_xg end f from cur)
select player_key, fixture_key, round(coalesce(u, f), 6) as xg, case when u is not null then 'us' when f is not null then 'fpl' end as xg_source from v""")
def coalesce_with_source(spark, d):
    """First valid measurement of several sources, and which it was (NaN and out-of-range are no values)."""
    ok = lambda c: F.when(F.col(c).between(0, 5), F.col(c))
    m = current_matches(spark, d).select("player_key", "fixture_key", ok("us_xg").alias("u"), ok("fpl_xg").alias("f"))
    return m.select("player_key", "fixture_key", F.round(F.coalesce("u", "f"), 6).alias("xg"), F.when(F.col("u").isNotNull(), "us").when(F.col("f").isNotNull(), "fpl").alias("xg_source"))


@query(f"""with {_CUR}, v as (select player_key, fixture_key, case when us_xg between 0 and 5 and not isnan(us_xg) then us_xg end ux, case when us_xa between 0 and 5 and not isnan(us_xa) then us_xa end ua,
 case when fpl_xg between 0 and 5 and not isnan(fpl_xg) then fpl_xg end fx, case when fpl_xa between 0 and 5 and not isnan(fpl_xa) then fpl_xa end fa from cur)
select player_key, fixture_key, round(case when ux is not null and ua is not null then ux when fx is not null and fa is not null then fx end, 6) as xg,
 round(case when ux is not null and ua is not null then ua when fx is not null and fa is not null then fa end, 6) as xa from v""")
def coalesce_pairwise(spark, d):
    """Both values must come from one source."""
    ok = lambda c: F.when(F.col(c).between(0, 5), F.col(c))
    m = current_matches(spark, d)
    pair = lambda a, b: F.when(ok(a).isNotNull() & ok(b).isNotNull(), F.struct(ok(a).alias("xg"), ok(b).alias("xa")))
    p = F.coalesce(pair("us_xg", "us_xa"), pair("fpl_xg", "fpl_xa"))
    return m.select("player_key", "fixture_key", p.alias("p")).select("player_key", "fixture_key", F.round("p.xg", 6).alias("xg"), F.round("p.xa", 6).alias("xa"))


@query(f"""with {_CUR} select player_key, fixture_key, coalesce(defensive_contribution, clearances_blocks_interceptions + tackles + recoveries) as actions,
 coalesce(coalesce(defensive_contribution, clearances_blocks_interceptions + tackles + recoveries) >= 10, false) as reached from cur""")
def null_propagating_sum(spark, d):
    """NULL if a part is unknown; the provider's own count first; an unknown comparison counts as false."""
    a = F.coalesce("defensive_contribution", F.col("clearances_blocks_interceptions") + F.col("tackles") + F.col("recoveries"))
    return current_matches(spark, d).select("player_key", "fixture_key", a.alias("actions"), F.coalesce(a >= 10, F.lit(False)).alias("reached"))


@query("select event_id, least(greatest(round(value, 6), 10.0), 50.0) as clipped from events where value is not null")
def clip(spark, d):
    e = table(spark, d, "events").filter("value is not null")
    return e.select("event_id", F.least(F.greatest(F.round("value", 6), F.lit(10.0)), F.lit(50.0)).alias("clipped"))


@query("select distinct upper(trim(status)) as s, case lower(trim(status)) when 'a' then 0 when 'd' then 1 when 'i' then 2 when 's' then 3 when 'u' then 4 when 'n' then 5 else 6 end as code from player_snapshot")
def enum_encode(spark, d):
    codes = F.create_map(*[x for i, k in enumerate("adisun") for x in (F.lit(k), F.lit(i))])
    s = table(spark, d, "player_snapshot").select("status").distinct()
    return s.select(F.upper(F.trim("status")).alias("s"), F.coalesce(F.try_element_at(codes, F.lower(F.trim("status"))), F.lit(6)).alias("code")).distinct()


# ---------------------------------------------------------------- joins


@query("select o.o_orderkey, c.c_mktsegment, o.o_orderpriority from orders o join customer c on o.o_custkey = c.c_custkey")
def join_many_to_one(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.checked_join(o, table(spark, d, "customer"), ["c_custkey"], "inner", "m:1").select("o_orderkey", "c_mktsegment", "o_orderpriority")


@query("select c.c_custkey, count(o.o_orderkey) as n_orders from customer c left join orders o on o.o_custkey = c.c_custkey group by c.c_custkey")
def join_one_to_many_left(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    j = R.checked_join(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "left", "1:m")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("""with a as (select distinct player_key from player_snapshot), b as (select distinct player_key from ban_event)
select coalesce(a.player_key, b.player_key) as player_key, case when a.player_key is not null and b.player_key is not null then 'both' when a.player_key is not null then 'left_only' else 'right_only' end as side
from a full join b on a.player_key = b.player_key""")
def join_full_outer_indicator(spark, d):
    a = table(spark, d, "player_snapshot").select("player_key").distinct()
    b = table(spark, d, "ban_event").select("player_key").distinct()
    return R.outer_with_indicator(a, b, ["player_key"]).select("player_key", "side")


@query("""with k as (select distinct team_key from player_match), g as (select distinct season, gw from gameweek),
f as (select home_team_key team_key, season, gw, count(distinct fixture_key) n from fixture where gw is not null group by all)
select k.team_key, g.season, g.gw, coalesce(f.n, 0)::bigint as fixtures from k cross join g left join f on f.team_key = k.team_key and f.season = g.season and f.gw = g.gw""")
def dense_grid_fill(spark, d):
    """Every club with every gameweek, zero where it plays no home match."""
    keys = table(spark, d, "player_match").select("team_key").distinct()
    axis = table(spark, d, "gameweek").select("season", "gw")
    facts = table(spark, d, "fixture").filter("gw is not null").groupBy(F.col("home_team_key").alias("team_key"), "season", "gw").agg(F.countDistinct("fixture_key").alias("fixtures"))
    return R.dense_grid(keys, axis, facts, ["team_key", "season", "gw"], {"fixtures": 0})


@query("select s_suppkey from supplier where s_suppkey in (select l_suppkey from lineitem where l_discount > 0.09)")
def join_semi(spark, d):
    li = table(spark, d, "lineitem").filter("l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(li, "s_suppkey", "left_semi").select("s_suppkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def join_anti(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("""select 'snapshot' as origin, player_key from (select distinct player_key from player_snapshot where season = 2022)
union all select 'match', player_key from (select distinct player_key from player_match) where player_key not in (select player_key from player_snapshot where season = 2022)""")
def union_preferred_then_fallback(spark, d):
    a = table(spark, d, "player_snapshot").filter("season = 2022").select("player_key").distinct()
    b = table(spark, d, "player_match").select("player_key").distinct()
    return a.select(F.lit("snapshot").alias("origin"), "player_key").unionByName(b.join(a, "player_key", "left_anti").select(F.lit("match").alias("origin"), "player_key"))


@query(f"""with {_CUR}, s as (select fixture_key, season, team_key, player_key, gw from cur where minutes > 0),
g as (select season, gw, dense_rank() over (partition by season order by gw) o from (select distinct season, gw from s)),
x as (select s.*, o from s join g using (season, gw))
select a.season, a.team_key, a.o as gw_order, count(distinct a.player_key) as again from x a join x b on a.season = b.season and a.team_key = b.team_key and a.player_key = b.player_key and b.o = a.o - 1 group by all""")
def self_join_previous_order(spark, d):
    """Players of a side who also played in the previous round."""
    s = current_matches(spark, d).filter("minutes > 0").select("season", "team_key", "player_key", "gw")
    g = s.select("season", "gw").distinct().withColumn("gw_order", F.dense_rank().over(Window.partitionBy("season").orderBy("gw")).cast("long"))
    x = s.join(broadcast_if_small(g), ["season", "gw"]).select("season", "team_key", "player_key", "gw_order").distinct()
    prev = x.withColumn("gw_order", F.col("gw_order") + 1)
    return x.join(prev, ["season", "team_key", "player_key", "gw_order"], "left_semi").groupBy("season", "team_key", "gw_order").agg(F.count("*").alias("again"))


@query(f"""with {_CUR}, a as (select fixture_key, player_key, minutes, team_key from cur where minutes > 0),
b as (select fixture_key, player_key, us_minutes from cur where us_minutes is not null)
select a.player_key, count(*) as shared, count(*) filter (abs(a.minutes - b.us_minutes) <= 5) as together from a join b on a.fixture_key = b.fixture_key and a.player_key = b.player_key group by a.player_key""")
def join_conditional_count(spark, d):
    """Equi-join on the fixture, then how many pairs agree within a tolerance."""
    m = current_matches(spark, d)
    a = m.filter("minutes > 0").select("fixture_key", "player_key", "minutes")
    b = m.filter("us_minutes is not null").select("fixture_key", "player_key", "us_minutes")
    j = a.join(b, ["fixture_key", "player_key"])
    return j.groupBy("player_key").agg(F.count("*").alias("shared"), F.count(F.when(F.abs(F.col("minutes") - F.col("us_minutes")) <= 5, 1)).alias("together"))


@query("""with b as (select distinct ban_key, player_key, team_key, season, event_time, n_certain from ban_event),
s as (select distinct fixture_key, season, kickoff_time, home_team_key team_key from fixture where kickoff_time is not null and gw is not null union select distinct fixture_key, season, kickoff_time, away_team_key from fixture where kickoff_time is not null and gw is not null),
j as (select b.ban_key, s.fixture_key, n_certain, row_number() over (partition by b.ban_key order by s.kickoff_time, s.fixture_key) r from b join s on s.team_key = b.team_key and s.season = b.season and s.kickoff_time > b.event_time)
select ban_key, fixture_key, r as nth from j where r <= n_certain""")
def join_next_n_events(spark, d):
    """The club's next n matches after each ban: equi-join with a range residual, then the first n."""
    b = table(spark, d, "ban_event").select("ban_key", "player_key", "team_key", "season", "event_time", "n_certain").distinct()
    f = table(spark, d, "fixture").filter("kickoff_time is not null and gw is not null")
    s = R.unpivot_sides(f, ["fixture_key", "season", "kickoff_time"], {"team_key": "home_team_key"}, {"team_key": "away_team_key"}).drop("is_home").distinct()
    j = b.join(s, ["team_key", "season"]).filter("kickoff_time > event_time")
    w = Window.partitionBy("ban_key").orderBy("kickoff_time", "fixture_key")
    return j.withColumn("nth", F.row_number().over(w).cast("long")).filter("nth <= n_certain").select("ban_key", "fixture_key", "nth")


@query("select distinct f.fixture_key from fixture f where f.home_team_key not in (select team_key from team_dim) or f.away_team_key not in (select team_key from team_dim)")
def missing_key_report(spark, d):
    f = table(spark, d, "fixture")
    s = R.unpivot_sides(f, ["fixture_key"], {"team_key": "home_team_key"}, {"team_key": "away_team_key"})
    return s.join(table(spark, d, "team_dim").select("team_key"), "team_key", "left_anti").select("fixture_key").distinct()


# ---------------------------------------------------------------- aggregates


@query(f"""with {_CUR}, v as (select *, case when us_xg between 0 and 5 and not isnan(us_xg) then us_xg end x from cur)
select player_key, sum(minutes)::bigint as minutes, round(sum(x), 6) as xg, round(case when count(*) = count(x) then sum(x) end, 6) as xg_strict,
round(case when sum(case when x is not null then minutes end) > 0 then sum(x) / sum(case when x is not null then minutes end) * 90 end, 6) as xg_per90 from v group by player_key""")
def grouped_sums_nulls(spark, d):
    """Sum with min_count 1, strict sum, and a rate over the exposure where the value is known."""
    m = current_matches(spark, d).withColumn("x", F.when(F.col("us_xg").between(0, 5), F.col("us_xg")))
    return m.groupBy("player_key").agg(
        F.sum("minutes").alias("minutes"), F.round(R.sum_min_count("x"), 6).alias("xg"), F.round(R.strict_sum("x"), 6).alias("xg_strict"), F.round(R.rate_per("x", "minutes", 90.0), 6).alias("xg_per90")
    )


@query(f"""with {_CUR}, r as (select player_key, total_points, row_number() over (partition by player_key order by kickoff_time desc, fixture_key desc) r from cur)
select player_key, round(avg(total_points), 6) as mean_last5, count(*) as n from r where r <= 5 group by player_key""")
def mean_of_last_rows(spark, d):
    m = R.top_n(current_matches(spark, d), ["player_key"], [F.desc("kickoff_time"), F.desc("fixture_key")], 5)
    return m.groupBy("player_key").agg(F.round(F.avg("total_points"), 6).alias("mean_last5"), F.count("*").alias("n"))


@query("select season, gw, epoch_us(min(kickoff_time)) as first_us, epoch_us(max(kickoff_time)) as last_us, count(distinct fixture_key) as n from fixture where gw is not null group by season, gw")
def named_aggregation(spark, d):
    f = table(spark, d, "fixture").filter("gw is not null")
    return f.groupBy("season", "gw").agg(micros(F.min("kickoff_time")).alias("first_us"), micros(F.max("kickoff_time")).alias("last_us"), F.countDistinct("fixture_key").alias("n"))


@query("""with m as (select o_custkey, year(o_orderdate) y, sum(o_totalprice) t from orders group by all) select cast(y as bigint) as y, round(avg(t), 4) as mean_total, count(*) as customers from m group by y""")
def two_level_aggregation(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("y")).agg(F.sum("o_totalprice").alias("t"))
    return o.groupBy("y").agg(F.round(F.avg("t"), 4).alias("mean_total"), F.count("*").alias("customers"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as disc from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def tpch_q1_like(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc")
    )


@query("""select n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) as revenue from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey
join supplier s on l.l_suppkey = s.s_suppkey and s.s_nationkey = c.c_nationkey join nation n on s.s_nationkey = n.n_nationkey group by n.n_name""")
def tpch_q5_like(spark, d):
    li, o, c, s, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    s, n = broadcast_if_small(s.select("s_suppkey", "s_nationkey")), broadcast_if_small(n.select("n_nationkey", "n_name"))
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select event_type, count(*) as n, count(distinct user_id) as users from events group by event_type")
def value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("select o_custkey from orders group by o_custkey having count(distinct o_orderpriority) = 5")
def filter_by_distinct_count(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n")).filter("n = 5").select("o_custkey")


@query("select p_brand, round(quantile_cont(p_retailprice, 0.5), 4) as median_price, round(quantile_cont(p_retailprice, 0.75), 4) as p75, round(quantile_cont(p_retailprice, 0.9), 4) as p90 from part group by p_brand")
def quantiles(spark, d):
    q = lambda p: F.round(F.percentile("p_retailprice", F.lit(p)), 4)
    return table(spark, d, "part").groupBy("p_brand").agg(q(0.5).alias("median_price"), q(0.75).alias("p75"), q(0.9).alias("p90"))


@query("""with n as (select c_nationkey, c_mktsegment, count(*) n from customer group by all) select cast(c_nationkey as bigint) as c_nationkey, c_mktsegment, n from n
qualify row_number() over (partition by c_nationkey order by n desc, length(c_mktsegment), c_mktsegment) = 1""")
def mode_with_ties(spark, d):
    m = R.mode_by(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", [F.length("c_mktsegment"), F.col("c_mktsegment")])
    return m.select(F.col("c_nationkey").cast("long"), "c_mktsegment", "n")


@query("select user_id, arg_min(event_type, event_id) as first_type, arg_max(event_type, event_id) as last_type from events group by user_id")
def first_last_per_group(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"))


@query("""with p as (select o_custkey, case when isnan(x) then null else x end x from (select o_custkey, 1 - 1 / (1 + o_totalprice / 100000) x from orders))
select o_custkey, round(1 - exp(sum(ln(1 - x))), 6) as any_hit from p group by o_custkey having count(*) = count(x)""")
def product_aggregate(spark, d):
    """1 - Π(1 - p); an unknown factor makes it NULL."""
    p = 1 - 1 / (1 + F.col("o_totalprice") / 100000)
    o = table(spark, d, "orders").groupBy("o_custkey").agg((1 - R.strict_product(1 - p)).alias("h"))
    return o.filter("h is not null").select("o_custkey", F.round("h", 6).alias("any_hit"))


@query("select user_id, bool_or(event_type = 'error') as any_error, bool_and(value >= 0) as all_positive from events group by user_id")
def any_all(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("any_error"), F.bool_and(F.col("value") >= 0).alias("all_positive"))


@query("select n_regionkey::bigint as region, string_agg(n_name, '|' order by n_name) as names from nation group by n_regionkey")
def sorted_set_as_text(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), "|").alias("names"))


@query("""select now_cost, chance_of_playing_next_round as chance, epoch_us(min(snapshot_at)) as first_us from player_snapshot group by all""")
def first_seen(spark, d):
    """When each distinct combination was first delivered."""
    return table(spark, d, "player_snapshot").groupBy("now_cost", F.col("chance_of_playing_next_round").alias("chance")).agg(micros(F.min("snapshot_at")).alias("first_us"))


@query("""with m as (select user_id, round(median(value) filter (event_type = 'click'), 4) click, round(median(value) filter (event_type = 'view'), 4) as view, round(median(value) filter (event_type = 'purchase'), 4) purchase from events group by user_id)
select user_id, click, view, purchase from m where click is not null and view is not null and purchase is not null""")
def pivot_complete(spark, d):
    """Types as columns by median; only complete rows."""
    kinds = ["click", "view", "purchase"]
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.round(F.median("value"), 4))
    return p.na.drop(subset=kinds)


@query("select player_key, fixture_key, stat, value from (select distinct player_key, fixture_key, goals_scored, assists, saves from player_match) unpivot (value for stat in (goals_scored, assists, saves))")
def unpivot_columns(spark, d):
    m = table(spark, d, "player_match").select("player_key", "fixture_key", "goals_scored", "assists", "saves").distinct()
    return m.unpivot(["player_key", "fixture_key"], ["goals_scored", "assists", "saves"], "stat", "value")


@query("""with f as (select distinct fixture_key, home_team_key, away_team_key from fixture) select fixture_key, home_team_key as team_key, away_team_key as opponent_key, true as is_home from f union all select fixture_key, away_team_key, home_team_key, false from f""")
def unpivot_sides(spark, d):
    f = table(spark, d, "fixture").select("fixture_key", "home_team_key", "away_team_key").distinct()
    return R.unpivot_sides(f, ["fixture_key"], {"team_key": "home_team_key", "opponent_key": "away_team_key"}, {"team_key": "away_team_key", "opponent_key": "home_team_key"})


@query("select l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as wmean, round((sum(case when l_returnflag = 'R' then 1.0 else 0.0 end) + 0.25 * 20) / (count(*) + 20), 6) as shrunk from lineitem group by l_suppkey")
def weighted_and_shrunk(spark, d):
    returned = F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.round(R.weighted_mean("l_discount", "l_quantity"), 6).alias("wmean"), F.round(R.shrunk_ratio(returned, F.count("*"), 0.25, 20.0), 6).alias("shrunk")
    )


@query("""with b as (select case when value < 20 then 0 when value < 40 then 1 when value < 60 then 2 else 3 end band, value from events where value is not null)
select band, count(*) as n, round(avg(value), 6) as mean, round(min(value), 6) as low from b group by band""")
def banded_aggregate(spark, d):
    e = table(spark, d, "events").filter("value is not null").withColumn("band", R.band(F.col("value"), [0.0, 20.0, 40.0, 60.0, 80.0]))
    return e.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"))


@query("""select coalesce(c_mktsegment, 'all') as segment, cast(c_nationkey as bigint) as nation, round(sum(c_acctbal), 2) as bal, count(*) as n from customer group by grouping sets ((c_mktsegment, c_nationkey), (c_mktsegment), ())""")
def grouping_sets(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("tidemark_customer")
    return spark.sql(
        "select coalesce(c_mktsegment, 'all') as segment, cast(c_nationkey as bigint) as nation, round(sum(c_acctbal), 2) as bal, count(*) as n"
        " from tidemark_customer group by grouping sets ((c_mktsegment, c_nationkey), (c_mktsegment), ())"
    )


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select round(sum(case when l_returnflag = 'R' then l_quantity end) / sum(l_quantity), 6) as share from lineitem")
def captured_share(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))) / F.sum("l_quantity"), 6).alias("share"))


@query(f"""with {_CUR}, u as (select season, gw, stat, value, goals_scored from cur unpivot (value for stat in (saves, recoveries, tackles)))
select season, gw, stat from u group by all having sum(goals_scored) > 0 and count(value) > 0 and bool_and(value = 0)""".replace("from cur unpivot", "from (select season, gw, goals_scored, saves, recoveries, tackles from cur) unpivot"))
def placeholder_zero_blocks(spark, d):
    """(season, gameweek, column) blocks with goals in which every known value is zero."""
    m = current_matches(spark, d).select("season", "gw", "goals_scored", "saves", "recoveries", "tackles")
    u = m.unpivot(["season", "gw", "goals_scored"], ["saves", "recoveries", "tackles"], "stat", "value")
    g = u.groupBy("season", "gw", "stat").agg(F.sum("goals_scored").alias("g"), F.count("value").alias("n"), F.bool_and(F.col("value") == 0).alias("z"))
    return g.filter("g > 0 and n > 0 and z").select("season", "gw", "stat")


@query(f"""with {_CUR}, p as (select fixture_key, team_key, sum(goals_scored)::bigint g, sum(own_goals)::bigint og from cur group by all),
f as (select distinct on (fixture_key) fixture_key, home_team_key, away_team_key, home_goals from (select * from fixture order by fixture_key, available_at desc))
select f.fixture_key, f.home_goals, h.g + a.og as counted from f join p h on h.fixture_key = f.fixture_key and h.team_key = f.home_team_key join p a on a.fixture_key = f.fixture_key and a.team_key = f.away_team_key where f.home_goals <> h.g + a.og""")
def reconciliation(spark, d):
    """A fixture's goals against its players' goals and the opponents' own goals: rows that disagree."""
    p = current_matches(spark, d).groupBy("fixture_key", "team_key").agg(F.sum("goals_scored").alias("g"), F.sum("own_goals").alias("og"))
    f = table(spark, d, "fixture").groupBy("fixture_key").agg(F.max_by(F.struct("home_team_key", "away_team_key", "home_goals"), "available_at").alias("f")).select("fixture_key", "f.*")
    h = p.select("fixture_key", F.col("team_key").alias("home_team_key"), F.col("g").alias("hg"))
    a = p.select("fixture_key", F.col("team_key").alias("away_team_key"), F.col("og").alias("aog"))
    j = f.join(h, ["fixture_key", "home_team_key"]).join(a, ["fixture_key", "away_team_key"]).withColumn("counted", F.col("hg") + F.col("aog"))
    return j.filter("home_goals <> counted").select("fixture_key", "home_goals", "counted")


# ---------------------------------------------------------------- windows


@query(f"""with {_CUR} select fixture_key, player_key, team_key, row_number() over (partition by fixture_key, team_key order by minutes desc, player_key) as rank from cur where minutes > 0 qualify rank <= 11""")
def top_rows_per_group(spark, d):
    """The eleven with most minutes per side, ties by key."""
    w = Window.partitionBy("fixture_key", "team_key").orderBy(F.desc("minutes"), "player_key")
    m = current_matches(spark, d).filter("minutes > 0").withColumn("rank", F.row_number().over(w).cast("long"))
    return m.filter("rank <= 11").select("fixture_key", "player_key", "team_key", "rank")


@query("select season, gw, dense_rank() over (partition by season order by gw) as gw_order from gameweek")
def dense_rank_index(spark, d):
    return table(spark, d, "gameweek").select("season", "gw", F.dense_rank().over(Window.partitionBy("season").orderBy("gw")).cast("long").alias("gw_order"))


@query("""select p_partkey, ntile(4) over w as quarter, percent_rank() over w as pr, cume_dist() over w as cd,
nth_value(p_partkey, 2) over (w rows between unbounded preceding and unbounded following) as second
from part window w as (partition by p_brand order by p_retailprice, p_partkey)""")
def position_functions(spark, d):
    """Where each part stands among its brand's: quarter, percent rank, share at or below, and the brand's second part."""
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "part").select(
        "p_partkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"),
        F.nth_value("p_partkey", 2).over(whole).alias("second"),
    )


@query("select p_partkey, rank() over (partition by p_brand order by p_size desc) as rk, round(sum(p_retailprice) over (partition by p_brand) - p_retailprice, 4) as others from part")
def rank_and_sum_of_others(spark, d):
    w = Window.partitionBy("p_brand")
    return table(spark, d, "part").select("p_partkey", F.rank().over(w.orderBy(F.desc("p_size"))).cast("long").alias("rk"), F.round(F.sum("p_retailprice").over(w) - F.col("p_retailprice"), 4).alias("others"))


@query("""select event_id, lag(event_type) over w as before_type, lead(event_type) over w as after_type, round(last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 6) as last_purchase,
round(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 4) as running from events window w as (partition by user_id order by ts, event_id)""")
def lag_lead_fill_running(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select(
        "event_id", F.lag("event_type").over(w).alias("before_type"), F.lead("event_type").over(w).alias("after_type"),
        F.round(F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(up), 6).alias("last_purchase"), F.round(F.sum("value").over(up), 4).alias("running"),
    )


@query("select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows 4 preceding), 6) as mean5, count(*) over (partition by user_id) as n from events")
def rolling_mean_and_group_count(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean5"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))


@query("""with e as (select event_id, user_id, epoch_us(ts) t, value from events) select event_id, round(coalesce(sum(value) over (partition by user_id order by t range between 604800000000 preceding and 1 preceding), 0), 4) as week_before from e""")
def trailing_time_window(spark, d):
    """Σ over the seven days before, equal instants excluded."""
    e = table(spark, d, "events").withColumn("t", micros("ts"))
    return e.select("event_id", F.round(F.coalesce(R.trailing_sum_time("t", "value", ["user_id"], 604_800_000_000), F.lit(0.0)), 4).alias("week_before"))


@query(f"""with {_CUR}, x as (select player_key, fixture_key, minutes, row_number() over w i from cur window w as (partition by player_key order by kickoff_time, fixture_key)),
y as (select *, coalesce(max(case when minutes > 0 then i end) over (partition by player_key order by i rows between unbounded preceding and 1 preceding), 0) l from x)
select player_key, fixture_key, (i - 1 - l)::bigint as absent from y""")
def absence_run_lengths(spark, d):
    """Gaps and islands: matches missed in a row just before each match."""
    m = current_matches(spark, d).select("player_key", "fixture_key", "kickoff_time", "minutes")
    return R.absence_runs(m, ["player_key"], ["kickoff_time", "fixture_key"], F.coalesce(F.col("minutes"), F.lit(0)) == 0, "absent").select("player_key", "fixture_key", F.col("absent").cast("long"))


@query(f"""with {_CUR}, x as (select *, case when lag(team_key) over w is distinct from team_key then 1 else 0 end c from cur window w as (partition by player_key order by kickoff_time, fixture_key)),
y as (select *, sum(c) over (partition by player_key order by kickoff_time, fixture_key) isl from x)
select player_key, isl::bigint as spell, any_value(team_key) as team_key, count(*) as matches from y group by player_key, isl""")
def club_spells(spark, d):
    """Islands of consecutive matches for one club."""
    m = R.islands(current_matches(spark, d), ["player_key"], ["kickoff_time", "fixture_key"], "team_key", "spell")
    return m.groupBy("player_key", "spell").agg(F.first("team_key").alias("team_key"), F.count("*").alias("matches"))


@query("""with x as (select user_id, epoch_us(ts) t, event_id, case when epoch_us(ts) - lag(epoch_us(ts)) over w > 1800000000 or lag(ts) over w is null then 1 else 0 end c from events window w as (partition by user_id order by ts, event_id)),
y as (select *, sum(c) over (partition by user_id order by t, event_id) s from x) select user_id, s::bigint as session, count(*) as n, min(t) as start_us, max(t) as end_us from y group by user_id, s""")
def sessions(spark, d):
    """Sessions by a gap of half an hour (flag and running sum)."""
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = e.withColumn("c", F.when((F.col("t") - F.lag("t").over(w) > 1_800_000_000) | F.lag("t").over(w).isNull(), 1).otherwise(0))
    e = e.withColumn("session", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("t").alias("start_us"), F.max("t").alias("end_us"))


@query(f"""with {_CUR}, b as (select player_key, season * 100 + gw as blk, sum(minutes)::double s, count(*) c from cur group by all)
select player_key, blk, coalesce(sum(c) over w, 0)::bigint as n, sum(s) over w as total from b window w as (partition by player_key order by blk rows between unbounded preceding and 1 preceding)""")
def rows_of_earlier_blocks(spark, d):
    """Totals over all rows of earlier gameweek blocks; double rounds don't see each other."""
    b = current_matches(spark, d).groupBy("player_key", (F.col("season") * 100 + F.col("gw")).alias("blk")).agg(F.sum("minutes").cast("double").alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy("player_key").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    return b.select("player_key", "blk", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("n"), F.sum("s").over(w).alias("total"))


@query("""with s as (select snapshot_at, player_key, arg_max(now_cost, available_at) now_cost from player_snapshot where season = 2022 and source = 'fplcache' group by all),
m as (select max(snapshot_at) mat from s), r as (select player_key, arg_max(now_cost, snapshot_at) c0, arg_max(now_cost, snapshot_at) filter (snapshot_at <= mat - interval 7 day) c7, arg_max(now_cost, snapshot_at) filter (snapshot_at <= mat - interval 28 day) c28 from s, m group by player_key)
select player_key, (c0 - c7)::bigint as change_7d, (c0 - c28)::bigint as change_28d from r""")
def delta_vs_days_ago(spark, d):
    """Change against the newest reading at or before 7 and 28 days earlier: one conditional aggregation, no as-of joins."""
    s = table(spark, d, "player_snapshot").filter("season = 2022 and source = 'fplcache'").groupBy("snapshot_at", "player_key").agg(F.max_by("now_cost", "available_at").alias("now_cost"))
    newest = one_row(s.agg(F.max("snapshot_at").alias("at")))
    back = lambda n: F.max_by("now_cost", F.when(F.col("snapshot_at") <= F.col("at") - F.expr(f"interval {n} day"), F.col("snapshot_at")))
    g = s.withColumn("at", newest["at"]).groupBy("player_key").agg(F.max_by("now_cost", "snapshot_at").alias("c0"), back(7).alias("c7"), back(28).alias("c28"))
    return g.select("player_key", (F.col("c0") - F.col("c7")).alias("change_7d"), (F.col("c0") - F.col("c28")).alias("change_28d"))


@query("""with s as (select * from player_snapshot qualify row_number() over (partition by season, player_key, snapshot_at order by (source = 'fpl') desc, available_at desc, now_cost desc) = 1),
m as (select season, max(snapshot_at) mat from s group by season), r as (select season, player_key, arg_max(now_cost, snapshot_at) c0, arg_max(now_cost, snapshot_at) filter (snapshot_at <= mat - interval 7 day) c7,
arg_max(now_cost, snapshot_at) filter (snapshot_at <= mat - interval 28 day) c28 from s join m using (season) group by season, player_key)
select season, player_key, (c0 - c7)::bigint as change_7d, (c0 - c28)::bigint as change_28d from r""")
def deltas_of_all_seasons(spark, d):
    """``delta_vs_days_ago`` of every season over both sources, fpl preferred at the same instant."""
    rank = F.struct((F.col("source") == "fpl").alias("p"), F.col("available_at").alias("at"), F.col("now_cost").alias("c"))
    s = table(spark, d, "player_snapshot").groupBy("season", "player_key", "snapshot_at").agg(F.max_by("now_cost", rank).alias("now_cost"))
    newest = table(spark, d, "player_snapshot").groupBy("season").agg(F.max("snapshot_at").alias("at"))
    back = lambda n: F.max_by("now_cost", F.when(F.col("snapshot_at") <= F.col("at") - F.expr(f"interval {n} day"), F.col("snapshot_at")))
    g = s.join(broadcast_if_small(newest), "season").groupBy("season", "player_key").agg(F.max_by("now_cost", "snapshot_at").alias("c0"), back(7).alias("c7"), back(28).alias("c28"))
    return g.select("season", "player_key", (F.col("c0") - F.col("c7")).alias("change_7d"), (F.col("c0") - F.col("c28")).alias("change_28d"))


# ---------------------------------------------------------------- order, dedup, sets


@query("select o_orderkey, o_custkey from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 500")
def mixed_direction_sort(spark, d):
    return table(spark, d, "orders").orderBy(F.asc_nulls_last("o_orderpriority"), F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(500).select("o_orderkey", "o_custkey")


@query("select o_orderkey, o_custkey, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) as position from orders")
def mixed_direction_positions(spark, d):
    """Every row with its place in the mixed order: rows before its price band, and its rank within the band."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    cuts = one_row(o.agg(F.percentile_approx("o_totalprice", [i / 64 for i in range(1, 64)], 1000).alias("at")))["at"]
    o = o.withColumn("cuts", cuts).withColumn("band", F.when(F.col("o_totalprice").isNotNull(), F.expr("size(filter(cuts, c -> c <= o_totalprice))"))).drop("cuts")
    bands = o.groupBy("o_orderpriority", "band").agg(F.count("*").alias("n"))  # at most 65 bands a priority
    w = Window.orderBy(F.asc_nulls_last("o_orderpriority"), F.desc_nulls_last("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(F.col("o_orderpriority").alias("bp"), F.col("band").alias("bb"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("o_orderpriority", "band").orderBy(F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey"))
    o = o.withColumn("r", F.row_number().over(inner)).join(broadcast_if_small(bands), F.col("o_orderpriority").eqNullSafe(F.col("bp")) & F.col("band").eqNullSafe(F.col("bb")))
    return o.select("o_orderkey", "o_custkey", (F.col("ahead") + F.col("r")).alias("position"))


@query(f"with {_CUR} select player_key, fixture_key, total_points from cur")
def dedup_keep_newest(spark, d):
    return current_matches(spark, d).select("player_key", "fixture_key", "total_points")


@query("select count(*) as n from (select distinct * from player_match)")
def exact_duplicate_drop(spark, d):
    return table(spark, d, "player_match").dropDuplicates().agg(F.count("*").alias("n"))


@query("""with p as (select distinct p_partkey, p_brand, p_size, p_retailprice from part), a as (select * from p qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 3),
b as (select * from p qualify row_number() over (partition by p_brand order by p_size desc, p_partkey) <= 3) select p_partkey, p_brand from a union select p_partkey, p_brand from b""")
def union_of_two_top_n(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    w1 = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    w2 = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    x = p.withColumn("a", F.row_number().over(w1)).withColumn("b", F.row_number().over(w2))
    return x.filter("a <= 3 or b <= 3").select("p_partkey", "p_brand")


@query("""select a.p_partkey, a.p_brand from part a where not exists (select 1 from part b where b.p_brand = a.p_brand and b.p_retailprice <= a.p_retailprice and b.p_size >= a.p_size and (b.p_retailprice < a.p_retailprice or b.p_size > a.p_size))""")
def skyline(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return R.skyline(p, ["p_brand"], "p_partkey", ["p_retailprice"], ["p_size"]).select("p_partkey", "p_brand")


@query("select c_nationkey::bigint as k from customer union select s_nationkey from supplier")
def set_union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")).union(table(spark, d, "supplier").select(F.col("s_nationkey").cast("long"))).distinct()


@query("select c_nationkey::bigint as k from customer intersect select s_nationkey from supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").cast("long")))


@query("select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 45")
def set_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, d, "lineitem").filter("l_quantity > 45").select("l_partkey").distinct())


@query("select a.c_custkey, 'value' as kind, 'c_acctbal' as \"column\" from customer a where a.c_custkey % 100 = 0 and a.c_acctbal <> 0")
def compare_two_tables(spark, d):
    """Keyed differences between a table and a changed copy (every hundredth balance doubled)."""
    a = table(spark, d, "customer")
    b = a.withColumn("c_acctbal", F.when(F.col("c_custkey") % 100 == 0, F.col("c_acctbal") * 2).otherwise(F.col("c_acctbal")))
    return R.compare_tables(a, b, ["c_custkey"])
