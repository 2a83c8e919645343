"""Scalar functions on strings, times, probabilities; JSON and nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.engine.session import micros, table
from tidemark.functions import prob as P
from tidemark.functions import strings as S
from tidemark.functions import times as T
from tidemark.plans.registry import collector

QUERIES, query = collector()

# ---------------------------------------------------------------- strings


@query(r"""select player_key, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(first_name || ' ' || second_name)), '[-_/.]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as name from player_dim""")
def normalised_names(spark, d):
    n = S.normalise_name(F.concat_ws(" ", "first_name", "second_name"))
    return table(spark, d, "player_dim").select("player_key", n.alias("name"))


@query("select distinct season, printf('%d-%02d', season, (season + 1) % 100) as label, printf('%02d%02d', season % 100, (season + 1) % 100) as code, season::bigint as back from gameweek")
def season_labels(spark, d):
    g = table(spark, d, "gameweek").select("season").distinct().withColumn("label", S.season_label(F.col("season")))
    return g.select("season", "label", S.season_code(F.col("season")).alias("code"), S.season_of_label(F.col("label")).cast("long").alias("back"))


@query(r"""select c_custkey, 'token=<secret> id <uuid>' as text from customer""")
def redacted_text(spark, d):
    """Secrets and identifiers built around each customer's number are masked."""
    raw = F.concat(F.lit("token="), F.sha2(F.col("c_custkey").cast("string"), 256), F.lit(" id "), F.lit("0b1c2d3e-aaaa-4bbb-8ccc-0123456789ab"))
    return table(spark, d, "customer").select("c_custkey", S.redact(raw).alias("text"))


@query("select team_key, football_data_name, starts_with(football_data_name, 'Wold') as starts from team_dim")
def prefix_test(spark, d):
    return table(spark, d, "team_dim").select("team_key", "football_data_name", F.col("football_data_name").startswith("Wold").alias("starts"))


@query(r"""with n as (select distinct player_key, snapshot_at, news, regexp_extract(news, '(?i)(?:expected back|suspended until)\s+(\d{1,2})\s+([A-Za-z]{3})', 1) dd, regexp_extract(news, '(?i)(?:expected back|suspended until)\s+(\d{1,2})\s+([A-Za-z]{3})', 2) mm from player_snapshot where news is not null),
c as (select n.*, k, try_strptime(dd || ' ' || mm || ' ' || (year(snapshot_at at time zone 'UTC') + k)::varchar, '%d %b %Y')::date dt from n cross join (select unnest([-1, 0, 1]) k) where dd <> ''),
f as (select player_key, snapshot_at, min(dt) r from c where dt >= (snapshot_at at time zone 'UTC')::date - 60 and dt < (snapshot_at at time zone 'UTC')::date + 366 group by all)
select player_key, epoch_us(snapshot_at) as snapshot_us, strftime(r, '%Y-%m-%d') as returns from f""")
def news_return_dates(spark, d):
    """'Expected back DD Mon' with the year rolled into the window around the report."""
    s = table(spark, d, "player_snapshot").filter("news is not null").select("player_key", "snapshot_at", "news").distinct()
    r = s.withColumn("returns", T.rolled_date(F.col("news"), F.col("snapshot_at"), T.RETURN_DATE)).filter("returns is not null")
    return r.groupBy("player_key", "snapshot_at").agg(F.min("returns").alias("r")).select("player_key", micros("snapshot_at").alias("snapshot_us"), F.date_format("r", "yyyy-MM-dd").alias("returns"))


# ---------------------------------------------------------------- times


@query("""select distinct fixture_key, strftime(cast(kickoff_time at time zone 'Europe/London' as date), '%Y-%m-%d') as uk_date,
epoch_us((cast(kickoff_time at time zone 'Europe/London' as date) + interval 1 day + interval 9 hour)::timestamp at time zone 'Europe/London') as lockdown_us,
(year(kickoff_time at time zone 'UTC') - case when month(kickoff_time at time zone 'UTC') < 7 then 1 else 0 end)::bigint as season_start from fixture where kickoff_time is not null""")
def lockdown_times(spark, d):
    f = table(spark, d, "fixture").filter("kickoff_time is not null").select("fixture_key", "kickoff_time").distinct()
    k = F.col("kickoff_time")
    return f.select("fixture_key", F.date_format(T.local_date(k), "yyyy-MM-dd").alias("uk_date"), micros(T.lockdown_time(k)).alias("lockdown_us"), T.season_start_year(k).cast("long").alias("season_start")).distinct()


@query("""with k as (select distinct fixture_key, kickoff_time, cast(kickoff_time at time zone 'Europe/London' as date) dy from fixture where kickoff_time is not null),
w as (select *, isodow(dy) - 1 wd from k), b as (select *, case when wd between 1 and 3 then wd - 1 else (wd - 4 + 7) % 7 end back from w)
select fixture_key, epoch_us(least(((dy - back::int) + interval 15 hour)::timestamp at time zone 'Europe/London', kickoff_time - interval 1 hour)) as collected_us from b""")
def collection_times(spark, d):
    f = table(spark, d, "fixture").filter("kickoff_time is not null").select("fixture_key", "kickoff_time").distinct()
    return f.select("fixture_key", micros(T.collection_time(F.col("kickoff_time"))).alias("collected_us"))


@query("""with l as (select season, max(lockdown_time) m from gameweek group by season) select g.season, epoch_us(greatest(make_timestamptz(g.season, 6, 1, 0, 0, 0.0, 'UTC'), coalesce(l.m, make_timestamptz(1970, 1, 1, 0, 0, 0.0, 'UTC')))) as published_us from (select distinct season from gameweek) g left join l on l.season = g.season - 1""")
def publication_times(spark, d):
    g = table(spark, d, "gameweek")
    prev = g.groupBy((F.col("season") + 1).alias("season")).agg(F.max("lockdown_time").alias("m"))
    return g.select("season").distinct().join(prev, "season", "left").select("season", micros(T.publication_time(F.col("season"), F.col("m"))).alias("published_us"))


@query("select season, gw, round((epoch_us(last_kickoff) - epoch_us(first_kickoff)) / 86400000000.0, 6) as days from gameweek")
def fractional_days(spark, d):
    return table(spark, d, "gameweek").select("season", "gw", F.round(T.days_between(F.col("last_kickoff"), F.col("first_kickoff")), 6).alias("days"))


@query("""with t as (select row_id, trim(kickoff) k from raw_fixture_row where feed in ('coastdesk') and regexp_matches(trim(kickoff), '^\\d{2}/\\d{2}/(\\d{4}|\\d{2}) \\d{2}:\\d{2}$'))
select row_id, strftime(case when k like '__/__/____ %' then try_strptime(k, '%d/%m/%Y %H:%M') else try_strptime(k, '%d/%m/%y %H:%M') end, '%Y-%m-%d') as day from t""")
def two_date_formats(spark, d):
    r = table(spark, d, "raw_fixture_row").select("row_id", "feed", F.trim("kickoff").alias("k")).filter("feed = 'coastdesk'").filter(F.col("k").rlike(r"^\d{2}/\d{2}/(\d{4}|\d{2}) \d{2}:\d{2}$"))
    return r.select("row_id", F.date_format(T.parse_dates(F.col("k"), ["dd/MM/yyyy HH:mm", "dd/MM/yy HH:mm"]), "yyyy-MM-dd").alias("day"))


@query("""with n as (select min(deadline_time) a, max(deadline_time) b from gameweek where season = 2022), days as (select unnest(generate_series(cast(a at time zone 'Europe/London' as date), cast(b at time zone 'Europe/London' as date), interval 1 day))::date d from n),
t as (select d, (d + interval 22 hour)::timestamp at time zone 'Europe/London' night from days)
select strftime(d, '%Y-%m-%d') as day, epoch_us(night) as night_us, (select min(gw) from gameweek g where g.season = 2022 and g.deadline_time > night and g.deadline_time = (select min(deadline_time) from gameweek h where h.season = 2022 and h.deadline_time > night)) as next_gw from t""")
def nights_calendar(spark, d):
    """One row per local date at 22:00 between the first and last deadline, with the next gameweek: a forward as-of join."""
    from tidemark.operators.asof_join import asof_join

    g = table(spark, d, "gameweek").filter("season = 2022").select("season", "gw", "deadline_time", micros("deadline_time").alias("dl"))
    span = g.groupBy("season").agg(F.min("deadline_time").alias("a"), F.max("deadline_time").alias("b"))
    days = span.select("season", F.explode(F.sequence(T.local_date(F.col("a")), T.local_date(F.col("b")))).alias("day"))
    n = days.select("season", F.date_format("day", "yyyy-MM-dd").alias("day"), micros(T.at_local_hour(F.col("day"), 22)).alias("night_us"))
    return asof_join(n, g.select("season", "gw", "dl"), "night_us", "dl", ["season"], ["gw"], "forward", strict=True).select("day", "night_us", F.col("gw").alias("next_gw"))


@query("""select (select gw from gameweek where season = 2022 and deadline_time > timestamptz '2022-12-10 00:00:00+00' order by deadline_time limit 1) as next_gw, (select gw from gameweek where season = 2022 and deadline_time < timestamptz '2022-12-10 00:00:00+00' order by deadline_time desc limit 1) as started_gw""")
def next_and_last_event(spark, d):
    g = table(spark, d, "gameweek").filter("season = 2022")
    now = F.lit("2022-12-10 00:00:00").cast("timestamp")
    return g.agg(F.min_by("gw", F.when(F.col("deadline_time") > now, F.col("deadline_time"))).alias("next_gw"), F.max_by("gw", F.when(F.col("deadline_time") < now, F.col("deadline_time"))).alias("started_gw"))


# ---------------------------------------------------------------- probability (prices made from order data)


def _prices(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (1.5 + F.pmod("o_orderkey", F.lit(7)) * 0.35).alias("a"), (3.0 + F.pmod("o_orderkey", F.lit(5)) * 0.2).alias("b"), (2.2 + F.pmod("o_orderkey", F.lit(11)) * 0.4).alias("c"))
    return o


_PR = "with p as (select o_orderkey, 1.5 + (o_orderkey % 7) * 0.35 a, 3.0 + (o_orderkey % 5) * 0.2 b, 2.2 + (o_orderkey % 11) * 0.4 c from orders) "


@query(_PR + "select o_orderkey, round((1 / a) / (1 / a + 1 / b + 1 / c), 6) as pa, round((1 / b) / (1 / a + 1 / b + 1 / c), 6) as pb from p".replace("1 / ", "1.0::double / "))
def overround_shares(spark, d):
    p = _prices(spark, d)
    sa, sb, _ = P.overround_shares([F.col("a"), F.col("b"), F.col("c")])
    return p.select("o_orderkey", F.round(sa, 6).alias("pa"), F.round(sb, 6).alias("pb"))


@query()
def devig(spark, d):
    """Power and Shin probabilities of three prices (bisection inside an expression)."""
    x = F.array("a", "b", "c")
    p = _prices(spark, d).select("a", "b", "c").distinct()
    p = p.select("a", "b", "c", P.devig_power(x).alias("w"), P.devig_shin(x).alias("s"))
    return p.select("a", "b", "c", *[F.round(F.get(q, F.lit(i)), 8).alias(f"{n}{i}") for q, n in (("w", "power"), ("s", "shin")) for i in range(3)])


@query("""select o_orderkey, round(1 / (1 + pow(10.0, -((1400 + o_orderkey % 300) + 60 - (1350 + o_custkey % 400)) / 400.0)), 6) as expected, round(case when o_orderkey % 6 <= 1 then 1.0 when o_orderkey % 6 = 2 then 1.5 else (11 + o_orderkey % 6) / 8.0 end, 6) as g from orders""")
def elo_expectation(spark, d):
    o = table(spark, d, "orders")
    h, a = (1400 + F.col("o_orderkey") % 300).cast("double"), (1350 + F.col("o_custkey") % 400).cast("double")
    return o.select("o_orderkey", F.round(P.elo_expected(h, a), 6).alias("expected"), F.round(P.goal_multiplier((F.col("o_orderkey") % 6).cast("double")), 6).alias("g"))


@query("""with r as (select distinct l_quantity / 20.0 lam from lineitem) select round(lam, 4) as lam, round(exp(-lam) * pow(lam, 2) / 2, 8) as p2, round((select sum(floor(n / 3.0) * exp(-lam + n * ln(lam) - lgamma(n + 1.0))) from range(0, 41) t(n)), 8) as ef, round(2 * ln(lam) - lam - ln(2), 8) as ll from r""")
def poisson_functions(spark, d):
    lam = F.col("lam")
    r = table(spark, d, "lineitem").select((F.col("l_quantity") / 20.0).alias("lam")).distinct()
    return r.select(F.round(lam, 4).alias("lam"), F.round(F.get(P.poisson_pmf(lam, 5), F.lit(2)), 8).alias("p2"), F.round(P.poisson_expected_floor(lam, 3), 8).alias("ef"), F.round(P.poisson_log_likelihood(lam, F.lit(2)), 8).alias("ll"))


@query("""with r as (select distinct l_quantity / 20.0 m from lineitem) select round(m, 4) as m, round(1 - (select sum(exp(lgamma(n + 2.5) - lgamma(2.5) - lgamma(n + 1.0)) * pow(2.5 / (2.5 + m), 2.5) * pow(m / (2.5 + m), n)) from range(0, 3) t(n)), 8) as tail from r""")
def negative_binomial_tail(spark, d):
    r = table(spark, d, "lineitem").select((F.col("l_quantity") / 20.0).alias("m")).distinct()
    return r.select(F.round("m", 4).alias("m"), F.round(P.negbin_tail(F.col("m"), 2.5, 3), 8).alias("tail"))


@query("""with r as (select distinct l_quantity / 20.0 lh, l_discount * 10 + 0.5 la from lineitem), g as (select lh, la, h, a, exp(-lh - la + h * ln(lh) + a * ln(la) - lgamma(h + 1.0) - lgamma(a + 1.0)) * case when h = 0 and a = 0 then 1 + lh * la * 0.03 when h = 0 and a = 1 then 1 - lh * 0.03 when h = 1 and a = 0 then 1 - la * 0.03 when h = 1 and a = 1 then 1.03 else 1 end p from r, range(0, 11) x(h), range(0, 11) y(a))
select round(lh, 4) as lh, round(la, 4) as la, round(sum(case when h > a then greatest(p, 0) end) / sum(greatest(p, 0)), 6) as home, round(sum(case when h = a then greatest(p, 0) end) / sum(greatest(p, 0)), 6) as draw from g group by lh, la""")
def dixon_coles_outcomes(spark, d):
    r = table(spark, d, "lineitem").select((F.col("l_quantity") / 20.0).alias("lh"), (F.col("l_discount") * 10 + 0.5).alias("la")).distinct()
    m = r.withColumn("m", P.dixon_coles(F.col("lh"), F.col("la")))
    h, x, _ = P.outcome_probabilities(F.col("m"))
    return m.select(F.round("lh", 4).alias("lh"), F.round("la", 4).alias("la"), F.round(h, 6).alias("home"), F.round(x, 6).alias("draw"))


@query()
def handicap_probabilities(spark, d):
    r = table(spark, d, "lineitem").select((F.col("l_quantity") / 20.0).alias("lh")).distinct()
    m = r.withColumn("m", P.dixon_coles(F.col("lh"), F.lit(1.2)))
    return m.select("lh", *[F.round(P.handicap_probability(F.col("m"), x), 6).alias(n) for n, x in (("level", 0.0), ("half", -0.5), ("quarter", -0.25), ("one", -1.0))])


@query("""with q as (select o_custkey, list(0.1::double + (o_orderkey % 8) * 0.1::double order by o_orderkey) p from orders group by o_custkey), z as (select o_custkey, list_reduce(list_transform(p, lambda x: 1 - x), lambda a, b: a * b) none from q)
select o_custkey, round(1 - none, 6) as any_of from z""")
def poisson_binomial(spark, d):
    q = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(0.1 + (F.col("o_orderkey") % 8) * 0.1).alias("p"))
    return q.select("o_custkey", F.round(P.poisson_binomial_tail(F.col("p"), 1), 6).alias("any_of"))


@query("""with e as (select event_id, value / 100.0 x from events where value is not null) select event_id, round(case when x <= 0.1 then 0.05 when x >= 0.9 then 0.8 when x < 0.5 then 0.05 + (x - 0.1) * (0.3 - 0.05) / (0.5 - 0.1) else 0.3 + (x - 0.5) * (0.8 - 0.3) / (0.9 - 0.5) end, 8) as y from e""")
def piecewise_linear(spark, d):
    xs, ys = F.array(*[F.lit(v) for v in (0.1, 0.5, 0.9)]), F.array(*[F.lit(v) for v in (0.05, 0.3, 0.8)])
    e = table(spark, d, "events").filter("value is not null")
    return e.select("event_id", F.round(P.interpolate(F.col("value") / 100.0, xs, ys), 8).alias("y"))


@query("""with e as (select event_id, (event_id % 9 + 0.5) / 10.0 p, event_id % 3 = 0 hit, [0.2, 0.5, 0.3] q, (event_id % 3)::int c from events)
select event_id, round(-case when hit then ln(p) else ln(1 - p) end, 8) as ll, round(-ln(q[c + 1]), 8) as oll, round((pow(q[1] - case when c <= 0 then 1 else 0 end, 2) + pow(q[1] + q[2] - case when c <= 1 then 1 else 0 end, 2)) / 2, 8) as rps from e""")
def forecast_scores(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 9 + 0.5) / 10.0).alias("p"), (F.col("event_id") % 3).cast("int").alias("c"))
    q = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    hit = F.when(F.col("c") == 0, 1).otherwise(0)
    return e.select("event_id", F.round(P.log_loss(F.col("p"), hit), 8).alias("ll"), F.round(P.ordinal_log_loss(q, F.col("c")), 8).alias("oll"), F.round(P.ranked_probability_score(q, F.col("c")), 8).alias("rps"))


@query("""with g as (select user_id, count(*)::double n, count(*) filter (event_type = 'click')::double k from events group by user_id), w as (select user_id, n, k / n p, 1.6448536269514722 z from g)
select user_id, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 8) as low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 8) as high from w""")
def wilson_intervals(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.count(F.when(F.col("event_type") == "click", 1)).cast("double").alias("k"))
    lo, hi = P.wilson(F.col("k"), F.col("n"))
    return g.select("user_id", F.round(lo, 8).alias("low"), F.round(hi, 8).alias("high"))


# ---------------------------------------------------------------- JSON and nested values


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("""select season, run_id, f as file, list_contains(written, f) as arrived from (select season, run_id, written, unnest(expected) f from run_manifest)""")
def explode_array(spark, d):
    return table(spark, d, "run_manifest").select("season", "run_id", "written", F.explode("expected").alias("file")).select("season", "run_id", "file", F.array_contains("written", F.col("file")).alias("arrived"))


@query("""select season, run_id, coalesce(list_sort(list_filter(expected, lambda x: not list_contains(written, x))), []) as missing_list, len(failed)::bigint as n_failed from run_manifest""".replace("coalesce(list_sort(list_filter(expected, lambda x: not list_contains(written, x))), []) as missing_list", "array_to_string(list_sort(list_filter(expected, lambda x: not list_contains(written, x))), ',') as missing"))
def array_difference(spark, d):
    m = table(spark, d, "run_manifest")
    return m.select("season", "run_id", F.array_join(F.array_sort(F.array_except("expected", "written")), ",").alias("missing"), F.size("failed").cast("long").alias("n_failed"))


@query("""select season, element_id, player_key from (select season, element_id, min(player_key) player_key from player_snapshot group by all)""")
def map_per_group(spark, d):
    """A map id → key per season, built once and read back by key."""
    ids = table(spark, d, "player_snapshot").groupBy("season", "element_id").agg(F.min("player_key").alias("player_key"))
    maps = ids.groupBy("season").agg(F.map_from_entries(F.collect_list(F.struct("element_id", "player_key"))).alias("m"))
    return maps.select("season", F.explode("m").alias("element_id", "player_key"))


@query("select user_id, json_object('user', user_id, 'n', count(*), 'types', array_to_string(list_sort(list(distinct event_type)), ','))::varchar as doc from events group by user_id")
def json_documents(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))
    return g.select("user_id", F.to_json(F.struct(F.col("user_id").alias("user"), "n", "types")).alias("doc"))


@query("""with b as (select o_custkey, o_orderkey, o_totalprice from orders) select o_custkey, o_orderkey, l_linenumber::bigint as line, round(l_extendedprice, 2) as price from b join lineitem on l_orderkey = o_orderkey where l_quantity > 49""")
def nested_triple_explode(spark, d):
    """customer → orders → lines packed into nested arrays and exploded again."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    li = table(spark, d, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("line"), F.round("l_extendedprice", 2).alias("price"))).alias("lines"))
    packed = o.join(li, "o_orderkey").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "lines")).alias("orders"))
    x = packed.select("o_custkey", F.explode("orders").alias("o")).select("o_custkey", "o.o_orderkey", F.explode("o.lines").alias("l"))
    return x.select("o_custkey", "o_orderkey", "l.line", "l.price")


@query("""with c as (select user_id, d, count(*) n from (select user_id, cast(ts as date) d from events) group by all), l as (select user_id, list(n order by d) ns from c group by user_id)
select user_id, list_reduce(list_prepend(1::bigint, ns), lambda a, n: least(5, greatest(a - n, 0) + 1))::bigint as left_over from l""")
def capped_recurrence(spark, d):
    """Ordered fold per key: x' = min(5, max(x − n, 0) + 1) over daily counts."""
    c = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    a = c.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("d", "n"))).alias("s"))
    fold = F.aggregate("s", F.lit(1).cast("long"), lambda x, s: F.least(F.lit(5).cast("long"), F.greatest(x - s["n"], F.lit(0).cast("long")) + 1))
    return a.select("user_id", fold.alias("left_over"))
