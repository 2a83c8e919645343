"""Sources and sinks: landing files, manifests, JSON and CSV, validated writes, increments."""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine.scale import one_row
from tidemark.engine.session import ensure_checkpoint_dir, micros, table
from tidemark.operators.snapdiff import complete_deliveries
from tidemark.plans.registry import collector
from tidemark.sources import raw_store as RS
from tidemark.sources import sinks as K

QUERIES, query = collector()


def _shared(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex[:12]}"


@query("select season, run_id from run_manifest where len(failed) = 0 and list_sort(list_distinct(expected)) = list_sort(list_distinct(written))")
def complete_runs(spark, d):
    return complete_deliveries(table(spark, d, "run_manifest")).select("season", "run_id")


@query("select season, arg_max(run_id, captured_at) as run_id from run_manifest where len(failed) = 0 and list_sort(list_distinct(expected)) = list_sort(list_distinct(written)) group by season")
def newest_complete_run(spark, d):
    return complete_deliveries(table(spark, d, "run_manifest")).groupBy("season").agg(F.max_by("run_id", "captured_at").alias("run_id"))


@query("select source, epoch_us(snapshot_at) as at_us, count(distinct player_key) as players from player_snapshot group by all")
def union_of_two_archives(spark, d):
    """Two overlapping snapshot archives as one list (time, source)."""
    ps = table(spark, d, "player_snapshot").select("source", "snapshot_at", "player_key")
    both = ps.filter("source = 'fpl'").unionByName(ps.filter("source <> 'fpl'"))
    return both.groupBy("source", micros("snapshot_at").alias("at_us")).agg(F.countDistinct("player_key").alias("players"))


@query("select season, max(epoch_us(snapshot_at)) as newest_us from player_snapshot group by season")
def newest_per_season(spark, d):
    return table(spark, d, "player_snapshot").groupBy("season").agg(F.max(micros("snapshot_at")).alias("newest_us"))


@query("select c_custkey, c_name, c_nationkey::bigint as c_nationkey, round(c_acctbal, 2) as c_acctbal, c_mktsegment from customer")
def csv_round_trip(spark, d):
    """Written as gzip CSV with header and read again with names trimmed."""
    c = table(spark, d, "customer").withColumn("c_acctbal", F.round("c_acctbal", 2))
    path = _shared(spark)
    c.write.option("header", "true").option("compression", "gzip").csv(path)
    back = RS.read_csv(spark, path, schema=c.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    return back.withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


@query("select n_nationkey::bigint as key, n_name as name from nation")
def json_elements(spark, d):
    """One document per region with an array of nations, exploded from its text."""
    path = _shared(spark)
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))).alias("elements"))
    n.select(F.to_json(F.struct("elements")).alias("value")).coalesce(1).write.text(path)
    docs = spark.read.text(path).withColumn("doc", F.from_json("value", "elements array<struct<key:long,name:string>>"))
    return docs.select(F.explode("doc.elements").alias("e")).select("e.key", "e.name")


@query("select o_orderkey, o_orderstatus from orders")
def orc_round_trip(spark, d):
    path = _shared(spark)
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.orc(path)
    return spark.read.orc(path)


@query("select s_suppkey, s_name from supplier")
def validated_sink(spark, d):
    """Schema, constraints and key are checked before a sorted zstd write."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType())])
    path = _shared(spark)
    K.write_table(s, path, schema, [K.not_null("s_suppkey"), K.not_null("s_name")], ["s_suppkey"])
    return spark.read.parquet(path)


@query("""select 'value in [0, 50]' as "check", count(*) filter (value is not null and not (value between 0 and 50)) as failures from events
union all select 'event_type in set', count(*) filter (event_type not in ('click', 'view', 'purchase')) from events union all select 'user_id not null', count(*) filter (user_id is null) from events
union all select 'unique user_id, event_type', (select sum(c - 1)::bigint from (select count(*) c from events group by user_id, event_type))""")
def constraint_report(spark, d):
    e = table(spark, d, "events")
    checks = [K.in_range("value", 0, 50), K.one_of("event_type", ["click", "view", "purchase"]), K.not_null("user_id")]
    return K.constraint_report(e, checks, ["user_id", "event_type"])


@query("select p_partkey, p_name from part")
def incremental_append(spark, d):
    """Two overlapping batches end up as each key once."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    path = _shared(spark)
    K.append_new(spark, path, p.filter("p_partkey % 3 <> 0"), ["p_partkey"])
    K.append_new(spark, path, p.filter("p_partkey % 2 = 0 or p_partkey % 3 = 0"), ["p_partkey"])
    K.append_new(spark, path, p, ["p_partkey"])
    return spark.read.parquet(path)


@query("""with w as (select season, gw, deadline_time from gameweek where timestamptz '2022-09-02 12:00:00+00' >= deadline_time - interval 3 day and timestamptz '2022-09-02 12:00:00+00' < deadline_time)
select season, gw from w where not exists (select 1 from player_snapshot s where s.snapshot_at >= w.deadline_time - interval 3 day and s.snapshot_at < w.deadline_time)""")
def due_windows(spark, d):
    """Deadlines whose window is open now and that have no snapshot yet."""
    now = F.lit("2022-09-02 12:00:00").cast("timestamp")
    taken = table(spark, d, "player_snapshot").select("snapshot_at").distinct()
    return K.due(now, table(spark, d, "gameweek").select("season", "gw", "deadline_time"), taken, "deadline_time", "3 days").select("season", "gw")


@query("select source, epoch_us(max(snapshot_at)) as newest_us, max(snapshot_at) < timestamptz '2023-05-01 00:00:00+00' - interval 7 day as stale from player_snapshot where season = 2022 group by source")
def freshness(spark, d):
    now = F.lit("2023-05-01 00:00:00").cast("timestamp")
    f = K.freshness(table(spark, d, "player_snapshot").filter("season = 2022"), "snapshot_at", now, "7 days", ["source"])
    return f.select("source", micros("newest").alias("newest_us"), "stale")


@query("select season, run_id, epoch_us(captured_at) as at_us from run_manifest qualify dense_rank() over (partition by season order by captured_at desc) <= 3")
def retention(spark, d):
    return K.keep_newest(table(spark, d, "run_manifest"), ["season"], "captured_at", 3).select("season", "run_id", micros("captured_at").alias("at_us"))


@query("select sha256(string_agg(r_name, chr(10) order by r_name)) as fingerprint from (select distinct r_name from region)")
def content_fingerprint(spark, d):
    return K.content_fingerprint(table(spark, d, "region"), "r_name")


@query("select 'bootstrap' as endpoint, 3 as files, count(*)::int as players from region")
def raw_store_entries(spark, d):
    """A local landing area (tests and single machines): write-once files in three codecs, listed and read."""
    import lzma

    root = tempfile.mkdtemp(prefix="tidemark-raw-")
    people = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).collect()  # five rows at any scale
    body = json.dumps({"elements": [r.asDict() for r in people]}).encode()
    for i, (suffix, data) in enumerate(((".json", body), (".json.gz", RS.deterministic_gzip(body)), (".json.xz", lzma.compress(body)))):
        RS.write_once(root, RS.path_for("feed", "bootstrap", dt.datetime(2023, 1, 1, i, tzinfo=dt.UTC), suffix), data)
    e = RS.entries(spark, f"file://{root}", "feed")
    x = RS.read_json_elements(spark, f"file://{root}", "elements array<struct<id:long,name:string>>", "elements")
    n = x.agg(F.countDistinct("element.id").cast("int").alias("players"))
    return e.groupBy("endpoint").agg(F.count("*").cast("int").alias("files")).withColumn("players", one_row(n)["players"])


@query("select r_name as name, r_regionkey::bigint as key from region")
def jdbc_like_small_store(spark, d):
    """A small keyed store as JSON lines: upsert by key, newest wins."""
    path = _shared(spark)
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    old = r.withColumn("name", F.lower("name")).withColumn("v", F.lit(1))
    old.unionByName(r.withColumn("v", F.lit(2))).write.json(path)
    back = spark.read.schema("key long, name string, v int").json(path)
    return back.groupBy("key").agg(F.max_by("name", "v").alias("name")).select("name", "key")


