"""The general data problems against brute force, with NULLs, ties, repeats, empty tables and extra columns."""

import datetime as dt
import random
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.engine.scale import broadcast_if_small, current_rows
from tidemark.operators.event_attributes import attributes_at_event
from tidemark.operators.impute import Level, fill_missing
from tidemark.operators.rolling import banded, trailing_totals
from tidemark.operators.snapdiff import complete_deliveries, merkle_diff
from tidemark.operators.timenorm import normalise_times, offset_intervals

# ---------------------------------------------------------------- filling


def test_fill_uses_verified_dependency_then_group_then_overall(spark, rows):
    data = [(i, i % 7, 1.0 + i % 7, i % 3, 90) for i in range(60)]  # b follows a
    data += [(100, 3, None, 0, 90), (101, None, None, 1, 45), (102, None, None, 99, 90), (103, 3, None, 0, 0), (None, 3, None, 0, 90)]
    df = spark.createDataFrame(data, "id long, a long, b double, g long, minutes long").withColumn("value", F.lit("x")).withColumn("n", F.lit(1))
    levels = [Level("a", "b", ("a",)), Level("g", "b", ("g",), "group", "minutes")]
    got = {r.id: r for r in fill_missing(df, ["id"], ["b"], levels, needs="minutes > 0").collect()}
    assert set(got) == {100, 101, 102, None}
    assert got[100].filled_by == "a" and got[100].value == pytest.approx(4.0)
    assert got[None].filled_by == "a"
    assert got[101].filled_by == "g"
    per_minute = sum(r[2] for r in data[:60] if r[3] == 1) / (90 * sum(r[3] == 1 for r in data[:60]))
    assert got[101].value == pytest.approx(per_minute * 45)
    assert got[102].filled_by == "overall"


def test_fill_rejects_a_false_dependency_and_handles_empty(spark):
    rnd = random.Random(1)
    data = [(i, i % 5, rnd.random() * 5, 90) for i in range(100)] + [(200, 2, None, 90)]
    df = spark.createDataFrame(data, "id long, a long, b double, minutes long")
    levels = [Level("a", "b", ("a",)), Level("all", "b", ("minutes",), "group", "minutes")]
    assert [r.filled_by for r in fill_missing(df, ["id"], ["b"], levels).collect()] == ["all"]
    assert fill_missing(df.filter("false"), ["id"], ["b"], levels).count() == 0
    alone = fill_missing(df.filter("id = 200"), ["id"], ["b"], levels).collect()
    assert [(r.filled_by, r.value) for r in alone] == [("none", None)]


# ---------------------------------------------------------------- times

ZONES = ["Europe/London", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "UTC"]


def truth(local: dt.datetime, zone: str) -> set:
    z, out = zoneinfo.ZoneInfo(zone), set()
    for fold in (0, 1):
        u = local.replace(tzinfo=z, fold=fold).astimezone(dt.UTC)
        if u.astimezone(z).replace(tzinfo=None) == local:
            out.add(u)
    return out


def us(t: dt.datetime) -> int:
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)


def feeds(spark):
    rows = [(z, z, "mdy" if z.startswith("America") else "dmy") for z in ZONES] + [("ymd", "UTC", "ymd")]
    return spark.createDataFrame(rows, "feed string, home_zone string, date_order string")


def test_local_times_around_every_clock_change(spark):
    cells, want = [], {}
    rnd = random.Random(2)
    for zone in ZONES:
        edges = [i[0] // 1_000_000 for i in offset_intervals(zone) if 946_684_800 < i[0] // 1_000_000 < 2_000_000_000]
        for e in edges:
            for shift in (-3601, -1800, 0, 1800, 3599, 3600, rnd.randint(-90000, 90000)):
                local = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=e + shift)
                if not 1971 < local.year < 2037:
                    continue
                n = len(cells)
                cells.append((n, zone, local.strftime("%Y-%m-%d %H:%M:%S")))
                t = truth(local, zone)
                want[n] = ("local", us(t.pop())) if len(t) == 1 else ("ambiguous" if t else "nonexistent", None)
    got = normalise_times(spark.createDataFrame(cells, "id long, feed string, text string"), feeds(spark), "text")
    assert {r.id: (r.verdict, r.instant_us) for r in got.collect()} == want
    assert {v for v, _ in want.values()} == {"local", "ambiguous", "nonexistent"}


@pytest.mark.parametrize(
    ("text", "feed", "verdict", "instant"),
    [
        ("2022-10-30T01:30:00+01:00", "Europe/London", "instant", "2022-10-30T00:30:00+00:00"),
        ("30/10/2022 01:30", "Europe/London", "ambiguous", None),
        ("10/30/2022 1:30 PM", "America/New_York", "local", "2022-10-30T17:30:00+00:00"),
        ("12/31/2022 12:05 AM", "America/New_York", "local", "2022-12-31T05:05:00+00:00"),
        ("31.12.2022 18:00 Uhr", "America/New_York", "local", "2022-12-31T23:00:00+00:00"),
        ("29 Mar 2020 03:10 CEST", "Europe/London", "instant", "2020-03-29T01:10:00+00:00"),
        ("Sat,  03 Sep 2022 15:30:00 +0530", "UTC", "instant", "2022-09-03T10:00:00+00:00"),
        ("1489230000", "UTC", "instant", "2017-03-11T11:00:00+00:00"),
        ("1489230000123", "UTC", "instant", "2017-03-11T11:00:00.123000+00:00"),
        ("1489230000123456", "UTC", "instant", "2017-03-11T11:00:00.123456+00:00"),
        ("1489230000.5", "UTC", "instant", "2017-03-11T11:00:00.500000+00:00"),
        ("20170311T110000Z", "UTC", "instant", "2017-03-11T11:00:00+00:00"),
        ("11/03/17 11:00", "Europe/London", "local", "2017-03-11T11:00:00+00:00"),
        ("17/03/11 11:00", "ymd", "local", "2017-03-11T11:00:00+00:00"),
        ("2017-03-11", "UTC", "date", None),
        ("2017-02-29 10:00", "UTC", "none", None),
        ("2016-02-29 10:00", "UTC", "local", "2016-02-29T10:00:00+00:00"),
        ("25:61", "UTC", "none", None),
        ("0000-00-00 00:00:00", "UTC", "none", None),
        ("TBC", "UTC", "none", None),
        ("", "UTC", "none", None),
        (None, "UTC", "none", None),
        ("2017-03-11 10:00", None, "none", None),
        ("2017-03-11 10:00", "unknown", "none", None),
        ("2017-03-11T10:00:00Z", "unknown", "instant", "2017-03-11T10:00:00+00:00"),
        ("9" * 5000, "UTC", "none", None),
        ("2017-03-11 10:00 QZT", "UTC", "none", None),
    ],
)
def test_forms(spark, text, feed, verdict, instant):
    cells = spark.createDataFrame([(1, feed, text, 5)], "id long, feed string, text string, offset int")
    r = normalise_times(cells, feeds(spark), "text").collect()
    assert len(r) == 1 and r[0].offset == 5
    want = us(dt.datetime.fromisoformat(instant)) if instant else None
    assert (r[0].verdict, r[0].instant_us) == (verdict, want)


def test_no_cells_no_feeds(spark):
    none = spark.createDataFrame([], "id long, feed string, text string")
    assert normalise_times(none, feeds(spark), "text").count() == 0
    cells = spark.createDataFrame([(1, "a", "2017-03-11 10:00")], "id long, feed string, text string")
    assert normalise_times(cells, feeds(spark).filter("false"), "text").first().verdict == "none"


# ---------------------------------------------------------------- snapshot differences


def test_merkle_diff_equals_set_comparison(spark, rows):
    rnd = random.Random(3)
    data, state = [], {k: rnd.randint(1, 9) for k in range(300)}
    snaps = {}
    for run in range(6):
        for k in rnd.sample(range(330), 12):
            if k in state and rnd.random() < 0.4:
                del state[k]
            else:
                state[k] = rnd.randint(1, 9) if rnd.random() < 0.9 else None
        if run == 4:
            state = dict(snaps[3])  # an unchanged list
        snaps[run] = dict(state)
        data += [("g", 10 - run, k, v) for k, v in state.items()]
    data += data[:50] + [("g", 10, None, 4)]  # repeats, and a row without a key
    order = [("g", 10 - r, r) for r in range(6)] + [("h", 1, 0)]
    df = spark.createDataFrame(data, "grp string, run long, id long, v long").withColumn("leaf", F.lit("x")).withColumn("seq", F.lit(1))
    manifest = spark.createDataFrame(order, "grp string, run long, at long")
    got = merkle_diff(df, manifest, ["grp"], "run", "at", "id", "v", fanout=4, depth=3)
    want = []
    for r in range(1, 6):
        a, b = snaps[r - 1], snaps[r]
        want += [("g", 10 - r, k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if (k in a) != (k in b) or a.get(k) != b.get(k)]
    assert rows(got, "grp", "run", "id", "change") == sorted(want)
    assert merkle_diff(df.filter("false"), manifest, ["grp"], "run", "at", "id", "v").count() == 0
    assert merkle_diff(df, manifest.filter("false"), ["grp"], "run", "at", "id", "v").count() == 0


def test_list_that_lost_all_rows(spark, rows):
    df = spark.createDataFrame([("g", 1, 7, 1)], "grp string, run long, id long, v long")
    m = spark.createDataFrame([("g", 1, 0), ("g", 2, 1), ("g", 3, 2)], "grp string, run long, at long")
    assert rows(merkle_diff(df, m, ["grp"], "run", "at", "id", "v"), "run", "id", "change") == [(2, 7, "removed")]


def test_complete_deliveries(spark, rows):
    data = [(1, ["a", "b"], ["b", "a"], []), (2, ["a", "b"], ["a"], []), (3, ["a"], ["a"], ["x"]), (4, None, ["a"], []), (5, ["a"], ["a"], None)]
    df = spark.createDataFrame(data, "run_id long, expected array<string>, written array<string>, failed array<string>")
    assert rows(complete_deliveries(df), "run_id") == [(1,)]


# ---------------------------------------------------------------- attributes at event time


def test_attributes_at_event_equals_brute_force(spark, rows):
    rnd = random.Random(4)
    readings = [(rnd.choice([1, 2, None]), rnd.randint(0, 50), rnd.randint(0, 400), rnd.randint(1, 5)) for _ in range(160)]
    readings = list({(r[0], r[1], r[2]): r for r in readings}.values()) + readings[:10]
    events = [(i, rnd.choice([1, 2, 3, None]), rnd.choice([None, *range(0, 500, 7)])) for i in range(120)]
    events += events[:3]
    r = spark.createDataFrame(readings, "e long, rank long, known long, price long").withColumn("__note", F.lit(1))
    e = spark.createDataFrame(events, "id long, e long, t long").withColumn("price", F.lit(-1))
    got = attributes_at_event(r, e, ["e"], "rank", "known", "price", "t", bucket_us=50)
    want = []
    for i, k, t in events:
        seen = [x for x in readings if k is not None and t is not None and x[0] == k and x[2] < t]
        if seen:
            best = max(seen, key=lambda x: (x[1], x[2], x[3]))
            want.append((i, k, t, best[1], best[2], best[3]))
    assert rows(got, "id", "e", "t", "rank", "known", "price") == sorted(want)
    assert attributes_at_event(r.filter("false"), e, ["e"], "rank", "known", "price", "t").count() == 0
    assert attributes_at_event(r, e.filter("false"), ["e"], "rank", "known", "price", "t").count() == 0


# ---------------------------------------------------------------- trailing totals


def test_trailing_totals_equal_brute_force(spark, rows):
    rnd = random.Random(5)
    cells = {}
    for p in range(20):
        for d in rnd.sample(range(-40, 300), 12):
            cells[p, d] = (rnd.choice([None, 0, 45, 90]), rnd.choice([0, 1]))
    data = [(p, d, a, b) for (p, d), (a, b) in cells.items()] + [(None, 3, 9, 9), (4, None, 9, 9)]
    df = spark.createDataFrame(data, "p long, d int, a long, b long").withColumn("e", F.lit(0)).withColumn("t", F.lit(0))
    got = trailing_totals(df, "p", "d", ["a", "b"], [7, 30], tile=32, blocks=3)
    want = []
    for p in range(20):
        days = [d for q, d in cells if q == p]
        for d in range(min(days), max(days) + 30):
            s = [sum((cells.get((p, x), (0, 0))[i] or 0) for x in range(d - w + 1, d + 1)) for i in (0, 1) for w in (7, 30)]
            want.append((p, d, *s))
    assert rows(got, "p", "d", "a_7d", "a_30d", "b_7d", "b_30d") == sorted(want)
    some = trailing_totals(df, "p", "d", ["a"], [7, 30], ("a", 7, 90), tile=32)
    assert rows(some, "p", "d", "a_7d", "a_30d") == sorted(w[:4] for w in want if w[2] >= 90)
    assert trailing_totals(df.filter("false"), "p", "d", ["a"], [7]).count() == 0


def test_band_and_large_values(spark, rows):
    assert banded(3, 2, 2).tolist() == [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 1], [0, 0, 1]]
    big = spark.createDataFrame([(1, 0, 2**60), (1, 1, 3)], "p long, d int, a long")
    assert rows(trailing_totals(big, "p", "d", ["a"], [2]), "d", "a_2d")[:2] == [(0, 2**60), (1, 2**60 + 3)]
    assert np.array_equal(banded(4, 3, 4).sum(0), [4, 4, 4, 4])


# ---------------------------------------------------------------- helpers


def test_current_rows_and_broadcast_bound(spark, rows):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "b"), (None, 1, "c"), (2, None, "d")], "k long, t long, v string")
    assert rows(current_rows(df, ["k"], [F.desc_nulls_last("t")])) == [(1, 7, "b"), (2, None, "d"), (None, 1, "c")]
    assert "broadcast" in broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, 2)._jdf.queryExecution().logical().toString().lower()


def test_merkle_diff_sees_repeats_and_hot_keys(spark, rows):
    """Rows given twice don't cancel out, and a hot key's repeats may overflow the digest's sum."""
    runs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "grp long, run long, at long")
    twice = [(1, 10, 7, 5), (1, 10, 7, 5), (1, 11, 7, 6), (1, 11, 7, 6), (1, 12, 7, 6), (1, 12, 7, 6), (1, 12, 7, 6)]
    df = spark.createDataFrame(twice, "grp long, run long, id long, v long")
    assert rows(merkle_diff(df, runs, ["grp"], "run", "at", "id", "v")) == [(1, 11, 7, "changed", 5, 6)]
    hot = df.filter("run < 12").distinct().selectExpr("*", "explode(sequence(1, 60000)) as n").drop("n")
    assert rows(merkle_diff(hot, runs.filter("run < 12"), ["grp"], "run", "at", "id", "v", depth=1)) == [(1, 11, 7, "changed", 5, 6)]


def test_times_far_from_the_present(spark):
    """Every year is resolved by the zone's rules: before there were any, and beyond the table's last year."""
    texts = ["2101-06-01 12:00", "1965-06-01 12:00", "3001-07-01 12:00", "1801-07-01 12:00", "2520-06-01 12:00", "1700-01-01 00:30"]
    zones = ["Europe/London", "America/New_York", "Asia/Kolkata"]
    cells = spark.createDataFrame([(z, t) for z in zones for t in texts], "feed string, text string")
    feeds = spark.createDataFrame([(z, z, "dmy") for z in zones] + [(f"f{i}", f"No/Zone{i}", "dmy") for i in range(1200)], "feed string, home_zone string, date_order string")
    for r in normalise_times(cells, feeds, "text").collect():
        want = dt.datetime.fromisoformat(r.text).replace(tzinfo=zoneinfo.ZoneInfo(r.feed)) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
        assert r.verdict == "local" and r.instant_us == want // dt.timedelta(microseconds=1), r
