import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.engine.asof import AsOfView, latest_per_group, utc, visible_per_cutoff
from tidemark.engine.catalog import Catalog, TableSpec
from tidemark.engine.leakcheck import check_leakage, corrupt_future, fingerprint, truncate_future
from tidemark.operators.asof_join import asof_join, range_join

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
H = dt.timedelta(hours=1)


def store(spark):
    ev = spark.createDataFrame([(1, 10, T0), (1, 11, T0 + H), (2, 12, T0 + 2 * H), (None, 13, T0)], "k long, v long, available_at timestamp")
    sn = spark.createDataFrame(
        [(2024, 1, T0, "other", 1, T0), (2024, 1, T0, "fpl", 2, T0), (2024, 2, T0 + H, "other", 3, T0 + H), (2024, None, T0, "other", 4, T0)],
        "season long, k long, snapshot_at timestamp, source string, v long, available_at timestamp",
    )
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k long, name string")
    cat = Catalog(spark, None, {}, {})
    cat.register(TableSpec("ev", "event", ("k", "v")), ev)
    cat.register(TableSpec("sn", "snapshot", ("snapshot_at", "k")), sn)
    cat.register(TableSpec("fall", "schedule", ("k",)), ev.select(F.lit(2024).cast("long").alias("season"), "k", "v", "available_at"))
    cat.register(TableSpec("dim", "static", ("k",)), dim)
    return cat


def test_strict_cutoff_narrowing_and_refusals(spark, rows):
    v = AsOfView.at(store(spark), T0 + H)
    assert rows(v.table("ev", ["k", "v"])) == [(1, 10), (None, 13)]
    with pytest.raises(ValueError):
        AsOfView.at(store(spark), dt.datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        v.earlier(T0 + 2 * H)
    with pytest.raises(ValueError):
        v.table("dim")
    assert v.earlier(T0).table("ev").count() == 0
    late = v.for_deadline(T0 + 5 * H)
    assert late.cutoff == T0 + H and late.deadline == T0 + 5 * H
    assert utc(T0) == T0


def test_latest_null_group_preference_lookup_and_fallback(spark, rows):
    v = AsOfView.at(store(spark), T0 + H)
    assert rows(v.latest("sn", ["k"], ["k", "v"])) == [(1, 2), (None, 4)]
    assert rows(v.latest("sn", [], ["v"])) == [(2,)]
    assert rows(v.lookup("dim", v.table("ev")), "name") == [("a",)]
    assert rows(v.with_fallback("sn", "fall", 2024, ["k", "v"])) == [(1, 1), (1, 2), (None, 4)]
    assert v.earlier(T0).with_fallback("sn", "fall", 2024, ["k", "v"]).count() == 0
    assert latest_per_group(v.table("sn").filter("false"), ["k"], "snapshot_at").count() == 0


def test_files_blocked(spark):
    cat = Catalog(spark, "/nowhere")
    with cat.files_blocked("builder"), pytest.raises(RuntimeError):
        cat.load("gameweek")


def test_many_cutoffs(spark, rows):
    df = spark.createDataFrame([(T0,), (T0 + H,), (T0 + 900 * H,), (None,)], "a timestamp")
    cut = spark.createDataFrame([(T0,), (T0 + H,), (T0 + 2000 * H,), (T0 + 2 * H,)], "c timestamp")
    assert [r[1] for r in rows(visible_per_cutoff(df, cut, "a", "c"))] == [0, 1, 2, 3]


def test_leak_checker_finds_a_leak(spark):
    cat = store(spark)
    good = lambda v: v.table("ev", ["k", "v"]).groupBy("k").agg(F.sum("v").alias("s"))
    bad = lambda v: v.catalog.load("ev").groupBy("k").agg(F.sum("v").alias("s"))
    found = check_leakage(cat, [T0 + H], {"good": good, "bad": bad})
    assert {f[0] for f in found} == {"bad"}
    ev = cat.load("ev")
    assert truncate_future(ev, T0 + H).count() == 2
    c = corrupt_future(ev, T0 + H, ("k",), ghost_fraction=1.0)
    assert c.count() == 6 and c.filter(F.col("available_at") < F.lit(T0 + H)).count() == 2
    assert fingerprint(ev) == fingerprint(ev.orderBy(F.desc("v")))


side = st.tuples(st.sampled_from([1, 2, None]), st.one_of(st.none(), st.integers(0, 9)))


def nearest(left, right, direction, strict, tol):
    out = []
    for i, (k, t) in enumerate(left):
        ok = [(rt, j) for j, (rk, rt) in enumerate(right) if k is not None and t is not None and rt is not None and rk == k]
        ok = [(rt, j) for rt, j in ok if ((rt < t or (rt == t and not strict)) if direction == "backward" else (rt > t or (rt == t and not strict)))]
        ok = [(rt, j) for rt, j in ok if tol is None or abs(rt - t) <= tol]
        best = (max(ok) if direction == "backward" else min(ok, key=lambda x: (x[0], -x[1]))) if ok else None
        out.append((i, best[1] if best else None))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(side, max_size=12), st.lists(side, max_size=12), st.sampled_from(["backward", "forward"]), st.booleans(), st.sampled_from([None, 2]))
def test_asof_join_equals_brute_force(spark, rows, a, b, direction, strict, tol):
    left = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(a)], "i long, k long, t long")
    right = spark.createDataFrame([(j, k, t, 0) for j, (k, t) in enumerate(b)], "j long, k long, rt long, i long")
    got = asof_join(left, right, "t", "rt", ["k"], ["j"], direction, strict, F.lit(tol) if tol else None)
    assert rows(got, "i", "j") == sorted(nearest(a, b, direction, strict, tol), key=lambda x: x[0])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(side, max_size=12), st.lists(side, max_size=12))
def test_range_join_equals_brute_force(spark, rows, a, b):
    left = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(a)], "i long, k long, t long")
    right = spark.createDataFrame([(j, k, t) for j, (k, t) in enumerate(b)], "j long, k long, rt long")
    got = range_join(left, right, ["k"], "t", "rt", 2, 1, ["j"])
    want = [(i, j) for i, (k, t) in enumerate(a) for j, (rk, rt) in enumerate(b) if k is not None and k == rk and t is not None and rt is not None and t - 2 <= rt <= t + 1]
    assert rows(got, "i", "j_r") == sorted(want)
