from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.engine.scale import sequence_index
from tidemark.operators.history import scd2_merge

SCHEMA = "key long, at long, pref int, cost long, status string"


def brute(rows, instants):
    """Versions by walking every key over every instant."""
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        state, start = None, None
        for i, t in enumerate(instants):
            here = [r for r in rows if r[0] == key and r[1] == t]
            now = max(here, key=lambda r: r[2])[3:] if here else None
            if now != state:
                if state is not None:
                    out.append((key, *state, instants[start], t))
                state, start = now, i
        if state is not None:
            out.append((key, *state, instants[start], None))
    return out


def unique_rows(rows):
    """At most one row per key, instant and preference, as the preference must decide."""
    seen = {}
    for r in rows:
        seen[(r[0], r[1], r[2])] = r
    return list(seen.values())


row = st.tuples(st.sampled_from([1, 2, None]), st.integers(1, 9).map(lambda x: x * 1000), st.integers(0, 2), st.sampled_from([None, 5, 6]), st.sampled_from([None, "a", "d"]))


def result(dim, rows):
    return rows(dim, "key", "cost", "status", "valid_from_us", "valid_to_us")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, max_size=25))
def test_history_equals_brute_force_whole_and_in_batches(spark, rows, data):
    data = unique_rows(data)
    instants = sorted({r[1] for r in data if r[0] is not None})
    df = spark.createDataFrame(data, SCHEMA)
    want = sorted(brute(data, instants), key=str)
    whole = scd2_merge(None, df, "key", "at", ["cost", "status"], ["pref"], block=3)
    assert sorted(result(whole, rows), key=str) == want
    dim = scd2_merge(None, df.filter("at < 4000"), "key", "at", ["cost", "status"], ["pref"], block=2)
    dim = scd2_merge(dim, df.filter("at >= 4000 and at < 7000"), "key", "at", ["cost", "status"], ["pref"], block=2)
    dim = scd2_merge(dim, df.filter("at >= 7000"), "key", "at", ["cost", "status"], ["pref"], block=2)
    assert sorted(result(dim, rows), key=str) == want


def test_empty_batch_and_extra_columns(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert scd2_merge(None, empty, "key", "at", ["cost", "status"], ["pref"]).count() == 0
    df = spark.createDataFrame([(1, 1000, 0, 5, "a", 7, 8)], SCHEMA + ", k long, at_us long")
    dim = scd2_merge(None, df, "key", "at", ["cost", "status"], ["pref"])
    assert result(dim, rows) == [(1, 5, "a", 1000, None)]
    assert result(scd2_merge(dim, empty, "key", "at", ["cost", "status"], ["pref"]), rows) == [(1, 5, "a", 1000, None)]


def test_sequence_index_is_dense_across_days(spark, rows):
    day = 86_400_000_000
    at = [0, 5, day - 1, day, 3 * day + 7, 3 * day + 7, None]
    got = rows(sequence_index(spark.createDataFrame([(a,) for a in at], "at long"), "at"), "at_us", "k", "next_us")
    assert got == [(0, 0, 5), (5, 1, day - 1), (day - 1, 2, day), (day, 3, 3 * day + 7), (3 * day + 7, 4, None)]
