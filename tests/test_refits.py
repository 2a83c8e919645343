"""Models of many cutoffs fitted side by side: the same as one fit after the other, in a number of jobs that cutoffs don't raise."""

import random

import pytest

from tidemark.operators import refits
from tidemark.operators.models import Boosted, Poisson, WalkForward


@pytest.fixture(scope="module")
def history(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(1, 41):
        for k in range(20):
            a, b = rnd.choice([None, 0.0, rnd.randint(1, 90) / 3]), rnd.random()
            rate = 0.2 + (a or 0) / 40 + b / 3
            rows.append((100 * i + k, i, a, b, k % 2, rnd.choice([None, *[int(rnd.random() < rate)] * 9]), rnd.choices([0, 1, 2, None], [5, 3, 1, 1])[0]))
    return spark.createDataFrame(rows, "id long, i long, a double, b double, home int, start int, goals long").persist()


def one_by_one(model, history, every=4):
    """Predictions by id of a fit per cutoff with pyspark.ml."""
    out = {}
    for cut in range(every + 1, 41, every):
        p = model.predict(model.fit(history.filter(f"i < {cut}")), history.filter(f"i between {cut} and {cut + every - 1}"), "p")
        out |= {r["id"]: r["p"] for r in p.collect()}
    return out


@pytest.mark.parametrize("model", [Poisson(["a", "b", "home"], "goals"), Boosted(["a", "b", "home"], "start", rounds=4, depth=3)], ids=["poisson", "boosted"])
def test_same_as_one_fit_after_the_other(history, model):
    got = WalkForward(lambda: model, every=8).predict(history, "i", list(range(1, 41)), "p")
    assert got.columns == [*history.columns, "p"]
    rows = {r["id"]: r for r in got.collect()}
    want = one_by_one(model, history, 8)
    assert rows.keys() == want.keys() and len(want) == 32 * 20
    assert max(abs(rows[k]["p"] - p) for k, p in want.items()) < 1e-6
    same = {r["id"]: r for r in history.collect()}
    assert all(tuple(r)[:-1] == tuple(same[k]) for k, r in rows.items())


@pytest.mark.parametrize("model", [Poisson(["a", "b"], "goals"), Boosted(["a", "b"], "start", rounds=3, depth=2)], ids=["poisson", "boosted"])
def test_jobs_don_t_grow_with_cutoffs(spark, history, model):
    def jobs(every, group):
        spark.sparkContext.setJobGroup(group, group)
        WalkForward(lambda: model, every=every).predict(history, "i", list(range(1, 41)), "p").count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(20, "few-" + type(model).__name__), jobs(1, "many-" + type(model).__name__)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 20 < 39


def test_labels_out_of_range_and_without_history(spark):
    h = spark.createDataFrame([(1, 0.5, 3, -1), (2, 0.5, 1, 1), (3, 0.1, 0, 0)], "i long, a double, start int, goals int")
    with pytest.raises(Exception, match="other than 0 and 1"):
        WalkForward(lambda: Boosted(["a"], "start"), every=1).predict(h, "i", [1, 2, 3]).count()
    with pytest.raises(Exception, match="negative"):
        WalkForward(lambda: Poisson(["a"], "goals"), every=1).predict(h, "i", [1, 2, 3]).count()
    late = h.selectExpr("i", "a", "case when i = 2 then start end as start", "case when i = 2 then goals end as goals")
    for m in (Boosted(["a"], "start"), Poisson(["a"], "goals")):
        assert [r["i"] for r in WalkForward(lambda m=m: m, every=1).predict(late, "i", [1, 2, 3]).collect()] == [3]
        assert WalkForward(lambda m=m: m, every=1).predict(late.filter("i < 2"), "i", [1, 2, 3]).count() == 0


def test_thresholds_count_every_row():
    few = refits.thresholds(*map(refits.np.array, ([0.0, 1.0, 3.0], [5, 1, 1])))
    assert few.tolist() == [0.5, 2.0]
    many = refits.thresholds(refits.np.arange(640.0), refits.np.ones(640))
    assert len(many) == 31 and many[0] == 19.5
