"""Queries that must do the whole job: every row, in the stated order."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators.models import WalkForward, out_of_fold
from tidemark.plans import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_typed_projection_returns_every_row_in_order(spark):
    got = [tuple(r) for r in catalogue()["typed_projection_whole"][0](spark, DATA).collect()]
    li = spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("cast(l_orderkey as long)", "cast(l_linenumber as long)", "cast(l_quantity as double)")
    assert got == sorted(tuple(r) for r in li.collect())


def test_mixed_sort_places_every_row(spark):
    got = {r["o_orderkey"]: r["position"] for r in catalogue()["mixed_direction_positions"][0](spark, DATA).collect()}
    o = [tuple(r) for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderpriority", "o_totalprice", "o_orderkey").collect()]
    want = sorted(o, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, -(r[1] or 0), r[2]))
    assert got == {r[2]: i for i, r in enumerate(want, 1)}


def test_mixed_sort_places_nulls_last_and_ties_by_key(spark, tmp_path):
    rows = [(1, 7, "b", 5.0), (2, 7, "b", 5.0), (3, 7, None, 9.0), (4, 7, "b", None), (5, 7, "a", 1.0), (6, 7, "b", 8.0), (7, 7, None, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["position"]: r["o_orderkey"] for r in catalogue()["mixed_direction_positions"][0](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(1, 8)] == [5, 6, 1, 2, 4, 3, 7]


class Seen:
    """A stand-in for a model: predicts the number of rows that it was fitted on."""

    def fit(self, df):
        return float(df.count())

    def predict(self, model, df, out):
        return df.withColumn(out, F.lit(model))


def test_walk_forward_predicts_every_round_with_history(spark, rows):
    h = spark.range(1, 13).withColumnRenamed("id", "i")
    got = WalkForward(Seen).predict(h, "i", list(range(1, 13)))
    assert rows(got) == [(i, 4.0 if i < 9 else 8.0) for i in range(5, 13)]
    assert WalkForward(Seen).predict(h.filter("i < 5"), "i", [1, 2, 3, 4]).count() == 0


def test_out_of_fold_raises_on_too_many_folds_and_needs_another(spark, rows):
    with pytest.raises(ValueError, match="more than 100"):
        out_of_fold(spark.range(101), Seen, "id", "p")
    assert rows(out_of_fold(spark.range(3), Seen, "id", "p")) == [(0, 2.0), (1, 2.0), (2, 2.0)]
    assert rows(out_of_fold(spark.range(1), Seen, "id", "p")) == [(0, None)]


@pytest.mark.parametrize("name", ["walk_forward_starts", "poisson_goals", "out_of_fold_starts"])
def test_models_cover_all_seasons(spark, tmp_path, name):
    g = spark.range(10).selectExpr("2020 + id div 5 as season", "id % 5 + 1 as gw", "id % 5 + 1 as gw_index")
    g.write.parquet(f"{tmp_path}/gameweek.parquet")
    m = g.crossJoin(spark.range(6).withColumnRenamed("id", "player_key")).withColumn("kickoff_time", F.timestamp_seconds((F.col("season") * 100 + F.col("gw")) * 86_400))
    m = m.withColumns({"fixture_key": F.col("season") * 100 + F.col("gw"), "available_at": F.col("kickoff_time"), "starts": F.col("player_key") % 2, "minutes": F.col("player_key") * 10, "goals_scored": (F.col("gw") + F.col("player_key")) % 3})
    m.withColumns({"team_key": F.lit(1), "opponent_team_key": F.lit(2), "was_home": F.lit(True)}).write.parquet(f"{tmp_path}/player_match.parquet")
    got = catalogue()[name][0](spark, str(tmp_path)).collect()
    assert len(got) == len({(r["player_key"], r["fixture_key"]) for r in got}) == (60 if name == "out_of_fold_starts" else 36)
    assert all(r[2] is not None for r in got)
    spark.catalog.clearCache()


def test_pivot_keeps_players_of_late_rounds_and_all_seasons(spark, rows, tmp_path):
    day = dt.datetime(2022, 9, 1, tzinfo=dt.UTC)
    m = [(1, 10, 2021, 1, 4, day), (1, 11, 2022, 4, 6, day), (1, 12, 2022, 4, 1, day), (2, 11, 2022, 40, 2, day), (3, 13, 2022, 1, 9, day.replace(year=2023))]
    spark.createDataFrame(m, "player_key long, fixture_key long, season long, gw long, total_points long, available_at timestamp").write.parquet(f"{tmp_path}/player_match.parquet")
    got = catalogue()["pivot_all_rounds"][0](spark, str(tmp_path))
    assert got.columns == ["season", "player_key", "gw1", "gw4", "gw40"]
    assert rows(got) == [(2021, 1, 4, None, None), (2022, 1, None, 7, None), (2022, 2, None, None, 2)]


def test_deltas_read_both_sources_of_all_seasons_and_prefer_fpl(spark, rows, tmp_path):
    at = lambda year, day: dt.datetime(year, 9, day, tzinfo=dt.UTC)
    s = [(2021, 1, "fplcache", at(2021, 1), 50), (2021, 1, "fplcache", at(2021, 30), 60), (2021, 1, "fpl", at(2021, 30), 55), (2022, 1, "fpl", at(2022, 1), 70), (2022, 1, "fplcache", at(2022, 9), 74), (2022, 2, "fplcache", at(2022, 9), 40)]
    df = spark.createDataFrame(s, "season long, player_key long, source string, snapshot_at timestamp, now_cost long")
    df.withColumn("available_at", F.col("snapshot_at")).write.parquet(f"{tmp_path}/player_snapshot.parquet")
    assert rows(catalogue()["deltas_of_all_seasons"][0](spark, str(tmp_path))) == [(2021, 1, 5, 5), (2022, 1, 4, None), (2022, 2, None, None)]
