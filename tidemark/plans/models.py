"""Model queries: walk-forward and out-of-fold predictions from match history (rows only, no SQL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.engine.scale import broadcast_if_small
from tidemark.engine.session import table
from tidemark.operators.models import Boosted, Poisson, WalkForward, out_of_fold
from tidemark.plans.registry import collector
from tidemark.plans.relational import current_matches

QUERIES, query = collector()


def history(spark, d):
    """One row per match with lags over the player's earlier matches."""
    m = current_matches(spark, d).select("player_key", "fixture_key", "season", "gw", "kickoff_time", "minutes", "starts", "goals_scored", "team_key", "opponent_team_key", "was_home")
    g = broadcast_if_small(table(spark, d, "gameweek").select("season", "gw", "gw_index"))
    w = Window.partitionBy("player_key").orderBy("kickoff_time", "fixture_key")
    m = m.join(g, ["season", "gw"]).withColumn("home", F.col("was_home").cast("int"))
    return m.select(
        "player_key", "fixture_key", "season", "gw_index", "home", F.coalesce("starts", F.lit(0)).alias("start"), "goals_scored",
        F.lag("minutes").over(w).alias("m1"), F.avg("minutes").over(w.rowsBetween(-5, -1)).alias("m5"), F.avg(F.coalesce("starts", F.lit(0))).over(w.rowsBetween(-5, -1)).alias("s5"),
        F.avg("goals_scored").over(w.rowsBetween(-10, -1)).alias("g10"),
    )


def indexed_history(spark, d):
    """``history`` with the place ``i`` of its round among all seasons' rounds, and those places."""
    g = table(spark, d, "gameweek").select("season", "gw_index").distinct()
    g = g.withColumn("i", F.dense_rank().over(Window.orderBy("season", "gw_index")))  # one row per round
    return history(spark, d).join(broadcast_if_small(g), ["season", "gw_index"]).persist(), sorted(r["i"] for r in g.collect())


@query()
def walk_forward_starts(spark, d):
    """Start probabilities of all rounds with history from boosted trees refitted every four rounds across the seasons."""
    h, rounds = indexed_history(spark, d)
    wf = WalkForward(lambda: Boosted(["m1", "m5", "s5", "home"], "start", rounds=8, depth=3))
    p = wf.predict(h, "i", rounds)
    return p.select("player_key", "fixture_key", F.round("pred", 6).alias("p_start"), "start")


@query()
def poisson_goals(spark, d):
    """Goal rates of all rounds with history from a regression refitted every four rounds across the seasons."""
    h, rounds = indexed_history(spark, d)
    p = WalkForward(lambda: Poisson(["m5", "s5", "g10", "home"], "goals_scored")).predict(h, "i", rounds, "rate")
    return p.select("player_key", "fixture_key", F.round("rate", 6).alias("rate"), "goals_scored")


@query()
def out_of_fold_starts(spark, d):
    """Start probabilities of every match, fitted on the seasons of the other parity (NULL if there are none)."""
    h = history(spark, d).withColumn("fold", F.col("season") % 2).persist()
    p = out_of_fold(h, lambda: Boosted(["m1", "m5", "s5"], "start", rounds=5, depth=3), "fold", "p")
    return p.select("player_key", "fixture_key", F.round("p", 6).alias("p_start"), "start")
