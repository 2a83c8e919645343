"""Ordered folds: ratings, thresholds on running totals, and greedy one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.engine.session import ensure_checkpoint_dir
from tidemark.functions.prob import goal_multiplier

START, ADVANTAGE, K = 1500.0, 60.0, 20.0


def entry_ratings(rating: dict, before: set, now: set) -> dict:
    """Ratings of the clubs new in a season: the mean of those that left, START if none did."""
    left = [rating[c] for c in sorted(before - now)]
    return dict.fromkeys(now - before, sum(left) / len(left) if left else START)


RATING_SCHEMA = "league string, season long, fixture_key long, home long, away long, home_before double, away_before double, move double, expected double"


def elo(matches: DataFrame) -> DataFrame:
    """Ratings before and the move of each match, in the order (kickoff, home) within a league.

    ``matches``: league, season, fixture_key, kickoff_us, home, away, home_goals, away_goals.
    Ratings are a sequential fold, so a league is the unit of parallelism; its matches stream
    through one task in Arrow batches sorted by time, and only the clubs' ratings are held.
    Rows with a NULL in league, kickoff, club or goals are left out. Zero-sum within a match.
    """
    need = ["league", "season", "kickoff_us", "home", "away", "home_goals", "away_goals"]
    m = matches.filter(" and ".join(f"{c} is not null" for c in need)).select("fixture_key", *need)
    lead = F.col("home_goals") - F.col("away_goals")
    m = m.withColumn("stake", F.lit(K) * goal_multiplier(lead)).withColumn("result", (F.signum(lead.cast("double")) + 1) / 2).drop("home_goals", "away_goals")
    sides = m.select("league", "season", F.explode(F.array("home", "away")).alias("club"))
    clubs = sides.groupBy("league", "season").agg(F.collect_set("club").alias("clubs"))  # a league's clubs
    m = m.join(clubs, ["league", "season"]).repartition("league").sortWithinPartitions("league", "kickoff_us", "home", "fixture_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rating, clubs, at = {}, set(), (None, None)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.league != at[0]:
                    rating, clubs = {}, set()
                if (r.league, r.season) != at:
                    at, now = (r.league, r.season), set(r.clubs)
                    rating |= entry_ratings(rating, clubs, now)
                    clubs = now
                h, a = rating[r.home], rating[r.away]
                expected = 1 / (1 + 10 ** ((a - h - ADVANTAGE) / 400))
                move = r.stake * (r.result - expected)
                rating[r.home], rating[r.away] = h + move, a - move
                out.append((r.league, r.season, r.fixture_key, r.home, r.away, h, a, move, expected))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RATING_SCHEMA.split(", ")])

    return m.mapInPandas(run, RATING_SCHEMA)


def crossings(df: DataFrame, by: list[str], order: list[str], amount: str, thresholds: list[tuple[int, int, Column | None]]) -> DataFrame:
    """Rows at which the running total of ``amount`` first reaches a threshold: adds ``threshold`` and ``penalty``.

    ``thresholds``: (total, penalty, condition at the row or None). A row may reach several.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("__t", F.sum(amount).over(w)).withColumn("__b", F.col("__t") - F.col(amount))
    hits = [
        F.when((F.col("__b") < t) & (F.col("__t") >= t) & (c if c is not None else F.lit(True)), F.struct(F.lit(t).alias("threshold"), F.lit(p).alias("penalty")))
        for t, p, c in thresholds
    ]
    return x.withColumn("__h", F.explode(F.array_compact(F.array(*hits)))).select(*df.columns, "__h.threshold", "__h.penalty")


def greedy_match(pairs: DataFrame, a: str, b: str, scores: list[str], max_rounds: int = 1000) -> DataFrame:
    """One-to-one pairs as a greedy pass by descending scores (ties by the ids) would choose them.

    A pair that is the best of both its sides is what the greedy pass would take at some point, so
    all such mutual bests are taken at once and their sides removed, until none is left:
    typically a few rounds over shrinking pairs instead of one sequential pass. Each round's
    remainder is checkpointed. Pairs with a NULL id are ignored; of repeated pairs the best counts.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    key = F.struct(*[(-F.col(s).cast("double")).alias(s) for s in scores], F.col(a), F.col(b))
    left = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(*[F.max(s).alias(s) for s in scores]).checkpoint()
    taken: list[DataFrame] = []
    for _ in range(max_rounds):
        ranked = left.withColumn("__key", key)
        # the best of each side by aggregation, so that a hot id needs no sort
        ba = ranked.groupBy(a).agg(F.min("__key").alias("__ka"))
        bb = ranked.groupBy(b).agg(F.min("__key").alias("__kb"))
        mutual = ranked.join(ba, a).join(bb, b).filter((F.col("__key") == F.col("__ka")) & (F.col("__key") == F.col("__kb"))).select(*left.columns).checkpoint()
        if not mutual.take(1):
            break
        taken.append(mutual)
        left = left.join(mutual.select(a), a, "left_anti").join(mutual.select(b), b, "left_anti").checkpoint()
    else:
        raise RuntimeError("matching did not settle")
    out = pairs.sparkSession.createDataFrame([], left.schema)
    for t in taken:
        out = out.unionByName(t)
    return out


def accept(pairs: DataFrame, rules: list[dict[str, float]], floor: dict[str, float]) -> DataFrame:
    """Pairs that reach every value of ``floor`` and of at least one rule; both map columns to least values. A NULL reaches nothing."""
    reaches = lambda least: F.coalesce(F.expr(" and ".join(f"`{c}` >= {v}" for c, v in least.items())), F.lit(False))
    some = F.lit(False)
    for rule in rules:
        some = some | reaches(rule)
    return pairs.filter(reaches(floor) & some)


def apply_overrides(matched: DataFrame, overrides: DataFrame, a: str, b: str) -> DataFrame:
    """Forced pairs replace matches on either side; an override without ``b`` blocks its ``a``."""
    forced = overrides.filter(F.col(b).isNotNull()).select(a, b)
    kept = matched.join(overrides.select(a).distinct(), a, "left_anti").join(forced.select(b).distinct(), b, "left_anti")
    return kept.select(a, b, F.lit("auto").alias("method")).unionByName(forced.select(a, b, F.lit("override").alias("method")))
