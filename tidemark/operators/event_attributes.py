"""Entity attributes as known at the time of each event.

Method: validity intervals are derived from the successive times at which the newest known
reading changed; each interval is exploded into time buckets, and events meet them in an
equi-join on entity and bucket with half-open containment. What an interval carries into later
buckets is one pre-aggregated row per entity and bucket, so that no task holds a whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


DAY_US = 86_400_000_000


def attributes_at_event(
    readings: DataFrame,
    events: DataFrame,
    entity: list[str],
    rank: str,
    known_us: str,
    value: str,
    at_us: str,
    bucket_us: int = 28 * DAY_US,
) -> DataFrame:
    """Events with the newest reading known strictly before their time.

    ``readings``: entity columns, ``rank`` (long; the greatest is the newest reading, later
    ``known_us`` settles equal ranks, then the greatest value), ``known_us`` (epoch µs at which
    it became known) and ``value`` (long or string). ``events``: entity columns, ``at_us`` and
    whatever else, which is kept. A reading is valid for event times in
    [known_us + 1, next change + 1). Events without a known reading are left out, as are events
    and readings with NULL in an entity column, time or rank. Repeated events are kept as they
    are. Result: the event's columns, ``rank``, ``known_us`` and ``value`` (an event's own columns of
    these three names give way). Column names that begin with two underscores are reserved.
    """
    r = readings.select(
        *entity,
        (F.col(known_us) + 1).alias("__from"),
        F.col(rank).alias("__rank"),
        F.col(value).alias("__value"),
    ).filter(" and ".join(f"`{c}` is not null" for c in [*entity, "__from", "__rank"]))
    bucket = lambda c: F.floor(F.col(c) / F.lit(bucket_us))
    r = r.withColumn("__b", bucket("__from"))
    e = events.filter(" and ".join(f"`{c}` is not null" for c in [*entity, at_us])).withColumn("__b", bucket(at_us))
    last = e.groupBy(*entity).agg(F.max("__b").alias("__last"))

    # what is known by the end of each bucket, carried into the buckets up to the next one with readings
    best = r.groupBy(*entity, "__b").agg(F.max(F.struct("__rank", "__from", "__value")).alias("__best"))
    w = Window.partitionBy(*entity).orderBy("__b")
    best = best.withColumn("__best", F.max("__best").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = best.withColumn("__next", F.lead("__b").over(w))
    # nothing is carried past an entity's last event
    best = best.join(last, entity).withColumn("__upto", F.least(F.col("__next"), F.col("__last"))).filter(F.col("__upto") > F.col("__b"))
    carried = best.select(
        *entity,
        F.col("__best.__rank").alias("__rank"),
        F.col("__best.__value").alias("__value"),
        F.col("__best.__from").alias("__known"),
        F.explode(F.sequence(F.col("__b") + 1, F.col("__upto"))).alias("__b"),
    ).withColumn("__from", F.col("__b") * F.lit(bucket_us))

    pieces = r.withColumn("__known", F.col("__from")).unionByName(carried)
    w = Window.partitionBy(*entity, "__b").orderBy("__from", "__rank", "__known", "__value")
    seen = F.max(F.struct("__rank", "__known", "__value")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.withColumn("__seen", seen).withColumn("__to", F.lead("__from").over(w))
    intervals = pieces.filter("__to is null or __to > __from").select(
        *entity, "__b", "__from", "__to", "__seen"
    )
    joined = e.join(intervals, [*entity, "__b"]).filter(
        (F.col(at_us) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(at_us) < F.col("__to")))
    )
    return joined.select(
        *[joined[f"`{c}`"] for c in events.columns if c not in (rank, known_us, value)],
        F.col("__seen.__rank").alias(rank),
        (F.col("__seen.__known") - 1).alias(known_us),
        F.col("__seen.__value").alias(value),
    )


