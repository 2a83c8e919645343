"""Size checks that decide between broadcasting and shuffling."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side with more rows than this is never broadcast (at a few dozen bytes a row, some tens of MB).
BROADCAST_ROWS = 250_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it measurably holds at most ``max_rows`` rows, else ``df`` as it is.

    The frame is kept (memory and disk) so that the count and the join compute it once; a lost
    executor recomputes its part from the lineage. Beyond the bound the join shuffles, and
    adaptive execution splits its skewed partitions.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def current_rows(df: DataFrame, keys: list[str], order: list[Column], tie: list[str] | None = None) -> DataFrame:
    """The first row of each key by ``order`` (pass descending columns for "newest wins").

    NULL keys form a group of their own. Ties on ``order`` are settled by a hash of ``tie``
    (default: all columns), so the result doesn't depend on the input's order. Spark places a
    group limit before the shuffle, so repeated rows of a hot key are cut where they are read.
    """
    tie_cols = tie or df.columns
    w = Window.partitionBy(*keys).orderBy(*order, F.xxhash64(*[F.col(f"`{c}`") for c in tie_cols]))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def sequence_index(values: DataFrame, at: str, day_us: int = 86_400_000_000) -> DataFrame:
    """Dense positions ``k`` (0-based) and the following value ``next_us`` of distinct epoch-µs values.

    Ranks within calendar days in parallel and offsets the days by a running count; only the
    days' table, bounded by the calendar, passes through a single task. NULLs are ignored.
    """
    v = values.filter(F.col(at).isNotNull()).select(F.col(at).alias("at_us")).distinct()
    v = v.withColumn("day", F.floor(F.col("at_us") / F.lit(day_us)))
    by_day = v.groupBy("day").agg(F.count("*").alias("n"), F.min("at_us").alias("first_us"))
    w = Window.orderBy("day")
    by_day = by_day.select(
        "day",
        (F.sum("n").over(w) - F.col("n")).alias("before"),
        F.lead("first_us").over(w).alias("next_day_us"),
    )
    wd = Window.partitionBy("day").orderBy("at_us")
    v = v.select("day", "at_us", F.row_number().over(wd).alias("r"), F.lead("at_us").over(wd).alias("n_us"))
    return v.join(by_day, "day").select(
        "at_us", (F.col("before") + F.col("r") - 1).alias("k"), F.coalesce("n_us", "next_day_us").alias("next_us")
    )


def one_row(df: DataFrame) -> Column:
    """The single row of an ungrouped aggregation as a struct column: a scalar subquery, no join."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).scalar()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy per row.

    A table of few row groups is read by few tasks; only then are its rows (small, as it has few
    groups) dealt out. With enough partitions nothing is shuffled.
    """
    sc = df.sparkSession.sparkContext
    cores = max(sc.defaultParallelism, 1)
    have = df.rdd.getNumPartitions()
    return df if have >= cores else df.repartition(cores)
