"""Structured Streaming counterparts of the batch operators.

Sources are file streams; every query can run with ``availableNow`` and then equals its batch twin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a path, a directory or a single file.

    The path is given as a glob, since the file source takes a plain path for a directory.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path if "*" in path or "[" in path else f"{path[:-1]}[{path[-1]}]")


def run_once(stream: DataFrame, base: str, mode: str) -> DataFrame:
    """Run a streaming query over what is available and return what it put out.

    Each batch is written below ``base`` (in the shared folder), never to the driver; in complete
    mode the last batch holds the whole result, else all batches together do.
    """
    spark, done = stream.sparkSession, []

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{n:09d}")
        done.append(n)

    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{base}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    kept = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/{n:09d}" for n in kept])


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """foreachBatch over what is available; with an idempotent ``each`` this is exactly-once."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_per_key(stream: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Newest row per key (complete or update mode): state holds one struct per key."""
    best = F.max(F.struct(F.col(at), *[F.col(c) for c in columns])).alias("b")
    return stream.groupBy(key).agg(best).select(key, F.col(f"b.{at}").alias(at), *[F.col(f"b.{c}").alias(c) for c in columns])


def windowed(stream: DataFrame, at: str, size: str, slide: str | None, late: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums in tumbling (no slide) or sliding windows with a watermark."""
    win = F.window(at, size, slide) if slide else F.window(at, size)
    g = stream.withWatermark(at, late).groupBy(win.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, late: str, by: list[str]) -> DataFrame:
    g = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n")


def dedup(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def keyed_fold(
    stream: DataFrame, key: str, key_type: str, order: str, value: str, step: Callable[[float, float], float], start: float
) -> DataFrame:
    """A per-key fold x' = step(x, value) in ``order`` within each batch; one (key, n, state) row per updated key.

    The state survives in the checkpoint; rows later than already folded ones are folded when they arrive.
    """

    def fold(k: tuple, pdfs: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, x = state.get if state.exists else (0, start)
        rows = pd.concat(list(pdfs)).sort_values(order)
        for v in rows[value]:
            x = step(x, v)
            n += 1
        state.update((int(n), float(x)))
        yield pd.DataFrame({key: [k[0]], "n": [int(n)], "state": [float(x)]})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(
        fold, f"{key} {key_type}, n long, state double", "n long, state double", "update", "NoTimeout"
    )


def incremental_upsert(target: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose keys aren't in ``target`` yet (left anti)."""

    def each(batch: DataFrame, _: int) -> None:
        from tidemark.sources.sinks import append_new

        append_new(batch.sparkSession, target, batch, key)

    return each
