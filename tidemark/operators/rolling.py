"""Totals and averages over trailing days, days without activity included.

Method: entities by days are packed into sparse-to-dense numpy blocks (a block of entities, a
tile of days and the preceding-day halo) and multiplied by banded window operators.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Entities whose days are held densely at once.
ENTITIES = 4096


def banded(tile: int, halo: int, window: int) -> np.ndarray:
    """(halo + tile) × tile operator: column j sums the ``window`` days that end with day j of the tile."""
    day = np.arange(halo + tile)[:, None]
    end = np.arange(tile)[None, :] + halo
    return ((day <= end) & (day > end - window)).astype(np.float64)


def trailing_totals(
    daily: DataFrame,
    entity: str,
    day: str,
    values: list[str],
    windows: list[int],
    at_least: tuple[str, int, float] | None = None,
    tile: int = 64,
    blocks: int | None = None,
) -> DataFrame:
    """For each entity and day, sums and averages of long ``values`` over each trailing window.

    ``daily`` has at most one row per entity and ``day`` (days since the epoch, int); NULL values
    add nothing, rows without entity or day are left out. Days run from the entity's first to
    ``max(windows) - 1`` after its last, after which all totals are zero. Result: entity, day,
    ``{value}_{window}d`` (long) and ``{value}_avg_{window}d`` (sum / window). ``at_least`` =
    (value, window, threshold) keeps only days whose sum reaches a positive threshold; the filter
    runs inside the blocks, so nothing else leaves them. An empty input gives an empty result.

    A group is one block of entities (a hash; by default twice as many as shuffle partitions) and one tile of days; a group's entities are worked on
    ENTITIES at a time, so its dense cells stay few whatever the size of the input. Each row is sent to its own tile
    and, near its end, to the next (the halo), one shuffle in all, and the input is read once.
    """
    blocks = blocks or max(64, 2 * int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    halo = max(windows) - 1
    if halo > tile:
        raise ValueError("the longest window must fit into one preceding tile")
    rows = daily.filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(
        F.col(entity).alias("__e"), F.col(day).cast("int").alias("__d"), *[F.col(v).cast("long").alias(v) for v in values]
    )
    span = rows.groupBy("__e").agg(F.min("__d").alias("__d0"), F.max("__d").alias("__d1"))
    own = F.floor(F.col("__d") / tile).cast("int")
    last = F.floor((F.col("__d") + halo) / tile).cast("int")
    tiles = rows.withColumn("__t", F.explode(F.sequence(own, last)))
    if at_least is None:  # tiles without any activity hold rows of zeros, too
        gaps = span.select(
            "__e",
            F.lit(None).cast("int").alias("__d"),
            *[F.lit(None).cast("long").alias(v) for v in values],
            F.explode(
                F.sequence(F.floor(F.col("__d0") / tile).cast("int"), F.floor((F.col("__d1") + halo) / tile).cast("int"))
            ).alias("__t"),
        )
        tiles = tiles.unionByName(gaps)
    elif not at_least[2] > 0:
        raise ValueError("at_least needs a positive threshold")
    tiles = tiles.join(span, "__e") if at_least is None else tiles.withColumn("__d0", F.lit(-(2**31))).withColumn("__d1", F.lit(2**31 - 1 - halo))
    tiles = tiles.withColumn("__b", F.pmod(F.xxhash64("__e"), F.lit(blocks)).cast("int"))
    schema = T.StructType(
        [T.StructField("__e", daily.schema[entity].dataType), T.StructField("__d", T.IntegerType())]
        + [T.StructField(f"{v}_{w}d", T.LongType()) for v in values for w in windows]
        + [T.StructField(f"{v}_avg_{w}d", T.DoubleType()) for v in values for w in windows]
    )
    bands = {w: banded(tile, halo, w) for w in windows}

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pdf["__e"])
        part = codes // ENTITIES
        return pd.concat([some(int(key[1]), pdf[part == k]) for k in range(max(1, -(-len(names) // ENTITIES)))], ignore_index=True)

    def some(t: int, pdf: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pdf["__e"])
        start = t * tile - halo
        has = pdf["__d"].notna().to_numpy()
        r, c = codes[has], (pdf["__d"].to_numpy(dtype=float)[has]).astype(np.int64) - start
        out: dict = {}
        for v in values:
            x = pdf[v].fillna(0).to_numpy(dtype=np.int64)[has]
            exact = float(np.abs(x.astype(float)).sum()) < 2**53
            dense = np.zeros((len(names), halo + tile), dtype=np.float64 if exact else np.int64)
            np.add.at(dense, (r, c), x)
            for w in windows:
                out[v, w] = (dense @ (bands[w] if exact else bands[w].astype(np.int64))).round().astype(np.int64)
        days = t * tile + np.arange(tile)
        lo = np.full(len(names), 2**31, dtype=np.int64)
        hi = np.full(len(names), -(2**31), dtype=np.int64)
        np.minimum.at(lo, codes, pdf["__d0"].to_numpy(dtype=np.int64))
        np.maximum.at(hi, codes, pdf["__d1"].to_numpy(dtype=np.int64))
        keep = (days[None, :] >= lo[:, None]) & (days[None, :] <= hi[:, None] + halo)
        if at_least is not None:
            keep &= out[at_least[0], at_least[1]] >= at_least[2]
        i, j = np.nonzero(keep)
        res = {"__e": names.to_numpy()[i] if hasattr(names, "to_numpy") else np.asarray(names)[i], "__d": days[j].astype(np.int32)}
        res |= {f"{v}_{w}d": out[v, w][i, j] for v in values for w in windows}
        res |= {f"{v}_avg_{w}d": out[v, w][i, j] / w for v in values for w in windows}
        return pd.DataFrame(res)

    done = tiles.groupBy("__b", "__t").applyInPandas(block, schema)
    return done.withColumnRenamed("__e", entity).withColumnRenamed("__d", day)
