"""Type-two history of changing attributes, built or extended from periodic full lists.

Method: a type-two dimension merge. Each batch of snapshots is reduced to runs of equal
attribute hashes; the runs meet the dimension's open versions, whose hash is compared; equal
and adjacent ones are extended, changed ones are closed with an end date, new ones inserted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.engine.scale import broadcast_if_small, sequence_index

#: Instants per block: a (key, block) group is sorted in one task and never holds more than this many instants.
BLOCK = 256


def attr_hash(cols: list[Column | str]) -> Column:
    """A 64-bit hash in which NULL is a value of its own (plain xxhash64 skips NULLs)."""
    parts: list[Column] = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def _stitch(runs: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """Join runs of one key that adjoin and have equal hashes."""
    w = Window.partitionBy(key).orderBy("k_from")
    fresh = (
        F.lag("k_to").over(w).isNull()
        | (F.lag("attr_hash").over(w) != F.col("attr_hash"))
        | (F.lag("k_to").over(w) + 1 != F.col("k_from"))
    )
    runs = runs.withColumn("__new", fresh.cast("int")).withColumn(
        "__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return runs.groupBy(key, "__island").agg(
        *[F.min_by(a, "k_from").alias(a) for a in attrs],
        F.first("attr_hash").alias("attr_hash"),
        F.min("k_from").alias("k_from"),
        F.max("k_to").alias("k_to"),
        F.min("valid_from_us").alias("valid_from_us"),
        F.max("valid_to_us").alias("valid_to_us"),
    ).drop("__island")


def _runs(states: DataFrame, key: str, attrs: list[str], prefer: list[str], block: int) -> DataFrame:
    """Runs of equal state within blocks of instants: one shuffle and one sort; the first row by
    ``prefer`` (descending) is an instant's final word."""
    states = states.withColumn("__block", F.floor(F.col("k") / block))
    part = Window.partitionBy(key, "__block")
    w = part.orderBy("k", *[F.desc_nulls_last(p) for p in prefer], "attr_hash")
    states = states.withColumn("__pk", F.lag("k").over(w)).filter("__pk is null or __pk <> k")
    w = part.orderBy("k")
    fresh = (
        F.lag("k").over(w).isNull()
        | (F.lag("attr_hash").over(w) != F.col("attr_hash"))
        | (F.lag("k").over(w) + 1 != F.col("k"))
    )
    states = states.withColumn("__new", fresh.cast("int")).withColumn(
        "__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return states.groupBy(key, "__block", "__run").agg(
        *[F.first(a).alias(a) for a in attrs],
        F.first("attr_hash").alias("attr_hash"),
        F.min("k").alias("k_from"),
        F.max("k").alias("k_to"),
        F.min("at_us").alias("valid_from_us"),
        F.max("next_us").alias("valid_to_us"),
    ).drop("__block", "__run")


def scd2_merge(
    dim: DataFrame | None,
    snapshots: DataFrame,
    key: str,
    at: str,
    attrs: list[str],
    prefer: list[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Merge a batch of full lists into a type-two dimension and return the new dimension.

    ``snapshots`` has one row per listed entity and instant (``at``, epoch µs); of several rows
    for one entity and instant the greatest by ``prefer`` holds. All instants of the batch must
    be later than those already merged. ``dim`` is an earlier result, or None to start. The
    result has key, attrs, attr_hash, k_from, k_to (positions in the sequence of instants),
    valid_from_us and valid_to_us: a version ends at the first instant after its last one, NULL
    while open. An entity missing from a list has its version closed there.

    NULL attributes are values. Rows with a NULL key or instant are left out (no entity or time
    to attach them to). An empty batch returns the dimension unchanged. Columns beyond the
    named ones are dropped. Two shuffles: states by (key, block of instants), runs by key.
    """
    cols = [key, *attrs, "attr_hash", "k_from", "k_to", "valid_from_us", "valid_to_us"]
    snaps = snapshots.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    instants = sequence_index(snaps, at)
    base = 0
    first_us = None
    if dim is not None:
        edge = dim.agg(F.max("k_to").alias("k")).first()
        base = 0 if edge.k is None else edge.k + 1
        first_us = snaps.agg(F.min(at).alias("a")).first().a
        if first_us is None:
            return dim.select(*cols)
    far = F.lit(2**62)  # stands for "open" while ends are compared, as MAX would skip a NULL
    instants = broadcast_if_small(
        instants.withColumn("k", F.col("k") + F.lit(base)).withColumn("next_us", F.coalesce("next_us", far))
    )
    names = list(dict.fromkeys([key, at, *attrs, *prefer]))
    states = snaps.select(*names).withColumn("attr_hash", attr_hash(list(attrs)))
    states = states.join(instants, F.col(at) == F.col("at_us"))
    runs = _runs(states, key, attrs, list(prefer), block).select(*cols)
    if dim is None:
        merged = _stitch(runs, key, attrs)
    else:
        current = dim.filter(F.col("valid_to_us").isNull()).withColumn("valid_to_us", F.lit(first_us))
        merged = _stitch(current.select(*cols).unionByName(runs), key, attrs)
    merged = merged.withColumn("valid_to_us", F.when(F.col("valid_to_us") < far, F.col("valid_to_us"))).select(*cols)
    return merged if dim is None else dim.filter(F.col("valid_to_us").isNotNull()).select(*cols).unionByName(merged)
