"""Proof that results don't depend on the future: corrupt or cut it and compare."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine.asof import AsOfView, utc
from tidemark.engine.catalog import Catalog


def truncate_future(df: DataFrame, deadline: dt.datetime, available_at: str = "available_at") -> DataFrame:
    """Rows available strictly before the deadline."""
    return df.filter(F.col(available_at) < F.lit(utc(deadline)))


def _noise(field: T.StructField, seed: int, salt: Column) -> Column:
    h = F.xxhash64(salt, F.lit(field.name), F.lit(seed))
    t = field.dataType
    if isinstance(t, T.BooleanType):
        return h % 2 == 0
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType)):
        return F.pmod(h, F.lit(1000)).cast(t)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return (F.pmod(h, F.lit(100_000)) / 100.0).cast(t)
    if isinstance(t, T.StringType):
        return F.hex(h)
    if isinstance(t, T.TimestampType):
        return F.timestamp_micros(F.pmod(h, F.lit(2_000_000_000_000_000)))
    if isinstance(t, T.DateType):
        return F.date_from_unix_date(F.pmod(h, F.lit(20_000)).cast("int"))
    return F.lit(None).cast(t)


def corrupt_future(
    df: DataFrame,
    deadline: dt.datetime,
    keys: tuple[str, ...] = (),
    available_at: str = "available_at",
    seed: int = 1,
    ghost_fraction: float = 0.01,
) -> DataFrame:
    """Randomise rows available at or after the deadline and add ghost copies of past rows after it.

    Of a future row's cells 45% become fresh values, 10% NULL, keys are kept in 75% of the rows;
    ``available_at`` is left alone. Past rows are untouched. All choices are hashes of the row
    and the seed, so the result is reproducible on any partitioning.
    """
    d = F.lit(utc(deadline))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    future = F.coalesce(F.col(available_at) >= d, F.lit(True))
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == available_at:
            cols.append(c)
            continue
        u = F.pmod(F.xxhash64(row, F.lit(f.name), F.lit(seed + 1)), F.lit(100))
        if f.name in keys:
            new = F.when(u < 75, c).otherwise(_noise(f, seed, row))
        else:
            new = F.when(u < 45, _noise(f, seed, row)).when(u < 55, F.lit(None).cast(f.dataType)).otherwise(c)
        cols.append(F.when(future, new).otherwise(c).alias(f.name))
    share = F.pmod(F.xxhash64(row, F.lit(seed + 2)), F.lit(1_000_000)) < int(ghost_fraction * 1_000_000)
    later = d + F.make_dt_interval(days=F.pmod(F.xxhash64(row, F.lit(seed + 3)), F.lit(60)).cast("int"))
    ghosts = df.filter(~future & share).withColumn(available_at, later.cast(df.schema[available_at].dataType))
    return df.select(*cols).unionByName(ghosts)


def fingerprint(df: DataFrame) -> tuple[str, int, int, int]:
    """Schema, row count and two order-free hashes of all cells (NULLs and their places count)."""
    parts: list[Column] = []
    for c in df.columns:
        parts += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`")]
    h = F.xxhash64(*parts)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 16)).alias("s")).first()
    return df.schema.json(), r.n, r.x or 0, r.s or 0


def check_leakage(
    catalog: Catalog, deadlines: list[dt.datetime], builders: dict[str, Callable[[AsOfView], DataFrame]], seed: int = 1
) -> list[tuple[str, dt.datetime, str]]:
    """(builder, deadline, variant) of every result that changes when the future is corrupted or cut.

    An exception on one side only is a leak, too. The loop runs over registered builders and
    chosen deadlines; the data stays distributed, only fingerprints come back.
    """
    leaks = []
    for d in deadlines:
        variants: dict[str, Catalog] = {"clean": catalog}
        for kind in ("corrupted", "truncated"):
            frames = {}
            for name, spec in catalog.specs.items():
                try:
                    df = catalog.load(name)
                except Exception:  # noqa: BLE001  a table that isn't there can't leak
                    continue
                if spec.kind == "static":
                    frames[name] = df
                elif kind == "corrupted":
                    frames[name] = corrupt_future(df, d, spec.key, spec.available_at, seed)
                else:
                    frames[name] = truncate_future(df, d, spec.available_at)
            variants[kind] = Catalog(catalog.spark, None, frames, dict(catalog.specs))
        for name, build in builders.items():
            seen: dict[str, object] = {}
            for kind, cat in variants.items():
                try:
                    seen[kind] = fingerprint(build(AsOfView.at(cat, d)))
                except Exception as e:  # noqa: BLE001
                    seen[kind] = f"{type(e).__name__}"
            leaks += [(name, d, kind) for kind in ("corrupted", "truncated") if seen[kind] != seen["clean"]]
    return leaks


def spread_deadlines(deadlines: DataFrame, at: str, n: int, held_out: Column | None = None) -> DataFrame:
    """The middle deadline of each of ``n`` equal runs of the ordered deadlines (a bounded dimension)."""
    d = deadlines.select(at).distinct()
    if held_out is not None:
        d = d.filter(~held_out)
    w = Window.orderBy(at)
    d = d.withColumn("tile", F.ntile(n).over(w))
    wt = Window.partitionBy("tile").orderBy(at)
    d = d.withColumn("r", F.row_number().over(wt)).withColumn("size", F.count("*").over(Window.partitionBy("tile")))
    return d.filter(F.col("r") == F.floor((F.col("size") + 1) / 2)).select(at)
