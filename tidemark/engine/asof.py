"""Point-in-time reads: a view of the catalogue that only sees rows available strictly before a cutoff."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.engine.catalog import Catalog
from tidemark.engine.scale import one_row

PREFERRED_SOURCE = "fpl"


def utc(moment: dt.datetime) -> dt.datetime:
    """A zoned moment in UTC; a naive one raises, as its meaning is unknown."""
    if moment.tzinfo is None or moment.utcoffset() is None:
        raise ValueError("a cutoff needs a time zone")
    return moment.astimezone(dt.UTC)


def latest_per_group(df: DataFrame, by: list[str], at: str, prefer: str | None = None, preferred: str = PREFERRED_SOURCE) -> DataFrame:
    """The newest row of each group; NULL keys are a group; ``by=[]`` makes one group.

    Of rows at the same instant the preferred source wins, then a hash of the row, so that the
    result doesn't depend on input order. A group limit runs before the shuffle.
    """
    order = [F.desc_nulls_last(at)]
    if prefer:
        order.append(F.desc(F.coalesce(F.col(prefer) == preferred, F.lit(False))))
    if not by:  # one group: a top-1 instead of a window over a single partition
        return df.orderBy(*order, F.xxhash64(*df.columns)).limit(1)
    w = Window.partitionBy(*by).orderBy(*order, F.xxhash64(*df.columns))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


@dataclass(frozen=True)
class AsOfView:
    """What was known strictly before ``cutoff``; ``deadline`` is the decision it is made for."""

    catalog: Catalog
    cutoff: dt.datetime
    deadline: dt.datetime

    @classmethod
    def at(cls, catalog: Catalog, deadline: dt.datetime, cutoff: dt.datetime | None = None) -> AsOfView:
        d = utc(deadline)
        c = utc(cutoff) if cutoff else d
        if c > d:
            raise ValueError("the cutoff must not be after the deadline")
        return cls(catalog, c, d)

    def earlier(self, cutoff: dt.datetime) -> AsOfView:
        """The same catalogue at an earlier cutoff; a later one would widen what is seen and raises."""
        c = utc(cutoff)
        if c > self.cutoff:
            raise ValueError("a view can only be narrowed")
        return AsOfView(self.catalog, c, c)

    def for_deadline(self, deadline: dt.datetime) -> AsOfView:
        """A later deadline seen from the same cutoff."""
        return AsOfView.at(self.catalog, deadline, self.cutoff)

    def _visible(self, name: str) -> DataFrame:
        spec = self.catalog.specs[name]
        return self.catalog.load(name).filter(F.col(spec.available_at) < F.lit(self.cutoff))

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """Rows with ``available_at`` < cutoff; static tables are refused (use ``lookup``). The filter and
        the projection reach the scan."""
        if self.catalog.specs[name].kind == "static":
            raise ValueError(f"{name} is static: look it up by visible keys")
        df = self._visible(name)
        return df.select(*columns) if columns else df

    def latest(self, name: str, by: list[str], columns: list[str] | None = None, at: str = "snapshot_at") -> DataFrame:
        df = self._visible(name)
        out = latest_per_group(df, by, at, "source" if "source" in df.columns else None)
        return out.select(*columns) if columns else out

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a static table whose key appears in ``keys`` (a frame of visible keys), once each."""
        spec = self.catalog.specs[name]
        if spec.kind != "static":
            raise ValueError(f"{name} is not static")
        wanted = keys.select(*spec.key).distinct()
        return self.catalog.load(name).join(wanted, list(spec.key), "left_semi").dropDuplicates(list(spec.key))

    def with_fallback(self, name: str, fallback: str, season: int, columns: list[str], at: str = "snapshot_at") -> DataFrame:
        """The newest whole snapshot of a season if one is visible, else the season's rows of ``fallback``."""
        snaps = self._visible(name).filter(F.col("season") == season)
        newest = one_row(snaps.agg(F.max(at).alias("at")))["at"]
        chosen = snaps.filter(F.col(at) == newest).select(*columns)
        other = self._visible(fallback).filter(F.col("season") == season).select(*columns)
        return chosen.unionByName(other.filter(newest.isNull()))

    def gameweek_for_deadline(self) -> DataFrame:
        """The one gameweek whose deadline is this view's; anything but one raises."""
        got = self.catalog.load("gameweek").filter(F.col("deadline_time") == F.lit(self.deadline)).limit(2)
        if (n := got.count()) != 1:
            raise LookupError(f"{n} gameweeks have this deadline")
        return got


def visible_per_cutoff(df: DataFrame, cutoffs: DataFrame, available_at: str, cutoff: str, bucket_days: int = 28) -> DataFrame:
    """Many as-of reads in one pass: for each cutoff, counts are taken from rows known before it.

    Instead of one scan per cutoff, rows are reduced to day counts and a running total over
    the days, bounded by the calendar, gives each cutoff's total: (cutoff, visible).
    """
    us = F.unix_micros(F.col(available_at).cast("timestamp"))
    rows = df.filter(F.col(available_at).isNotNull()).groupBy(us.alias("t")).agg(F.count("*").alias("n"))
    cut = cutoffs.select(F.unix_micros(F.col(cutoff).cast("timestamp")).alias("t")).distinct()
    both = rows.select("t", "n", F.lit(0).alias("is_cut")).unionByName(cut.select("t", F.lit(0).cast("long").alias("n"), F.lit(1).alias("is_cut")))
    both = both.withColumn("b", F.floor(F.col("t") / F.lit(bucket_days * 86_400_000_000)))
    before = both.groupBy("b").agg(F.sum("n").alias("bn"))
    before = before.select("b", (F.sum("bn").over(Window.orderBy("b")) - F.col("bn")).alias("before"))
    # at equal instants the cutoff comes first: visibility is strict
    w = Window.partitionBy("b").orderBy("t", F.desc("is_cut")).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("inside", F.sum("n").over(w)).filter("is_cut = 1")
    return inside.join(before, "b").select(F.col("t").alias("cutoff_us"), (F.col("before") + F.col("inside")).alias("visible"))
