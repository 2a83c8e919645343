"""Timestamps in many formats and zones, brought to exact UTC microseconds.

Parsing is done with built-in expressions. A local time without an offset is resolved by an
as-of join to zone-offset intervals that are exploded into (zone, local year) buckets: two
matching intervals mean ambiguous, none means nonexistent, one gives the offset.
"""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.engine.scale import broadcast_if_small

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
GREGORIAN_US = 146_097 * DAY_US
#: Years of the interval tables: from before zones had rules to 400 years after the tz database's last ones.
FIRST_YEAR, LAST_YEAR = 1800, 2500
FIRST_LOCAL_US = int((dt.datetime(FIRST_YEAR, 6, 1) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))

# Zone abbreviations and their offsets in minutes, used where the home zone has no such abbreviation.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "JST": 540, "NZST": 720, "NZDT": 780,
}

# Month names by their first three letters (English, with German and Spanish variants).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mai": 5, "okt": 10, "dez": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}


@functools.lru_cache(maxsize=1024)
def offset_intervals(zone: str, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> tuple[tuple[int, int, int], ...]:
    """(local_from_us, local_to_us, offset_us) half-open intervals of one zone, from the tz database."""
    try:
        tz = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return ()
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)

    def off(us: int) -> int:
        return tz.utcoffset((epoch + dt.timedelta(microseconds=us)).astimezone(tz)) // dt.timedelta(microseconds=1)

    lo = (dt.datetime(first_year, 1, 1, tzinfo=dt.UTC) - epoch) // dt.timedelta(microseconds=1)
    hi = (dt.datetime(last_year, 1, 1, tzinfo=dt.UTC) - epoch) // dt.timedelta(microseconds=1)
    out, start, at, cur = [], lo, lo, off(lo)
    while at < hi:
        nxt = min(at + 5 * DAY_US, hi)
        if (new := off(nxt)) != cur:
            a, b = at, nxt
            while b - a > 1_000_000:
                mid = (a + b) // 2_000_000 * 1_000_000
                mid = mid if a < mid < b else a + (b - a) // 2
                a, b = (mid, b) if off(mid) == cur else (a, mid)
            b = b // 1_000_000 * 1_000_000
            out.append((start + cur, b + cur, cur))
            start, cur = b, new
        at = nxt
    out.append((start + cur, hi + cur, cur))
    return tuple(out)


def zone_abbreviations(zone: str) -> dict[str, int]:
    """Abbreviation → offset in minutes as used in a zone since 1990."""
    try:
        tz = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return {}
    found: dict[str, int] = {}
    for year in range(1990, 2050):
        for month in (1, 4, 7, 10):
            t = dt.datetime(year, month, 15, 12, tzinfo=tz)
            if (name := t.tzname()) and name.isalpha():
                found.setdefault(name, int(t.utcoffset().total_seconds() // 60))
    return found


def zone_table(zones: DataFrame) -> DataFrame:
    """Zone intervals exploded into local years: (zone, local_year, intervals array). Made in the workers, so zones are
    never gathered; ``zones`` has a column ``home_zone``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(z, *i) for z in pdf["home_zone"] for i in offset_intervals(z)]
            yield pd.DataFrame(rows, columns=["zone", "local_from", "local_to", "offset"])

    df = zones.select("home_zone").filter("home_zone is not null").distinct().mapInPandas(run, "zone string, local_from long, local_to long, offset long")
    year = lambda c: F.year(F.timestamp_micros(c).cast("timestamp"))
    buckets = F.sequence(year(F.col("local_from")), year(F.col("local_to") - 1))
    df = df.withColumn("local_year", F.explode(buckets))
    return df.groupBy("zone", "local_year").agg(F.collect_list(F.struct("local_from", "local_to", "offset")).alias("intervals"))


def with_abbreviations(feeds: DataFrame) -> DataFrame:
    """``feeds`` (feed, home_zone, date_order) with the zone's abbreviations in minutes and whether the zone is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            zones = [z if isinstance(z, str) else None for z in pdf["home_zone"]]
            pdf["home_abbr"] = [zone_abbreviations(z) if z else {} for z in zones]
            pdf["zone_known"] = [bool(z) and bool(offset_intervals(z, 2000, 2002)) for z in zones]
            yield pdf

    return feeds.mapInPandas(run, "feed string, home_zone string, date_order string, home_abbr map<string,int>, zone_known boolean")


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


#: Time, fraction, half of day and zone after a date; six groups.
_TAIL = (
    r"(?:(?:,? |T|t|, )(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)? ?([AaPp]\.?[Mm]\.?)?(?: ?Uhr)?"
    r" ?(Z|z|[A-Za-z]{2,5}|(?:GMT|UTC)?[+-]\d{1,2}(?::?\d{2})?)?)?$"
)
_WEEK = r"(?:[A-Za-zäéáÁ]{2,10}\.?,? )?"
#: Date forms; each has three parts and a separator (groups 1, 3, 4 and 2). Tried in this order.
_FORMS = {
    "epoch": r"^(\d{9,16})()()(?:\.(\d{1,9}))?()()()()()()$",
    "ymd": r"^" + _WEEK + r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TAIL,
    "compact": r"^(\d{4})()(\d{2})(\d{2})" + _TAIL,
    "bare": r"^" + _WEEK + r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _TAIL,
    "named": r"^" + _WEEK + r"(\d{1,2})(?:st|nd|rd|th|\.)?[ -]()(?:de )?([A-Za-zäÄ]{3,12})\.?,?[ -](?:de )?(\d{4}|\d{2})" + _TAIL,
    "named_us": r"^" + _WEEK + r"([A-Za-zäÄ]{3,12})\.? ()(\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _TAIL,
}


def parse_local(text: Column, date_order: Column, home_abbr: Column) -> Column:
    """Struct(local_us, instant_us, kind) of a written time.

    ``kind``: 'instant' (epoch number, or an offset or zone name is written), 'local' (needs a
    zone), 'date' (a date alone) or 'none'. ``date_order`` ('dmy', 'mdy', 'ymd') applies to dates in
    bare numbers with slashes or dashes that don't start with a four-digit year. ``home_abbr`` maps
    the home zone's abbreviations to minutes. Precision beyond microseconds is cut off.
    """
    groups = "|".join(f"${i}" for i in range(1, 11))

    def split_text(s: Column) -> Column:
        hit = F.lit(None).cast("string")
        for form, p in reversed(_FORMS.items()):
            hit = F.when(s.rlike(p), F.regexp_replace(s, p, f"{form}|{groups}")).otherwise(hit)
        return F.split(hit, r"\|", -1)

    num = lambda c: F.when(c != "", c).cast("int")
    micro = lambda c: F.when(c != "", F.rpad(F.substring(c, 1, 6), 6, "0").cast("long"))
    month_map = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    by_name = lambda c: F.try_element_at(month_map, F.lower(F.substring(c, 1, 3)))
    year4 = lambda c: F.when(F.length(c) == 2, num(c) + 2000).otherwise(num(c))
    known = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    num_z = r"^(?:GMT|UTC)?([+-])(\d{1,2}):?(\d{2})?$"

    def parts(g: Column) -> Column:
        form, a, sep, b, c = g[0], g[1], g[2], g[3], g[4]
        n = F.length(a)
        frac = micro(c)
        epoch = F.when(
            form == "epoch",
            F.when(n.between(9, 10), a.cast("long") * 1_000_000 + F.coalesce(frac, F.lit(0)))
            .when(n.between(12, 13) & (c == ""), a.cast("long") * 1000)
            .when(n.between(15, 16) & (c == ""), a.cast("long")),
        )
        year_first = form.isin("ymd", "compact")
        day_first = (form == "bare") & ((sep == ".") | (date_order == "dmy"))
        month_first = (form == "bare") & (sep != ".") & (date_order == "mdy")
        short_year_first = (form == "bare") & (sep != ".") & (date_order == "ymd") & (F.length(c) == 2)
        named, named_us = form == "named", form == "named_us"
        y = F.when(year_first, num(a)).when(short_year_first, num(a) + 2000).when(day_first | month_first | named | named_us, year4(c))
        mo = (
            F.when(year_first | short_year_first | day_first, num(b))
            .when(month_first, num(a))
            .when(named, by_name(b))
            .when(named_us, by_name(a))
        )
        d = F.when(year_first | short_year_first, num(c)).when(day_first | named, num(a)).when(month_first | named_us, num(b))
        h0 = num(g[5])
        half = F.lower(F.substring(g[9], 1, 1))
        hour = F.when(half == "", h0).when((h0 >= 1) & (h0 <= 12), F.when(half == "p", h0 % 12 + 12).otherwise(h0 % 12))
        zone = F.upper(g[10])
        sign = F.regexp_extract(zone, num_z, 1)
        minutes = num(F.regexp_extract(zone, num_z, 2)) * 60 + F.coalesce(num(F.regexp_extract(zone, num_z, 3)), F.lit(0))
        offset = F.when(sign == "-", -minutes).when(sign == "+", minutes).otherwise(
            F.coalesce(F.try_element_at(home_abbr, zone), F.try_element_at(known, zone))
        )
        return F.struct(
            epoch.alias("epoch"), y.alias("y"), mo.alias("mo"), d.alias("d"), (g[5] != "").alias("timed"), hour.alias("h"),
            num(g[6]).alias("mi"), F.coalesce(num(g[7]), F.lit(0)).alias("s"), F.coalesce(micro(g[8]), F.lit(0)).alias("us"),
            F.when(zone != "", offset).alias("offset"), ((zone != "") & offset.isNull()).alias("bad_zone"),
        )

    def result(v: Column) -> Column:
        y, mo, d = v["y"], v["mo"], v["d"]
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        length = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        valid = mo.between(1, 12) & (d >= 1) & (d <= length) & (y >= 1) & ~v["bad_zone"]
        valid_time = v["h"].between(0, 23) & v["mi"].between(0, 59) & v["s"].between(0, 59)
        # days from the civil calendar, in integers (no session zone, no errors on bad dates)
        y0 = F.when(mo <= 2, y - 1).otherwise(y).cast("long")
        m0 = F.when(mo > 2, mo - 3).otherwise(mo + 9).cast("long")
        days = y0 * 365 + F.floor(y0 / 4) - F.floor(y0 / 100) + F.floor(y0 / 400) + F.floor((m0 * 153 + 2) / 5) + d - 719469
        local = days * DAY_US + ((v["h"].cast("long") * 60 + v["mi"]) * 60 + v["s"]) * 1_000_000 + v["us"]
        kind = (
            F.when(v["epoch"].isNotNull(), "instant")
            .when(valid & ~v["timed"], "date")
            .when(valid & valid_time & v["offset"].isNotNull(), "instant")
            .when(valid & valid_time, "local")
            .otherwise("none")
        )
        return F.struct(
            F.when(valid & valid_time & v["offset"].isNull(), local).alias("local_us"),
            F.coalesce(v["epoch"], F.when(valid & valid_time, local - v["offset"].cast("long") * 60_000_000)).alias("instant_us"),
            kind.alias("kind"),
        )

    s = F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))
    return _let(_let(_let(s, split_text), parts), result)


def normalise_times(cells: DataFrame, feeds: DataFrame, text: str, feed: str = "feed") -> DataFrame:
    """Resolve each cell's text to ``instant_us`` and a ``verdict``.

    ``feeds`` (feed, home_zone, date_order) says how a feed writes. Years from 1 on are resolved by the tz database's rules. Verdicts: 'instant', 'local' (resolved through the zone), 'ambiguous',
    'nonexistent', 'date', 'none' (no time; also NULL, blank and unknown feeds or zones without an
    offset written). Every input row comes out once with its own columns; nothing is shuffled
    as long as the feeds are few, which is measured.
    """
    empty = F.create_map().cast("map<string,int>")
    f = feeds.filter(F.col("feed").isNotNull()).groupBy(F.col("feed").cast("string").alias("feed")).agg(
        F.min("home_zone").alias("home_zone"), F.min("date_order").alias("date_order")
    )
    f = broadcast_if_small(with_abbreviations(f).withColumnRenamed("feed", "__feed"))
    own = [F.col(f"__in.`{c}`").alias(c) for c in cells.columns]
    x = cells.select(F.struct(*[F.col(f"`{c}`") for c in cells.columns]).alias("__in"), F.col(feed).alias("__f"), F.col(text).alias("__text"))
    x = x.join(f, F.col("__f") == F.col("__feed"), "left")
    x = x.withColumn(
        "__p", parse_local(F.col("__text"), F.coalesce("date_order", F.lit("")), F.coalesce("home_abbr", empty))
    )
    # rules without an end repeat every 400 years, so later years are looked up at their place in the table's last 400;
    # times before the table's first year lie in the zone's first interval
    year = F.year(F.timestamp_micros(F.col("__p.local_us")))
    cycles = F.when(year >= LAST_YEAR, F.floor((year - (LAST_YEAR - 400)) / 400)).otherwise(0)
    local = F.when(year < FIRST_YEAR, F.lit(FIRST_LOCAL_US)).otherwise(F.col("__p.local_us") - cycles * F.lit(GREGORIAN_US))
    x = x.withColumn("__local", local).withColumn("__year", F.year(F.timestamp_micros(F.col("__local"))))
    iv = broadcast_if_small(zone_table(f.select("home_zone")))
    x = x.join(iv, (F.col("home_zone") == F.col("zone")) & (F.col("__year") == F.col("local_year")), "left")
    hits = F.filter(
        F.col("intervals"), lambda i: (F.col("__local") >= i["local_from"]) & (F.col("__local") < i["local_to"])
    )
    x = x.withColumn("__hits", hits)
    n = F.size("__hits")
    kind = F.coalesce(F.col("__p.kind"), F.lit("none"))
    return x.select(
        *own,
        F.when(kind == "instant", F.col("__p.instant_us"))
        .when((kind == "local") & (n == 1), F.col("__p.local_us") - F.col("__hits")[0]["offset"])
        .alias("instant_us"),
        F.when(kind != "local", kind)
        .when(~F.coalesce(F.col("zone_known"), F.lit(False)), "none")
        .when(n == 1, "local")
        .when(n > 1, "ambiguous")
        .otherwise("nonexistent")
        .alias("verdict"),
    )
