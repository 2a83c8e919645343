"""Date and time functions. Instants are timestamps in UTC; business rules use a local zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UK = "Europe/London"
HOUR = 3_600_000_000


def local_date(ts: Column, zone: str = UK) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def at_local_hour(day: Column, hour: int, zone: str = UK) -> Column:
    """The instant of a full hour on a local day, right across clock changes."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.make_dt_interval(hours=F.lit(hour)), zone)


def lockdown_time(last_kickoff: Column) -> Column:
    """09:00 local on the day after the local date of the last kickoff."""
    return at_local_hour(F.date_add(local_date(last_kickoff), 1), 9)


def season_start_year(ts: Column, first_month: int = 7) -> Column:
    return F.year(ts) - F.when(F.month(ts) < first_month, 1).otherwise(0)


def publication_time(season: Column, previous_lockdown: Column) -> Column:
    """1 June of the season or the previous season's last lockdown, whichever is later; NULLs are skipped."""
    june = F.to_timestamp(F.concat(season.cast("string"), F.lit("-06-01 00:00:00")))
    return F.greatest(june, previous_lockdown)


def collection_time(kickoff: Column) -> Column:
    """Odds are collected on Tuesdays and Fridays at 15:00 local: the Tuesday of a match on Tuesday to
    Thursday, else the Friday on or before it; one hour before kickoff at the latest."""
    day = local_date(kickoff)
    wd = F.weekday(day)  # 0 is Monday
    back = F.when(wd.between(1, 3), wd - 1).otherwise(F.pmod(wd - 4, F.lit(7)))
    return F.least(at_local_hour(F.date_sub(day, back.cast("int")), 15), kickoff - F.expr("interval 1 hour"))


def days_between(a: Column, b: Column) -> Column:
    """(a - b) in fractional days."""
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(24 * HOUR)


def parse_dates(text: Column, formats: list[str]) -> Column:
    """The first format that fits; NULL if none."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def rolled_date(text: Column, reference: Column, pattern: str, back_days: int = 60, ahead_days: int = 366) -> Column:
    """A 'DD Mon' after a phrase, put into the year that lands in [ref - back, ref + ahead); the earliest
    such year of last, this and next. NULL if the phrase or a fitting year is missing."""
    day = F.regexp_extract(text, pattern, 1)
    mon = F.regexp_extract(text, pattern, 2)
    ref = F.to_date(reference)
    options = []
    for k in (-1, 0, 1):
        y = (F.year(ref) + k).cast("string")
        d = F.to_date(F.try_to_timestamp(F.concat_ws(" ", F.when(day != "", day), F.initcap(F.lower(mon)), y), F.lit("d MMM yyyy")))
        options.append(F.when((d >= F.date_sub(ref, back_days)) & (d < F.date_add(ref, ahead_days)), d))
    return F.coalesce(*options)


# The phrases before a return date, and the date's form (day and month).
RETURN_PHRASES = ("expected back", "suspended until")
RETURN_DATE = "(?i)(?:" + "|".join(RETURN_PHRASES) + r")\s+([0-3]?\d)\s+(\p{Alpha}{3})"
