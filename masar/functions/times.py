"""Clocks and calendars as column expressions; sessions are in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAIRO = "Africa/Cairo"


def parse_utc(text: Column) -> Column:
    """ISO text to a timestamp; without an offset it is UTC; anything else is null."""
    return F.try_to_timestamp(text)


def cairo(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, CAIRO)


def quarter(ts: Column) -> Column:
    """The 15-minute slot of the day, 0 to 95."""
    return F.hour(ts) * 4 + F.floor(F.minute(ts) / 15).cast("int")


def slot_minute(slot: Column) -> Column:
    return slot * 15 + 300


def clock_of_minutes(minutes: Column) -> Column:
    m = F.pmod(minutes, F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def clock12(minutes: Column) -> Column:
    h = F.floor(F.pmod(minutes, F.lit(1440)) / 60).cast("int")
    return F.format_string("%d:%02d %s", F.pmod(h + 11, F.lit(12)) + 1, F.pmod(minutes, F.lit(60)).cast("int"), F.when(h < 12, "AM").otherwise("PM"))


def same_weekday_ahead(target: Column, today: Column) -> Column:
    """A past date becomes the next date with its weekday, a week ahead if that is today."""
    ahead = F.pmod(F.weekday(target) - F.weekday(today), F.lit(7))
    return F.when(target >= today, target).otherwise(F.date_add(today, F.when(ahead == 0, 7).otherwise(ahead)))


def next_night(ts: Column) -> Column:
    """The next 03:30 of Cairo, in UTC."""
    local = cairo(ts)
    night = F.date_trunc("day", local) + F.expr("INTERVAL '3:30' HOUR TO MINUTE")
    return F.to_utc_timestamp(F.when(night > local, night).otherwise(night + F.expr("INTERVAL 1 DAY")), CAIRO)
