"""Times: parsing, local text, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_HOURS = 3


def parse_dt(c: Column) -> Column:
    """An ISO date or time without its zone; null if it is none."""
    text = F.regexp_replace(F.trim(c), r"([+-]\d{2}:?\d{2}|Z)$", "")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"), F.replace(text, F.lit("T"), F.lit(" ")))
    return iso.try_cast("timestamp_ntz")


def to_local_iso(ts: Column) -> Column:
    """A UTC time (without zone) as local ISO text with its offset."""
    local = ts.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(LOCAL_HOURS))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"+{LOCAL_HOURS:02d}:00"))


def run_at(kind: Column, time: Column, weekday: Column, once_at: Column, now: Column) -> Column:
    """When a schedule runs: once at its time; daily today, weekly in this week on its day (0 Monday to 6), at HH:MM.

    Hours, minutes and the weekday are clamped; a time that is none is 01:00; an unknown kind is daily.
    """
    parts = r"^\s*(\d+)\s*:\s*(\d+)"
    good = F.left(F.coalesce(time, F.lit("")), F.lit(5)).rlike(parts)
    part = lambda k, top: F.least(F.regexp_extract(F.left(time, F.lit(5)), parts, k).try_cast("int"), F.lit(top))
    hour, minute = F.when(good, part(1, 23)).otherwise(1), F.when(good, part(2, 59)).otherwise(0)
    at = F.date_trunc("DAY", now).cast("timestamp_ntz") + F.make_dt_interval(hours=hour, mins=minute)
    wanted = F.greatest(F.lit(0), F.least(F.lit(6), F.coalesce(weekday, F.lit(0)).cast("int")))
    return F.when(kind == "once", once_at.cast("timestamp_ntz")).when(kind == "weekly", at + F.make_dt_interval(days=wanted - F.weekday(now))).otherwise(at)


def next_run_at(kind: Column, time: Column, weekday: Column, once_at: Column, now: Column) -> Column:
    """The run, or where it is not after now the next one: a day later, or a week for weekly ones; 'once' keeps its time."""
    at = run_at(kind, time, weekday, once_at, now)
    past = at <= now.cast("timestamp_ntz")
    step = F.when(kind == "weekly", F.make_dt_interval(days=F.lit(7))).otherwise(F.make_dt_interval(days=F.lit(1)))
    return F.when((kind != "once") & past, at + step).otherwise(at)
