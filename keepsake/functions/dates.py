"""Dates of exports: strict building, vote on the day's place, epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _int(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast("int")


def build(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None, second: Column | None = None) -> Column:
    """A UTC timestamp from integers; null for days or times that do not exist."""
    zero = F.lit(0)
    ymd = F.try_make_timestamp(year, month, day, F.coalesce(hour, zero) if hour is not None else zero, F.coalesce(minute, zero) if minute is not None else zero,
                               (F.coalesce(second, zero) if second is not None else zero).cast("decimal(8,6)"), F.lit("UTC"))
    return F.when((F.coalesce(second, zero) if second is not None else zero) < 60, ymd)


def date_votes(date: Column) -> tuple[Column, Column, Column]:
    """Votes of a d/m/y-like text for (dmy, mdy, ymd), 0 or 1 each."""
    parts = F.split(date, "[-/.]")
    three = F.size(parts) == 3
    a, b = _int(F.get(parts, F.lit(0))), _int(F.get(parts, F.lit(1)))
    year_first = three & (F.length(F.trim(F.get(parts, F.lit(0)))) == 4)
    vote = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return vote(three & ~year_first & (a > 12) & (b <= 12)), vote(three & ~year_first & (b > 12) & (a <= 12)), vote(year_first)


def date_order(dmy: Column, mdy: Column, ymd: Column) -> Column:
    return F.when(ymd > dmy + mdy, "ymd").when(mdy > dmy, "mdy").otherwise("dmy")


def chat_date(date: Column, time: Column, ampm: Column, order: Column) -> Column:
    """A chat header's date and time in the given order of day, month and year; two-digit years are 20xx."""
    d, t = F.split(date, "[-/.]"), F.split(time, "[.:]")
    part = lambda a, i: _int(F.get(a, F.lit(i)))
    year = F.when(order == "ymd", part(d, 0)).otherwise(part(d, 2))
    month = F.when(order == "mdy", part(d, 0)).otherwise(part(d, 1))
    day = F.when(order == "ymd", part(d, 2)).when(order == "mdy", part(d, 1)).otherwise(part(d, 0))
    h, half = part(t, 0), F.lower(F.coalesce(ampm, F.lit("")))
    hour = F.when(half.contains("p") & (h < 12), h + 12).when(half.contains("a") & (h == 12), 0).otherwise(h)
    return build(F.when(year < 100, year + 2000).otherwise(year), month, day, hour, part(t, 1), part(t, 2))


def linkedin_date(raw: Column) -> Column:
    """2020-01-31[ 10:20[:30]] [UTC], 31 Jan 2020, Jan 31, 2020, 1/31/20[20]; null for anything else.

    The text is read by its form, in which 9 stands for a number and a for a word; numbers and words are then
    taken by their places.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    core = F.rtrim(F.regexp_replace(text, "(?i)(UTC|Z)$", ""))
    form = lambda t: F.regexp_replace(F.regexp_replace(t, "[0-9]+", "9"), "[A-Za-z]+", "a")
    numbers = F.regexp_extract_all(core, F.lit("[0-9]+"), F.lit(0))
    number = lambda i: F.get(numbers, F.lit(i)).try_cast("int")
    digits = lambda i: F.length(F.get(numbers, F.lit(i)))
    clock = F.forall(F.slice(numbers, 2, 9), lambda n: F.length(n) == 2)
    stamp = form(F.regexp_replace(core, "(?<=[0-9])[Tt](?=[0-9])", " ")).isin("9-9-9", "9-9-9 9:9", "9-9-9 9:9:9")
    iso = stamp & (digits(0) == 4) & clock
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    place = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(F.get(words, F.lit(0)), 1, 3))).cast("int")
    spoken = form(F.regexp_replace(text, r"\s+", " "))
    named = spoken.isin("9 a 9", "a 9 9", "a 9, 9") & (F.length(F.get(words, F.lit(0))) >= 3) & (place > 0) & (digits(0) <= 2) & (digits(1) == 4)
    slashed = (spoken == "9/9/9") & (digits(0) <= 2) & (digits(1) <= 2) & digits(2).isin(2, 4)
    return (F.when(iso, build(number(0), number(1), number(2), number(3), number(4), number(5)))
            .when(named, build(number(1), place, number(0)))
            .when(slashed, build(F.when(digits(2) == 2, number(2) + 2000).otherwise(number(2)), number(0), number(1))))


def apple_date(raw: Column) -> Column:
    """Since 2001-01-01: nanoseconds from 1e14 on, microseconds from 1e11 on, else seconds."""
    n = raw.cast("double")
    millis = F.when(F.abs(n) >= 1e14, n / 1e6).when(F.abs(n) >= 1e11, n / 1e3).otherwise(n * 1e3)
    return F.timestamp_millis((F.lit(978_307_200_000) + millis).cast("long"))


def epoch(raw: Column, per_second: int = 1) -> Column:
    """A timestamp of numbers or numeric text since 1970; null for anything else."""
    n = raw.cast("string").try_cast("double")
    return F.when(F.abs(n) < 8.64e12 * per_second, F.timestamp_millis((n * (1000 / per_second)).cast("long")))


def telegram_date(unix: Column, date: Column) -> Column:
    """date_unixtime, else date as a number, else date as ISO text, UTC where it names no zone."""
    text = date.cast("string")
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.coalesce(epoch(unix), epoch(date), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), zoned.try_cast("timestamp")))
