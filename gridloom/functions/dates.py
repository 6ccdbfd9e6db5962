"""Dates written as text, and date parts kept as text so that a missing date stays missing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Formats tried in this order.
DATE_FORMATS = ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yy", "MM/dd/yyyy", "dd MMM yyyy", "dd-MMM-yyyy",
                "MMM yyyy")
_NUMBERS, _ISO = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})$", r"^\d{4}-\d{1,2}-\d{1,2}$"
_DAY_NAME, _NAME_DAY = r"^(\d{1,2}) ([A-Za-z]{3,9}) (\d{4})$", r"^([A-Za-z]{3}) (\d{1,2}),? (\d{4})$"
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


DATE_SHAPE = (r"^\s*(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})"
              r"([T ]\d{1,2}:\d{2}(:\d{2})?)?\s*$")
_SHAPES = {"dd/MM/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "MM/dd/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
           "dd-MM-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "yyyy-MM-dd": r"^\d{4}-\d{1,2}-\d{1,2}$",
           "dd/MM/yy": r"^\d{1,2}/\d{1,2}/\d{2}$", "dd MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
           "dd-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "MMM yyyy": r"^[A-Za-z]{3} \d{4}$"}


def _lenient(fmt: str) -> str:
    """One-digit days and months are accepted."""
    return fmt.replace("dd", "d").replace("MM", "M") if "MMM" not in fmt else fmt.replace("dd", "d")


def century(at: Column, fmt: str) -> Column:
    """Two-digit years 69 to 99 belong to the last century."""
    if "yyyy" in fmt or "yy" not in fmt:
        return at
    return F.when(F.year(at) >= 2069, at - F.expr("interval 100 years")).otherwise(at)


def parse_one(c: Column, fmt: str) -> Column:
    """A date in one format, NULL when the text has another shape or names no real day."""
    t = F.trim(c)
    got = F.to_date(century(F.try_to_timestamp(t, F.lit(_lenient(fmt))), fmt))
    shape = _SHAPES.get(fmt)
    return F.when(t.rlike(shape), got) if shape else got


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses wins."""
    return F.coalesce(*[parse_one(c, f) for f in formats])


def _month_number(name: Column) -> Column:
    """1 to 12 of a month's name, whole or its first three letters; 0 for other words."""
    low = F.lower(name)
    return F.greatest(F.array_position(F.array(*[F.lit(m[:3]) for m in _MONTHS]), low), F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), low)).cast("string")


def day_text(day: Column, day_first: bool = True) -> Column:
    """A day written in numbers or with a month's name as `year-month-day`, by its shape alone; it may name no real day."""
    def got(pattern: str, i: int) -> Column:
        return F.regexp_extract(day, pattern, i)
    year = got(_NUMBERS, 4)
    year = F.when(F.length(year) == 4, year).otherwise(F.concat(F.when(year >= "69", "19").otherwise("20"), year))  # two-digit years 69 to 99: last century
    d, m = (got(_NUMBERS, 1), got(_NUMBERS, 3)) if day_first else (got(_NUMBERS, 3), got(_NUMBERS, 1))
    return (F.when(day.rlike(_ISO), day).when(day.rlike(_NUMBERS), F.concat_ws("-", year, m, d))
            .when(day.rlike(_DAY_NAME), F.concat_ws("-", got(_DAY_NAME, 3), _month_number(got(_DAY_NAME, 2)), got(_DAY_NAME, 1)))
            .when(day.rlike(_NAME_DAY), F.concat_ws("-", got(_NAME_DAY, 3), _month_number(got(_NAME_DAY, 1)), got(_NAME_DAY, 2))))


def parse_stamp(c: Column, day_first: bool = True) -> Column:
    """Date with an optional time, in day-first or month-first reading. The shape gives year, month and day; one cast checks
    that they name a real day."""
    t = F.trim(c)
    timed = t.rlike(r"[T ]\d{1,2}:\d{2}(:\d{2})?$")
    day = F.when(timed, F.regexp_replace(t, r"[T ]\d{1,2}:\d{2}(:\d{2})?$", "")).otherwise(t)
    at = day_text(day, day_first).try_cast("date").cast("timestamp")
    clock = F.split(F.regexp_extract(t, r"[T ](\d{1,2}:\d{2}(?::\d{2})?)$", 1), ":")
    secs = clock[0].cast("int") * 3600 + clock[1].cast("int") * 60 + F.coalesce(F.get(clock, F.lit(2)).cast("int"), F.lit(0))
    return F.when(timed, F.timestamp_seconds(F.unix_timestamp(at) + secs)).otherwise(at)


def part(c: Column, what: str) -> Column:
    """Month (2025-09), quarter (2025-Q3) or year of a date, as text."""
    if what == "month":
        return F.date_format(c, "yyyy-MM")
    if what == "quarter":
        return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))
    if what == "year":
        return F.year(c).cast("string")
    raise ValueError(f"unknown date part {what!r}")


def edge(c: Column, end: bool) -> Column:
    """A date, or a month (`2025-09`, `09/2025`, `Sep 2025`): its first day, or its last day as an upper bound."""
    t = F.trim(c)
    month = F.coalesce(*[F.when(t.rlike(shape), F.to_date(F.try_to_timestamp(t, F.lit(f)))) for shape, f in (
        (r"^\d{4}-\d{1,2}$", "yyyy-M"), (r"^\d{1,2}/\d{4}$", "M/yyyy"), (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
        (r"^[A-Za-z]{4,9} \d{4}$", "MMMM yyyy"))])
    return F.coalesce(F.last_day(month) if end else month, parse_date(t, ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")))


def listing_date(c: Column, today: Column) -> Column:
    """Dates as file listings print them: `7 Nov 2025`, `Nov 7, 2025`, `Nov 7` (this year, or last year when that lies
    ahead), a bare clock time (today)."""
    t = F.trim(c)
    full = F.coalesce(F.when(t.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.to_date(F.try_to_timestamp(t, F.lit("d MMM yyyy")))),
                      F.when(t.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), F.to_date(F.try_to_timestamp(t, F.lit("MMM d, yyyy")))))
    md = F.when(t.rlike(r"^[A-Za-z]{3} \d{1,2}$"), t)
    with_year = [F.to_date(F.try_to_timestamp(F.concat(md, F.lit(", "), (F.year(today) - k).cast("string")),
                                              F.lit("MMM d, yyyy"))) for k in (0, 1)]
    recent = F.when(with_year[0] <= today, with_year[0]).otherwise(with_year[1])
    clock = F.when(t.rlike(r"(?i)^\d{1,2}:\d{2}\s*[ap]m$"), today)
    return F.coalesce(full, recent, clock)


def show(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")
