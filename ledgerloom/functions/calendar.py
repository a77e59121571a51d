"""Lenient dates: ISO, day-first, month-first where day-first is impossible, and spreadsheet serial numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import TEXT, Rule, looks_like

#: Day 0 of spreadsheet serial dates.
EPOCH = "1899-12-30"
_TIME = r"(?:[ T]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*(?:Z|[+-]\d{2}:?\d{2}))?)?"
_YEAR_FIRST = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$"
_DAY_FIRST = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TIME}$"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def _date_of(text: Column) -> Column:
    serial = F.date_add(F.lit(EPOCH).cast("date"), F.regexp_extract(text, r"^(\d{5,6})(\.0+)?$", 1).try_cast("int"))
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    year = part(_DAY_FIRST, 3)
    full_year = F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") < 69, F.lit("20")).otherwise(F.lit("19")), year)).otherwise(year)
    first, second = part(_DAY_FIRST, 1), part(_DAY_FIRST, 2)
    day_first = F.coalesce(_date(full_year, second, first), _date(full_year, first, second))
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))  # the usual form first
        .when(text.rlike(r"^\d{5,6}(\.0+)?$"), serial)
        .when(text.rlike(_YEAR_FIRST), _date(part(_YEAR_FIRST, 1), part(_YEAR_FIRST, 2), part(_YEAR_FIRST, 3)))
        .when(text.rlike(_DAY_FIRST), day_first)
    )


DATE = Rule(*TEXT.steps, _date_of, plain=(looks_like(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), lambda c: c.try_cast("date")))


def to_date(c: Column) -> Column:
    return DATE(c)


def report_date(file_name: Column) -> Column:
    """The first dd.mm.yyyy (also with - or _) in a file name; null if there is none or no such day."""
    pattern = r"(\d{2})[.\-_](\d{2})[.\-_](\d{4})"
    day, month, year = (F.regexp_extract(file_name, pattern, k) for k in (1, 2, 3))
    return F.when(file_name.rlike(pattern), _date(year, month, day))
