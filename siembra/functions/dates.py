"""Months, calendar features and tolerant dates as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from siembra.functions.numeric import lookup
from siembra.functions.text import strip_accents

# Spanish month names.
MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}
MONTH_NAMES = {v: k for k, v in MONTHS.items() if k != "setiembre"}


def month_number(name: Column) -> Column:
    plain = lookup(F.trim(F.lower(name.cast("string"))), MONTHS)
    return F.coalesce(plain, lookup(F.trim(F.lower(strip_accents(name))), MONTHS))  # accents are looked for only where the name isn't plain


def month_start(year: Column, name: Column) -> Column:
    """First day of a named month; null if the year or the name isn't one."""
    y, m = year.try_cast("int"), month_number(name)
    return F.when(y.between(1, 9999), F.make_date(y, m, F.lit(1)))


def month_of(date: Column) -> Column:
    return F.trunc(date, "MM")


def month_index(date: Column) -> Column:
    """Months since year 0: differences are whole months."""
    return F.year(date) * 12 + F.month(date)


def parse_date(c: Column) -> Column:
    """ISO and day/month/year text, and serial numbers of spreadsheets."""
    text = F.trim(c.cast("string"))
    serial = F.when(text.rlike(r"^\d{4,6}(\.\d+)?$"), text.try_cast("double").cast("int"))
    return F.coalesce(
        F.to_date(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.substring_index(F.substring_index(text, " ", 1), "T", 1)), F.lit("yyyy-M-d"))),
        F.to_date(F.try_to_timestamp(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), text), F.lit("d/M/yyyy"))),
        F.date_add(F.lit("1899-12-30").cast("date"), serial),
    )


def calendar(date: Column) -> dict[str, Column]:
    """Month, quarter, year and the month on a circle."""
    turn = F.month(date) * F.lit(2 * math.pi / 12)
    return {"month": F.month(date), "quarter": F.quarter(date), "year": F.year(date), "month_sin": F.sin(turn), "month_cos": F.cos(turn)}


def day_flags(date: Column) -> dict[str, Column]:
    """Weekday from 0 = Monday, ISO week and whether a month starts or ends."""
    return {"weekday": F.weekday(date), "week": F.weekofyear(date), "is_month_start": (F.dayofmonth(date) == 1).cast("int"), "is_month_end": (F.last_day(date) == date).cast("int")}


def in_months(date: Column, months: Column, blank: bool = False) -> Column:
    """Whether the month stands in a list such as ``1,2,12``; ``blank`` for an empty list."""
    given = F.coalesce(months, F.lit(""))
    return F.when(F.trim(given) == "", F.lit(blank)).otherwise(F.array_contains(F.transform(F.split(given, ","), lambda m: F.trim(m)), F.month(date).cast("string")))
