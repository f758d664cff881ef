"""Date expressions; the evaluation date is always an argument."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, functions as F

from . import refdata as R

_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
)


def day(as_of: datetime.date) -> Column:
    return F.lit(as_of.isoformat()).cast("date")


def parse_any(text: Column) -> Column:
    """Date in one of the three accepted notations, else null."""
    value = F.trim(text)
    return F.coalesce(*[F.when(value.rlike(shape), F.try_to_date(value, fmt)) for shape, fmt in _FORMATS])


def parse_iso(text: Column) -> Column:
    value = F.trim(text)
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def days_left(text: Column, as_of: datetime.date) -> Column:
    return F.datediff(parse_any(text), day(as_of))


def urgency(text: Column, as_of: datetime.date) -> Column:
    left = F.datediff(parse_iso(text), day(as_of))
    return (
        F.when(left < 0, "scaduto").when(left < 30, "alta").when(left < 90, "media").when(left >= 90, "bassa")
    )


def italian_long(text: Column) -> Column:
    """"30 giugno 2026"; a value that is no date passes through trimmed, a blank one is null."""
    parsed = parse_any(text)
    names = F.array(*[F.lit(m) for m in R.MONTHS])
    spelled = F.concat_ws(
        " ", F.dayofmonth(parsed).cast("string"), F.element_at(names, F.month(parsed)), F.year(parsed).cast("string")
    )
    return F.when(F.trim(text) != "", F.when(parsed.isNotNull(), spelled).otherwise(F.trim(text)))


def normalised(text: Column) -> Column:
    """ISO text when a date is recognised, the raw text otherwise, null when blank."""
    return F.when(F.trim(text) != "", F.coalesce(F.date_format(parse_any(text), "yyyy-MM-dd"), text))


def months_since(founded: Column, as_of: datetime.date) -> Column:
    """Calendar-month difference that ignores the day."""
    return (F.lit(as_of.year) - F.year(founded)) * 12 + (F.lit(as_of.month) - F.month(founded))
