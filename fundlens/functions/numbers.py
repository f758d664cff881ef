"""Number formats and parsers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import refdata as R


def parse_loose(text: Column) -> Column:
    """Number out of text with %, €, blanks and Italian or English separators; null when it is none."""
    s = F.translate(text, "%€ ", "")
    # one dot with three characters behind it, or several dots, part thousands
    thousands = s.rlike(r"(?s)\A[^.]*\.(?:[^.]{3}\z|[^.]*\.)")
    plain = F.when(text.contains(","), F.translate(text, ",.%€ ", ".")).when(thousands, F.translate(text, ".%€ ", "")).otherwise(s)
    return F.regexp_extract(plain, r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:\r?\n|\r)?\z", 0).try_cast("double")


def parse_italian(text: Column) -> Column:
    """1.234,56 → 1234.56"""
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def unit_months(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in R.UNIT_MONTHS for x in pair])
    return F.element_at(table, F.lower(unit))


def duration_text_months(text: Column) -> Column:
    """Months stated in a text such as "16 semestri"; text without a unit is read as months."""
    pattern = "(?iU)" + R.DURATION_PATTERN
    amount = F.regexp_extract(text, pattern, 1)
    unit = F.regexp_extract(text, pattern, 2)
    return F.when(text.rlike(pattern), parse_loose(amount) * unit_months(unit)).otherwise(parse_loose(text))


def grouped(value: Column) -> Column:
    """Half-even rounding to an integer with comma groups: 1,234"""
    return F.format_number(value.cast("double"), 0)


def euro(value: Column) -> Column:
    return F.concat(F.lit("€ "), F.replace(grouped(value), F.lit(","), F.lit(".")))


def plain_number(value: Column) -> Column:
    """Shortest text of a number: whole values without a fraction."""
    whole = value.cast("double") == F.floor(value.cast("double"))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("double").cast("string"))


def percent(value: Column) -> Column:
    return F.concat(plain_number(value), F.lit("%"))
