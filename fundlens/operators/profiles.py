"""Per-side preparation: everything a pair needs is computed once per call and once per company."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, refdata as R, text as X


def sector_prefix(code: Column) -> Column:
    """First two characters of the division part of a sector code."""
    bare = F.replace(F.trim(code), F.lit(" "), F.lit(""))
    return F.substring(F.substring_index(bare, ".", 1), 1, 2)


def division(code: Column) -> Column:
    prefix = sector_prefix(code)
    return F.when(prefix.rlike(r"^\d+$"), prefix.try_cast("int"))


def section_of_division(number: Column) -> Column:
    """Section letter of a division; some divisions lie in no section."""
    by_division = [None] * 100
    for letter, low, high, _ in R.SECTIONS:
        for d in range(low, high + 1):
            by_division[d] = letter
    letters = F.array(*[F.lit(x).cast("string") for x in by_division])
    return F.get(letters, number)


def section_letter(entry: Column) -> Column:
    """First standalone section letter in a text such as "Sezione K"."""
    letter = F.regexp_extract(F.upper(F.trim(entry)), "(?U)" + R.SECTION_LETTER_PATTERN, 1)
    return F.when(letter != "", letter)


def legal_category(key: Column) -> Column:
    """Category of a normalised legal form: exact key first, else the longest key it contains."""
    pairs = [(k, category) for category, keys in R.LEGAL_FORM_KEYS.items() for k in keys]
    exact = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    contained = F.lit(None).cast("string")
    # Built inside out: the longest key, and the earlier one of equally long keys, is asked first.
    for k, category in sorted(reversed(pairs), key=lambda p: len(p[0])):
        contained = F.when(key.contains(k), F.lit(category)).otherwise(contained)
    return F.when(key != "", F.coalesce(F.try_element_at(exact, key), contained))




def prepare_companies(companies: DataFrame, as_of: datetime.date) -> DataFrame:
    """Adds the ``f_*`` columns a pair expression reads."""
    code = X.blank_to_null(F.col("sector_code"))
    description = X.blank_to_null(F.col("activity_description"))
    form_key = X.legal_form_key(X.blank_to_null(F.col("legal_form")))
    return companies.withColumns(
        {
            "f_region": F.lower(X.blank_to_null(F.col("region"))),
            "f_code": F.lower(code),
            "f_prefix": sector_prefix(code),
            "f_section": section_of_division(division(code)),
            "f_tokens": X.word_tokens(description, 4),
            "f_size": F.lower(X.blank_to_null(F.col("size_class"))),
            "f_revenue": F.col("revenue").try_cast("double"),
            "f_employees": F.col("employees").try_cast("int"),
            "f_months": dates.months_since(F.col("founded_on"), as_of),
            "f_form": form_key,
            "f_category": legal_category(form_key),
        }
    )


def prepare_calls(calls: DataFrame) -> DataFrame:
    """Adds the ``k_*`` columns a pair expression reads."""
    regions = X.clean_list(F.col("regions"))
    codes = X.clean_list(F.col("sector_codes"))
    activities = X.clean_list(F.col("activities"))
    sizes = X.clean_list(F.col("sizes"))
    excluded = X.clean_list(F.col("excluded_sections"))
    forms = F.transform(X.clean_list(F.col("legal_forms")), X.legal_form_key)
    lowered = F.array_distinct(F.transform(regions, lambda r: F.lower(r)))
    categories = F.transform(forms, legal_category)
    return calls.withColumns(
        {
            # a call whose record could not be read restricts nothing by its columns, and must not admit everyone
            "k_usable": F.coalesce("payload_ok", F.lit(False)) if "payload_ok" in calls.columns else F.lit(True),
            "k_regions": lowered,
            "k_region_free": (F.size(lowered) == 0)
            | F.arrays_overlap(lowered, F.array(*[F.lit(r) for r in R.ANY_REGION])),
            "k_open": F.coalesce(F.col("open_to_all"), F.lit(False)),
            "k_codes": F.array_distinct(F.transform(codes, lambda c: F.lower(c))),
            "k_prefixes": F.array_distinct(F.transform(codes, sector_prefix)),
            "k_activities": F.transform(activities, lambda a: X.word_tokens(a, 4)),
            "k_sections": F.array_distinct(
                F.filter(F.transform(excluded, section_letter), lambda letter: letter.isNotNull())
            ),
            "k_sizes": F.array_distinct(F.transform(sizes, lambda s: F.lower(s))),
            "k_cap": F.col("revenue_max").try_cast("double"),
            "k_forms": F.array_distinct(forms),
            "k_registry": F.exists(forms, lambda f: f.contains(R.REGISTRY_MARKER)),
            "k_categories": F.array_distinct(F.filter(categories, lambda c: c.isNotNull())),
            "k_unknown_forms": F.filter(forms, lambda f: legal_category(f).isNull()),
        }
    ).withColumn("k_ambiguous", ~has_constraints() & ~F.col("k_open"))


def has_constraints() -> Column:
    """Does the call restrict anything? Only the literal "Tutta Italia" frees the territory here."""
    sector = ((F.size("k_codes") > 0) | (F.size("k_activities") > 0)) & ~F.col("k_open")
    territory = (F.size("k_regions") > 0) & ~F.array_contains("k_regions", "tutta italia")
    revenue = F.coalesce(F.col("k_cap") != 0, F.lit(False))
    return sector | territory | revenue | F.size("k_sizes").between(1, 3)
