"""Review reasons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text as X


def parse_reasons(value: Column) -> Column:
    """Reasons from a JSON list, or the text itself when it is no JSON; other JSON gives none."""
    parsed = F.try_parse_json(value)
    entries = F.try_variant_get(parsed, "$", "array<string>")
    plain = F.when((F.trim(value) != "") & parsed.isNull(), F.array(F.trim(value)))
    return X.clean_list(F.coalesce(entries, plain))


def select_reasons(warnings: Column, gaps: Column) -> Column:
    """Reasons shown for a review: the review warnings, or one line per critical gap."""
    about_review = F.filter(
        warnings, lambda w: F.lower(w).contains("revisionare manualmente") | w.startswith("RF-007:")
    )
    lines = F.transform(gaps, lambda g: F.concat(F.lit("Campo critico mancante: "), g))
    return F.when(F.size(about_review) > 0, F.array_distinct(F.transform(about_review, lambda w: F.trim(w)))).otherwise(lines)
