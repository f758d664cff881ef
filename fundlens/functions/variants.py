"""Reading values of unknown type out of VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import numbers as N, refdata as R, text as X


_KINDS = (
    "STRING", "text", "BOOLEAN", "boolean", "ARRAY", "list", "OBJECT", "object",
    "BIGINT", "number", "DECIMAL", "number", "DOUBLE", "number", "FLOAT", "number",
)


def part(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def kind(value: Column) -> Column:
    """text, number, boolean, list, object or null (also for JSON null)."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for x in _KINDS]), name)


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def is_list(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY<")


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT<")


def raw_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def text(value: Column) -> Column:
    """The value if it is text."""
    return F.when(is_text(value), raw_text(value))


def trimmed(value: Column) -> Column:
    """Trimmed text, null when blank or no text."""
    said = raw_text(value)
    return F.when(is_text(value), F.when(said.rlike(r"(?U)\S"), X.strip(said)))


def items(value: Column) -> Column:
    """Entries of a list; anything else has none."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), no_items())


def no_items() -> Column:
    return F.array().cast("array<string>").cast("array<variant>")


def texts(value: Column) -> Column:
    """Trimmed, non-blank text entries of a list in order, each once."""
    return F.array_distinct(all_texts(value))


def all_texts(value: Column) -> Column:
    return F.filter(F.transform(items(value), trimmed), lambda t: t.isNotNull())


def truthy(value: Column) -> Column:
    return F.coalesce(
        F.when(is_text(value), raw_text(value) != "")
        .when(is_list(value), F.size(F.try_variant_get(value, "$", "array<variant>")) > 0)
        .when(is_object(value), F.schema_of_variant(value) != "OBJECT<>")
        .otherwise(F.try_variant_get(value, "$", "boolean")),
        F.lit(False),
    )


def boolean(value: Column) -> Column:
    said = F.lower(X.strip(raw_text(value))).isin(*R.TRUE_WORDS)
    return F.when(is_text(value), said).otherwise(truthy(value))


def nullable_boolean(value: Column) -> Column:
    unknown = kind(value).isNull() | (is_text(value) & (raw_text(value) == ""))
    return F.when(~unknown, boolean(value))


def number(value: Column) -> Column:
    """Text as ``parse_loose`` reads it, a boolean as 0 or 1, else the number; lists and objects are none."""
    return F.when(is_text(value), N.parse_loose(raw_text(value))).otherwise(F.try_variant_get(value, "$", "double"))


def months(value: Column) -> Column:
    return F.when(is_text(value), N.duration_text_months(X.strip(raw_text(value)))).otherwise(number(value))


def whole(value: Column) -> Column:
    """Number cut to an integer."""
    return number(value).try_cast("int")


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    known = F.create_map(*[F.lit(x) for word in allowed for x in (word, word)])
    return F.when(is_text(value), F.try_element_at(known, F.lower(X.strip(raw_text(value)))))


def some_of(value: Column, allowed: tuple[str, ...]) -> Column:
    words = F.transform(items(value), lambda v: one_of(v, allowed))
    return F.array_distinct(F.filter(words, lambda w: w.isNotNull()))


def percent_bands(value: Column) -> Column:
    """Percentage per size band; a single number is the default band."""
    bands = [number(part(value, b)).alias(b) for b in R.PERCENT_BANDS[:-1]]
    return F.struct(*bands, F.coalesce(number(part(value, "default")), number(value)).alias("default"))
