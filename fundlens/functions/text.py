"""Text expressions shared by the operators (JVM-side only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import refdata as R

def _fold_tables() -> tuple[str, str]:
    """Accent table as Unicode itself defines it: a letter maps to the base of its decomposition."""
    import unicodedata

    accented, plain = [], []
    for code in range(0xC0, 0x180):
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
        if base != [char] and len(base) == 1:
            accented.append(char)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _fold_tables()


def fold_accents(text: Column) -> Column:
    return F.translate(text, _ACCENTED, _PLAIN)


def squash(text: Column) -> Column:
    """Runs of Unicode whitespace become one blank; outer blanks go."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Outer Unicode whitespace goes."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    stripped = F.trim(text)
    return F.when(stripped != "", stripped)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit(""))


def clean_list(values: Column) -> Column:
    """Trimmed, non-blank entries; a missing list is an empty one."""
    trimmed = F.transform(values, lambda v: F.trim(v))
    return F.coalesce(F.filter(trimmed, lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>"))


def matches(text: Column, pattern: str) -> Column:
    """Unicode-aware, case-insensitive search."""
    return text.rlike("(?iU)" + pattern)


def mentions(lowered: Column, *parts: str) -> Column:
    """Whether a lower-case text holds one of some strings: a cheap look before a pattern that needs one of them.

    The strings must be free of i, k and s: patterns take a dotless i, a Kelvin sign and a long s for those letters.
    """
    out = F.lit(False)
    for part in parts:
        if set("iks") & set(part):
            raise ValueError(f"a pattern may match a text without {part!r}")
        out = out | lowered.contains(part)
    return out


def folded(text: Column) -> Column:
    """fold_accents, which leaves a text of one byte a character alone."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(fold_accents(text))


def capture(text: Column, pattern: str, group: int) -> Column:
    """First match's group, or null when nothing matches."""
    return F.when(matches(text, pattern), F.regexp_extract(text, "(?iU)" + pattern, group))


def word_tokens(text: Column, min_length: int) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= min_length))


def spans(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start,stop,hit>>, 0-based code-point positions.

    Splitting on the pattern and extracting it align one to one, so match k starts after the first
    k+1 pieces and the first k hits.
    """
    regex = "(?iU)" + pattern
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.transform(F.split(text, regex, -1), lambda piece: F.length(piece))
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,hit:string>>").alias("out")
    )
    steps = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))

    def advance(acc: Column, step: Column) -> Column:
        begin = acc["at"] + step["gap"]
        stop = begin + F.length(step["hit"])
        entry = F.struct(begin.alias("start"), stop.alias("stop"), step["hit"].alias("hit"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(entry)).alias("out"))

    return F.when(F.size(hits) > 0, F.aggregate(steps, start, advance, lambda acc: acc["out"])).otherwise(
        F.array().cast("array<struct<start:int,stop:int,hit:string>>")
    )


def piece(text: Column, begin: Column, end: Column) -> Column:
    """Characters [begin, end) with 0-based bounds clipped to the text."""
    low = F.greatest(begin, F.lit(0))
    return F.substring(text, low + 1, F.greatest(end - low, F.lit(0)))


def shorten(text: Column, limit: int) -> Column:
    compact = squash(text)
    cut = F.concat(F.rtrim(F.substring(compact, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(compact) <= limit, compact).otherwise(cut)


def legal_form_key(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s./\-]", "")
    return F.lower(F.translate(bare, *R.LEGAL_FORM_ACCENTS))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text without regard to spacing and case; blank text has none."""
    plain = F.replace(F.lower(squash(text)), F.lit("ß"), F.lit("ss"))
    return F.when(plain != "", F.sha2(plain, 256))
