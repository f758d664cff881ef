"""List expressions that keep order: distinct by signature, greedy phrase merging, entity merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import refdata as R, text as X


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def distinct_by(values: Column, signature: Callable[[Column], Column]) -> Column:
    """First entry of every signature, in order."""
    marked = F.transform(values, lambda v: F.struct(v.alias("v"), signature(v).alias("s")))
    firsts = bind(
        marked,
        lambda all_: F.filter(
            all_, lambda e, i: F.array_position(F.transform(all_, lambda x: x["s"]), e["s"]) == i + 1
        ),
    )
    return F.transform(firsts, lambda e: e["v"])


def source_signature(source: Column) -> Column:
    return F.to_json(F.struct(source["campo"], source["pagina"], source["testo"]))


def phrase_tokens(phrase: Column) -> Column:
    words = F.regexp_extract_all(X.fold_accents(F.lower(phrase)), F.lit("([a-z0-9]+)"), F.lit(1))
    told = F.filter(
        words,
        lambda w: ((F.length(w) >= 3) | w.rlike("^[0-9]+$")) & ~w.isin(*R.PHRASE_STOPWORDS),
    )
    same = F.create_map(*[F.lit(x) for pair in R.PHRASE_SYNONYMS for x in pair])
    return F.array_distinct(F.transform(told, lambda w: F.coalesce(F.try_element_at(same, w), w)))


def tidy_phrase(raw: Column) -> Column:
    """Compacted phrase without outer punctuation and without "x e x" repetitions."""
    compact = F.btrim(F.regexp_replace(raw, r"(?U)\s+", " "), F.lit(" ,;."))
    return F.regexp_replace(compact, r"(?iU)\b([A-Za-zÀ-ÿ]{3,})\s+(?:e|ed|,)\s+\1\b", "$1")


def _holds_word(text: Column, word: Column) -> Column:
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return (F.length(word) >= 5) & F.regexp_like(text, quoted)


def same_meaning(a: Column, b: Column) -> Column:
    """Near-equal phrases: nearly all words of the shorter one occur in the other."""
    left, right = F.lower(a["phrase"]), F.lower(b["phrase"])
    wordless = (left == right) | _holds_word(left, right) | _holds_word(right, left)
    overlap = F.size(F.array_intersect(a["tokens"], b["tokens"]))
    smaller = F.least(F.size(a["tokens"]), F.size(b["tokens"]))
    union = F.size(F.array_union(a["tokens"], b["tokens"]))
    close = (overlap / smaller >= 0.85) & ((overlap / union >= 0.35) | (smaller <= 2))
    return F.when(smaller == 0, wordless).otherwise(close)


def merge_phrases(phrases: Column) -> Column:
    """Greedy, order-dependent merge: a phrase that means the same as a kept one replaces it only when
    it says more; the place in the list stays."""
    entries = F.transform(
        F.transform(phrases, tidy_phrase), lambda p: F.struct(p.alias("phrase"), phrase_tokens(p).alias("tokens"))
    )
    start = F.array().cast("array<struct<phrase:string,tokens:array<string>>>")

    def richer(new: Column, old: Column) -> Column:
        more = F.size(new["tokens"]) > F.size(old["tokens"])
        longer = (F.size(new["tokens"]) == F.size(old["tokens"])) & (F.length(new["phrase"]) > F.length(old["phrase"]))
        return more | longer

    def step(kept: Column, new: Column) -> Column:
        place = F.array_position(F.transform(kept, lambda old: same_meaning(old, new)), True)
        return bind(
            place,
            lambda p: F.when(p == 0, F.concat(kept, F.array(new))).otherwise(
                F.transform(kept, lambda old, i: F.when((i + 1 == p) & richer(new, old), new).otherwise(old))
            ),
        )

    return F.transform(F.aggregate(entries, start, step), lambda e: e["phrase"])


def merge_entities(entities: Column) -> Column:
    """Entities with the same folded name become one: all sources, spelling and role of the strongest role."""
    weight = F.create_map(*[F.lit(x) for pair in R.ROLE_PRIORITY for x in pair])

    def strength(e: Column) -> Column:
        return F.coalesce(F.try_element_at(weight, e["ruolo"]), F.lit(0))

    def key(e: Column) -> Column:
        return F.regexp_replace(X.fold_accents(F.lower(e["nome"])), "[^a-z0-9]", "")

    def combine(group: Column) -> Column:
        best = F.aggregate(group, F.element_at(group, 1), lambda a, e: F.when(strength(e) > strength(a), e).otherwise(a))
        sources = distinct_by(F.flatten(F.transform(group, lambda e: e["fonti"])), source_signature)
        return bind(best, lambda b: F.struct(b["nome"].alias("nome"), b["ruolo"].alias("ruolo"), sources.alias("fonti")))

    def by_key(all_: Column) -> Column:
        keys = F.array_distinct(F.transform(all_, key))
        return F.transform(keys, lambda k: bind(F.filter(all_, lambda e: key(e) == k), combine))

    return bind(entities, by_key)
