"""Long texts: overlapping chunks, their coverage, and the merge of what was extracted per chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lists as L, refdata as R
from . import normalise as O


def _bounds(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunk bounds: a cut falls on the last newline of the second half of the window if there is one."""
    start, end = 0, len(text)
    while True:
        stop = min(start + size, end)
        if stop < end:
            newline = text.rfind("\n", start + size // 2, stop)
            stop = newline if newline > start else stop
        yield start, stop
        if stop >= end:
            return
        start = stop - overlap if stop - overlap > start else stop


def bounds(docs: DataFrame, key: str, text: str, size: int = R.CHUNK_CHARS, overlap: int = R.CHUNK_OVERLAP) -> DataFrame:
    """The chunks of `split` without their texts: key, chunk, start, stop."""
    lap = min(max(overlap, 0), size // 4)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, a, b) for k, t in zip(batch[key], batch[text]) if t is not None for i, (a, b) in enumerate(_bounds(t, size, lap))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "start", "stop"])

    return docs.select(key, text).mapInPandas(cut, f"{key} bigint, chunk int, start int, stop int")


def split(docs: DataFrame, key: str, text: str, size: int = R.CHUNK_CHARS, overlap: int = R.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: key, chunk, start, stop, text. Each cut depends on the one before it, so the
    documents stream through Arrow batches; no document meets another."""
    lap = min(max(overlap, 0), size // 4)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, i, a, b, t[a:b])
                for k, t in zip(batch[key], batch[text]) if t is not None
                for i, (a, b) in enumerate(_bounds(t, size, lap))
            ]
            yield pd.DataFrame(rows, columns=[key, "chunk", "start", "stop", "text"])

    return docs.select(key, text).mapInPandas(cut, f"{key} bigint, chunk int, start int, stop int, text string")


def coverage(docs: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """Characters in all, characters reached, number of chunks, and whether the text is covered without gaps."""
    pieces = chunks.select(key, "chunk", "start", "stop")
    reached = pieces.groupBy(key).agg(F.max("stop").alias("read_chars"), F.count("*").alias("blocks"))
    total = docs.select(key, F.length(text).alias("total_chars"))
    return total.join(reached, key).withColumn("complete", F.col("read_chars") == F.col("total_chars"))


STRING_LISTS = (
    "codici_ateco_ammessi", "attivita_ammesse", "regioni_ammesse", "spese_ammissibili", "forme_giuridiche_ammesse", "tipo_agevolazione",
)
STRUCT_LISTS = ("fonti", "enti_coinvolti", "agevolazioni")
FIRST_TEXTS = (
    "titolo", "ente", "data_pubblicazione", "modalita_presentazione", "cumulabilita", "link_fonte_ufficiale", "url_documento_origine", "note_text",
)


def _first(value: Column, filled: Column) -> Column:
    """First filled value in chunk order, as a combinable aggregate."""
    return F.min(F.when(filled, F.struct(F.col("chunk"), value.alias("v"))))["v"]


def merge_instruments(items: Column) -> Column:
    """Instruments of the same type become one: first known value per detail, all conditions and sources."""

    def combine(group: Column) -> Column:
        def first(*path: str) -> Column:
            def read(a: Column) -> Column:
                for step in path:
                    a = a[step]
                return a

            return F.get(F.filter(F.transform(group, read), lambda v: v.isNotNull()), F.lit(0)).alias(path[-1])

        return F.struct(
            F.element_at(group, 1)["tipo"].alias("tipo"),
            *[first(n) for n in R.INSTRUMENT_NUMBERS],
            F.struct(*[first("percentuali_per_dimensione", b) for b in R.PERCENT_BANDS]).alias("percentuali_per_dimensione"),
            first("rimborso_richiesto"),
            first("tasso_descrizione"),
            first("descrizione"),
            F.array_distinct(F.flatten(F.transform(group, lambda a: a["condizioni"]))).alias("condizioni"),
            L.distinct_by(F.flatten(F.transform(group, lambda a: a["fonti"])), L.source_signature).alias("fonti"),
        )

    types = F.array_distinct(F.transform(items, lambda a: a["tipo"]))
    return F.transform(types, lambda t: L.bind(F.filter(items, lambda a: a["tipo"] == t), combine))


def merge_partials(partials: DataFrame, key: str) -> DataFrame:
    """Normalised records of the chunks of a document → one record per document.

    Scalars are combinable aggregates. List entries are exploded and reduced to their first place per
    distinct entry before they meet, so a document with very many chunks is reduced on the map side.
    """
    note, age, cover, size, bands = (
        F.col(c) for c in ("note_esclusioni", "anzianita_impresa", "copertura_estrazione", "dimensione_impresa", "percentuale_fondo_perduto"))
    note_lists = {f"note_{n}": F.coalesce(note[n], F.array().cast("array<string>")) for n in R.NOTE_LISTS}
    scalars = partials.groupBy(key).agg(
        *[_first(F.col(c), F.col(c).isNotNull() & (F.col(c) != "")).alias(c) for c in FIRST_TEXTS],
        *[_first(F.col(c), F.col(c).isNotNull()).alias(c) for c in R.NUMERIC_FIELDS],
        F.max("data_scadenza").alias("data_scadenza"),
        F.min(F.struct("chunk", F.col("ateco_aperto_a_tutti").alias("v")))["v"].alias("ateco_aperto_a_tutti"),
        F.min(F.struct("chunk", age.alias("v")))["v"].alias("anzianita_impresa"),
        F.min(F.struct("chunk", cover.alias("v")))["v"].alias("copertura_estrazione"),
        F.struct(*[F.bool_or(size[s]).alias(s) for s in R.SIZES]).alias("dimensione_impresa"),
        F.struct(*[_first(bands[b], bands[b].isNotNull()).alias(b) for b in R.PERCENT_BANDS]).alias("percentuale_fondo_perduto"),
        F.bool_or(note.isNotNull()).alias("has_note"),
        _first(note["lista_testuale"], note["lista_testuale"].isNotNull()).alias("note_list_text"),
        F.bool_or("has_sources").alias("has_sources"),
    )
    named = {**{c: F.col(c) for c in STRING_LISTS}, **note_lists, **{c: F.transform(c, lambda x: F.to_json(x)) for c in STRUCT_LISTS}}
    entries = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("items")) for n, c in named.items()])
    exploded = partials.select(key, "chunk", F.inline(entries)).select(key, "chunk", "field", F.posexplode("items").alias("place", "item"))
    distinct = exploded.groupBy(key, "field", "item").agg(F.min(F.struct("chunk", "place")).alias("at"))

    def gathered(name: str) -> Column:
        rows = F.collect_list(F.when(F.col("field") == name, F.struct("at", "item")))
        return F.transform(F.array_sort(rows), lambda r: r["item"]).alias(name)

    lists = distinct.groupBy(key).agg(*[gathered(n) for n in named])
    none = F.array().cast("array<string>")
    joined = scalars.join(lists, key, "left").withColumns({n: F.coalesce(n, none) for n in named})
    schema = {f.name: f.dataType for f in partials.schema.fields}
    back = lambda c: F.transform(c, lambda x: F.from_json(x, schema[c].elementType))
    rebuilt = F.struct(F.col("note_list_text").alias("lista_testuale"), *[L.merge_phrases(F.col(f"note_{n}")).alias(n) for n in R.NOTE_LISTS])
    merged = joined.withColumns(
        {
            "attivita_ammesse": L.merge_phrases(F.col("attivita_ammesse")),
            "spese_ammissibili": L.merge_phrases(F.col("spese_ammissibili")),
            "fonti": L.distinct_by(back("fonti"), L.source_signature),
            "enti_coinvolti": L.merge_entities(back("enti_coinvolti")),
            "agevolazioni": merge_instruments(back("agevolazioni")),
            "note_esclusioni": F.when(F.col("has_note"), rebuilt),
            "note_text": F.when(~F.col("has_note"), F.col("note_text")),
        }
    )
    return O.reconcile(merged.drop("has_note", "note_list_text", *note_lists))
