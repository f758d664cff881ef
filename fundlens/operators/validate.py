"""Validation of normalised records, with or without the text they come from."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, refdata as R
from . import evidence as E

REVIEW_LIMIT = 50.0
ISO = r"^\d{4}-\d{2}-\d{2}$"
DATE_KEYS = ("data_pubblicazione", "data_scadenza")
COHERENCE = (
    "Coerenza agevolazioni", "Coerenza fonti", "Coerenza ATECO", "Copertura estrazione incompleta", "Completezza economica",
)


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def _all(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def emptiness() -> dict[str, Column]:
    """For every record key, whether it carries no information; false and zero are information."""
    size, note, age, cover = (F.col(c) for c in ("dimensione_impresa", "note_esclusioni", "anzianita_impresa", "copertura_estrazione"))
    bands = F.col("percentuale_fondo_perduto")
    out: dict[str, Column] = {}
    for key in R.RECORD_KEYS:
        value = F.col(key)
        if key == "dimensione_impresa":
            out[key] = _all(*[~size[s] for s in R.SIZES])
        elif key == "percentuale_fondo_perduto":
            out[key] = _all(*[bands[b].isNull() for b in R.PERCENT_BANDS])
        elif key == "note_esclusioni":
            empty_note = _all(_blank(note["lista_testuale"]), *[F.size(note[n]) == 0 for n in R.NOTE_LISTS])
            out[key] = F.col("note_text").isNull() & (note.isNull() | empty_note)
        elif key == "anzianita_impresa":
            out[key] = age["mesi_minimi_dalla_costituzione"].isNull() & age["mesi_massimi_dalla_costituzione"].isNull()
        elif key == "copertura_estrazione":
            out[key] = _all(*[cover[n].isNull() for n in ("caratteri_totali", "caratteri_analizzati", "numero_blocchi", "completa")])
        elif key in R.NUMERIC_FIELDS:
            out[key] = value.isNull()
        elif key == "ateco_aperto_a_tutti":
            out[key] = F.lit(False)
        elif key in ("titolo", "ente", "data_pubblicazione", "data_scadenza", "modalita_presentazione", "cumulabilita",
                     "link_fonte_ufficiale", "url_documento_origine"):
            out[key] = _blank(value)
        else:
            out[key] = F.size(value) == 0
    return out


def null_percentage() -> Column:
    counted = [e for k, e in emptiness().items() if k not in R.NOT_COUNTED_KEYS]
    return sum((F.when(e, 1).otherwise(0) for e in counted), F.lit(0)) / len(counted) * 100.0


def normalise_dates(record: DataFrame) -> DataFrame:
    return record.withColumns({k: dates.normalised(F.col(k)) for k in DATE_KEYS})


def format_errors() -> Column:
    """Structure and format errors of a normalised record."""
    by_date = [
        F.when(~_blank(F.col(k)) & ~F.trim(k).rlike(ISO), F.lit(f"bando.{k} deve essere YYYY-MM-DD o null")) for k in DATE_KEYS
    ]
    open_codes = F.when(
        F.col("ateco_aperto_a_tutti") & (F.size("codici_ateco_ammessi") > 0),
        F.lit("Se ateco_aperto_a_tutti è true, codici_ateco_ammessi deve essere []"),
    )

    def per_instrument(a: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("bando.agevolazioni["), i.cast("string"), F.lit("]."))
        negative = [F.when(a[n] < 0, F.concat(prefix, F.lit(f"{n} non può essere negativo"))) for n in R.INSTRUMENT_NUMBERS]
        return F.array(*negative, F.when(a["percentuale"] > 100, F.concat(prefix, F.lit("percentuale non può superare 100"))))

    return F.concat(
        F.col("type_errors"),
        F.array_compact(F.array(*by_date, open_codes)),
        F.array_compact(F.flatten(F.transform("agevolazioni", per_instrument))),
    )


def logical_errors() -> Column:
    raw = F.col("data_scadenza")
    impossible = F.trim(raw).rlike(ISO) & dates.parse_any(raw).isNull()
    return F.array_compact(F.array(F.when(impossible, F.lit("bando.data_scadenza non è una data valida"))))


def logical_warnings(as_of: datetime.date) -> Column:
    raw, aid, flat = F.col("data_scadenza"), F.col("agevolazioni"), F.col("tipo_agevolazione")
    past = F.trim(raw).rlike(ISO) & (dates.parse_any(raw) <= dates.day(as_of))
    structured = F.array_distinct(F.transform(aid, lambda a: a["tipo"]))
    differ = (F.size(structured) > 0) & (
        (F.size(F.array_except(structured, flat)) > 0) | (F.size(F.array_except(flat, structured)) > 0)
    )
    types = F.when(F.size(structured) > 0, structured).otherwise(flat)
    loans_only = (F.size(types) > 0) & ~F.exists(types, lambda t: t.isin(*R.NON_REPAYABLE))

    def per_instrument(a: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("Coerenza agevolazioni: agevolazioni["), i.cast("string"), F.lit("]"))
        bands = a["percentuali_per_dimensione"]
        no_share = _all(a["percentuale"].isNull(), *[bands[b].isNull() for b in R.PERCENT_BANDS])
        return F.array(
            F.when((a["tipo"] == "finanziamento_agevolato") & ~a["rimborso_richiesto"],
                   F.concat(prefix, F.lit(" è un finanziamento ma rimborso_richiesto è false"))),
            F.when((a["tipo"] == "fondo_perduto") & a["importo_max"].isNull() & no_share,
                   F.concat(prefix, F.lit(" è a fondo perduto ma non contiene né importo massimo né percentuale"))),
        )

    return F.concat(
        F.array_compact(F.array(
            F.when(past, F.lit("data_scadenza nel passato — verificare se il bando è ancora attivo")),
            F.when(differ, F.lit("Coerenza agevolazioni: tipo_agevolazione non coincide con agevolazioni[].tipo")),
            F.when(loans_only & F.col("contributo_max").isNotNull(), F.lit(
                "Coerenza agevolazioni: contributo_max è valorizzato per uno strumento solo rimborsabile; "
                "verificare che non sia il massimale del prestito")),
        )),
        F.array_compact(F.flatten(F.transform(aid, per_instrument))),
        F.array_compact(F.array(F.when(
            ~F.col("copertura_estrazione")["completa"],
            F.lit("Copertura estrazione incompleta — revisione manuale obbligatoria")))),
    )


def critical_gaps(text: Column | None = None, lowered: Column | None = None) -> Column:
    empty = emptiness()
    rolling = E.rolling_window(text, lowered) if text is not None else F.lit(False)
    no_money = _all(*[empty[k] for k in ("contributo_max", "percentuale_fondo_perduto", "agevolazioni", "tipo_agevolazione")])
    no_sector = empty["codici_ateco_ammessi"] & ~F.col("ateco_aperto_a_tutti") & empty["attivita_ammesse"]
    return F.array_compact(F.array(
        F.when(empty["titolo"], F.lit("titolo")),
        F.when(empty["data_scadenza"] & ~rolling, F.lit("data_scadenza")),
        F.when(no_money, F.lit("contributo_max/percentuale_fondo_perduto")),
        F.when(no_sector, F.lit("codici_ateco_ammessi/ateco_aperto_a_tutti/attivita_ammesse")),
    ))


def _is_coherence(warning: Column) -> Column:
    out = F.lit(False)
    for prefix in COHERENCE:
        out = out | warning.startswith(prefix)
    return out


def judge(record: DataFrame) -> DataFrame:
    """Adds the review decision to a record with ``gaps``, ``null_percentage`` and ``warnings``."""
    coherent = F.exists("warnings", _is_coherence)
    high = F.col("null_percentage") > REVIEW_LIMIT
    needs = (F.size("gaps") > 0) | high | coherent
    return record.withColumn("needs_review", needs).withColumn("warnings", F.concat("warnings", F.array_compact(F.array(
        F.when(F.size("gaps") > 0, F.concat(
            F.lit("Da revisionare manualmente — campi critici mancanti: "), F.array_join("gaps", ", "))),
        F.when(high, F.concat(F.lit("RF-007: Da revisionare manualmente — più del 50% dei campi è nullo ("),
                              F.format_number("null_percentage", 0), F.lit("%)"))),
        F.when(coherent & (F.size("gaps") == 0) & ~high,
               F.lit("Da revisionare manualmente — verificare le avvertenze di coerenza")),
    ))))


def validate(record: DataFrame, text: str, as_of: datetime.date) -> DataFrame:
    """Full validation of normalised records joined with their raw text (null where there is none).

    Adds errors, warnings, gaps, null_percentage and needs_review.
    """
    t = F.col(text)
    has_text = F.coalesce(t != "", F.lit(False))
    none = F.array().cast("array<string>")
    # in lower case once: most patterns are tried only where a plain string of theirs occurs
    r = normalise_dates(record).withColumn("_low", F.lower(t))
    low = F.col("_low")
    missing = has_text & _blank(F.col("data_scadenza"))
    r = r.withColumn("_inferred", F.when(missing, E.infer_deadline(t, as_of, low)))
    r = r.withColumn("data_scadenza", F.coalesce("_inferred", "data_scadenza"))

    r = r.withColumn("_sections", F.col("note_esclusioni")["sezioni_ateco_escluse"])
    r = E.reconcile_sections(r, text, "_sections", "fonti", low)
    note = F.col("note_esclusioni")
    rebuilt = F.struct(
        F.coalesce(note["lista_testuale"], F.when(note.isNull(), F.col("note_text"))).alias("lista_testuale"),
        F.col("kept_sections").alias("sezioni_ateco_escluse"),
        *[F.coalesce(note[n], none).alias(n) for n in R.NOTE_LISTS[1:]],
    )
    r = r.withColumns(
        {
            "note_esclusioni": F.when(has_text, rebuilt).otherwise(note),
            "note_text": F.when(~has_text, F.col("note_text")),
            "ateco_aperto_a_tutti": F.col("ateco_aperto_a_tutti") & ~(has_text & (F.size("kept_sections") > 0)),
        }
    )
    r = E.repair_issuer_source(r, text, low)
    r = E.reconcile_economics(r, text, low)
    inferred = F.lit("bando.data_scadenza ricavata dal testo PDF (il modello non l'aveva compilata)")
    issuer = F.when(F.col("wrapped") & F.col("has_sources"), E.issuer_warning(F.col("ente"), F.col("fonti")))
    warnings = F.concat(
        F.col("raw_warnings"),
        F.array_compact(F.array(F.when(F.col("_inferred").isNotNull(), inferred))),
        E.section_warnings(),
        F.array_compact(F.array("issuer_notice")),
        F.when(has_text, E.economic_warnings(t, low)).otherwise(none),
        F.array_compact(F.array(issuer)),
        logical_warnings(as_of),
    )
    checked = r.withColumns(
        {
            "errors": F.concat(format_errors(), logical_errors()),
            "warnings": warnings,
            "gaps": critical_gaps(t, low),
            "null_percentage": null_percentage(),
        }
    )
    return judge(checked).drop("_inferred", "_sections", "issuer_notice", "_low")


def route(checked: DataFrame, text: str) -> DataFrame:
    """Where each validated record goes.

    Needs ``early_reason``/``late_reason`` (not a call at all), ``hash_duplicate`` and ``title_duplicate``.
    """
    return checked.withColumn(
        "route",
        F.when(F.col("early_reason").isNotNull(), "non_compatibile")
        .when(F.col("hash_duplicate").isNotNull(), "duplicato")
        .when(F.col("late_reason").isNotNull(), "non_compatibile")
        .when(F.size("errors") > 0, "errore")
        .when(F.col("title_duplicate").isNotNull(), "duplicato")
        .when(F.col("needs_review"), R.PENDING)
        .otherwise(R.VALIDATED),
    )


def override_provenance(records: DataFrame, fetched: DataFrame) -> DataFrame:
    """Records fetched from an address: the address is their origin, and no official link is taken from the text.

    ``fetched`` has call_id and address, one row per fetched call; other records stay as they are.
    """
    known = fetched.select("call_id", F.col("address").alias("_address"))
    joined = records.join(known, "call_id", "left")
    taken = F.col("_address").isNotNull()
    return joined.withColumns(
        {
            "link_fonte_ufficiale": F.when(~taken, F.col("link_fonte_ufficiale")),
            "url_documento_origine": F.coalesce("_address", "url_documento_origine"),
        }
    ).drop("_address")
