"""Renders normalised records as Markdown sheets."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, labels as T, lists as L, numbers as N, refdata as R, text as X
from .profiles import section_letter


def _line(label: str, value: Column) -> Column:
    """Null when the value is null."""
    return F.concat(F.lit(label), value)


def _bullets(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n")


def _block(title: str, body: Column) -> Column:
    return L.bind(body, lambda b: F.when(b != "", F.concat(F.lit(f"{title}\n\n"), b)))


def _join(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *parts)


def _non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def _overview(as_of: datetime.date) -> Column:
    due = F.struct(dates.italian_long(F.col("data_scadenza")).alias("day"), dates.days_left(F.col("data_scadenza"), as_of).alias("left"))
    mode = T.mode_label(F.col("modalita_presentazione"))

    def told(d: Column) -> Column:
        soon = F.when(d["left"] < 30, F.lit(" giorni (urgenza alta)")).otherwise(F.lit(" giorni"))
        rest = F.when(d["left"] < 0, F.lit("SCADUTO")).otherwise(F.concat(d["left"].cast("string"), soon))
        return F.when(d["left"].isNull(), d["day"]).otherwise(F.concat(d["day"], F.lit(" — "), rest))

    when = L.bind(due, told)
    until_spent = F.when(F.col("modalita_presentazione") == "sportello", F.lit("- **Scadenza:** fino a esaurimento fondi"))
    return _block("## Panoramica", _join(
        "\n", _line("- **Ente promotore:** ", X.blank_to_null(F.col("ente"))),
        F.coalesce(_line("- **Scadenza:** ", when), until_spent), _line("- **Presentazione:** ", mode)))


def _involved() -> Column:
    shown = F.filter("enti_coinvolti", lambda e: F.coalesce(e["ruolo"] != "piattaforma", F.lit(True)))
    lines = F.transform(shown, lambda e: F.concat(F.lit("- **"), T.role_label(e["ruolo"]), F.lit(":** "), e["nome"]))
    return _block("## Soggetti coinvolti", F.array_join(lines, "\n"))


def who_can_apply() -> Column:
    size = F.col("dimensione_impresa")
    admitted = F.array_join(F.array(*[F.when(size[s], F.lit(s)) for s in R.SIZES]), ", ")
    codes = F.array_join("codici_ateco_ammessi", ", ")
    some = lambda label, v: F.when(v != "", _line(label, v))
    is_open = F.col("ateco_aperto_a_tutti")
    activities = F.when(~is_open & (F.size("spese_ammissibili") == 0), _block("### Interventi ammessi", _bullets(F.col("attivita_ammesse"))))
    return _join(
        "\n", some("- **Territorio:** ", F.array_join("regioni_ammesse", ", ")),
        F.when(is_open, F.lit("- **ATECO:** aperto a tutti i settori")).otherwise(some("- **ATECO ammessi:** ", codes)),
        activities, some("- **Dimensioni impresa:** ", admitted))


def _requirements() -> Column:
    age = F.col("anzianita_impresa")
    months = lambda name: F.when(age[name] > 0, F.concat(age[name].cast("string"), F.lit(" mesi")))
    forms = F.array_join(T.legal_form_labels(F.col("forme_giuridiche_ammesse")), ", ")
    return _block("## Requisiti principali", _join(
        "\n", _line("- **Investimento minimo:** ", N.euro(F.col("spesa_minima_ammissibile"))),
        _line("- **Investimento massimo:** ", N.euro(F.col("spesa_massima_ammissibile"))),
        _line("- **Anzianità minima:** ", months("mesi_minimi_dalla_costituzione")),
        _line("- **Anzianità massima:** ", months("mesi_massimi_dalla_costituzione")),
        F.when(forms != "", _line("- **Forme giuridiche:** ", forms))))


def instrument_blocks() -> Column:
    """One Markdown block per instrument."""

    def block(a: Column) -> Column:
        suffix = F.when(a["tipo"] == "finanziamento_agevolato", F.lit(" del finanziamento: ")).otherwise(F.lit(": "))
        shares = T.band_shares(a["percentuali_per_dimensione"])
        rate = F.coalesce(N.percent(a["tasso_interesse_percentuale"]), a["tasso_descrizione"])
        repaid = F.when(a["rimborso_richiesto"], F.lit("- Rimborso richiesto: sì")).when(~a["rimborso_richiesto"], F.lit("- Rimborso richiesto: no"))
        conditions = F.transform(F.slice(a["condizioni"], 1, 2), lambda c: F.concat(F.lit("- Condizione: "), X.shorten(c, 120)))
        number = lambda label, v, unit: F.concat(F.lit(label), N.plain_number(v), F.lit(unit))
        return _join(
            "\n", F.concat(F.lit("**"), T.aid_label(a["tipo"]), F.lit("**")),
            F.concat(F.lit("- Importo minimo"), suffix, N.euro(a["importo_min"])),
            F.concat(F.lit("- Importo massimo"), suffix, N.euro(a["importo_max"])),
            _line("- Copertura: ", N.percent(a["percentuale"])),
            F.when(shares != "", _line("- Copertura per fascia: ", shares)),
            _line("- Tasso: ", rate),
            number("- Durata: ", a["durata_mesi"], " mesi"),
            number("- Preammortamento: ", a["preammortamento_mesi"], " mesi"),
            number("- Abbuono: ", a["abbuono_rate"], " rate"),
            repaid,
            F.when(F.size(conditions) > 0, F.array_join(conditions, "\n")))

    return F.transform("agevolazioni", block)


def _money() -> Column:
    bands = F.col("percentuale_fondo_perduto")
    shares = T.band_shares(bands)
    types = F.array_join(F.transform("tipo_agevolazione", T.aid_label), ", ")
    flat = F.array(
        _line("**Contributo massimo:** ", N.euro(F.col("contributo_max"))),
        F.when(shares != "", _line("**Fondo perduto per fascia:** ", shares)).otherwise(_line("**Fondo perduto:** ", N.percent(bands["default"]))),
        F.when(types != "", _line("**Tipo di agevolazione:** ", types)))
    parts = F.when(F.size("agevolazioni") > 0, instrument_blocks()).otherwise(F.array_compact(flat))
    cumulation = _line("**Cumulabilità:** ", T.cumulability_label(F.col("cumulabilita")))
    return _block("## Contributi e agevolazioni", F.array_join(F.concat(parts, F.array_compact(F.array(cumulation))), "\n\n"))


def exclusions() -> Column:
    note = F.col("note_esclusioni")
    names = F.create_map(*[F.lit(x) for s in R.SECTIONS for x in (s[0], s[3])])

    def shown(entry: Column) -> Column:
        return L.bind(section_letter(entry), lambda letter: F.coalesce(
            F.concat(F.lit("Sez. "), letter, F.lit(" – "), F.try_element_at(names, letter)), entry))

    bans = note["attivita_vietate"]
    groups = F.array_compact(F.array(
        _block("### Sezioni ATECO", _bullets(F.transform(note["sezioni_ateco_escluse"], shown))),
        _block("### Settori esclusi", _bullets(T.excluded_sectors(bans))),
        _block("### Attività vietate", _bullets(T.ban_labels(bans))),
        *[_block(f"### {title}", _bullets(note[key])) for title, key in (
            ("Soggetti esclusi", "soggetti_esclusi"), ("Spese non ammissibili", "spese_non_ammissibili"), ("Altre esclusioni", "altre_esclusioni"))]))
    free = _block("### Nota", note["lista_testuale"])
    body = L.bind(groups, lambda g: F.when(F.size(g) > 0, F.array_join(g, "\n\n")).otherwise(free))
    return F.coalesce(_block("## Esclusioni", F.col("note_text")), _block("## Esclusioni", body))


def render(record: DataFrame, as_of: datetime.date) -> DataFrame:
    """Adds ``sheet``, the Markdown text of a normalised record."""
    url = X.blank_to_null(F.col("url_documento_origine"))
    parts = F.array_compact(F.array(
        _line("# ", X.blank_to_null(F.col("titolo"))), _overview(as_of), _involved(),
        _block("## Beneficiari e interventi", who_can_apply()), _requirements(), _money(),
        _block("## Spese ammissibili", _bullets(T.expense_labels(F.col("spese_ammissibili")))), exclusions(),
        F.concat(F.lit("## Documento di origine\n\n["), url, F.lit("]("), url, F.lit(")"))))
    closing = F.array(F.lit("---"), F.lit(R.SHEET_DISCLAIMER))
    return record.withColumn("_parts", parts).withColumn(
        "sheet",
        F.when(F.size("_parts") == 0, F.lit(R.SHEET_UNAVAILABLE)).otherwise(F.array_join(F.concat("_parts", closing), "\n\n")),
    ).drop("_parts")


def with_disclaimer(sheet: Column, status: Column, null_percentage: Column) -> Column:
    """A sheet under review opens with a warning."""
    banner = F.concat(
        F.lit("# ⚠️ Scheda in revisione\n\n**Estrazione incompleta ("),
        F.format_number(F.coalesce(null_percentage, F.lit(0.0)), 0),
        F.lit("% di campi nulli). Il matching è sospeso e questa scheda non va condivisa senza una verifica manuale.**\n\n---\n\n"))
    return F.when(status == R.PENDING, F.concat(banner, sheet)).otherwise(sheet)
