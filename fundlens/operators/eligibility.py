"""Hard eligibility rules. Only a failed criterion excludes; an unverifiable one never does.

Each criterion is a pair of columns (outcome, message); casts never raise, so a broken value shows up
as an unverifiable criterion and not as a silent pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N, refdata as R, text as X
from .matching import meet, section_excluded

FAIL, OK, UNKNOWN = "fail", "ok", "unverifiable"


@dataclass(frozen=True)
class Criterion:
    name: str
    outcome: Column  # FAIL, OK, UNKNOWN or null when the criterion does not apply
    message: Column


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(column: Column) -> Column:
    return column.cast("string")


def _compare(active: Column, known: Column, fails: Column) -> Column:
    return F.when(active, F.when(~known, UNKNOWN).when(fails, FAIL).otherwise(OK))


def _choose(outcome: Column, fail: Column, ok: Column, unknown: Column) -> Column:
    return F.when(outcome == FAIL, fail).when(outcome == OK, ok).when(outcome == UNKNOWN, unknown)


def criteria() -> list[Criterion]:
    months, low, high = F.col("f_months"), F.col("min_age_months"), F.col("max_age_months")
    has_age = months.isNotNull()
    youngest = _compare(F.coalesce(low > 0, F.lit(False)), has_age, months < low)
    oldest = _compare(F.coalesce(high > 0, F.lit(False)), has_age, months > high)
    code, form, region, size = F.trim("sector_code"), F.trim("legal_form"), F.trim("region"), F.trim("size_class")

    has_form = F.coalesce(F.col("f_form") != "", F.lit(False))
    in_category = F.array_contains("k_categories", F.col("f_category"))
    same_text = F.array_contains("k_unknown_forms", F.col("f_form"))
    form_match = F.when(F.col("f_category").isNotNull(), in_category).otherwise(same_text)
    form_outcome = F.when(
        F.size("k_forms") > 0,
        F.when(~has_form, UNKNOWN)
        .when(F.col("k_registry") | form_match, OK)
        .when(F.col("f_category").isNull(), UNKNOWN)
        .otherwise(FAIL),
    )
    form_unknown = F.when(~has_form, F.lit("Forma giuridica: non verificabile")).otherwise(
        _say("Verifica forma giuridica: '", form, "' non riconosciuta, controlla manualmente")
    )
    form_ok = F.when(
        F.col("k_registry"),
        _say("Forma giuridica: OK (", form, ", bando aperto a tutte le forme iscritte al Registro Imprese)"),
    ).otherwise(_say("Forma giuridica: OK (", form, ")"))

    spend, revenue, cap = F.col("min_spend"), F.col("f_revenue"), F.col("k_cap")
    known_revenue = F.coalesce(revenue, F.lit(0.0))
    spend_active = F.coalesce(spend > 0, F.lit(False))
    spend_outcome = F.when(spend_active, F.when(known_revenue == 0, UNKNOWN).otherwise(OK))
    spend_ok = F.when(
        known_revenue < spend,
        _say("⚠️ Attenzione: fatturato € ", N.grouped(revenue), " inferiore alla spesa minima di € ",
             N.grouped(spend), " — verificare la capacità di investimento"),
    ).otherwise(_say("Spesa minima: OK (€ ", N.grouped(revenue), " >= € ", N.grouped(spend), ")"))

    has_size = F.col("f_size").isNotNull()
    size_outcome = _compare(F.size("k_sizes") > 0, has_size, ~F.array_contains("k_sizes", F.col("f_size")))
    cap_outcome = _compare(cap.isNotNull(), revenue.isNotNull(), revenue > cap)

    staff, least, most = F.col("f_employees"), F.col("employees_min"), F.col("employees_max")
    few, many = F.coalesce(staff < least, F.lit(False)), F.coalesce(staff > most, F.lit(False))
    staff_outcome = _compare(least.isNotNull() | most.isNotNull(), staff.isNotNull(), few | many)
    staff_fail = F.when(
        few, _say("Numero dipendenti insufficiente: ", _text(staff), " (richiesti almeno ", _text(least), ")")
    ).otherwise(_say("Numero dipendenti troppo alto: ", _text(staff), " (massimo ", _text(most), ")"))

    has_region = F.col("f_region").isNotNull()
    region_outcome = _compare(~F.col("k_region_free"), has_region, ~F.array_contains("k_regions", F.col("f_region")))

    return [
        Criterion("min_age", youngest, _choose(
            youngest,
            _say("Azienda costituita da ", _text(months), " mesi, richiesti almeno ", _text(low)),
            _say("Anzianità minima: OK (", _text(months), " mesi su ", _text(low), " richiesti)"),
            F.lit("Anzianità minima: non verificabile"))),
        Criterion("max_age", oldest, _choose(
            oldest,
            _say("Azienda costituita da ", _text(months), " mesi, limite massimo ", _text(high)),
            _say("Anzianità massima: OK (", _text(months), " mesi, limite ", _text(high), ")"),
            F.lit("Anzianità massima: non verificabile"))),
        Criterion("section", F.when(section_excluded(), FAIL),
                  _say("Codice ATECO ", code, " (Sezione ", F.col("f_section"), ") escluso dal bando")),
        Criterion("legal_form", form_outcome, _choose(
            form_outcome,
            _say("Forma giuridica '", form, "' (", F.col("f_category"), ") non inclusa tra le ammesse: ",
                 F.array_join("legal_forms", ", ")),
            form_ok, form_unknown)),
        Criterion("min_spend", spend_outcome, _choose(
            spend_outcome, F.lit(None).cast("string"), spend_ok, F.lit("Spesa minima: non verificabile"))),
        Criterion("size", size_outcome, _choose(
            size_outcome,
            _say("Dimensione '", size, "' non ammessa dal bando (ammesse: ", F.array_join("sizes", ", "), ")"),
            _say("Dimensione impresa: OK (", size, ")"),
            F.lit("Dimensione impresa: non verificabile (dato cliente assente)"))),
        Criterion("revenue_cap", cap_outcome, _choose(
            cap_outcome,
            _say("Fatturato € ", N.grouped(revenue), " supera il limite di € ", N.grouped(cap)),
            _say("Fatturato: OK (€ ", N.grouped(revenue), " ≤ € ", N.grouped(cap), ")"),
            F.lit("Fatturato massimo: non verificabile (dato cliente assente)"))),
        Criterion("employees", staff_outcome, _choose(
            staff_outcome, staff_fail, _say("Numero dipendenti: OK (", _text(staff), ")"),
            F.lit("Numero dipendenti: non verificabile (dato cliente assente)"))),
        Criterion("region", region_outcome, _choose(
            region_outcome,
            _say("Regione '", region, "' non ammessa dal bando (ammesse: ", F.array_join("regions", ", "), ")"),
            _say("Regione: OK (", region, ")"),
            F.lit("Regione: non verificabile (dato cliente assente)"))),
    ]


def count_outcomes(kind: str) -> Column:
    total = sum((F.when(c.outcome == kind, 1).otherwise(0) for c in criteria()), F.lit(0))
    return total.cast("int")


def is_eligible() -> Column:
    """True when no criterion fails; null when the call's record could not be read."""
    failed = F.lit(False)
    for c in criteria():
        failed = failed | F.coalesce(c.outcome == FAIL, F.lit(False))
    return F.when(F.col("k_usable"), ~failed)


def check_rows(pairs: DataFrame, *keep: str) -> DataFrame:
    """One row per pair and applicable criterion: position, criterion, outcome, message."""
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c.name).alias("criterion"), c.outcome.alias("outcome"),
                 c.message.alias("message"))
        for i, c in enumerate(criteria(), 1)
    ]
    rows = pairs.select(*keep, F.explode(F.filter(F.array(*entries), lambda e: e["outcome"].isNotNull())).alias("e"))
    return rows.select(*keep, "e.position", "e.criterion", "e.outcome", "e.message")


def eligible_pairs(calls: DataFrame, companies: DataFrame, blocks: int | None = None) -> DataFrame:
    """Prepared sides → eligible pairs only, through an equi-join on region and size.

    Both are exact necessary conditions: a bound call accepts the listed values and the unknown one.
    """
    free, unknown = F.array(F.lit("*")), F.array(F.lit("?"))
    region_keys = F.when(F.col("k_region_free"), free).otherwise(F.concat(F.col("k_regions"), unknown))
    size_keys = F.when(F.size("k_sizes") == 0, free).otherwise(F.concat(F.col("k_sizes"), unknown))
    call_keys = F.flatten(
        F.transform(region_keys, lambda r: F.transform(size_keys, lambda s: F.concat_ws("|", r, s)))
    )
    own_regions = (F.lit("*"), F.coalesce(F.col("f_region"), F.lit("?")))
    own_sizes = (F.lit("*"), F.coalesce(F.col("f_size"), F.lit("?")))
    own = F.array(*[F.concat_ws("|", r, s) for r in own_regions for s in own_sizes])
    pairs = meet(calls.withColumn("call_keys", call_keys), companies.withColumn("company_keys", own), blocks)
    return pairs.filter(is_eligible())


def status_label(eligible: Column, status: Column) -> Column:
    return (
        F.when(eligible.isNull(), "Verifica non riuscita")
        .when(~eligible, "Non ammissibile")
        .when(status == "da_verificare", "Da verificare")
        .otherwise("Ammissibile sui dati disponibili")
    )
