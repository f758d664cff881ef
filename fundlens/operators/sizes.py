"""Company form checks: required fields, formats and coherence with the EU size limits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import numbers as N, refdata as R, text as X


def _quoted(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def size_errors() -> Column:
    """Messages where head count or revenue contradict the declared size; unknown values are not judged."""
    declared, staff, revenue = F.col("size_class"), F.col("employees"), F.col("revenue")
    name = F.lower(F.trim(declared))
    found = []
    for size, low, high, cap in R.EU_SIZE_LIMITS:
        is_size = name == size
        if high is not None:
            found.append(F.when(is_size & (staff > high), _quoted(
                "Un'impresa '", declared, f"' non può avere più di {high} dipendenti (inseriti: ", staff.cast("string"), ")")))
        if low is not None:
            found.append(F.when(is_size & (staff < low), _quoted(
                "Un'impresa '", declared, f"' deve avere almeno {low} dipendenti (inseriti: ", staff.cast("string"), ")")))
        if cap is not None:
            found.append(F.when(is_size & (revenue > cap), _quoted(
                "Un'impresa '", declared, f"' non può avere fatturato superiore a € {cap:,} (inserito: € ", N.grouped(revenue), ")")))
    return F.array_compact(F.array(*found))


def form_errors() -> Column:
    vat, code = X.text_or_empty(F.col("vat_number")), X.text_or_empty(F.col("sector_code"))
    first = F.array(
        F.when(X.text_or_empty(F.col("legal_name")) == "", F.lit("La ragione sociale è obbligatoria.")),
        F.when(vat == "", F.lit("La Partita IVA è obbligatoria.")).when(
            ~vat.rlike(r"^\d{11}$"),
            F.lit("La Partita IVA non è valida. Deve contenere esattamente 11 numeri (niente lettere o spazi).")),
        F.when(code == "", F.lit("Il Codice ATECO è obbligatorio.")).when(
            ~code.rlike(r"^\d{2}\.\d{2}(\.\d{2})?$"),
            F.lit("Il Codice ATECO non è valido. Usa il formato corretto, es: 62.01 o 62.01.12")),
        F.when(X.text_or_empty(F.col("legal_form")) == "", F.lit("La forma giuridica è obbligatoria.")),
    )
    return F.concat(F.array_compact(first), size_errors())
