"""Short labels for verbose descriptions. The data keep the full wording; labels only serve display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lists as L, numbers as N, refdata as R, text as X


def _any(key: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | key.contains(n)
    return out


def _pick(value: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), value)


def fallback(value: Column, limit: int = 90) -> Column:
    """Readable form of a description no rule covers."""
    compact = F.btrim(F.regexp_replace(value, r"(?U)\s+", " "), F.lit(" -–—,;."))
    bare = F.regexp_replace(compact, "(?iU)" + R.FALLBACK_PREFIX_PATTERN, "")
    shown = L.bind(bare, lambda b: F.concat(F.upper(F.substring(b, 1, 1)), F.substr(b, F.lit(2))))
    cut = lambda s: F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…"))
    return L.bind(shown, lambda s: F.when(F.length(s) <= limit, s).otherwise(cut(s)))


def _non_blank_distinct(labels: Column) -> Column:
    return F.array_distinct(F.filter(labels, lambda v: v != ""))


def expense_labels(values: Column) -> Column:
    """Expense categories in order of appearance; umbrella terms only when nothing else is known."""

    def ruled(value: Column, key: Column) -> Column:
        hits = [F.when(_any(key, needles), F.lit(label)) for label, needles in R.EXPENSE_RULES]
        return F.array_compact(F.array(*hits, F.when(X.matches(value, r"\biva\b"), F.lit("IVA"))))

    none = F.array().cast("array<string>")

    def sorted_out(value: Column, key: Column, hits: Column) -> Column:
        umbrella = (F.size(hits) == 0) & key.isin(*R.UMBRELLA_EXPENSES)
        shown = F.when(F.size(hits) > 0, hits).otherwise(F.array(fallback(value)))
        return L.bind(F.struct(umbrella.alias("u"), shown.alias("s")), lambda r: F.struct(
            F.when(r["u"], none).otherwise(r["s"]).alias("plain"), F.when(r["u"], r["s"]).otherwise(none).alias("umbrella")))

    def per_value(value: Column) -> Column:
        key = X.legal_form_key(F.trim(value))
        return L.bind(key, lambda k: L.bind(ruled(value, k), lambda hits: sorted_out(value, k, hits)))

    def choose(rows: Column) -> Column:
        plain = _non_blank_distinct(F.flatten(F.transform(rows, lambda r: r["plain"])))
        return F.when(F.size(plain) > 0, plain).otherwise(
            _non_blank_distinct(F.flatten(F.transform(rows, lambda r: r["umbrella"]))))

    return L.bind(F.transform(values, per_value), choose)


def ban_labels(values: Column) -> Column:
    """Categories of forbidden activities; purely financial or real-estate ones are shown as sectors instead."""

    def judged(value: Column, key: Column) -> Column:
        tobacco = F.when(key.contains("tabacc"), F.when(key.contains("bartabacc"), F.lit(R.TOBACCO_LABELS[0])).otherwise(F.lit(R.TOBACCO_LABELS[1])))
        hits = []
        for label, groups in R.BAN_RULES:
            rule = F.lit(True)
            for group in groups:
                rule = rule & _any(key, group)
            hits.append(F.when(rule, F.lit(label)))
        sector_only = _any(key, ("finanziar", "assicurativ")) | (key.contains("immobiliar") & ~key.contains("sviluppoimmobiliar"))
        return L.bind(F.array_compact(F.array(tobacco, *hits)), lambda found: F.when(
            (F.size(found) > 0) | sector_only, found).otherwise(F.array(fallback(value))))

    keyed = lambda value: L.bind(X.legal_form_key(F.trim(value)), lambda key: judged(value, key))
    return _non_blank_distinct(F.flatten(F.transform(values, keyed)))


def excluded_sectors(values: Column) -> Column:
    names = {s[0]: s[3] for s in R.SECTIONS}

    def one(value: Column) -> Column:
        v = F.lower(value)
        finance, insurance = v.contains("finanziar"), v.contains("assicurativ")
        return (
            F.when(finance & insurance, F.lit(names["K"])).when(finance, F.lit("Attività finanziarie"))
            .when(insurance, F.lit("Attività assicurative")).when(v.contains("immobiliar"), F.lit(names["L"]))
        )

    return F.array_distinct(F.array_compact(F.transform(values, one)))


def legal_form_labels(values: Column) -> Column:
    """Canonical legal forms, each once."""

    def one(value: Column, key: Column) -> Column:
        return (
            F.when(key.contains("responsabilitalimitatasemplificata") | key.startswith("srls"), F.lit("S.r.l.s."))
            .when(key.contains("responsabilitalimitata") | key.startswith("srl"), F.lit("S.r.l."))
            .when(key.contains("nomecollettivo") | (key == "snc"), F.lit("S.n.c."))
            .when(key.contains("accomanditasemplice") | (key == "sas"), F.lit("S.a.s."))
            .when(key.contains("cooperativ"), F.lit("Cooperative"))
            .when(key.contains("individual"), F.lit("Ditte individuali"))
            .when(key.contains("profession"), F.lit("Liberi professionisti"))
            .otherwise(value)
        )

    named = F.transform(values, lambda v: L.bind(X.legal_form_key(v), lambda key: one(v, key)))
    return L.distinct_by(named, X.legal_form_key)


def cumulability_label(value: Column) -> Column:
    text = F.trim(value)
    label = L.bind(F.lower(text), lambda v: (
        F.when(v.contains("limiti di cumulo") & (v.contains("salvo") | v.contains("rispett")), F.lit("Ammessa nel rispetto dei limiti di cumulo applicabili"))
        .when(_any(v, ("non cumulabil", "non è compatibil", "non e compatibil")), F.lit("Non cumulabile sul medesimo investimento"))
        .when(v.contains("non aver beneficiato") & v.contains("medesimo investimento"), F.lit("Non cumulabile sul medesimo investimento, salvo i limiti applicabili"))
        .when(v.contains("de minimis"), F.lit("Soggetta alle regole de minimis"))
        .otherwise(X.shorten(text, 180))
    ))
    return F.when(text != "", label)


def mode_label(value: Column) -> Column:
    return _pick(value, R.MODE_LABELS)


def aid_label(value: Column) -> Column:
    return _pick(value, R.AID_LABELS)


def role_label(value: Column) -> Column:
    return F.coalesce(_pick(F.coalesce(value, F.lit("")), R.ROLE_LABELS), F.lit("Soggetto coinvolto"))


def band_shares(bands: Column) -> Column:
    shares = [F.when(bands[b].isNotNull(), F.concat(F.lit(f"{b.capitalize()} "), N.percent(bands[b]))) for b in R.PERCENT_BANDS[:-1]]
    return F.array_join(F.array(*shares), "; ")
