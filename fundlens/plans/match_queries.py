"""Queries on calls × companies: scores, eligibility and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import DEFAULT_AS_OF as AS_OF
from ..functions import refdata as R, text as X
from ..operators import cards as C, counts as N, eligibility as E, factors as L, matching as M, profiles as P
from ..sources import tables as T
from . import oracle_base as B
from .registry import query


def firms(spark, sf) -> DataFrame:
    return P.prepare_companies(T.companies(spark, sf), AS_OF)


def funds(spark, sf) -> DataFrame:
    return P.prepare_calls(T.calls(spark, sf))


@query("match_scores", B.with_pairs("SELECT call_id, company_id, score FROM pairs"))
def match_scores(spark, sf):
    return M.scores(funds(spark, sf), firms(spark, sf))


@query("match_threshold", B.with_pairs("SELECT call_id, company_id, score FROM pairs WHERE score >= 75"))
def match_threshold(spark, sf):
    return M.scores(funds(spark, sf), firms(spark, sf), 75)


def stored(spark, sf) -> DataFrame:
    """All stored matches of validated calls, with parts, status and eligibility."""
    return C.enrich(T.stored_matches(spark, sf, by_company=True), funds(spark, sf), firms(spark, sf))


@query("score_breakdown", B.with_stored(
    "SELECT match_id, call_id, company_id, region_score, sector_score, size_score, revenue_score, score, score_status FROM checks"))
def score_breakdown(spark, sf):
    return stored(spark, sf).select("match_id", "call_id", "company_id", *M.PARTS, "score", "score_status")


def _distribution(part: str) -> str:
    return B.with_pairs(f"SELECT call_id, {part}, CAST(count(*) AS BIGINT) AS companies FROM pairs GROUP BY ALL")


def _by_attribute(spark, sf, part: str, *attributes: str) -> DataFrame:
    """Distribution of one part per call: companies are counted per attribute value before they meet the calls."""
    values = firms(spark, sf).groupBy(*attributes).agg(F.count("*").alias("companies"), F.min("company_id").alias("company_id"))
    free = F.array(F.lit("*"))
    met = M.meet(funds(spark, sf).withColumn("call_keys", free), values.withColumn("company_keys", free))
    return (
        met.select("call_id", M.PARTS[part]().cast("int").alias(part), "companies")
        .groupBy("call_id", part)
        .agg(F.sum("companies").alias("companies"))
    )


@query("score_region", _distribution("region_score"))
def score_region(spark, sf):
    return _by_attribute(spark, sf, "region_score", "f_region")


@query("score_sector", _distribution("sector_score"))
def score_sector(spark, sf):
    """Companies per score from shared codes, prefixes and words; the rest by subtraction."""
    calls, companies = funds(spark, sf), firms(spark, sf)
    named = N.code_counts(calls.where(~F.col("k_open") & (F.size("k_codes") > 0)), companies)
    by_words = ~F.col("k_open") & (F.size("k_codes") == 0) & (F.size("k_activities") > 0)
    counted = N.activity_counts(calls.withColumn("k_activities", F.when(by_words, F.col("k_activities")).otherwise(F.slice("k_activities", 1, 0))), companies).join(named, "call_id", "left")
    rest = F.col("everyone") - F.col("gone")
    whole, half = R.WEIGHT_SECTOR, R.WEIGHT_SECTOR // 2
    uncertain = F.col("partial") + F.col("silent")
    assert R.ACTIVITY_UNCERTAIN == R.ACTIVITY_PARTIAL

    def scores(*given):
        some = sum((n for _, n in given), F.lit(0))
        return F.array(*(F.struct(F.lit(s).cast("int").alias("sector_score"), n.cast("long").alias("companies")) for s, n in ((0, F.col("everyone") - some), *given)))

    none = F.lit(0).cast("long")
    parts = (
        F.when(F.col("k_open"), scores((whole, rest), (half, none)))
        .when(F.size("k_codes") > 0, scores((whole, F.col("same_code")), (half, F.col("same_prefix"))))
        .when(F.size("k_activities") > 0, scores((R.ACTIVITY_GOOD, F.col("good")), (R.ACTIVITY_PARTIAL, uncertain)))
        .otherwise(scores((half, rest), (whole, none)))
    )
    return counted.select("call_id", F.inline(parts)).filter("companies > 0")


@query("score_size", _distribution("size_score"))
def score_size(spark, sf):
    return _by_attribute(spark, sf, "size_score", "f_size")


@query("score_revenue", _distribution("revenue_score"))
def score_revenue(spark, sf):
    """Companies within each cap from running counts; a missing revenue counts as zero."""
    calls = funds(spark, sf).select("call_id", F.col("k_cap").alias("x"))
    earned = firms(spark, sf).groupBy(F.coalesce("f_revenue", F.lit(0.0)).alias("v")).agg(F.count("*").alias("n"))
    everyone = earned.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    counted = calls.join(N.ranks(earned, calls), "x", "left").join(F.broadcast(everyone))  # one row
    within = F.when(F.col("x").isNull(), F.col("all")).otherwise(F.col("at_most"))
    parts = F.array(*(F.struct(F.lit(s).cast("int").alias("revenue_score"), n.alias("companies")) for s, n in ((R.WEIGHT_REVENUE, within), (0, F.col("all") - within))))
    return counted.select("call_id", F.inline(parts)).filter("companies > 0")


@query("score_activity", B.with_pairs(
    f"SELECT call_id, CAST(CASE WHEN len(k_activities) = 0 THEN 0 WHEN f_tokens IS NULL THEN 15 WHEN {B.OVERLAP} >= 2 THEN 30 "
    f"WHEN {B.OVERLAP} = 1 THEN 15 ELSE 0 END AS INT) AS activity_score, CAST(count(*) AS BIGINT) AS companies FROM pairs GROUP BY ALL"))
def score_activity(spark, sf):
    """Companies per score from shared words; a call without activities scores nobody."""
    counted = N.activity_counts(_anywhere(funds(spark, sf)), firms(spark, sf))
    listed = F.size("k_activities") > 0
    good = F.when(listed, F.col("good")).otherwise(0)
    assert R.ACTIVITY_UNCERTAIN == R.ACTIVITY_PARTIAL
    partial = F.when(listed, F.col("partial") + F.col("silent")).otherwise(0)
    parts = F.array(*(F.struct(F.lit(s).cast("int").alias("activity_score"), n.cast("long").alias("companies")) for s, n in ((R.ACTIVITY_GOOD, good), (R.ACTIVITY_PARTIAL, partial), (0, F.col("everyone") - good - partial))))
    return counted.select("call_id", F.inline(parts)).filter("companies > 0")


def _anywhere(calls: DataFrame) -> DataFrame:
    """Calls as if no section were excluded."""
    return calls.withColumn("k_sections", F.slice("k_sections", 1, 0))


@query("sector_to_verify", B.with_pairs(
    "SELECT call_id, CAST(count(*) AS BIGINT) AS companies FROM pairs WHERE NOT open_to_all AND len(k_codes) = 0 AND len(k_activities) > 0 "
    f"AND (f_tokens IS NULL OR {B.OVERLAP} < 2) GROUP BY call_id"))
def sector_to_verify(spark, sf):
    calls = funds(spark, sf).where(~F.col("k_open") & (F.size("k_codes") == 0) & (F.size("k_activities") > 0))
    unsure = (F.col("everyone") - F.col("good")).alias("companies")
    return N.activity_counts(_anywhere(calls), firms(spark, sf)).select("call_id", unsure).filter("companies > 0")


@query("sector_excluded", B.with_calls(
    "SELECT call_id, company_id, f_section AS section FROM funds, firms WHERE list_contains(k_sections, f_section)"))
def sector_excluded(spark, sf):
    left = funds(spark, sf).select("call_id", F.col("k_sections").alias("call_keys"))
    right = firms(spark, sf).select("company_id", "f_section", F.array_compact(F.array("f_section")).alias("company_keys"))
    return M.meet(left, right).select("call_id", "company_id", F.col("f_section").alias("section"))


@query("legal_form_category", B.with_calls(
    "SELECT company_id, legal_form, f_form AS form_key, f_category AS category FROM firms"))
def legal_form_category(spark, sf):
    return firms(spark, sf).select("company_id", "legal_form", F.col("f_form").alias("form_key"), F.col("f_category").alias("category"))


@query("call_constraints", B.with_calls(
    "SELECT call_id, (len(k_codes) > 0 AND NOT open_to_all) OR (len(k_activities) > 0 AND NOT open_to_all) "
    "OR (len(k_regions) > 0 AND NOT list_contains(k_regions, 'tutta italia')) OR coalesce(revenue_max, 0) <> 0 "
    "OR len(k_sizes) BETWEEN 1 AND 3 AS has_constraints FROM funds"))
def call_constraints(spark, sf):
    return funds(spark, sf).select("call_id", P.has_constraints().alias("has_constraints"))


@query("call_ambiguous", B.with_calls(
    "SELECT call_id, CASE WHEN k_ambiguous THEN 'da_verificare' ELSE 'ok' END AS status FROM funds"))
def call_ambiguous(spark, sf):
    return funds(spark, sf).select("call_id", M.score_status().alias("status"))


def _nd(x: str) -> str:
    return f"coalesce(nullif(trim({x}), ''), 'N/D')"


@query("score_explanation", B.with_stored(
    "SELECT match_id, call_id, company_id, concat("
    f"CASE WHEN k_free THEN '✅ Regione: nessun vincolo' WHEN region_score = 30 THEN concat('✅ Regione compatibile (', trim(region), ')') ELSE concat('❌ Regione non compatibile (', {_nd('region')}, ')') END, ' · ', "
    f"CASE WHEN open_to_all THEN '✅ Settore: aperto a tutti' WHEN sector_score = 40 THEN concat('✅ Settore ammesso (', trim(sector_code), ')') WHEN sector_score > 0 THEN concat('⚠️ Settore parzialmente compatibile (', trim(sector_code), ')') ELSE concat('❌ Settore non ammesso (', {_nd('sector_code')}, ')') END, ' · ', "
    f"CASE WHEN len(k_sizes) = 0 THEN '✅ Dimensione: nessun vincolo' WHEN size_score = 20 THEN concat('✅ Dimensione compatibile (', trim(size_class), ')') ELSE concat('❌ Dimensione non compatibile (', {_nd('size_class')}, ')') END, ' · ', "
    "CASE WHEN revenue_max IS NULL THEN '✅ Fatturato: nessun vincolo' WHEN revenue_score = 10 THEN '✅ Fatturato entro i limiti' ELSE '❌ Fatturato fuori dai limiti' END"
    ") AS explanation FROM checks"))
def score_explanation(spark, sf):
    return stored(spark, sf).select("match_id", "call_id", "company_id", M.explanation().alias("explanation"))


@query("score_band", B.with_pairs(
    "SELECT call_id, CASE WHEN score > 70 THEN 'high' WHEN score >= 40 THEN 'mid' ELSE 'low' END AS band, CAST(count(*) AS BIGINT) AS companies FROM pairs GROUP BY ALL"))
def score_band(spark, sf):
    counted = L.score_counts(funds(spark, sf), firms(spark, sf))
    return counted.groupBy("call_id", M.score_band(F.col("score")).alias("band")).agg(F.sum("n").alias("companies"))


@query("eligibility", B.with_checks(
    "SELECT call_id, eligible, CAST(len(list_filter(outcomes, lambda o: o = 'fail')) AS INT) AS failed, "
    "CAST(len(list_filter(outcomes, lambda o: o = 'unverifiable')) AS INT) AS unverifiable, CAST(count(*) AS BIGINT) AS companies, "
    "CAST(sum(company_id) AS BIGINT) AS company_id_sum FROM checks GROUP BY ALL"))
def eligibility(spark, sf):
    calls = funds(spark, sf)
    usable = calls.select("call_id", "k_usable")
    counted = L.eligibility_counts(calls, firms(spark, sf)).join(usable, "call_id")
    eligible = F.when(F.col("k_usable"), F.col("failed") == 0).alias("eligible")
    return counted.select("call_id", eligible, "failed", "unverifiable", F.col("n").alias("companies"), F.col("ids").alias("company_id_sum"))


@query("eligible_pairs", B.with_checks("SELECT call_id, company_id FROM checks WHERE eligible"))
def eligible_pairs(spark, sf):
    return E.eligible_pairs(funds(spark, sf), firms(spark, sf)).select("call_id", "company_id")


def _grp(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


_MESSAGES = {
    "min_age": {"fail": "concat('Azienda costituita da ', f_months, ' mesi, richiesti almeno ', min_age_months)",
                "ok": "concat('Anzianità minima: OK (', f_months, ' mesi su ', min_age_months, ' richiesti)')",
                "unverifiable": "'Anzianità minima: non verificabile'"},
    "max_age": {"fail": "concat('Azienda costituita da ', f_months, ' mesi, limite massimo ', max_age_months)",
                "ok": "concat('Anzianità massima: OK (', f_months, ' mesi, limite ', max_age_months, ')')",
                "unverifiable": "'Anzianità massima: non verificabile'"},
    "section": {"fail": "concat('Codice ATECO ', trim(sector_code), ' (Sezione ', f_section, ') escluso dal bando')"},
    "legal_form": {"fail": "concat('Forma giuridica ''', trim(legal_form), ''' (', f_category, ') non inclusa tra le ammesse: ', array_to_string(legal_forms, ', '))",
                   "ok": "CASE WHEN contains(array_to_string(k_forms, ' '), 'registroimprese') THEN concat('Forma giuridica: OK (', trim(legal_form), ', bando aperto a tutte le forme iscritte al Registro Imprese)') ELSE concat('Forma giuridica: OK (', trim(legal_form), ')') END",
                   "unverifiable": "CASE WHEN f_form = '' THEN 'Forma giuridica: non verificabile' ELSE concat('Verifica forma giuridica: ''', trim(legal_form), ''' non riconosciuta, controlla manualmente') END"},
    "min_spend": {"ok": f"CASE WHEN revenue < min_spend THEN concat('⚠️ Attenzione: fatturato € ', {_grp('revenue')}, ' inferiore alla spesa minima di € ', {_grp('min_spend')}, ' — verificare la capacità di investimento') ELSE concat('Spesa minima: OK (€ ', {_grp('revenue')}, ' >= € ', {_grp('min_spend')}, ')') END",
                  "unverifiable": "'Spesa minima: non verificabile'"},
    "size": {"fail": "concat('Dimensione ''', size_class, ''' non ammessa dal bando (ammesse: ', array_to_string(sizes, ', '), ')')",
             "ok": "concat('Dimensione impresa: OK (', size_class, ')')",
             "unverifiable": "'Dimensione impresa: non verificabile (dato cliente assente)'"},
    "revenue_cap": {"fail": f"concat('Fatturato € ', {_grp('revenue')}, ' supera il limite di € ', {_grp('revenue_max')})",
                    "ok": f"concat('Fatturato: OK (€ ', {_grp('revenue')}, ' ≤ € ', {_grp('revenue_max')}, ')')",
                    "unverifiable": "'Fatturato massimo: non verificabile (dato cliente assente)'"},
    "employees": {"fail": "CASE WHEN employees < employees_min THEN concat('Numero dipendenti insufficiente: ', employees, ' (richiesti almeno ', employees_min, ')') ELSE concat('Numero dipendenti troppo alto: ', employees, ' (massimo ', employees_max, ')') END",
                  "ok": "concat('Numero dipendenti: OK (', employees, ')')",
                  "unverifiable": "'Numero dipendenti: non verificabile (dato cliente assente)'"},
    "region": {"fail": "concat('Regione ''', region, ''' non ammessa dal bando (ammesse: ', array_to_string(regions, ', '), ')')",
               "ok": "concat('Regione: OK (', region, ')')",
               "unverifiable": "'Regione: non verificabile (dato cliente assente)'"},
}


def _reason_sql() -> str:
    branches = []
    for i, name in enumerate(B.CRITERIA, 1):
        arms = " ".join(f"WHEN '{o}' THEN {m}" for o, m in _MESSAGES[name].items())
        branches.append(
            f"SELECT match_id, call_id, company_id, {i} AS position, '{name}' AS criterion, o_{name} AS outcome, CASE o_{name} {arms} END AS message "
            f"FROM checks WHERE o_{name} IS NOT NULL"
        )
    return B.with_stored(" UNION ALL ".join(branches))


@query("eligibility_reasons", _reason_sql())
def eligibility_reasons(spark, sf):
    return E.check_rows(stored(spark, sf), "match_id", "call_id", "company_id")


@query("eligibility_funnel", B.with_checks(
    "SELECT position, criterion, outcome, CAST(count(*) AS BIGINT) AS pairs FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS criterion, o_{n} AS outcome FROM checks" for i, n in enumerate(B.CRITERIA, 1))
    + ") WHERE outcome IS NOT NULL GROUP BY ALL"))
def eligibility_funnel(spark, sf):
    return N.funnel(funds(spark, sf), firms(spark, sf))


@query("match_status_label", B.with_checks(
    "SELECT call_id, CASE WHEN NOT eligible THEN 'Non ammissibile' WHEN score_status = 'da_verificare' THEN 'Da verificare' "
    "ELSE 'Ammissibile sui dati disponibili' END AS label, CAST(count(*) AS BIGINT) AS companies FROM checks GROUP BY ALL"))
def match_status_label(spark, sf):
    return L.status_counts(funds(spark, sf), firms(spark, sf))
