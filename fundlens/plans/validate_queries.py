"""Queries on the validation of call records."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF as AS_OF
from ..functions import dates, refdata as R, text as X
from ..operators import evidence as E, normalise as O, reviews, upkeep as U, validate as V
from ..sources import tables as T
from . import evidence_queries as EQ, normalise_queries as NQ, oracle_base as B
from .registry import query


def dated(spark, sf):
    return V.normalise_dates(NQ.record(spark, sf))


def _norm_date(c: str) -> str:
    return f"CASE WHEN trim({c}) <> '' THEN coalesce(CAST({B.parse_any(c)} AS VARCHAR), {c}) END"


@query("normalise_dates", NQ.with_rec(f"SELECT call_id, {_norm_date('data_pubblicazione')} AS data_pubblicazione, {_norm_date('data_scadenza')} AS data_scadenza FROM rec"))
def normalise_dates(spark, sf):
    return dated(spark, sf).select("call_id", *V.DATE_KEYS)


_STRUCT = "list_distinct(list_filter(list_transform(" + NQ.s_items(NQ.s_get("agevolazioni")) + f", lambda x: CASE WHEN json_type(x, '$.tipo') = 'VARCHAR' THEN x ->> '$.tipo' END), lambda t: list_contains({NQ.q(R.AID_TYPES)}, t)))"
_FLAT = "list_distinct(list_transform(" + NQ.s_items(NQ.s_get("tipo_agevolazione")) + ", lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' ELSE concat('#', CAST(x AS VARCHAR)) END))"
_RAWW = ("raww AS MATERIALIZED (SELECT call_id, wrapped, has_sources, list_filter([CASE WHEN wrapped AND len(s) > 0 AND NOT (list_has_all(s, f) AND list_has_all(f, s)) THEN 'Coerenza agevolazioni: tipo_agevolazione è stato riallineato automaticamente ad agevolazioni[].tipo' END, "
         f"CASE WHEN wrapped AND len(s) > 0 AND NOT list_has_any(s, {NQ.q(R.NON_REPAYABLE)}) AND has_amount THEN 'Coerenza agevolazioni: contributo_max conteneva il massimale del prestito ed è stato azzerato automaticamente' END], lambda w: w IS NOT NULL) AS rw FROM "
         f"(SELECT call_id, coalesce(json_type(payload, '$.bando') = 'OBJECT', false) AS wrapped, {_STRUCT} AS s, {_FLAT} AS f, coalesce(json_type(j, '$.contributo_max') <> 'NULL', false) AS has_amount, json_exists(j, '$.fonti') AS has_sources FROM raw_calls))")


@query("raw_conflicts", f"WITH {B.RAW_CALLS}, {_RAWW} SELECT call_id, array_to_string(rw, '|') AS warnings FROM raww")
def raw_conflicts(spark, sf):
    return NQ.opened(spark, sf).select("call_id", F.array_join(O.raw_conflicts(), "|").alias("warnings"))


# Final records of both flavours: "fin" holds flat fields, "fa" the instruments with 0-based idx.
_PLAIN_FIN = (f", fin AS MATERIALIZED (SELECT *, {_norm_date('data_pubblicazione')} AS published, {_norm_date('data_scadenza')} AS due, aperto AS is_open, cumulabilita AS cumulation, "
              "has_sezioni_ateco_escluse AS has_sections, CAST(NULL AS VARCHAR) AS text, note_text IS NOT NULL AS note_as_text FROM rec), "
              "fa AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pos) - 1 AS idx FROM aid)")

_EMPTY = {
    "titolo": "trim(coalesce(titolo, '')) = ''", "ente": "trim(coalesce(ente, '')) = ''", "data_pubblicazione": "published IS NULL", "data_scadenza": "trim(coalesce(due, '')) = ''",
    "codici_ateco_ammessi": "codici = ''", "attivita_ammesse": "NOT has_activities", "ateco_aperto_a_tutti": "false", "regioni_ammesse": "regioni = ''", "dimensione_impresa": "dimensioni = ''",
    **{f: f"{f} IS NULL" for f in R.NUMERIC_FIELDS},
    "percentuale_fondo_perduto": "(" + " AND ".join(f"pct_{b} IS NULL" for b in R.PERCENT_BANDS) + ")", "modalita_presentazione": "modalita IS NULL", "tipo_agevolazione": "len(tipi) = 0",
    "cumulabilita": "cumulation IS NULL", "spese_ammissibili": "NOT has_expenses", "link_fonte_ufficiale": "trim(coalesce(link, '')) = ''", "url_documento_origine": "trim(coalesce(url, '')) = ''",
    "note_esclusioni": "(note_text IS NULL AND note_list_text IS NULL AND NOT has_sections AND " + " AND ".join(f"NOT has_{n}" for n in R.NOTE_LISTS[1:]) + ")",
    "anzianita_impresa": "(eta_min IS NULL AND eta_max IS NULL)", "forme_giuridiche_ammesse": "forme = ''",
}
_COUNTED = [k for k in R.RECORD_KEYS if k not in R.NOT_COUNTED_KEYS]
_NULLS = "(" + " + ".join(f"CASE WHEN {_EMPTY[k]} THEN 1 ELSE 0 END" for k in _COUNTED) + f") / {len(_COUNTED)} * 100.0"


@query("null_percentage", NQ.with_rec(f"SELECT call_id, round({_NULLS}, 6) AS null_percentage FROM fin", _PLAIN_FIN))
def null_percentage(spark, sf):
    return dated(spark, sf).select("call_id", F.round(V.null_percentage(), 6).alias("null_percentage"))


_STATUS_EXTRA = {
    "agevolazioni": "n_aid = 0", "fonti": "NOT EXISTS (SELECT 1 FROM src WHERE src.call_id = fin.call_id AND (campo IS NOT NULL OR testo IS NOT NULL))",
    "enti_coinvolti": "len(list_filter(list_transform(" + NQ.s_items("json_extract(j, '$.enti_coinvolti')") + f", lambda x: {NQ.s_trim('json_extract(x, ' + chr(39) + '$.nome' + chr(39) + ')')}), lambda x: x IS NOT NULL)) = 0",
    "copertura_estrazione": "(coverage_total IS NULL AND coverage_read IS NULL AND coverage_blocks IS NULL AND coverage_complete IS NULL)",
}


@query("field_status", NQ.with_rec(
    "SELECT call_id, field, valued FROM (SELECT call_id, unnest([" + ", ".join(f"{{'field': 'bando.{k}', 'valued': NOT ({({**_EMPTY, **_STATUS_EXTRA})[k]})}}" for k in R.RECORD_KEYS)
    + "], recursive := true) FROM fin)", f"{_PLAIN_FIN}, {EQ._SOURCES_SQL}"))
def field_status(spark, sf):
    entries = F.array(*[F.struct(F.lit(f"bando.{k}").alias("field"), (~e).alias("valued")) for k, e in V.emptiness().items()])
    return dated(spark, sf).select("call_id", F.inline(entries))


_ISO = "regexp_full_match(trim({c}), '\\d{{4}}-\\d{{2}}-\\d{{2}}')"
_FORMAT = (
    "list_concat(list_filter([" + ", ".join(
        f"CASE WHEN trim(coalesce({c}, '')) <> '' AND NOT {_ISO.format(c=c)} THEN 'bando.{k} deve essere YYYY-MM-DD o null' END" for c, k in (("published", "data_pubblicazione"), ("due", "data_scadenza")))
    + ", CASE WHEN is_open AND codici <> '' THEN 'Se ateco_aperto_a_tutti è true, codici_ateco_ammessi deve essere []' END], lambda e: e IS NOT NULL), coalesce(ferr, []))"
)
_FA_SUM = (
    ", fa_sum AS (SELECT call_id, flatten(list(list_filter([" + ", ".join(f"CASE WHEN {n} < 0 THEN concat('bando.agevolazioni[', idx, '].{n} non può essere negativo') END" for n in R.INSTRUMENT_NUMBERS)
    + ", CASE WHEN percentuale > 100 THEN concat('bando.agevolazioni[', idx, '].percentuale non può superare 100') END], lambda e: e IS NOT NULL) ORDER BY idx)) AS ferr, "
    "flatten(list(list_filter([CASE WHEN tipo = 'finanziamento_agevolato' AND rimborso_richiesto = false THEN concat('Coerenza agevolazioni: agevolazioni[', idx, '] è un finanziamento ma rimborso_richiesto è false') END, "
    "CASE WHEN tipo = 'fondo_perduto' AND importo_max IS NULL AND percentuale IS NULL AND " + " AND ".join(f"pct_{b} IS NULL" for b in R.PERCENT_BANDS)
    + " THEN concat('Coerenza agevolazioni: agevolazioni[', idx, '] è a fondo perduto ma non contiene né importo massimo né percentuale') END], lambda e: e IS NOT NULL) ORDER BY idx)) AS lwarn, list(DISTINCT tipo) AS stypes FROM fa GROUP BY 1)"
)
_LOGIC = (
    f"list_concat(list_filter([CASE WHEN {_ISO.format(c='due')} AND {B.parse_any('due')} <= {B.AS_OF} THEN 'data_scadenza nel passato — verificare se il bando è ancora attivo' END, "
    "CASE WHEN stypes IS NOT NULL AND NOT (list_has_all(stypes, tipi) AND list_has_all(tipi, stypes)) THEN 'Coerenza agevolazioni: tipo_agevolazione non coincide con agevolazioni[].tipo' END, "
    f"CASE WHEN len(coalesce(stypes, tipi)) > 0 AND NOT list_has_any(coalesce(stypes, tipi), {NQ.q(R.NON_REPAYABLE)}) AND contributo_max IS NOT NULL THEN 'Coerenza agevolazioni: contributo_max è valorizzato per uno strumento solo rimborsabile; verificare che non sia il massimale del prestito' END], lambda e: e IS NOT NULL), "
    "coalesce(lwarn, []), CASE WHEN coverage_complete = false THEN ['Copertura estrazione incompleta — revisione manuale obbligatoria'] ELSE [] END)"
)
_LERR = f"CASE WHEN {_ISO.format(c='due')} AND {B.parse_any('due')} IS NULL THEN ['bando.data_scadenza non è una data valida'] ELSE [] END"


@query("format_errors", NQ.with_rec(f"SELECT fin.call_id, array_to_string(list_concat({_FORMAT}, {_LERR}), '|') AS errors FROM fin LEFT JOIN fa_sum USING (call_id)", _PLAIN_FIN + _FA_SUM))
def format_errors(spark, sf):
    return dated(spark, sf).select("call_id", F.array_join(F.concat(V.format_errors(), V.logical_errors()), "|").alias("errors"))


@query("logical_warnings", NQ.with_rec(f"SELECT fin.call_id, array_to_string({_LOGIC}, '|') AS warnings FROM fin LEFT JOIN fa_sum USING (call_id)", _PLAIN_FIN + _FA_SUM))
def logical_warnings(spark, sf):
    return dated(spark, sf).select("call_id", F.array_join(V.logical_warnings(AS_OF), "|").alias("warnings"))


_GAPS = (
    "list_filter([CASE WHEN " + _EMPTY["titolo"] + " THEN 'titolo' END, CASE WHEN " + _EMPTY["data_scadenza"] + f" AND NOT coalesce(regexp_matches(text, '{EQ._re(R.ROLLING_WINDOW_PATTERN)}'), false) THEN 'data_scadenza' END, "
    "CASE WHEN contributo_max IS NULL AND " + _EMPTY["percentuale_fondo_perduto"] + " AND fin_aid = 0 AND len(tipi) = 0 THEN 'contributo_max/percentuale_fondo_perduto' END, "
    "CASE WHEN codici = '' AND NOT is_open AND NOT has_activities THEN 'codici_ateco_ammessi/ateco_aperto_a_tutti/attivita_ammesse' END], lambda g: g IS NOT NULL)"
)


@query("critical_gaps", NQ.with_rec(f"SELECT call_id, array_to_string({_GAPS}, '|') AS gaps FROM (SELECT *, n_aid AS fin_aid FROM fin)", _PLAIN_FIN))
def critical_gaps(spark, sf):
    return dated(spark, sf).select("call_id", F.array_join(V.critical_gaps(), "|").alias("gaps"))


@query("needs_review", NQ.with_rec(
    f"SELECT call_id, len({_GAPS}) > 0 OR {_NULLS} > 50 OR len(list_filter(w, lambda x: starts_with(x, 'Coerenza') OR starts_with(x, 'Copertura estrazione incompleta'))) > 0 AS needs_review "
    f"FROM (SELECT *, n_aid AS fin_aid, {_LOGIC} AS w FROM fin LEFT JOIN fa_sum USING (call_id))", _PLAIN_FIN + _FA_SUM))
def needs_review(spark, sf):
    judged = dated(spark, sf).withColumns({"gaps": V.critical_gaps(), "null_percentage": V.null_percentage(), "warnings": V.logical_warnings(AS_OF)})
    return V.judge(judged).select("call_id", "needs_review")


# --- the whole validation ---
_SECTIONS = EQ._SEC_SQL.replace(f", {B.DOCUMENTS}", "", 1)
_REPAIR = EQ.REPAIR_SQL.replace(f", {B.DOCUMENTS}", "", 1)
_DEADLINES = EQ._dates_sql() + (", best AS (SELECT doc_id, day, row_number() OVER (PARTITION BY doc_id ORDER BY weight * 1000 - abs(d_at - k_at) DESC, kw, kpos, pat, pos) AS r FROM found JOIN words USING (doc_id) WHERE abs(d_at - k_at) <= 400), "
    f"inferred AS (SELECT docs.doc_id, CASE WHEN date_diff('day', day, {B.AS_OF}) <= 180 AND NOT regexp_matches(text, '{EQ._re(R.ROLLING_WINDOW_PATTERN)}') THEN CAST(day AS VARCHAR) END AS day FROM docs LEFT JOIN best ON best.doc_id = docs.doc_id AND r = 1)")
_LST = "CASE WHEN json_type(r.j, '$.note_esclusioni') = 'OBJECT' THEN " + EQ._RAW_SECTIONS + " ELSE CAST([] AS VARCHAR[]) END"
_SECTION_ROWS = (
    f", sec AS MATERIALIZED (SELECT *, list_concat(kll, fresh) AS kept_letters FROM (SELECT *, list_filter(outs, lambda x: NOT list_contains(kll, x)) AS fresh FROM (SELECT call_id, outs, "
    "list_filter(list_transform(lst, lambda v: regexp_extract(upper(v), '\\b([A-U])\\b', 1)), lambda x: list_contains(letters, x)) AS kll, "
    "list_filter(lst, lambda v: regexp_extract(upper(v), '\\b([A-U])\\b', 1) <> '' AND NOT list_contains(letters, regexp_extract(upper(v), '\\b([A-U])\\b', 1))) AS removed FROM "
    f"(SELECT call_id, {_LST} AS lst, coalesce(letters, []) AS letters, coalesce(outs, []) AS outs FROM raw_calls r JOIN docs ON docs.doc_id = call_id LEFT JOIN cites_by_doc c ON c.doc_id = call_id LEFT JOIN out_by_doc o ON o.doc_id = call_id))))"
)
_FULL = (
    EQ.ECON_SQL + ", " + _SECTIONS.lstrip(", ") + _SECTION_ROWS + ", " + _DEADLINES + EQ.ISSUER_SQL + _REPAIR + ", " + _RAWW
    + f", fin AS MATERIALIZED (SELECT rec.* EXCLUDE (note_text), e.text, {_norm_date('data_pubblicazione')} AS published, coalesce({_norm_date('data_scadenza')}, i.day) AS due, "
    f"CASE WHEN {_norm_date('data_scadenza')} IS NULL AND i.day IS NOT NULL THEN ['bando.data_scadenza ricavata dal testo PDF (il modello non l''aveva compilata)'] ELSE [] END AS w_inferred, "
    "aperto AND NOT (e.has_text AND len(s.kept_letters) > 0) AS is_open, e.cumulation, note_text, "
    "CASE WHEN e.has_text THEN len(s.kept_letters) > 0 ELSE has_sezioni_ateco_escluse END AS has_sections, "
    "CASE WHEN e.has_text THEN list_filter([CASE WHEN len(removed) > 0 THEN concat('Coerenza ATECO: rimosse sezioni non citate esplicitamente nel testo: ', array_to_string(removed, ', ')) END, "
    "CASE WHEN len(fresh) > 0 THEN concat('Coerenza ATECO: recuperate dal testo sezioni escluse esplicite: ', array_to_string(list_transform(fresh, lambda x: concat('Sez. ', x)), ', ')) END], lambda w: w IS NOT NULL) ELSE [] END AS w_sections, "
    "CASE WHEN p.call_id IS NOT NULL THEN [concat('Fonte ente: citazione incoerente sostituita con evidenza contestuale a pagina ', p.page)] ELSE [] END AS w_repair, "
    f"list_filter([CASE WHEN regexp_matches(e.text, '{EQ._re(R.REBATE_PATTERN)}') AND NOT (has_loan AND rebate IS NOT NULL) THEN 'Completezza economica: il testo cita un abbuono ma il campo è vuoto' END, "
    f"CASE WHEN regexp_matches(e.text, '{EQ._re(R.CUMULATION_WORD_PATTERN)}') AND coalesce(e.cumulation, '') = '' THEN 'Completezza economica: il testo cita il cumulo ma il campo è vuoto' END], lambda w: w IS NOT NULL) AS w_econ, "
    "CASE WHEN wrapped AND has_sources AND CASE WHEN p.call_id IS NOT NULL THEN NOT list_has_all(" + EQ._S_TOKENS.format(x="p.snippet") + ", tokens) ELSE warning IS NOT NULL END THEN [warning] ELSE [] END AS w_issuer, rw, "
    "e.has_text, e.has_loan FROM rec JOIN econ e USING (call_id) LEFT JOIN sec s USING (call_id) LEFT JOIN inferred i ON i.doc_id = rec.call_id LEFT JOIN repair p USING (call_id) JOIN issuer USING (call_id) JOIN raww USING (call_id)), "
    "fa AS MATERIALIZED (SELECT a.* EXCLUDE (rimborso_richiesto), row_number() OVER (PARTITION BY a.call_id ORDER BY pos) - 1 AS idx, CASE WHEN f.has_text AND tipo = 'finanziamento_agevolato' "
    "AND row_number() OVER (PARTITION BY a.call_id, tipo ORDER BY pos) = 1 THEN true ELSE rimborso_richiesto END AS rimborso_richiesto FROM aid a JOIN fin f USING (call_id))"
    + _FA_SUM
    + f", judged AS MATERIALIZED (SELECT *, {_GAPS} AS gaps, round({_NULLS}, 6) AS nullp, {_FORMAT} AS ferrs, {_LERR} AS lerrs, "
    f"list_concat(rw, w_inferred, w_sections, w_repair, w_econ, w_issuer, {_LOGIC}) AS w FROM (SELECT fin.* , ferr, lwarn, "
    # A loan rebuilt from the flat type list counts as a structured instrument.
    "CASE WHEN has_loan AND NOT list_contains(coalesce(stypes, []), 'finanziamento_agevolato') THEN list_concat(coalesce(stypes, []), ['finanziamento_agevolato']) ELSE stypes END AS stypes, "
    "n_aid + CASE WHEN has_loan AND NOT list_contains(coalesce(stypes, []), 'finanziamento_agevolato') THEN 1 ELSE 0 END AS fin_aid FROM fin LEFT JOIN fa_sum USING (call_id))), "
    "verdict AS MATERIALIZED (SELECT *, len(gaps) > 0 OR nullp > 50 OR coherent AS needs_review, list_concat(w, list_filter([CASE WHEN len(gaps) > 0 THEN concat('Da revisionare manualmente — campi critici mancanti: ', array_to_string(gaps, ', ')) END, "
    "CASE WHEN nullp > 50 THEN concat('RF-007: Da revisionare manualmente — più del 50% dei campi è nullo (', CAST(round_even(nullp, 0) AS INT), '%)') END, "
    "CASE WHEN coherent AND len(gaps) = 0 AND nullp <= 50 THEN 'Da revisionare manualmente — verificare le avvertenze di coerenza' END], lambda x: x IS NOT NULL)) AS warnings FROM "
    "(SELECT *, len(list_filter(w, lambda x: starts_with(x, 'Coerenza agevolazioni') OR starts_with(x, 'Coerenza fonti') OR starts_with(x, 'Coerenza ATECO') OR starts_with(x, 'Copertura estrazione incompleta') OR starts_with(x, 'Completezza economica'))) > 0 AS coherent FROM judged))"
)


def validated(spark, sf):
    return V.validate(EQ.records_with_text(spark, sf), "text", AS_OF)


@query("validate_calls", NQ.with_rec("SELECT call_id, due AS data_scadenza, array_to_string(list_concat(ferrs, lerrs), '|') AS errors, array_to_string(warnings, '|') AS warnings, nullp AS null_percentage, needs_review, array_to_string(gaps, '|') AS gaps FROM verdict", _FULL))
def validate_calls(spark, sf):
    return validated(spark, sf).select(
        "call_id", "data_scadenza", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"),
        F.round("null_percentage", 6).alias("null_percentage"), "needs_review", F.array_join("gaps", "|").alias("gaps"))


_REASON_SQL = ("CASE WHEN len(list_filter(warnings, lambda x: contains(lower(x), 'revisionare manualmente') OR starts_with(x, 'RF-007:'))) > 0 THEN list_filter(warnings, lambda x: contains(lower(x), 'revisionare manualmente') OR starts_with(x, 'RF-007:')) "
               "ELSE list_transform(gaps, lambda g: concat('Campo critico mancante: ', g)) END")


@query("review_reasons", NQ.with_rec(f"SELECT call_id, array_to_string({_REASON_SQL}, '|') AS reasons FROM verdict", _FULL))
def review_reasons(spark, sf):
    return validated(spark, sf).select("call_id", F.array_join(reviews.select_reasons(F.col("warnings"), F.col("gaps")), "|").alias("reasons"))


_NORM = EQ._NORM
_H = "CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' THEN sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) END"


def _reason(t: str, h: str) -> str:
    m = lambda c, p: f"regexp_matches({c}, '{p}')"
    return (f"({m(t, R.TITLE_COMPETITION_PATTERN)} OR ({m(t, R.SELECTION_PATTERN)} AND {m(t, R.PERSONNEL_PATTERN)}) OR (regexp_matches({t}, '\\bgraduatoria\\b') AND {m(t, R.RANKING_PATTERN)}) "
            f"OR (regexp_matches({h}, '\\bconcorso pubblico\\b') AND {m(h, R.PERSONNEL_PATTERN)}) OR ({m(h, R.SELECTION_PATTERN)} AND {m(h, R.RECRUITMENT_PATTERN)}) OR (regexp_matches({h}, '\\bgraduatoria\\b') AND {m(h, R.RANKING_PATTERN)}))")


_ROUTE_SQL = (
    _FULL + f", {B.CALLS}, known_hash AS (SELECT {_H} AS h, min(doc_id) AS first_id FROM docs GROUP BY 1), known_title AS (SELECT lower(coalesce(title, '')) AS t, lower(coalesce(issuer, '')) AS e, min(call_id) AS id FROM calls GROUP BY ALL), "
    f"routed AS (SELECT v.call_id, needs_review, len(ferrs) + len(lerrs) AS n_err, h.first_id < v.call_id AS hash_dup, CASE WHEN k.id < v.call_id THEN k.id END AS title_dup, "
    f"{_reason(chr(39) + chr(39), 'hd')} AS early, {_reason('tt', 'hd')} AS late FROM (SELECT *, {_NORM.format(x='titolo')} AS tt, {_NORM.format(x='text')} AS hd, {_H} AS hh FROM verdict WHERE has_text) v "
    "LEFT JOIN known_hash h ON h.h = v.hh LEFT JOIN known_title k ON trim(coalesce(v.titolo, '')) <> '' AND k.t = lower(v.titolo) AND k.e = lower(coalesce(v.ente, '')))"
)


@query("ingest_routing", NQ.with_rec(
    "SELECT call_id, CASE WHEN early THEN 'non_compatibile' WHEN hash_dup THEN 'duplicato' WHEN late THEN 'non_compatibile' WHEN n_err > 0 THEN 'errore' WHEN title_dup IS NOT NULL THEN 'duplicato' WHEN needs_review THEN 'da_revisionare' ELSE 'validato' END AS route FROM routed", _ROUTE_SQL))
def ingest_routing(spark, sf):
    """Route of every submitted document: rejected, duplicate, erroneous, pending or validated.

    A text or a title (with issuer) seen under a smaller id counts as already stored.
    """
    hashed = validated(spark, sf).filter("text IS NOT NULL").withColumn("document_hash", X.content_hash(F.col("text")))
    first = hashed.filter("document_hash IS NOT NULL").groupBy("document_hash").agg(F.min("call_id").alias("first_id"))
    stored = T.calls(spark, sf).select("call_id", "title", "issuer")
    rows = hashed.join(first, "document_hash", "left").withColumns({
        "early_reason": E.relevance(F.lit(None).cast("string"), F.col("text")), "late_reason": E.relevance(F.col("titolo"), F.col("text")),
        "hash_duplicate": F.when(F.col("first_id") < F.col("call_id"), F.col("first_id")), "title": F.col("titolo"), "issuer": F.col("ente")})
    named = U.find_duplicates(rows.select("call_id", "title", "issuer", "early_reason", "late_reason", "hash_duplicate", "errors", "needs_review"), stored, oldest=True)
    earlier = F.when(F.col("duplicate_of") < F.col("call_id"), F.col("duplicate_of"))
    return V.route(named.withColumn("title_duplicate", earlier).drop("duplicate_of"), "text").select("call_id", "route")


_GOLD_FIELDS = ("titolo", "ente", "data_scadenza", "contributo_max", "fatturato_max", "modalita_presentazione", "cumulabilita")


@query("field_accuracy", NQ.with_rec(
    "SELECT field, CAST(count(*) AS BIGINT) AS judged, CAST(count(*) FILTER (extracted = gold) AS BIGINT) AS correct, round(count(*) FILTER (extracted = gold) / count(*), 6) AS accuracy FROM "
    "(SELECT f.field, coalesce(f.value, '') AS extracted, CASE WHEN quality = 0 AND (length(f.field) + l.doc_id) % 3 = 0 THEN 'altro' ELSE coalesce(f.value, '') END AS gold FROM labels l JOIN "
    "(SELECT call_id, unnest([{'field': 'titolo', 'value': titolo}, {'field': 'ente', 'value': ente}, {'field': 'data_scadenza', 'value': due}, {'field': 'contributo_max', 'value': CAST(CAST(contributo_max AS BIGINT) AS VARCHAR)}, "
    "{'field': 'fatturato_max', 'value': CAST(CAST(fatturato_max AS BIGINT) AS VARCHAR)}, {'field': 'modalita_presentazione', 'value': modalita}, {'field': 'cumulabilita', 'value': cumulabilita}], recursive := true) FROM fin) f ON f.call_id = l.doc_id) GROUP BY field", _PLAIN_FIN))
def field_accuracy(spark, sf):
    """Share of extracted fields that agree with the labelled ones, per field."""
    number = lambda c: F.round(c).cast("bigint").cast("string")
    r = dated(spark, sf)
    values = {f: (number(F.col(f)) if f in R.NUMERIC_FIELDS else F.col(f)) for f in _GOLD_FIELDS}
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(v, F.lit("")).alias("extracted")) for f, v in values.items()])
    rows = r.select("call_id", F.inline(entries))
    labels = T.table(spark, sf, "labels").select(F.col("doc_id").alias("call_id"), "quality")
    # Labelled values: the extracted one, except that poorly extracted documents carry planted errors.
    wrong = (F.col("quality") == 0) & ((F.length("field") + F.col("call_id")) % 3 == 0)
    judged = rows.join(labels, "call_id").withColumn("gold", F.when(wrong, F.lit("altro")).otherwise(F.col("extracted")))
    return accuracy(judged)


def accuracy(judged):
    """Per field: judged values, correct ones and their share."""
    counted = judged.groupBy("field").agg(F.count("*").alias("judged"), F.count_if(F.col("extracted") == F.col("gold")).alias("correct"))
    return counted.withColumn("accuracy", F.round(F.col("correct") / F.col("judged"), 6))


@query("days_left", f"WITH {B.CALLS} SELECT call_id, deadline, {B.days_left('deadline')} AS days_left FROM calls")
def days_left(spark, sf):
    return T.calls(spark, sf).select("call_id", "deadline", dates.days_left(F.col("deadline"), AS_OF).alias("days_left"))


@query("urgency", f"WITH {B.CALLS} SELECT call_id, {B.urgency('deadline')} AS urgency FROM calls")
def urgency(spark, sf):
    return T.calls(spark, sf).select("call_id", dates.urgency(F.col("deadline"), AS_OF).alias("urgency"))


@query("italian_date", f"WITH {B.CALLS} SELECT call_id, {B.italian_long('deadline')} AS deadline_text FROM calls")
def italian_date(spark, sf):
    return T.calls(spark, sf).select("call_id", dates.italian_long(F.col("deadline")).alias("deadline_text"))
