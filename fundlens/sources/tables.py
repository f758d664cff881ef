"""The engine's input tables, derived from whole test tables.

Each table is a list of (column, SQL expression). The expressions are plain SQL that Spark and the
check database read alike, so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

K = "p_partkey"
C = "c_custkey"


def _pick(key: str, modulus: int, values: dict[int, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in values.items())
    return f"CASE {key} % {modulus} {arms} ELSE {default} END"


def _iso_day(days: str, start: str = "2024-03-01") -> str:
    return f"CAST(DATE '{start}' + CAST({days} AS INT) AS STRING)"


_DEADLINE_ISO = _iso_day(f"(7 * {K}) % 400")

COMPANY_COLUMNS = [
    ("company_id", C),
    ("legal_name", "c_name"),
    ("vat_number", f"CASE WHEN {C} % 29 = 0 THEN NULL WHEN {C} % 13 = 0 THEN '12345' ELSE lpad(CAST({C} AS STRING), 11, '0') END"),
    ("sector_code", f"CASE WHEN {C} % 53 = 0 THEN ' ' WHEN {C} % 59 = 0 THEN '6.1' ELSE "
                    f"concat(lpad(CAST(1 + {C} % 99 AS STRING), 2, '0'), '.', lpad(CAST({C} % 7 AS STRING), 2, '0')) END"),
    ("activity_description", f"CASE WHEN {C} % 31 = 0 THEN NULL ELSE concat(lower(c_mktsegment), "
                             f"CASE WHEN {C} % 3 = 0 THEN ' servizi digitali' ELSE ' produzione' END) END"),
    ("region", f"CASE WHEN {C} % 23 = 0 THEN NULL ELSE n_name END"),
    ("revenue", f"CASE WHEN {C} % 19 = 0 THEN NULL ELSE round(coalesce(rev, 0), 2) END"),
    ("size_class", f"CASE WHEN {C} % 61 = 0 THEN NULL WHEN coalesce(rev, 0) < 1000000 THEN 'micro' "
                   "WHEN coalesce(rev, 0) < 2500000 THEN 'piccola' WHEN coalesce(rev, 0) < 4000000 THEN 'media' ELSE 'grande' END"),
    ("founded_on", "CAST(first_order AS DATE)"),
    ("employees", f"CASE WHEN {C} % 17 = 0 THEN NULL ELSE CAST(coalesce(n_orders, 0) * 7 AS INT) END"),
    ("legal_form", _pick(C, 8, {0: "'S.r.l.'", 1: "'S.p.A.'", 2: "'S.n.c.'", 3: "'ditta individuale'",
                                4: "'Cooperativa'", 5: "'S.r.l. unipersonale'", 6: "'trust'"})),
]

CALL_COLUMNS = [
    ("call_id", K),
    ("title", f"CASE WHEN {K} % 41 = 0 THEN '' WHEN {K} % 37 = 0 THEN concat(upper(p_name), ' ') ELSE p_name END"),
    ("issuer", f"CASE WHEN {K} % 47 = 0 THEN NULL ELSE p_brand END"),
    ("deadline", f"CASE WHEN {K} % 11 = 0 THEN NULL WHEN {K} % 97 = 0 THEN 'da definire' "
                 f"WHEN {K} % 5 = 1 THEN concat(substr({_DEADLINE_ISO}, 9, 2), '/', substr({_DEADLINE_ISO}, 6, 2), '/', substr({_DEADLINE_ISO}, 1, 4)) "
                 f"WHEN {K} % 5 = 2 THEN concat(substr({_DEADLINE_ISO}, 9, 2), '-', substr({_DEADLINE_ISO}, 6, 2), '-', substr({_DEADLINE_ISO}, 1, 4)) "
                 f"ELSE {_DEADLINE_ISO} END"),
    ("open_to_all", f"({K} % 6 = 0)"),
    ("sector_codes_text", f"CASE WHEN {K} % 6 IN (1, 2, 3) THEN concat(lpad(CAST(1 + {K} % 99 AS STRING), 2, '0'), '.0', CAST({K} % 7 AS STRING), ';', "
                          f"lpad(CAST(1 + ({K} + 40) % 99 AS STRING), 2, '0'), '.01') ELSE '' END"),
    ("activities_text", f"CASE WHEN {K} % 6 = 4 THEN 'servizi digitali avanzati;produzione industriale' ELSE '' END"),
    ("regions_text", f"CASE {K} % 4 WHEN 0 THEN '' WHEN 1 THEN concat('NATION_', CAST({K} % 25 AS STRING), ';nation_', CAST(({K} + 7) % 25 AS STRING)) "
                     f"WHEN 2 THEN CASE WHEN {K} % 28 = 2 THEN 'tutte' ELSE 'Tutta Italia' END "
                     f"ELSE concat('NATION_', CAST({K} % 25 AS STRING), ';NATION_', CAST(({K} + 3) % 25 AS STRING), ';nation_', CAST({K} % 25 AS STRING)) END"),
    ("sizes_text", _pick(K, 5, {0: "''", 1: "'micro;piccola'", 2: "'micro;piccola;media'", 3: "'micro;piccola;media;grande'"}, "'media;grande'")),
    ("revenue_max", f"CASE WHEN {K} % 3 = 0 THEN NULL WHEN {K} % 101 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(1500000 + ({K} % 5) * 800000 AS DOUBLE) END"),
    ("contribution_max", f"CASE WHEN {K} % 4 = 0 THEN NULL ELSE round(p_retailprice * (1 + {K} % 7), 2) END"),
    ("min_spend", f"CASE WHEN {K} % 9 = 4 THEN CAST(2000000 AS DOUBLE) WHEN {K} % 9 = 5 THEN CAST(0 AS DOUBLE) ELSE NULL END"),
    ("excluded_sections_text", _pick(K, 7, {0: "'K;L'", 3: "'Sezione C - Manifattura'", 5: "'sez. g'"}, "''")),
    ("legal_forms_text", _pick(K, 8, {1: "'società di capitali;Cooperative'", 2: "'Tutte le forme iscritte al Registro Imprese'",
                                      3: "'ditte individuali'", 5: "'trust;S.r.l.s.'"}, "''")),
    ("min_age_months", f"CASE WHEN {K} % 9 = 1 THEN 300 WHEN {K} % 9 = 7 THEN 0 ELSE NULL END"),
    ("max_age_months", f"CASE WHEN {K} % 9 = 2 THEN 340 ELSE NULL END"),
    ("employees_min", f"CASE WHEN {K} % 10 = 1 THEN 60 ELSE NULL END"),
    ("employees_max", f"CASE WHEN {K} % 10 = 2 THEN 70 ELSE NULL END"),
    ("review_status", f"CASE WHEN {K} % 13 = 0 THEN 'da_revisionare' ELSE 'validato' END"),
    ("null_percentage", f"CASE WHEN {K} % 13 = 0 THEN 62.5 ELSE CAST({K} % 45 AS DOUBLE) END"),
    ("review_reasons", f"CASE WHEN {K} % 13 = 0 THEN '[\" manca titolo \",\"\",\"manca scadenza\"]' WHEN {K} % 31 = 0 THEN ' testo libero ' "
                       f"WHEN {K} % 37 = 0 THEN '{{\"a\":1}}' WHEN {K} % 3 = 0 THEN NULL ELSE '[]' END"),
    ("submission_mode", _pick(K, 6, {0: "'sportello'", 1: "'click_day'", 2: "'graduatoria'", 3: "'mista'"})),
    ("cumulability", _pick(K, 8, {0: "'Cumulabile, salvo i limiti di cumulo vigenti'", 1: "'Non cumulabile con altri aiuti'", 2: "'Soggetto a regime De Minimis'",
                                  3: "'non aver beneficiato di altri aiuti sul medesimo investimento'", 4: "concat('Nota ', p_type, ' cumulo: ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name)", 5: "'  '"})),
    ("expenses_text", _pick(K, 9, {0: "''", 1: "'Acquisto di arredi e impianti;spese di personale'", 2: "'Altre spese connesse;investimenti materiali e immateriali'",
                                   3: "'IVA non recuperabile;Licenze informatiche;arredi'", 4: "concat('spese ammissibili per ', p_name)",
                                   5: "'Ricerca e sviluppo;consulenze;Formazione del personale;imposta di bollo'",
                                   6: "'Altre spese connesse;Sito web e-commerce;veicoli'", 7: "concat(p_type, '  misto , ', p_name, ' -')"}, "'Brevetti'")),
    ("bans_text", _pick(K, 8, {0: "''", 1: "'produzione di tabacco;gioco d''azzardo'", 2: "'attività finanziarie e assicurative'",
                               3: "'bar tabacchi: vendita tabacco;commercio di armi e munizioni'", 4: "'sviluppo immobiliare speculativo'",
                               5: "'pesca e acquacoltura;produzione primaria di prodotti agricoli'", 6: "concat('vendita di ', p_name)"},
                       "'attività immobiliari;discariche e inceneritori;energia nucleare'")),
    ("source_url", f"CASE WHEN {K} % 5 = 0 THEN NULL WHEN {K} % 5 = 1 THEN ' ' ELSE concat('https://bandi.example.com/', CAST({K} AS STRING)) END"),
    ("regions_json", f"CASE WHEN {K} % 17 = 0 THEN '[non json' WHEN {K} % 4 = 0 THEN CASE WHEN {K} % 8 = 0 THEN NULL ELSE '[]' END "
                     f"WHEN {K} % 4 = 2 THEN '[\"Tutta Italia\"]' ELSE concat('[\"NATION_', CAST({K} % 25 AS STRING), '\",\"nation_', CAST(({K} + 3) % 25 AS STRING), '\",\"\"]') END"),
    ("created_on", "DATE '2023-01-01' + CAST((13 * p_partkey) % 500 AS INT)"),
    ("has_original", f"({K} % 3 <> 1)"),
]

CALL_LISTS = {
    "sector_codes": "sector_codes_text",
    "activities": "activities_text",
    "regions": "regions_text",
    "sizes": "sizes_text",
    "excluded_sections": "excluded_sections_text",
    "legal_forms": "legal_forms_text",
    "expenses": "expenses_text",
    "bans": "bans_text",
}

# Stored match results: one per line item's part and customer, with a score of its own that may be stale.
STORED_COLUMNS = [
    ("match_id", "(l_partkey * 10000000 + o_custkey) * 10 + l_linenumber"),
    ("call_id", "l_partkey"),
    ("company_id", "o_custkey"),
    ("score", "CAST((l_partkey * 7 + l_linenumber * 13 + o_custkey * 3) % 101 AS INT)"),
    ("matched_on", "CAST(shipped AS DATE)"),
]

# Company forms as typed in: padded and blank texts, a zero head count, known and new ids.
COMPANY_FORM_COLUMNS = [
    ("company_id", "s_suppkey * 20"),
    ("legal_name", "concat('  ', s_name, ' ')"),
    ("vat_number", "CASE s_suppkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '0123456789' ELSE concat(' ', lpad(CAST(s_suppkey AS STRING), 11, '0'), ' ') END"),
    ("sector_code", "CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' 62.01 ' WHEN 2 THEN '62.01.1' WHEN 3 THEN '62' ELSE '62.01.12' END"),
    ("activity_description", "CASE s_suppkey % 3 WHEN 0 THEN '  ' ELSE ' consulenza ' END"),
    ("region", "CASE s_suppkey % 4 WHEN 3 THEN ' ' ELSE concat('NATION_', CAST(s_nationkey AS STRING), ' ') END"),
    ("revenue", "s_acctbal * 10000"),
    ("size_class", "CASE s_suppkey % 6 WHEN 0 THEN 'micro' WHEN 1 THEN 'piccola' WHEN 2 THEN 'media' WHEN 3 THEN 'grande' WHEN 4 THEN ' Grande ' ELSE NULL END"),
    ("founded_on", "DATE '2010-01-01' + CAST(s_suppkey % 1000 AS INT)"),
    ("employees", "CAST(CASE s_suppkey % 5 WHEN 0 THEN 0 ELSE (s_suppkey * 13) % 400 END AS INT)"),
    ("legal_form", "CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' S.r.l. ' WHEN 2 THEN NULL ELSE 'S.p.A.' END"),
]

# Uploaded files: content and name per call, one per web page.
UPLOAD_COLUMNS = [
    ("call_id", "page_id"),
    ("content_text", "CASE WHEN page_id % 3 = 0 THEN html ELSE concat('%PDF-1.7 ', html) END"),
    ("file_name", "CASE page_id % 4 WHEN 0 THEN NULL ELSE concat(' file_', CAST(page_id AS STRING), '.pdf ') END"),
]

# Clauses injected into document texts, so that the evidence operators have something to find.
_DAY = _iso_day("(11 * doc_id) % 300")
_DMY = f"concat(substr({_DAY}, 9, 2), '/', substr({_DAY}, 6, 2), '/', substr({_DAY}, 1, 4))"
_DOTS = f"concat(substr({_DAY}, 9, 2), '.', substr({_DAY}, 6, 2), '.', substr({_DAY}, 1, 4))"
_MONTH = "CASE substr(" + _DAY + ", 6, 2) " + " ".join(
    f"WHEN '{i:02d}' THEN '{m}'" for i, m in enumerate(
        ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre",
         "ottobre", "novembre", "dicembre"), 1)
) + " END"
_LONG = f"concat(CAST(CAST(substr({_DAY}, 9, 2) AS INT) AS STRING), ' ', {_MONTH}, ' ', substr({_DAY}, 1, 4))"
DOCUMENT_CLAUSE = (
    "CASE doc_id % 12 "
    f"WHEN 0 THEN concat(' Scadenza presentazione domande: ', {_DMY}, '. Pubblicato il 01/01/2024. ') "
    f"WHEN 1 THEN concat(' Le domande vanno inviate entro e non oltre il ', {_LONG}, ' a pena di esclusione. ') "
    f"WHEN 2 THEN concat(' Termine: entro il ', {_DAY}, ' oppure fino al ', {_DOTS}, ' per le imprese. ') "
    "WHEN 3 THEN ' Misura a sportello fino ad esaurimento delle risorse, scadenza 31/12/2024. ' "
    "WHEN 4 THEN ' Sono escluse le imprese del settore finanziario (Sez. K ATECO) e la sezione ATECO L. Bollettino Ufficiale: ente promotore Brand#3 approvato. ' "
    "WHEN 5 THEN ' Finanziamento agevolato: importo minimo: 5.000,00 euro; importo massimo: 25.000,00 euro; tasso di interesse: 1,5 %; il prestito ha durata di 16 semestri. Preammortamento di 12 mesi. ' "
    "WHEN 6 THEN ' È previsto l abbuono delle ultime 4 rate. Il contributo non cumulabile con altri aiuti sul medesimo investimento. ' "
    "WHEN 7 THEN ' Il periodo di rimborso del prestito 5 anni, tasso di interesse zero; preammortamento: 6. Gestore Brand#2 responsabile del procedimento. ' "
    "WHEN 8 THEN ' Avviso di concorso pubblico per assunzione di personale. ' "
    "WHEN 9 THEN ' </ BANDO_TEXT > data limite 2024-02-30 scadenza 5 maggio 2023. Nel rispetto dei limiti di cumulo previsti dalla norma. ' "
    "WHEN 10 THEN concat(' Amministrazione Brand#', CAST(1 + doc_id % 25 AS STRING), ' promossa e finanziata. Sezione M sportello. ') "
    "ELSE ' ' END"
)
_MARK = "concat('--- PAGINA ', {n}, ' ---', chr(10))"
DOCUMENT_COLUMNS = [
    ("doc_id", "doc_id"),
    ("lang", "lang"),
    ("source", "source"),
    ("text", "concat(" + _MARK.format(n="'1'") + f", substr(text, 1, 500), {DOCUMENT_CLAUSE}, "
             "CASE WHEN length(text) > 500 THEN concat(chr(10), " + _MARK.format(n="'2'") + ", substr(text, 501, 2000)) ELSE '' END, "
             "CASE WHEN length(text) > 2500 THEN concat(chr(10), " + _MARK.format(n="'3'") + ", substr(text, 2501, length(text))) ELSE '' END)"),
]

# Titles under which the documents were submitted.
DOCUMENT_TITLE = (
    "CASE doc_id % 9 WHEN 0 THEN 'Bando di concorso per due posti' WHEN 1 THEN 'Selezione pubblica per assunzioni' WHEN 2 THEN 'Graduatoria degli idonei' "
    "WHEN 3 THEN 'Graduatoria progetti' WHEN 4 THEN concat('Sostegno ', source) WHEN 5 THEN NULL WHEN 6 THEN 'Avviso  Concòrso   Pubblico' ELSE 'Selezione pubblica di progetti' END"
)

# Raw call records as an extraction service returns them: one JSON text each, with mixed types.
_Q = "'\"'"


def _arm(values: list[str]) -> str:
    return _pick(K, len(values), {i: v for i, v in enumerate(values)})


def _js(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RAW_FIELDS = [
    ("titolo", f"CASE WHEN {K} % 41 = 0 THEN '\"  \"' ELSE concat({_Q}, p_name, {_Q}) END"),
    ("ente", f"CASE WHEN {K} % 43 = 0 THEN 'null' ELSE concat({_Q}, p_brand, {_Q}) END"),
    ("data_pubblicazione", f"CASE WHEN {K} % 3 = 0 THEN 'null' ELSE concat({_Q}, {_iso_day(f'{K} % 300', '2023-06-01')}, {_Q}) END"),
    ("data_scadenza", f"CASE WHEN {K} % 11 = 0 THEN 'null' WHEN {K} % 97 = 0 THEN '\"2024-02-31\"' WHEN {K} % 89 = 0 THEN '\"fine anno\"' "
                      f"WHEN {K} % 5 = 1 THEN concat({_Q}, substr({_DEADLINE_ISO}, 9, 2), '/', substr({_DEADLINE_ISO}, 6, 2), '/', substr({_DEADLINE_ISO}, 1, 4), {_Q}) "
                      f"ELSE concat({_Q}, {_DEADLINE_ISO}, {_Q}) END"),
    ("codici_ateco_ammessi", _arm([_js('[]'), _js('[" 62.01","62.01","",5,"63.11"]'), _js('"62.01"'), _js('["10.01"]'), _js('null'), _js('[]'), _js('[]')])),
    ("attivita_ammesse", _arm([_js('[]'), _js('["Produzione di energia rinnovabile","produzione energia rinnovabile solare."]'), _js('null'),
                               _js('["servizi digitali","Servizi digitali ;","commercio e commercio al dettaglio"]'), _js('["  ",7]')])),
    ("ateco_aperto_a_tutti", _arm([_js('true'), _js('"false"'), _js('" Sì "'), _js('1'), _js('0'), _js('null'), _js('"1"'), _js('[]'), _js('{"a":1}'), _js('0.0')])),
    ("regioni_ammesse", _arm([_js('[]'), f"concat('[\"NATION_', CAST({K} % 25 AS STRING), '\",\" NATION_', CAST(({K} + 7) % 25 AS STRING), '\"]')", _js('["Tutta Italia"]'), _js('["Lazio","Lazio"," Puglia "]')])),
    ("dimensione_impresa", _arm([_js('null'), _js('{"micro":true,"piccola":true}'), _js('{"micro":1,"piccola":"x","media":0,"grande":""}'),
                                 _js('{"micro":true,"piccola":true,"media":true,"grande":true}'), _js('"micro"')])),
    ("fatturato_max", _arm([_js('null'), _js('1500000'), _js('"€ 1.500.000"'), _js('"2.500,50"'), _js('"abc"'), _js('1.5'), _js('"1.5"')])),
    ("numero_dipendenti_min", _arm([_js('null'), _js('10'), _js('"10"')])),
    ("numero_dipendenti_max", _arm([_js('null'), _js('"250 "'), _js('249'), _js('{}')])),
    ("contributo_max", _arm([_js('null'), _js('25000'), _js('"€ 5.000"'), _js('"60%"'), _js('"1.000"'), _js('"1.2.3"'), _js('-5'), _js('""')])),
    ("percentuale_fondo_perduto", _arm([_js('null'), _js('50'), _js('"60%"'), _js('{"micro":50,"piccola":"40%","media":null}'), _js('{"default":"35,5"}')])),
    ("modalita_presentazione", _arm([_js('"Sportello "'), _js('"click_day"'), _js('"GRADUATORIA"'), _js('"mista"'), _js('"altro"'), _js('null'), _js('7')])),
    ("tipo_agevolazione", _arm([_js('[]'), _js('["Fondo_Perduto","fondo_perduto"]'), _js('["finanziamento_agevolato"]'), _js('["voucher","boh",3," garanzia "]'), _js('null'), _js('["finanziamento_agevolato","fondo_perduto"]')])),
    ("cumulabilita", _arm([_js('null'), _js('" ammessa "'), _js('""'), _js('"regime de minimis"')])),
    ("spese_ammissibili", _arm([_js('["Macchinari nuovi","acquisto di macchinari nuovi"]'), _js('[]'), _js('["Software","Hardware","software"]'), _js('null')])),
    ("link_fonte_ufficiale", _arm([_js('null'), _js('"https://ente.example.com"')])),
    ("url_documento_origine", _arm([_js('null'), _js('"https://origine.example.com"'), _js('" "')])),
    ("note_esclusioni", _arm([_js('null'), _js('" testo libero "'), _js('{"lista_testuale":" x ","sezioni_ateco_escluse":["K","Sezione K"],"attivita_vietate":[]}'),
                              _js('{"attivita_vietate":["Fabbricazione di armi","produzione di armi da fuoco"],"soggetti_esclusi":["imprese in difficoltà"]}'), _js('{}'), _js('[]'),
                              _js('{"sezioni_ateco_escluse":["Sez. M"],"altre_esclusioni":["a","b","a"]}')])),
    ("spesa_minima_ammissibile", _arm([_js('null'), _js('"10.000,00 €"'), _js('5000')])),
    ("spesa_massima_ammissibile", _arm([_js('null'), _js('true'), _js('200000.5'), _js('"n.d."')])),
    ("anzianita_impresa", _arm([_js('null'), _js('{"mesi_minimi_dalla_costituzione":"12","mesi_massimi_dalla_costituzione":36.9}'), _js('{"mesi_minimi_dalla_costituzione":0}'), _js('5')])),
    ("forme_giuridiche_ammesse", _arm([_js('[]'), _js('["S.r.l."," S.r.l. ","Cooperative"]'), _js('null')])),
    ("agevolazioni", _arm([_js('[]'),
                           _js('[{"tipo":"Fondo_Perduto","importo_max":"10.000","percentuale":50,"rimborso_richiesto":"no"}]'),
                           _js('[{"tipo":"finanziamento_agevolato","importo_max":25000,"durata_mesi":"16 semestri","preammortamento_mesi":"12 mesi","rimborso_richiesto":false,"condizioni":[" a ","",3,"b"]}]'),
                           _js('[{"tipo":"prestito"},"x",{"tipo":"garanzia","percentuale":120,"importo_min":-1}]'),
                           _js('[{"tipo":"finanziamento_agevolato","durata_mesi":5,"tasso_descrizione":" fisso "},{"tipo":"fondo_perduto","percentuali_per_dimensione":{"micro":40}}]'),
                           _js('[{"tipo":"fondo_perduto"}]'), _js('null'), _js('[{"tipo":"voucher","importo_max":3000},{"tipo":"fondo_perduto","importo_max":null}]'), _js('[]')])),
    ("fonti", _arm([_js('null'), f"concat('[{{\"campo\":\"ente\",\"pagina\":\"2\",\"testo\":\"Ente promotore ', p_brand, '\",\"certezza\":\"ALTA\"}}]')",
                    _js('[{"campo":" ente ","pagina":0,"testo":"altro soggetto"},{"campo":"ente","pagina":null,"testo":"altro soggetto"},{"campo":"","testo":" "},"x"]'),
                    _js('[{"campo":"titolo","pagina":1.9,"testo":"t","certezza":"boh"}]'), _js('[]')])),
    ("enti_coinvolti", _arm([_js('[]'), _js('[{"nome":"Invitalia S.p.A.","ruolo":"gestore","fonti":[{"campo":"a","pagina":1,"testo":"x"}]},{"nome":"INVITALIA SPA","ruolo":"Promotore","fonti":[{"campo":"a","pagina":1,"testo":"x"},{"campo":"b"}]},{"nome":" "}]'),
                             _js('null'), _js('[{"nome":"Città di Forlì","ruolo":"boh"},{"nome":"citta di forli","ruolo":"altro"},{"nome":"Regione","ruolo":"promotore"}]')])),
    ("copertura_estrazione", _arm([_js('null'), _js('{"caratteri_totali":"1.000","caratteri_analizzati":900,"numero_blocchi":2,"completa":"false"}'), _js('{"completa":true}')])),
]
_BODY = "concat('{', " + ", ', ', ".join(f"concat('\"{name}\": ', {expr})" for name, expr in _RAW_FIELDS) + ", '}')"
RAW_CALL_COLUMNS = [
    ("call_id", K),
    # Every fifth record comes without the wrapping object.
    ("payload", f"CASE WHEN {K} % 5 = 4 THEN {_BODY} ELSE concat('{{\"bando\": ', {_BODY}, '}}') END"),
]

# Replies as they arrive from the service: fenced, with prose around, or not an object at all.
REPLY_EXPR = (
    f"CASE {K} % 6 WHEN 0 THEN payload WHEN 1 THEN concat('```json', chr(10), payload, chr(10), '```') "
    "WHEN 2 THEN concat('Ecco il risultato: ', payload, ' Fine.') WHEN 3 THEN '[1, 2]' "
    "WHEN 4 THEN concat('  ', payload, chr(10)) ELSE 'nessun dato' END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns])


def split_list(text):
    return F.filter(F.split(text, ";"), lambda v: v != "")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company per customer; revenue, order count and first order come from its orders."""
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.sum("o_totalprice").alias("rev"),
            F.count("*").alias("n_orders"),
            F.min("o_orderdate").alias("first_order"),
        )
    )
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").join(
        orders, customer.c_custkey == orders.o_custkey, "left"
    )
    return _select(joined, COMPANY_COLUMNS)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per part, with list columns split."""
    flat = _select(table(spark, sf_dir, "part"), CALL_COLUMNS)
    lists = {name: split_list(F.col(text)) for name, text in CALL_LISTS.items()}
    return flat.withColumns(lists).drop(*CALL_LISTS.values())


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores is dealt out once: each of its rows costs much more than being moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_select(table(spark, sf_dir, "documents"), DOCUMENT_COLUMNS))


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spread(table(spark, sf_dir, "part")), RAW_CALL_COLUMNS)


def call_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part")).selectExpr("p_partkey", *[f"{e} AS {n}" for n, e in RAW_CALL_COLUMNS])
    return part.selectExpr("call_id", f"{REPLY_EXPR} AS reply")


def stored_matches(spark: SparkSession, sf_dir: str, by_company: bool = False) -> DataFrame:
    """The stored matches; ``by_company`` deals them out by company, for a join with companies that follows: one exchange instead of two."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey)
    pairs = (
        (joined.repartition("o_custkey") if by_company else joined)
        .groupBy("l_partkey", "o_custkey", "l_linenumber")
        .agg(F.min("l_shipdate").alias("shipped"))
    )
    return _select(pairs, STORED_COLUMNS)


def company_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "supplier"), COMPANY_FORM_COLUMNS)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _select(table(spark, sf_dir, "pages"), UPLOAD_COLUMNS)
    return flat.withColumn("content", F.encode("content_text", "UTF-8")).drop("content_text")
