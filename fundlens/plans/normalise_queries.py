"""Queries on raw call records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists as L, refdata as R, variants as V
from ..operators import normalise as O, validate
from ..sources import tables as T
from . import oracle_base as B
from .registry import query


def opened(spark, sf):
    return O.open_record(T.raw_calls(spark, sf))


def record(spark, sf):
    return O.normalise(T.raw_calls(spark, sf)).drop("payload")


def q(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- SQL for loosely typed values; v is a JSON expression ---
def s_text(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN {v} ->> '$' END"


def s_trim(v: str) -> str:
    return f"nullif(trim({s_text(v)}), '')"


def s_loose(t: str) -> str:
    s = f"regexp_replace(trim({t}), '[%€ ]', '', 'g')"
    dots = f"(length({s}) - length(replace({s}, '.', '')))"
    plain = (f"CASE WHEN contains({s}, ',') THEN replace(replace({s}, '.', ''), ',', '.') WHEN {dots} > 1 OR ({dots} = 1 AND length(split_part({s}, '.', 2)) = 3) "
             f"THEN replace({s}, '.', '') ELSE {s} END")
    return f"TRY_CAST({plain} AS DOUBLE)"


def s_num(v: str) -> str:
    return (f"CASE json_type({v}) WHEN 'VARCHAR' THEN {s_loose(f'({v} ->> ' + chr(39) + '$' + chr(39) + ')')} "
            f"WHEN 'BOOLEAN' THEN CASE WHEN {v} ->> '$' = 'true' THEN 1.0 ELSE 0.0 END "
            f"WHEN 'BIGINT' THEN CAST({v} ->> '$' AS DOUBLE) WHEN 'UBIGINT' THEN CAST({v} ->> '$' AS DOUBLE) WHEN 'DOUBLE' THEN CAST({v} ->> '$' AS DOUBLE) END")


def s_truthy(v: str) -> str:
    return (f"coalesce(CASE json_type({v}) WHEN 'VARCHAR' THEN {v} ->> '$' <> '' WHEN 'BOOLEAN' THEN {v} ->> '$' = 'true' WHEN 'ARRAY' THEN json_array_length({v}) > 0 "
            f"WHEN 'OBJECT' THEN len(json_keys({v})) > 0 WHEN 'NULL' THEN false ELSE TRY_CAST({v} ->> '$' AS DOUBLE) <> 0 END, false)")


def s_bool(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN lower(trim({v} ->> '$')) IN ('true', 'sì', 'si', 'yes', '1') ELSE {s_truthy(v)} END"


def s_nbool(v: str) -> str:
    return f"CASE WHEN {v} IS NULL OR json_type({v}) = 'NULL' OR (json_type({v}) = 'VARCHAR' AND {v} ->> '$' = '') THEN NULL ELSE {s_bool(v)} END"


def s_enum(v: str, allowed) -> str:
    w = f"lower(trim({s_text(v)}))"
    return f"CASE WHEN list_contains({q(allowed)}, {w}) THEN {w} END"


def s_items(v: str) -> str:
    return f"(CASE WHEN json_type({v}) = 'ARRAY' THEN CAST({v} AS JSON[]) ELSE CAST([] AS JSON[]) END)"


def s_distinct(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def s_texts(v: str) -> str:
    inner = f"list_filter(list_transform({s_items(v)}, lambda x: {s_trim('x')}), lambda x: x IS NOT NULL)"
    return s_distinct(inner)


def s_months(v: str) -> str:
    t = f"({v} ->> '$')"
    pat = "(?i)(\\d+(?:[.,]\\d+)?)\\s*(mesi?|trimestr[ei]|semestr[ei]|ann[oi])\\b"
    unit = f"CASE lower(regexp_extract({t}, '{pat}', 2)) " + " ".join(f"WHEN '{u}' THEN {m}" for u, m in R.UNIT_MONTHS) + " END"
    return (f"CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({t}, '{pat}') THEN {s_loose(f'regexp_extract({t}, ' + chr(39) + pat + chr(39) + ', 1)')} * {unit} ELSE {s_num(v)} END")


def s_get(key: str) -> str:
    return f"json_extract(j, '$.{key}')"


def raw(body: str) -> str:
    return f"WITH {B.RAW_CALLS} {body}"


def long(fields, expr: str, name: str) -> str:
    return raw(f"SELECT call_id, field, {expr} AS {name} FROM (SELECT call_id, f AS field, json_extract(j, '$.' || f) AS v FROM raw_calls, unnest({q(fields)}) t(f))")


@query("to_number", long(R.NUMERIC_FIELDS, s_num("v"), "number"))
def to_number(spark, sf):
    wide = opened(spark, sf).select("call_id", *[V.number(F.col(O.RAW + f)).alias(f) for f in R.NUMERIC_FIELDS])
    return wide.unpivot(["call_id"], list(R.NUMERIC_FIELDS), "field", "number")


_BOOL_FIELDS = ("ateco_aperto_a_tutti", "contributo_max", "cumulabilita", "fonti", "note_esclusioni")


@query("to_bool", raw(f"SELECT call_id, field, {s_bool('v')} AS flag, {s_nbool('v')} AS known_flag FROM (SELECT call_id, f AS field, json_extract(j, '$.' || f) AS v FROM raw_calls, unnest({q(_BOOL_FIELDS)}) t(f))"))
def to_bool(spark, sf):
    entries = F.array(*[
        F.struct(F.lit(f).alias("field"), V.boolean(F.col(O.RAW + f)).alias("flag"), V.nullable_boolean(F.col(O.RAW + f)).alias("known_flag"))
        for f in _BOOL_FIELDS])
    return opened(spark, sf).select("call_id", F.inline(entries))


@query("to_enum", raw(
    f"SELECT call_id, {s_enum(s_get('modalita_presentazione'), R.SUBMISSION_MODES)} AS mode, array_to_string("
    + s_distinct(f"list_filter(list_transform({s_items(s_get('tipo_agevolazione'))}, lambda x: {s_enum('x', R.AID_TYPES)}), lambda x: x IS NOT NULL)") + ", ',') AS types FROM raw_calls"))
def to_enum(spark, sf):
    return opened(spark, sf).select(
        "call_id", V.one_of(F.col("r_modalita_presentazione"), R.SUBMISSION_MODES).alias("mode"),
        F.array_join(V.some_of(F.col("r_tipo_agevolazione"), R.AID_TYPES), ",").alias("types"))


@query("duration_months", raw(
    f"SELECT call_id, position, {s_months('json_extract(x, ' + chr(39) + '$.durata_mesi' + chr(39) + ')')} AS duration, {s_months('json_extract(x, ' + chr(39) + '$.preammortamento_mesi' + chr(39) + ')')} AS grace "
    f"FROM (SELECT call_id, unnest({s_items(s_get('agevolazioni'))}) AS x, generate_subscripts({s_items(s_get('agevolazioni'))}, 1) AS position FROM raw_calls)").replace(" AS position FROM", " AS position FROM"))
def duration_months(spark, sf):
    rows = opened(spark, sf).select("call_id", F.posexplode(V.items(F.col("r_agevolazioni"))).alias("at", "x"))
    return rows.select(
        "call_id", (F.col("at") + 1).cast("bigint").alias("position"),
        V.months(V.part(F.col("x"), "durata_mesi")).alias("duration"), V.months(V.part(F.col("x"), "preammortamento_mesi")).alias("grace"))


def s_bands(v: str) -> dict[str, str]:
    out = {b: f"CASE WHEN json_type({v}) = 'OBJECT' THEN {s_num(f'json_extract({v}, ' + chr(39) + '$.' + b + chr(39) + ')')} END" for b in R.PERCENT_BANDS}
    out["default"] = f"CASE WHEN json_type({v}) = 'OBJECT' THEN {s_num(f'json_extract({v}, ' + chr(39) + '$.default' + chr(39) + ')')} ELSE {s_num(v)} END"
    return out


_BANDS = s_bands(s_get("percentuale_fondo_perduto"))


@query("pct_by_size", raw("SELECT call_id, " + ", ".join(f"{e} AS pct_{b}" for b, e in _BANDS.items()) + " FROM raw_calls"))
def pct_by_size(spark, sf):
    bands = V.percent_bands(F.col("r_percentuale_fondo_perduto"))
    return opened(spark, sf).select("call_id", bands.alias("b")).select("call_id", *[F.col(f"b.{b}").alias(f"pct_{b}") for b in R.PERCENT_BANDS])


def _s_source(x: str) -> str:
    g = lambda k: f"json_extract({x}, '$.{k}')"
    page = s_num(g("pagina"))
    return (f"{s_trim(g('campo'))} AS campo, CASE WHEN {page} >= 1 THEN CAST(trunc({page}) AS INT) END AS pagina, {s_trim(g('testo'))} AS testo, {s_enum(g('certezza'), R.CERTAINTY)} AS certezza")


@query("normalise_sources", raw(
    f"SELECT call_id, campo, pagina, testo, certezza FROM (SELECT *, row_number() OVER (PARTITION BY call_id, campo, pagina, testo ORDER BY pos) AS r FROM (SELECT call_id, pos, {_s_source('x')} "
    f"FROM (SELECT call_id, unnest({s_items(s_get('fonti'))}) AS x, generate_subscripts({s_items(s_get('fonti'))}, 1) AS pos FROM raw_calls) WHERE json_type(x) = 'OBJECT') WHERE campo IS NOT NULL OR testo IS NOT NULL) WHERE r = 1"))
def normalise_sources(spark, sf):
    return opened(spark, sf).select("call_id", F.inline(O.sources(V.items(F.col("r_fonti")))))


def _instruments_sql() -> str:
    g = lambda k: f"json_extract(x, '$.{k}')"
    nums = ", ".join(f"{(s_months if n in ('durata_mesi', 'preammortamento_mesi') else s_num)(g(n))} AS {n}" for n in R.INSTRUMENT_NUMBERS)
    bands = ", ".join(f"{e} AS pct_{b}" for b, e in s_bands(g("percentuali_per_dimensione")).items())
    return (f"aid AS MATERIALIZED (SELECT * FROM (SELECT call_id, pos, {s_enum(g('tipo'), R.AID_TYPES)} AS tipo, {nums}, {bands}, {s_nbool(g('rimborso_richiesto'))} AS rimborso_richiesto, "
            f"{s_trim(g('tasso_descrizione'))} AS tasso_descrizione, {s_trim(g('descrizione'))} AS descrizione, "
            f"array_to_string(list_filter(list_transform({s_items(g('condizioni'))}, lambda c: {s_trim('c')}), lambda c: c IS NOT NULL), '|') AS condizioni "
            f"FROM (SELECT call_id, unnest({s_items(s_get('agevolazioni'))}) AS x, generate_subscripts({s_items(s_get('agevolazioni'))}, 1) AS pos FROM raw_calls) WHERE json_type(x) = 'OBJECT') WHERE tipo IS NOT NULL)")


AID_SQL = _instruments_sql()
_AID_COLUMNS = "tipo, " + ", ".join(R.INSTRUMENT_NUMBERS) + ", " + ", ".join(f"pct_{b}" for b in R.PERCENT_BANDS) + ", rimborso_richiesto, tasso_descrizione, descrizione, condizioni"


@query("normalise_instruments", f"WITH {B.RAW_CALLS}, {AID_SQL} SELECT call_id, {_AID_COLUMNS} FROM aid")
def normalise_instruments(spark, sf):
    rows = opened(spark, sf).select("call_id", F.explode(O.instruments(F.col("r_agevolazioni"))).alias("a"))
    return rows.select(
        "call_id", "a.tipo", *[F.col(f"a.{n}") for n in R.INSTRUMENT_NUMBERS],
        *[F.col(f"a.percentuali_per_dimensione.{b}").alias(f"pct_{b}") for b in R.PERCENT_BANDS],
        "a.rimborso_richiesto", "a.tasso_descrizione", "a.descrizione", F.array_join("a.condizioni", "|").alias("condizioni"))


# The normalised record in SQL: CTE "rec", one flat row per call.
_g = s_get
_note = _g("note_esclusioni")


def _s_note_list(name: str) -> str:
    return s_texts(f"json_extract({_note}, '$.{name}')")


_REC_COLUMNS = {
    "titolo": s_text(_g("titolo")),
    "ente": s_text(_g("ente")),
    "data_pubblicazione": s_text(_g("data_pubblicazione")),
    "data_scadenza": s_text(_g("data_scadenza")),
    "codici": f"array_to_string({s_texts(_g('codici_ateco_ammessi'))}, '|')",
    "has_activities": f"len({s_texts(_g('attivita_ammesse'))}) > 0",
    "open0": s_bool(_g("ateco_aperto_a_tutti")),
    "regioni": f"array_to_string({s_texts(_g('regioni_ammesse'))}, '|')",
    "dimensioni": "array_to_string(list_filter(['micro', 'piccola', 'media', 'grande'], lambda s: json_type(j, '$.dimensione_impresa') = 'OBJECT' AND "
                  + s_truthy("json_extract(j, '$.dimensione_impresa.' || s)") + "), '|')",
    **{f"{f}0" if f == "contributo_max" else f: s_num(_g(f)) for f in R.NUMERIC_FIELDS},
    **{f"pct0_{b}": e for b, e in _BANDS.items()},
    "modalita": s_enum(_g("modalita_presentazione"), R.SUBMISSION_MODES),
    "tipi0": s_distinct(f"list_filter(list_transform({s_items(_g('tipo_agevolazione'))}, lambda x: {s_enum('x', R.AID_TYPES)}), lambda x: x IS NOT NULL)"),
    "cumulabilita": s_trim(_g("cumulabilita")),
    "has_expenses": f"len({s_texts(_g('spese_ammissibili'))}) > 0",
    "link": s_text(_g("link_fonte_ufficiale")),
    "url": s_text(_g("url_documento_origine")),
    "note_text": s_trim(_note),
    "note_is_object": f"coalesce(json_type({_note}) = 'OBJECT', false)",
    "note_list_text": f"CASE WHEN json_type({_note}) = 'OBJECT' THEN {s_trim('json_extract(' + _note + ', ' + chr(39) + '$.lista_testuale' + chr(39) + ')')} END",
    **{f"has_{n}": f"coalesce(json_type({_note}) = 'OBJECT' AND len({_s_note_list(n)}) > 0, false)" for n in R.NOTE_LISTS},
    "eta_min": "CAST(trunc(CASE WHEN json_type(j, '$.anzianita_impresa') = 'OBJECT' THEN " + s_num("json_extract(j, '$.anzianita_impresa.mesi_minimi_dalla_costituzione')") + " END) AS INT)",
    "eta_max": "CAST(trunc(CASE WHEN json_type(j, '$.anzianita_impresa') = 'OBJECT' THEN " + s_num("json_extract(j, '$.anzianita_impresa.mesi_massimi_dalla_costituzione')") + " END) AS INT)",
    "forme": f"array_to_string({s_texts(_g('forme_giuridiche_ammesse'))}, '|')",
    "coverage_total": "CAST(trunc(" + s_num("json_extract(j, '$.copertura_estrazione.caratteri_totali')") + ") AS INT)",
    "coverage_read": "CAST(trunc(" + s_num("json_extract(j, '$.copertura_estrazione.caratteri_analizzati')") + ") AS INT)",
    "coverage_blocks": "CAST(trunc(" + s_num("json_extract(j, '$.copertura_estrazione.numero_blocchi')") + ") AS INT)",
    "coverage_complete": s_nbool("json_extract(j, '$.copertura_estrazione.completa')"),
}
_NR = "('fondo_perduto', 'voucher', 'credito_imposta')"
REC_SQL = (
    AID_SQL + ", flat AS MATERIALIZED (SELECT call_id, j, " + ", ".join(f"{e} AS {n}" for n, e in _REC_COLUMNS.items()) + " FROM raw_calls), "
    f"aid_sum AS (SELECT call_id, count(*) AS n_aid, count(*) FILTER (tipo IN {_NR}) AS n_grants, count(importo_max) FILTER (tipo IN {_NR}) AS n_amounts, "
    f"max(importo_max) FILTER (tipo IN {_NR}) AS amount, list(tipo ORDER BY pos) AS aid_types, max(percentuale) FILTER (tipo IN {_NR}) AS g_pct, "
    + ", ".join(f"max(pct_{b}) FILTER (tipo IN {_NR}) AS g_{b}" for b in R.PERCENT_BANDS)
    + " FROM aid GROUP BY 1), merged_rec AS (SELECT f.*, coalesce(n_aid, 0) AS n_aid, n_grants, n_amounts, amount, aid_types, g_pct, "
    + ", ".join(f"g_{b}" for b in R.PERCENT_BANDS)
    + ", coalesce(n_aid, 0) > 0 AND n_grants = 0 AS loans_only, coalesce(n_aid, 0) > 0 AND n_grants = 1 AND "
    + " AND ".join(f"pct0_{b} IS NULL" for b in R.PERCENT_BANDS)
    + " AS fill, " + " OR ".join(f"g_{b} IS NOT NULL" for b in R.PERCENT_BANDS) + " AS g_banded FROM flat f LEFT JOIN aid_sum USING (call_id)), "
    "rec AS MATERIALIZED (SELECT *, open0 AND NOT has_sezioni_ateco_escluse AND NOT has_attivita_vietate AS aperto, "
    "CASE WHEN n_aid > 0 THEN " + s_distinct("aid_types") + " ELSE tipi0 END AS tipi, "
    "CASE WHEN loans_only THEN NULL ELSE coalesce(contributo_max0, CASE WHEN n_amounts = 1 THEN amount END) END AS contributo_max, "
    + ", ".join(
        f"CASE WHEN loans_only THEN NULL WHEN fill AND g_banded THEN g_{b} WHEN fill AND g_pct IS NOT NULL THEN {'g_pct' if b == 'default' else 'NULL'} ELSE pct0_{b} END AS pct_{b}"
        for b in R.PERCENT_BANDS)
    + " FROM merged_rec)"
)


def with_rec(body: str, extra: str = "") -> str:
    return f"WITH {B.RAW_CALLS}, {REC_SQL}{extra} {body}"


@query("reconcile_legacy", with_rec(
    "SELECT call_id, array_to_string(tipi, '|') AS types, contributo_max, " + ", ".join(f"pct_{b}" for b in R.PERCENT_BANDS) + " FROM rec"))
def reconcile_legacy(spark, sf):
    return record(spark, sf).select(
        "call_id", F.array_join("tipo_agevolazione", "|").alias("types"), "contributo_max",
        *[F.col(f"percentuale_fondo_perduto.{b}").alias(f"pct_{b}") for b in R.PERCENT_BANDS])


@query("normalise_calls", with_rec(
    "SELECT call_id, titolo, ente, data_pubblicazione, data_scadenza, codici, aperto, regioni, dimensioni, " + ", ".join(f for f in R.NUMERIC_FIELDS)
    + ", modalita, array_to_string(tipi, '|') AS tipi, cumulabilita, link, url, note_text, note_list_text, eta_min, eta_max, forme, has_activities, has_expenses, "
    + ", ".join(f"has_{n}" for n in R.NOTE_LISTS) + ", CAST(n_aid AS BIGINT) AS n_aid, coverage_total, coverage_read, coverage_blocks, coverage_complete FROM rec"))
def normalise_calls(spark, sf):
    size, note = F.col("dimensione_impresa"), F.col("note_esclusioni")
    return record(spark, sf).select(
        "call_id", "titolo", "ente", "data_pubblicazione", "data_scadenza", F.array_join("codici_ateco_ammessi", "|").alias("codici"),
        F.col("ateco_aperto_a_tutti").alias("aperto"), F.array_join("regioni_ammesse", "|").alias("regioni"),
        F.array_join(F.array(*[F.when(size[s], F.lit(s)) for s in R.SIZES]), "|").alias("dimensioni"), *R.NUMERIC_FIELDS,
        F.col("modalita_presentazione").alias("modalita"), F.array_join("tipo_agevolazione", "|").alias("tipi"), "cumulabilita",
        F.col("link_fonte_ufficiale").alias("link"), F.col("url_documento_origine").alias("url"), "note_text", note["lista_testuale"].alias("note_list_text"),
        F.col("anzianita_impresa.mesi_minimi_dalla_costituzione").alias("eta_min"), F.col("anzianita_impresa.mesi_massimi_dalla_costituzione").alias("eta_max"),
        F.array_join("forme_giuridiche_ammesse", "|").alias("forme"), (F.size("attivita_ammesse") > 0).alias("has_activities"), (F.size("spese_ammissibili") > 0).alias("has_expenses"),
        *[F.coalesce(F.size(note[n]) > 0, F.lit(False)).alias(f"has_{n}") for n in R.NOTE_LISTS], F.size("agevolazioni").cast("bigint").alias("n_aid"),
        F.col("copertura_estrazione.caratteri_totali").alias("coverage_total"), F.col("copertura_estrazione.caratteri_analizzati").alias("coverage_read"),
        F.col("copertura_estrazione.numero_blocchi").alias("coverage_blocks"), F.col("copertura_estrazione.completa").alias("coverage_complete"))


@query("entity_merge", raw(
    "SELECT call_id, arg_max(nome, prio * 1000 - pos) AS nome, arg_max(ruolo, prio * 1000 - pos) AS ruolo, CAST(count(DISTINCT sig) AS INT) AS sources FROM "
    f"(SELECT call_id, pos, nome, coalesce(ruolo, '') AS ruolo, regexp_replace(strip_accents(lower(nome)), '[^a-z0-9]', '', 'g') AS name_key, "
    "CASE ruolo " + " ".join(f"WHEN '{r}' THEN {p}" for r, p in R.ROLE_PRIORITY) + " ELSE 0 END AS prio, unnest(CASE WHEN len(src) = 0 THEN [NULL] ELSE src END) AS sig FROM "
    f"(SELECT call_id, pos, {s_trim('json_extract(x, ' + chr(39) + '$.nome' + chr(39) + ')')} AS nome, {s_enum('json_extract(x, ' + chr(39) + '$.ruolo' + chr(39) + ')', R.ENTITY_ROLES)} AS ruolo, "
    "list_transform(" + s_items("json_extract(x, '$.fonti')") + ", lambda s: concat_ws('/', s ->> '$.campo', s ->> '$.pagina', s ->> '$.testo')) AS src "
    f"FROM (SELECT call_id, unnest({s_items(_g('enti_coinvolti'))}) AS x, generate_subscripts({s_items(_g('enti_coinvolti'))}, 1) AS pos FROM raw_calls)) WHERE nome IS NOT NULL) GROUP BY call_id, name_key"))
def entity_merge(spark, sf):
    rows = record(spark, sf).select("call_id", F.inline_outer("enti_coinvolti")).filter("nome IS NOT NULL")
    return rows.select("call_id", "nome", F.coalesce("ruolo", F.lit("")).alias("ruolo"), F.size("fonti").alias("sources"))


@query("phrase_dedup")
def phrase_dedup(spark, sf):
    """Merged phrases of each record's phrase lists; greedy and order-dependent, so no check SQL."""
    note = F.col("note_esclusioni")
    named = {"attivita_ammesse": F.col("attivita_ammesse"), "spese_ammissibili": F.col("spese_ammissibili"), **{n: note[n] for n in R.NOTE_LISTS}}
    entries = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("phrases")) for n, c in named.items()])
    lists = record(spark, sf).select("call_id", F.inline(entries))
    return lists.select("call_id", "field", F.posexplode("phrases").alias("position", "phrase"))


_S_BODY = "trim(regexp_replace(trim(reply, chr(10) || ' '), '^```[^\\n]*\\n|\\n```[^\\n]*$', '', 'g'), chr(10) || ' ')"
_S_TEXT = f"CASE WHEN starts_with({_S_BODY}, '{{') THEN {_S_BODY} ELSE regexp_extract({_S_BODY}, '(?s)\\{{.*\\}}') END"


@query("json_reply_clean", "WITH replies AS (SELECT call_id, " + T.REPLY_EXPR + " AS reply FROM (SELECT p_partkey, " + B._columns(T.RAW_CALL_COLUMNS) + " FROM part)) "
       f"SELECT call_id, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN t END AS json_text FROM (SELECT call_id, {_S_TEXT} AS t FROM replies)")
def json_reply_clean(spark, sf):
    return T.call_replies(spark, sf).select("call_id", O.clean_reply(F.col("reply")).alias("json_text"))


@query("provenance_override", with_rec(
    "SELECT rec.call_id, CASE WHEN p.page_id IS NULL THEN link END AS link, coalesce(p.url, rec.url) AS url FROM rec LEFT JOIN pages p ON p.page_id = rec.call_id"))
def provenance_override(spark, sf):
    """Origin of records, where a page of the same id stands for the address that a call was fetched from."""
    fetched = T.table(spark, sf, "pages").select(F.col("page_id").alias("call_id"), F.col("url").alias("address"))
    done = validate.override_provenance(record(spark, sf).select("call_id", "link_fonte_ufficiale", "url_documento_origine"), fetched)
    return done.select("call_id", F.col("link_fonte_ufficiale").alias("link"), F.col("url_documento_origine").alias("url"))
