"""Queries on documents, chunks, sources, sheets and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF as AS_OF
from ..functions import labels as LB, numbers as N, refdata as R, text as X
from ..operators import admission, chunks, sheet
from ..sources import readers, tables as T
from . import normalise_queries as NQ, oracle_base as B
from .registry import query

CHUNK, OVERLAP = 2000, 200

_CHUNKS = (
    f"WITH RECURSIVE {B.DOCUMENTS}, ch AS (SELECT doc_id, 0 AS chunk, 0 AS start, {{cut0}} AS stop, length(text) AS total FROM docs UNION ALL "
    "SELECT c.doc_id, chunk + 1, ns, {cut}, total FROM (SELECT *, CASE WHEN stop - 200 > start THEN stop - 200 ELSE stop END AS ns FROM ch WHERE stop < total) c JOIN docs ON docs.doc_id = c.doc_id)"
)


def _cut(start: str) -> str:
    window = f"substr(text, {start} + 1001, 1000)"
    return (f"CASE WHEN {start} + 2000 >= length(text) THEN length(text) WHEN strpos({window}, chr(10)) > 0 THEN {start} + 1000 + length({window}) - strpos(reverse({window}), chr(10)) ELSE {start} + 2000 END")


_CHUNKS = _CHUNKS.format(cut0=_cut("0"), cut=_cut("ns"))


@query("chunk_documents", f"{_CHUNKS} SELECT ch.doc_id, CAST(chunk AS INT) AS chunk, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, md5(substr(text, start + 1, stop - start)) AS digest FROM ch JOIN docs ON docs.doc_id = ch.doc_id")
def chunk_documents(spark, sf):
    return chunks.split(T.documents(spark, sf), "doc_id", "text", CHUNK, OVERLAP).select("doc_id", "chunk", "start", "stop", F.md5("text").alias("digest"))


@query("coverage", f"{_CHUNKS} SELECT doc_id, CAST(max(total) AS INT) AS total_chars, CAST(max(stop) AS INT) AS read_chars, CAST(count(*) AS BIGINT) AS blocks, max(stop) = max(total) AS complete FROM ch GROUP BY doc_id")
def coverage(spark, sf):
    docs = T.documents(spark, sf)
    return chunks.coverage(docs, chunks.bounds(docs, "doc_id", "text", CHUNK, OVERLAP), "doc_id", "text")


def partials(spark, sf):
    """Three consecutive records stand for the chunks of one document."""
    record = NQ.record(spark, sf)
    return record.withColumns({"doc_id": F.floor(F.col("call_id") / 3).cast("bigint"), "chunk": (F.col("call_id") % 3).cast("int")})


def _first(c: str, filled: str = "") -> str:
    return f"arg_min({c}, call_id) FILTER ({filled or c + ' IS NOT NULL'})"


def _union(c: str) -> str:
    flat = f"string_split(string_agg({c}, '|' ORDER BY call_id) FILTER ({c} <> ''), '|')"
    return f"array_to_string(list_filter({flat}, lambda x, i: list_position({flat}, x) = i), '|')"


_NR = "('fondo_perduto', 'voucher', 'credito_imposta')"
_PARTIALS = (
    ", p AS MATERIALIZED (SELECT *, call_id // 3 AS doc_id, array_to_string(tipi, '|') AS tipi_text FROM rec), "
    "pa AS (SELECT *, call_id // 3 AS doc_id FROM aid), "
    f"ma AS (SELECT doc_id, tipo, min(call_id * 100 + pos) AS place, arg_min(importo_max, call_id * 100 + pos) FILTER (importo_max IS NOT NULL) AS importo_max, arg_min(percentuale, call_id * 100 + pos) FILTER (percentuale IS NOT NULL) AS percentuale, "
    + ", ".join(f"arg_min(pct_{b}, call_id * 100 + pos) FILTER (pct_{b} IS NOT NULL) AS pct_{b}" for b in R.PERCENT_BANDS) + " FROM pa GROUP BY doc_id, tipo), "
    f"ms AS (SELECT doc_id, count(*) AS n_aid, count(*) FILTER (tipo IN {_NR}) AS n_grants, count(importo_max) FILTER (tipo IN {_NR}) AS n_amounts, max(importo_max) FILTER (tipo IN {_NR}) AS amount, "
    f"max(percentuale) FILTER (tipo IN {_NR}) AS g_pct, string_agg(tipo, '|' ORDER BY place) AS mtypes, " + ", ".join(f"max(pct_{b}) FILTER (tipo IN {_NR}) AS g_{b}" for b in R.PERCENT_BANDS) + " FROM ma GROUP BY 1), "
    "md AS (SELECT doc_id, " + ", ".join(f"{_first(c, c + ' IS NOT NULL AND ' + c + ' <> ' + chr(39) * 2)} AS {c}" for c in ("titolo", "ente", "data_pubblicazione", "modalita", "cumulabilita"))
    + ", max(data_scadenza) AS data_scadenza, " + ", ".join(f"{_first(c)} AS {c}" for c in R.NUMERIC_FIELDS) + ", " + ", ".join(f"{_first('pct_' + b)} AS pct_{b}" for b in R.PERCENT_BANDS)
    + ", arg_min(aperto, call_id) AS aperto0, arg_min(struct_pack(v := eta_min), call_id).v AS eta_min, arg_min(struct_pack(v := eta_max), call_id).v AS eta_max, "
    + ", ".join(f"bool_or(contains(dimensioni, '{s}')) AS d_{s}" for s in R.SIZES)
    + ", " + ", ".join(f"{_union(c)} AS {c}" for c in ("codici", "regioni", "forme", "tipi_text")) + ", bool_or(has_sezioni_ateco_escluse OR has_attivita_vietate) AS closed FROM p GROUP BY 1), "
    "mf AS (SELECT md.*, coalesce(n_aid, 0) AS n_aid, n_grants, n_amounts, amount, g_pct, mtypes, " + ", ".join(f"g_{b}" for b in R.PERCENT_BANDS)
    + ", coalesce(n_aid, 0) > 0 AND n_grants = 0 AS loans_only, coalesce(n_aid, 0) > 0 AND n_grants = 1 AND " + " AND ".join(f"pct_{b} IS NULL" for b in R.PERCENT_BANDS) + " AS fill, "
    + " OR ".join(f"g_{b} IS NOT NULL" for b in R.PERCENT_BANDS) + " AS banded FROM md LEFT JOIN ms USING (doc_id))"
)


@query("merge_partials", NQ.with_rec(
    "SELECT doc_id, titolo, ente, data_pubblicazione, data_scadenza, coalesce(codici, '') AS codici, coalesce(regioni, '') AS regioni, coalesce(forme, '') AS forme, modalita, cumulabilita, "
    "aperto0 AND NOT closed AS aperto, concat_ws('|', " + ", ".join(f"CASE WHEN d_{s} THEN '{s}' END" for s in R.SIZES) + ") AS dimensioni, fatturato_max, "
    "CASE WHEN loans_only THEN NULL ELSE coalesce(contributo_max, CASE WHEN n_amounts = 1 THEN amount END) END AS contributo_max, "
    + ", ".join(f"CASE WHEN loans_only THEN NULL WHEN fill AND banded THEN g_{b} WHEN fill AND g_pct IS NOT NULL THEN {'g_pct' if b == 'default' else 'NULL'} ELSE pct_{b} END AS pct_{b}" for b in R.PERCENT_BANDS)
    + ", eta_min, eta_max, coalesce(CASE WHEN n_aid > 0 THEN mtypes ELSE tipi_text END, '') AS tipi, CAST(n_aid AS BIGINT) AS n_aid FROM mf", _PARTIALS))
def merge_partials(spark, sf):
    size = F.col("dimensione_impresa")
    return chunks.merge_partials(partials(spark, sf), "doc_id").select(
        "doc_id", "titolo", "ente", "data_pubblicazione", "data_scadenza", F.array_join("codici_ateco_ammessi", "|").alias("codici"), F.array_join("regioni_ammesse", "|").alias("regioni"),
        F.array_join("forme_giuridiche_ammesse", "|").alias("forme"), F.col("modalita_presentazione").alias("modalita"), "cumulabilita", F.col("ateco_aperto_a_tutti").alias("aperto"),
        F.array_join(F.array(*[F.when(size[s], F.lit(s)) for s in R.SIZES]), "|").alias("dimensioni"), "fatturato_max", "contributo_max",
        *[F.col(f"percentuale_fondo_perduto.{b}").alias(f"pct_{b}") for b in R.PERCENT_BANDS],
        F.col("anzianita_impresa.mesi_minimi_dalla_costituzione").alias("eta_min"), F.col("anzianita_impresa.mesi_massimi_dalla_costituzione").alias("eta_max"),
        F.array_join("tipo_agevolazione", "|").alias("tipi"), F.size("agevolazioni").cast("bigint").alias("n_aid"))


# --- sources ---
def _html_sql() -> str:
    body = f"regexp_replace(regexp_replace(html, '{readers.DROPPED_BLOCKS}', ' ', 'g'), '{readers.TAGS}', ' ', 'g')"
    for entity, char in readers.ENTITIES:
        body = f"replace({body}, '{entity.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({body}, '\\s+', ' ', 'g'))"


@query("html_main_text", f"SELECT page_id, CASE WHEN length(t) >= 50 THEN t ELSE '' END AS text FROM (SELECT page_id, {_html_sql()} AS t FROM pages)")
def html_main_text(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", readers.html_text(F.col("html")).alias("text"))


@query("page_marked_text", "SELECT conv_id, string_agg(concat('--- PAGINA ', turn + 1, ' ---', chr(10), text), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def page_marked_text(spark, sf):
    pages = T.table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    return readers.page_marked(pages, "conv_id", "page", "text")


@query("document_byte_gate", f"WITH {B.UPLOADS} SELECT call_id, CASE WHEN octet_length(encode(content_text)) > 10000000 THEN 'too_large' WHEN starts_with(content_text, '%PDF') THEN 'ok' ELSE 'not_pdf' END AS verdict FROM uploads")
def document_byte_gate(spark, sf):
    return T.uploads(spark, sf).select("call_id", readers.byte_gate(F.col("content")).alias("verdict"))


_HOSTS = ("10.1.2.3", "192.168.7.1", "8.8.8.8", "169.254.169.254", "172.20.0.9", "172.40.0.9", "127.0.0.1", "93.184.216.34", "224.0.0.251")
_URL = ("CASE page_id % 12 " + " ".join(f"WHEN {i} THEN 'https://{h}/bando?id=1'" for i, h in enumerate(_HOSTS)) + " WHEN 9 THEN 'HTTPS://Ente.example.com/x' WHEN 10 THEN 'https:///senza-host' ELSE url END")
_CLOSED = " OR ".join(f"ip BETWEEN {lo} AND {lo + 2 ** (32 - n) - 1}" for lo, n in (
    (sum(int(x) * 256 ** (3 - i) for i, x in enumerate(net.split("."))), n) for net, n in R.CLOSED_NETWORKS))


@query("url_admissible", f"SELECT page_id, link, lower(regexp_extract(link, '^([A-Za-z]+)://', 1)) = 'https' AND host <> '' AND NOT coalesce({_CLOSED}, false) AS admissible FROM "
       "(SELECT *, CASE WHEN regexp_full_match(host, '\\d+\\.\\d+\\.\\d+\\.\\d+') THEN CAST(split_part(host, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(host, '.', 2) AS BIGINT) * 65536 + CAST(split_part(host, '.', 3) AS BIGINT) * 256 + CAST(split_part(host, '.', 4) AS BIGINT) END AS ip FROM "
       f"(SELECT page_id, link, regexp_extract(link, '^[A-Za-z]+://([^/?#:]*)', 1) AS host FROM (SELECT page_id, {_URL} AS link FROM pages)))")
def url_admissible(spark, sf):
    links = T.table(spark, sf, "pages").selectExpr("page_id", f"{_URL} AS link")
    return links.select("page_id", "link", readers.url_admissible(F.col("link")).alias("admissible"))


# --- labels and sheets ---
def _key(x: str) -> str:
    return B.form_key(f"trim({x})")


def _fallback(x: str) -> str:
    bare = f"regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' -–—,;.'), '(?i){R.FALLBACK_PREFIX_PATTERN}', '')"
    shown = f"concat(upper(substr({bare}, 1, 1)), substr({bare}, 2))"
    return f"CASE WHEN length({shown}) <= 90 THEN {shown} ELSE concat(rtrim(substr({shown}, 1, 89)), '…') END"


def _sql_any(key: str, needles) -> str:
    return "(" + " OR ".join(f"contains({key}, '{n}')" for n in needles) + ")"


def _q(label: str) -> str:
    return "'" + label.replace("'", "''") + "'"


_EXP_HITS = "list_filter([" + ", ".join(f"CASE WHEN {_sql_any('k', ns)} THEN {_q(label)} END" for label, ns in R.EXPENSE_RULES) + ", CASE WHEN regexp_matches(v, '(?i)\\biva\\b') THEN 'IVA' END], lambda h: h IS NOT NULL)"
_UMB = "k IN (" + ", ".join(f"'{u}'" for u in R.UMBRELLA_EXPENSES) + ")"
_DISTINCT_JOIN = "array_to_string(list_filter(flat, lambda x, i: list_position(flat, x) = i AND x <> ''), '|')"


@query("expense_labels", f"WITH {B.CALLS}, vals AS (SELECT call_id, pos, v, {_key('v')} AS k FROM (SELECT call_id, unnest(expenses) AS v, generate_subscripts(expenses, 1) AS pos FROM calls)), "
       f"hits AS (SELECT call_id, pos, v, k, {_EXP_HITS} AS h FROM vals), shown AS (SELECT call_id, coalesce(flatten(list(CASE WHEN len(h) > 0 THEN h WHEN {_UMB} THEN CAST([] AS VARCHAR[]) ELSE [{_fallback('v')}] END ORDER BY pos)), []) AS plain, "
       f"coalesce(flatten(list(CASE WHEN len(h) = 0 AND {_UMB} THEN [{_fallback('v')}] ELSE CAST([] AS VARCHAR[]) END ORDER BY pos)), []) AS umb FROM hits GROUP BY 1) "
       f"SELECT calls.call_id, coalesce({_DISTINCT_JOIN}, '') AS labels FROM calls LEFT JOIN (SELECT call_id, CASE WHEN len(plain) > 0 THEN plain ELSE umb END AS flat FROM shown) s ON s.call_id = calls.call_id")
def expense_labels(spark, sf):
    return T.calls(spark, sf).select("call_id", F.array_join(LB.expense_labels(F.col("expenses")), "|").alias("labels"))


_BAN_HITS = (
    "list_filter([CASE WHEN contains(k, 'tabacc') THEN CASE WHEN contains(k, 'bartabacc') THEN 'Tabacco (salvo bar tabacchi)' ELSE 'Tabacco' END END, "
    + ", ".join(f"CASE WHEN {' AND '.join(_sql_any('k', g) for g in groups)} THEN {_q(label)} END" for label, groups in R.BAN_RULES) + "], lambda h: h IS NOT NULL)"
)


@query("ban_labels", f"WITH {B.CALLS}, vals AS (SELECT call_id, pos, v, {_key('v')} AS k FROM (SELECT call_id, unnest(bans) AS v, generate_subscripts(bans, 1) AS pos FROM calls)), "
       f"hits AS (SELECT call_id, flatten(list(CASE WHEN len(h) > 0 OR {_sql_any('k', ('finanziar', 'assicurativ'))} OR (contains(k, 'immobiliar') AND NOT contains(k, 'sviluppoimmobiliar')) THEN h ELSE [{_fallback('v')}] END ORDER BY pos)) AS flat FROM (SELECT *, {_BAN_HITS} AS h FROM vals) GROUP BY 1) "
       f"SELECT calls.call_id, coalesce({_DISTINCT_JOIN}, '') AS labels FROM calls LEFT JOIN hits ON hits.call_id = calls.call_id")
def ban_labels(spark, sf):
    return T.calls(spark, sf).select("call_id", F.array_join(LB.ban_labels(F.col("bans")), "|").alias("labels"))


_CANON = (
    "CASE WHEN contains(k, 'responsabilitalimitatasemplificata') OR starts_with(k, 'srls') THEN 'S.r.l.s.' WHEN contains(k, 'responsabilitalimitata') OR starts_with(k, 'srl') THEN 'S.r.l.' "
    "WHEN contains(k, 'nomecollettivo') OR k = 'snc' THEN 'S.n.c.' WHEN contains(k, 'accomanditasemplice') OR k = 'sas' THEN 'S.a.s.' WHEN contains(k, 'cooperativ') THEN 'Cooperative' "
    "WHEN contains(k, 'individual') THEN 'Ditte individuali' WHEN contains(k, 'profession') THEN 'Liberi professionisti' ELSE v END"
)


@query("legal_form_labels", f"WITH {B.CALLS}, vals AS (SELECT call_id, pos, {_CANON} AS c FROM (SELECT call_id, pos, v, {B.form_key('v')} AS k FROM (SELECT call_id, unnest(legal_forms) AS v, generate_subscripts(legal_forms, 1) AS pos FROM calls))), "
       f"firsts AS (SELECT call_id, string_agg(c, '|' ORDER BY pos) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY call_id, {B.form_key('c')} ORDER BY pos) AS r FROM vals) WHERE r = 1 GROUP BY 1) "
       "SELECT calls.call_id, coalesce(labels, '') AS labels FROM calls LEFT JOIN firsts ON firsts.call_id = calls.call_id")
def legal_form_labels(spark, sf):
    return T.calls(spark, sf).select("call_id", F.array_join(LB.legal_form_labels(F.col("legal_forms")), "|").alias("labels"))


_SHORT = "trim(regexp_replace(cumulability, '\\s+', ' ', 'g'))"


@query("cumulability_label", f"WITH {B.CALLS} SELECT call_id, CASE WHEN cumulability IS NULL OR trim(cumulability) = '' THEN NULL WHEN contains(l, 'limiti di cumulo') AND (contains(l, 'salvo') OR contains(l, 'rispett')) THEN 'Ammessa nel rispetto dei limiti di cumulo applicabili' "
       "WHEN contains(l, 'non cumulabil') OR contains(l, 'non è compatibil') OR contains(l, 'non e compatibil') THEN 'Non cumulabile sul medesimo investimento' "
       "WHEN contains(l, 'non aver beneficiato') AND contains(l, 'medesimo investimento') THEN 'Non cumulabile sul medesimo investimento, salvo i limiti applicabili' WHEN contains(l, 'de minimis') THEN 'Soggetta alle regole de minimis' "
       f"WHEN length({_SHORT}) <= 180 THEN {_SHORT} ELSE concat(rtrim(substr({_SHORT}, 1, 179)), '…') END AS label FROM (SELECT *, lower(trim(cumulability)) AS l FROM calls)")
def cumulability_label(spark, sf):
    return T.calls(spark, sf).select("call_id", LB.cumulability_label(F.col("cumulability")).alias("label"))


@query("format_euro", f"WITH {B.CALLS} SELECT call_id, concat('€ ', replace({B.grouped('contribution_max')}, ',', '.')) AS amount, concat(CASE WHEN null_percentage = floor(null_percentage) THEN CAST(CAST(null_percentage AS BIGINT) AS VARCHAR) ELSE CAST(null_percentage AS VARCHAR) END, '%') AS share "
       "FROM calls WHERE contribution_max IS NOT NULL")
def format_euro(spark, sf):
    return T.calls(spark, sf).filter("contribution_max IS NOT NULL").select("call_id", N.euro(F.col("contribution_max")).alias("amount"), N.percent(F.col("null_percentage")).alias("share"))


@query("call_sheet")
def call_sheet(spark, sf):
    """Markdown sheet of every call; checked against literal sheets in the tests."""
    return sheet.render(NQ.record(spark, sf), AS_OF).select("call_id", "sheet")


@query("sheet_markdown")
def sheet_markdown(spark, sf):
    """Sheets as they are downloaded: those under review open with a warning."""
    status = T.calls(spark, sf).select("call_id", "review_status", "null_percentage")
    rendered = call_sheet(spark, sf).join(status, "call_id")
    return rendered.select("call_id", sheet.with_disclaimer(F.col("sheet"), F.col("review_status"), F.col("null_percentage")).alias("sheet"))


# --- admission ---
WINDOW, HITS = 2 * 86400, 3


@query("rate_admission", "WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
       f"st AS (SELECT event_id, user_id, rn, [us] AS hits, true AS admitted FROM e WHERE rn = 1 UNION ALL SELECT event_id, user_id, rn, CASE WHEN len(kept) < {HITS} THEN list_append(kept, us) ELSE kept END, len(kept) < {HITS} FROM "
       f"(SELECT e.*, list_filter(st.hits, lambda h: e.us - h <= {WINDOW}000000) AS kept FROM st JOIN e ON e.user_id = st.user_id AND e.rn = st.rn + 1)) SELECT event_id, user_id, admitted FROM st")
def rate_admission(spark, sf):
    events = T.table(spark, sf, "events").select("user_id", "event_id", "ts")
    return admission.admit(events, "user_id", "ts", "event_id", WINDOW, HITS).select("event_id", "user_id", "admitted")
