"""Queries on raw document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF as AS_OF
from ..functions import numbers as N, refdata as R, text as X
from ..operators import evidence as E
from ..sources import tables as T
from . import normalise_queries as NQ, oracle_base as B
from .registry import query

_DOCS = f"WITH {B.DOCUMENTS}"


def _re(pattern: str, groups: bool = True) -> str:
    return "(?i)" + pattern.replace("'", "''")


@query("rolling_window_flag", f"{_DOCS} SELECT doc_id, regexp_matches(text, '{_re(R.ROLLING_WINDOW_PATTERN)}') AS rolling FROM docs")
def rolling_window_flag(spark, sf):
    return T.documents(spark, sf).select("doc_id", E.rolling_window(F.col("text")).alias("rolling"))


def _m(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{pattern}')"


_NORM = "lower(trim(regexp_replace(strip_accents(coalesce({x}, '')), '\\s+', ' ', 'g')))"


@query("doc_relevance", f"{_DOCS} SELECT doc_id, CASE WHEN {_m('t', R.TITLE_COMPETITION_PATTERN)} THEN 'Il documento è un concorso pubblico per il reclutamento di personale.' "
       f"WHEN ({_m('t', R.SELECTION_PATTERN)} AND {_m('t', R.PERSONNEL_PATTERN)}) OR (regexp_matches(t, '\\bgraduatoria\\b') AND {_m('t', R.RANKING_PATTERN)}) THEN 'Il documento riguarda una selezione o graduatoria per personale.' "
       f"WHEN (regexp_matches(h, '\\bconcorso pubblico\\b') AND {_m('h', R.PERSONNEL_PATTERN)}) OR ({_m('h', R.SELECTION_PATTERN)} AND {_m('h', R.RECRUITMENT_PATTERN)}) OR (regexp_matches(h, '\\bgraduatoria\\b') AND {_m('h', R.RANKING_PATTERN)}) "
       f"THEN 'Il documento riguarda un concorso o una selezione di personale.' END AS reason FROM (SELECT doc_id, {_NORM.format(x=T.DOCUMENT_TITLE)} AS t, {_NORM.format(x='text')} AS h FROM docs)")
def doc_relevance(spark, sf):
    docs = T.documents(spark, sf).withColumn("title", F.expr(T.DOCUMENT_TITLE))
    return docs.select("doc_id", E.relevance(F.col("title"), F.col("text")).alias("reason"))


@query("page_segments", f"{_DOCS}, {B.spans('marks', R.PAGE_MARKER_PATTERN)} SELECT doc_id, page, CAST(length(body) AS INT) AS chars, md5(body) AS digest FROM "
       "(SELECT m.doc_id, CAST(regexp_extract(hit, '\\d+') AS INT) AS page, substr(text, stop + 1, coalesce(lead(start) OVER (PARTITION BY m.doc_id ORDER BY pos), length(text)) - stop) AS body FROM marks m JOIN docs d ON d.doc_id = m.doc_id)")
def page_segments(spark, sf):
    pages = T.documents(spark, sf).select("doc_id", F.inline(E.page_segments(F.col("text"))))
    return pages.select("doc_id", "page", F.length("text").alias("chars"), F.md5("text").alias("digest"))


_WORDS = "entro|scadenza|importo|prestito|sezione"


@query("page_at", f"{_DOCS}, {B.spans('marks', R.PAGE_MARKER_PATTERN)}, {B.spans('words', _WORDS)} SELECT w.doc_id, w.start, "
       "(SELECT arg_max(CAST(regexp_extract(m.hit, '\\d+') AS INT), m.start) FROM marks m WHERE m.doc_id = w.doc_id AND m.stop <= w.start + 1) AS page FROM words w")
def page_at(spark, sf):
    """Page of every mention of a deadline, amount, loan or section."""
    docs = T.documents(spark, sf).withColumn("marks", E.page_marks(F.col("text")))
    found = docs.select("doc_id", "marks", F.inline(X.spans(F.col("text"), _WORDS)))
    return found.select("doc_id", "start", E.page_at(F.col("marks"), F.col("start")).alias("page"))


def _dates_sql() -> str:
    parts = []
    for i, p in enumerate(R.DATE_PATTERNS):
        parts.append(B.spans(f"d{i}", p))
    rows = []
    for i, p in enumerate(R.DATE_PATTERNS):
        g = lambda n: f"regexp_extract(hit, '{_re(p)}', {n})"  # noqa: E731, B023
        month = f"list_position([{', '.join(repr(m) for m in R.MONTHS)}], lower({g(2)}))" if i == 3 else g(2)
        y, m, d = (g(1), g(2), g(3)) if i == 2 else (g(3), month, g(1))
        rows.append(f"SELECT doc_id, {i} AS pat, pos, start AS d_at, TRY_CAST(concat({y}, '-', lpad(CAST({m} AS VARCHAR), 2, '0'), '-', lpad({d}, 2, '0')) AS DATE) AS day FROM d{i}")
    keys = []
    for i, (w, weight) in enumerate(R.DEADLINE_KEYWORDS):
        parts.append(B.spans(f"k{i}", w, text="lower(text)"))
        keys.append(f"SELECT doc_id, {i} AS kw, pos AS kpos, start AS k_at, {weight} AS weight FROM k{i}")
    return (", ".join(parts) + ", found AS (SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE day IS NOT NULL), words AS (" + " UNION ALL ".join(keys) + ")")


@query("infer_deadline", f"{_DOCS}, {_dates_sql()}, best AS (SELECT doc_id, day, row_number() OVER (PARTITION BY doc_id ORDER BY weight * 1000 - abs(d_at - k_at) DESC, kw, kpos, pat, pos) AS r "
       "FROM found JOIN words USING (doc_id) WHERE abs(d_at - k_at) <= 400) "
       f"SELECT docs.doc_id, CASE WHEN date_diff('day', day, {B.AS_OF}) <= 180 AND NOT regexp_matches(text, '{_re(R.ROLLING_WINDOW_PATTERN)}') THEN CAST(day AS VARCHAR) END AS deadline FROM docs LEFT JOIN best ON best.doc_id = docs.doc_id AND r = 1")
def infer_deadline(spark, sf):
    return T.documents(spark, sf).select("doc_id", E.infer_deadline(F.col("text"), AS_OF).alias("deadline"))


def records_with_text(spark, sf):
    """Normalised records with the text they were extracted from, where there is one."""
    texts = T.documents(spark, sf).select(F.col("doc_id").alias("call_id"), "text")
    return NQ.record(spark, sf).join(texts, "call_id", "left")


_SEC_SQL = (
    f", {B.DOCUMENTS}, {B.spans('cites', R.SECTION_CITATION_PATTERN)}, cited AS MATERIALIZED (SELECT c.doc_id, pos, start, upper(regexp_extract(hit, '{_re(R.SECTION_CITATION_PATTERN)}', 1)) AS letter, "
    f"regexp_matches(substr(text, greatest(start - 800, 0) + 1, stop + 800 - greatest(start - 800, 0)), '{_re(R.EXCLUSION_PATTERN)}') AS excluded FROM cites c JOIN docs d ON d.doc_id = c.doc_id), "
    "cites_by_doc AS (SELECT doc_id, list(DISTINCT letter) AS letters FROM cited GROUP BY 1), "
    "out_by_doc AS (SELECT doc_id, list(letter ORDER BY first_pos) AS outs FROM (SELECT doc_id, letter, min(pos) AS first_pos FROM cited WHERE excluded GROUP BY ALL) GROUP BY 1)"
)
_RAW_SECTIONS = NQ.s_texts("json_extract(r.j, '$.note_esclusioni.sezioni_ateco_escluse')")


@query("ateco_exclusions", f"WITH {B.RAW_CALLS}{_SEC_SQL}, notes AS (SELECT call_id, lst, text IS NOT NULL AS has_text, coalesce(letters, []) AS letters, coalesce(outs, []) AS outs FROM "
       f"(SELECT call_id, CASE WHEN json_type(r.j, '$.note_esclusioni') = 'OBJECT' THEN {_RAW_SECTIONS} ELSE CAST([] AS VARCHAR[]) END AS lst FROM raw_calls r) "
       "LEFT JOIN docs ON docs.doc_id = call_id LEFT JOIN cites_by_doc c ON c.doc_id = call_id LEFT JOIN out_by_doc o ON o.doc_id = call_id), "
       "kept AS (SELECT *, list_filter(lst, lambda v: list_contains(letters, regexp_extract(upper(v), '\\b([A-U])\\b', 1))) AS kl, list_filter(lst, lambda v: regexp_extract(upper(v), '\\b([A-U])\\b', 1) <> '' AND NOT list_contains(letters, regexp_extract(upper(v), '\\b([A-U])\\b', 1))) AS removed FROM notes), "
       "letters_of AS (SELECT *, list_filter(kl2, lambda x, i: list_position(kl2, x) = i) AS kll FROM (SELECT *, list_transform(kl, lambda v: regexp_extract(upper(v), '\\b([A-U])\\b', 1)) AS kl2 FROM kept)) "
       "SELECT call_id, CASE WHEN has_text THEN array_to_string(list_transform(list_concat(kll, list_filter(outs, lambda x: NOT list_contains(kll, x))), lambda x: concat('Sez. ', x)), '|') ELSE array_to_string(lst, '|') END AS kept, "
       "CASE WHEN has_text THEN array_to_string(removed, '|') ELSE '' END AS removed, CASE WHEN has_text THEN array_to_string(list_filter(outs, lambda x: NOT list_contains(kll, x)), '|') ELSE '' END AS added FROM letters_of")
def ateco_exclusions(spark, sf):
    rows = records_with_text(spark, sf).select("call_id", "text", F.col("note_esclusioni.sezioni_ateco_escluse").alias("sections"))
    done = E.reconcile_sections(rows, "text", "sections")
    return done.select("call_id", F.array_join("kept_sections", "|").alias("kept"), F.array_join("removed_sections", "|").alias("removed"), F.array_join("added_sections", "|").alias("added"))


def s_italian(x: str) -> str:
    return f"TRY_CAST(replace(replace({x}, '.', ''), ',', '.') AS DOUBLE)"


@query("italian_number", f"{_DOCS}, {B.spans('nums', R.ITALIAN_NUMBER)} SELECT doc_id, start, {s_italian('hit')} AS number FROM nums")
def italian_number(spark, sf):
    found = T.documents(spark, sf).select("doc_id", F.inline(X.spans(F.col("text"), R.ITALIAN_NUMBER)))
    return found.select("doc_id", "start", N.parse_italian(F.col("hit")).alias("number"))


def _x(pattern: str, group: int) -> str:
    return f"CASE WHEN regexp_matches(text, '{_re(pattern)}') THEN regexp_extract(text, '{_re(pattern)}', {group}) END"


def s_first(patterns, units) -> str:
    """Months by the earliest match; pattern order settles ties."""
    arms = []
    for i, (p, unit) in enumerate(zip(patterns, units)):
        p = p.replace(r"(?!\s*[/\\-]\s*\d)", "")
        start = f"length(string_split_regex(text, '{_re(p)}')[1])"
        amount = NQ.s_loose(f"regexp_extract(text, '{_re(p)}', 1)")
        months = f"{amount} * (CASE lower(regexp_extract(text, '{_re(p)}', 2)) " + " ".join(f"WHEN '{u}' THEN {m}" for u, m in R.UNIT_MONTHS) + " END)" if unit else amount
        arms.append(f"CASE WHEN regexp_matches(text, '{_re(p)}') THEN {{'s': {start}, 'i': {i}, 'm': {months}}} END")
    return f"list_min(list_filter([{', '.join(arms)}], lambda z: z IS NOT NULL))['m']"


_COMPACT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_RATE = _x(R.RATE_PATTERN, 1)
FACTS_SQL = (
    f"facts AS MATERIALIZED (SELECT doc_id, text, {s_italian(_x(R.AMOUNT_MIN_PATTERN, 1))} AS t_min, {s_italian(_x(R.AMOUNT_MAX_PATTERN, 1))} AS t_max, "
    f"{s_first(R.DURATION_TEXT_PATTERNS, (True, True, True))} AS t_duration, {s_first(R.GRACE_TEXT_PATTERNS, (True, False))} AS t_grace, "
    f"CASE WHEN lower({_RATE}) = 'zero' THEN 0.0 ELSE {s_italian(f'trim(replace({_RATE}, ' + chr(39) + '%' + chr(39) + ', ' + chr(39) + chr(39) + '))')} END AS t_rate, "
    f"CAST({_x(R.REBATE_PATTERN, 1)} AS DOUBLE) AS t_rebate, trim(nullif(regexp_extract({_COMPACT}, '{_re(R.CUMULATION_PATTERN)}'), '')) AS t_clause FROM docs)"
)
_LOAN = "'finanziamento_agevolato'"
ECON_SQL = (
    f", {B.DOCUMENTS}, {FACTS_SQL}, loan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pos) AS r FROM aid WHERE tipo = {_LOAN}) WHERE r = 1), "
    f"econ AS MATERIALIZED (SELECT rec.call_id, f.doc_id IS NOT NULL AS has_text, l.call_id IS NOT NULL OR (f.doc_id IS NOT NULL AND list_contains(tipi, {_LOAN})) AS has_loan, "
    "coalesce(l.importo_min, t_min) AS amount_min, coalesce(l.importo_max, t_max) AS amount_max, coalesce(l.tasso_interesse_percentuale, t_rate) AS rate, "
    "coalesce(t_duration, l.durata_mesi) AS duration, coalesce(t_grace, l.preammortamento_mesi) AS grace, coalesce(l.abbuono_rate, t_rebate) AS rebate, "
    "CASE WHEN t_clause IS NOT NULL AND (coalesce(cumulabilita, '') = '' OR (contains(lower(cumulabilita), 'de minimis') AND NOT contains(lower(cumulabilita), 'medesimo investimento') "
    "AND contains(lower(t_clause), 'medesimo investimento'))) THEN t_clause ELSE cumulabilita END AS cumulation, f.text FROM rec LEFT JOIN loan l ON l.call_id = rec.call_id LEFT JOIN facts f ON f.doc_id = rec.call_id)"
)


@query("economic_details", NQ.with_rec(
    "SELECT call_id, has_loan, " + ", ".join(f"CASE WHEN has_loan THEN {c} END AS {c}" for c in ("amount_min", "amount_max", "rate", "duration", "grace", "rebate")) + ", cumulation FROM econ", ECON_SQL))
def economic_details(spark, sf):
    rows = records_with_text(spark, sf).select("call_id", "text", "agevolazioni", "tipo_agevolazione", "cumulabilita", "fonti")
    done = E.reconcile_economics(rows, "text")
    loan = F.get(F.filter("agevolazioni", lambda a: a["tipo"] == "finanziamento_agevolato"), F.lit(0))
    named = {"importo_min": "amount_min", "importo_max": "amount_max", "tasso_interesse_percentuale": "rate", "durata_mesi": "duration",
             "preammortamento_mesi": "grace", "abbuono_rate": "rebate"}
    return done.withColumn("loan", loan).select(
        "call_id", F.col("loan").isNotNull().alias("has_loan"), *[F.col(f"loan.{k}").alias(v) for k, v in named.items()], F.col("cumulabilita").alias("cumulation"))


@query("economic_warnings", NQ.with_rec(
    f"SELECT e.call_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '{_re(R.REBATE_PATTERN)}') AND NOT (has_loan AND rebate IS NOT NULL) THEN 'Completezza economica: il testo cita un abbuono ma il campo è vuoto' END, "
    f"CASE WHEN regexp_matches(text, '{_re(R.CUMULATION_WORD_PATTERN)}') AND coalesce(cumulation, '') = '' THEN 'Completezza economica: il testo cita il cumulo ma il campo è vuoto' END], lambda w: w IS NOT NULL), '|') AS warnings FROM econ e", ECON_SQL))
def economic_warnings(spark, sf):
    rows = records_with_text(spark, sf).select("call_id", "text", "agevolazioni", "tipo_agevolazione", "cumulabilita", "fonti")
    done = E.reconcile_economics(rows, "text")
    return done.select("call_id", F.array_join(E.economic_warnings(F.col("text")), "|").alias("warnings"))


_S_TOKENS = ("list_distinct(list_transform(list_filter(regexp_extract_all(strip_accents(lower({x})), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains("
             + NQ.q(R.ENTITY_STOPWORDS) + ", w)), lambda w: substr(w, 1, 6)))")
_SOURCES_SQL = ("src AS (SELECT call_id, " + NQ._s_source("x") + f" FROM (SELECT call_id, unnest({NQ.s_items(NQ.s_get('fonti'))}) AS x FROM raw_calls) WHERE json_type(x) = 'OBJECT')")
ISSUER_SQL = (
    f", {_SOURCES_SQL}, own AS (SELECT call_id, list(testo) FILTER (testo IS NOT NULL) AS quotes, count(*) AS n FROM src WHERE campo = 'ente' GROUP BY 1), "
    "issuer AS MATERIALIZED (SELECT call_id, ente, CASE WHEN trim(coalesce(ente, '')) = '' THEN NULL WHEN n IS NULL THEN 'Coerenza fonti: manca una fonte testuale per il campo ente' "
    f"WHEN len(tokens) > 0 AND len(list_filter(coalesce(quotes, []), lambda t: list_has_all({_S_TOKENS.format(x='t')}, tokens))) > 0 THEN NULL "
    "ELSE concat('Coerenza fonti: la fonte associata a ente non supporta il valore estratto “', ente, '”') END AS warning, tokens FROM "
    f"(SELECT call_id, ente, {_S_TOKENS.format(x='ente')} AS tokens FROM rec) LEFT JOIN own USING (call_id))"
)


@query("issuer_support", NQ.with_rec("SELECT call_id, warning FROM issuer", ISSUER_SQL))
def issuer_support(spark, sf):
    return NQ.record(spark, sf).select("call_id", E.issuer_warning(F.col("ente"), F.col("fonti")).alias("warning"))


REPAIR_SQL = (
    f", {B.DOCUMENTS}, {B.spans('marks', R.PAGE_MARKER_PATTERN)}, pages_of AS MATERIALIZED (SELECT m.doc_id, CAST(regexp_extract(hit, '\\d+') AS INT) AS page, pos, "
    "trim(regexp_replace(substr(text, stop + 1, coalesce(lead(start) OVER (PARTITION BY m.doc_id ORDER BY pos), length(text)) - stop), '\\s+', ' ', 'g')) AS body FROM marks m JOIN docs d ON d.doc_id = m.doc_id), "
    "snips AS (SELECT call_id, ente, page, pos, substr(body, greatest(c - 320, 0) + 1, c + 520 - greatest(c - 320, 0)) AS snippet FROM (SELECT *, greatest(strpos(lower(body), lower(regexp_extract_all(ente, '[A-Za-z]{3,}')[-1])) - 1, 0) AS c "
    f"FROM issuer JOIN pages_of ON doc_id = call_id WHERE warning IS NOT NULL AND body <> '' AND list_has_all({_S_TOKENS.format(x='body')}, tokens))), "
    "repair AS MATERIALIZED (SELECT * FROM (SELECT call_id, page, snippet, row_number() OVER (PARTITION BY call_id ORDER BY 10 + CASE WHEN contains(lower(snippet), lower(ente)) THEN 5 ELSE 0 END + 2 * hits "
    f"- CASE WHEN regexp_matches(snippet, '{_re(R.ENTITY_NEGATIVE_PATTERN)}') THEN 8 ELSE 0 END + CASE WHEN page = 1 THEN 2 ELSE 0 END DESC, pos) AS r FROM "
    f"(SELECT *, len(regexp_extract_all(snippet, '{_re(R.ENTITY_CONTEXT_PATTERN)}')) AS hits FROM snips) WHERE hits > 0) WHERE r = 1)"
)


@query("issuer_repair", NQ.with_rec("SELECT call_id, concat('Fonte ente: citazione incoerente sostituita con evidenza contestuale a pagina ', page) AS notice, snippet FROM repair", ISSUER_SQL + REPAIR_SQL))
def issuer_repair(spark, sf):
    rows = records_with_text(spark, sf).select("call_id", "text", "ente", "fonti")
    done = E.repair_issuer_source(rows, "text").filter("issuer_notice IS NOT NULL")
    quote = F.get(F.filter("fonti", lambda s: s["campo"] == "ente"), F.lit(0))["testo"]
    return done.select("call_id", F.col("issuer_notice").alias("notice"), quote.alias("snippet"))


@query("sanitise_delims", f"{_DOCS} SELECT doc_id, regexp_replace(text, '{_re(R.DELIMITER_PATTERN)}', '[TAG_RIMOSSO]', 'g') AS text FROM docs")
def sanitise_delims(spark, sf):
    return T.documents(spark, sf).select("doc_id", E.neutralise_delimiters(F.col("text")).alias("text"))


@query("truncate_flag", f"{_DOCS} SELECT doc_id, CAST(length(substr(text, 1, {R.MAX_TEXT_CHARS})) AS INT) AS chars, length(text) > {R.MAX_TEXT_CHARS} AS truncated, md5(substr(text, 1, {R.MAX_TEXT_CHARS})) AS digest FROM docs")
def truncate_flag(spark, sf):
    """Texts cut to a limit, with a flag; the limit is an argument of the operator."""
    return truncate(T.documents(spark, sf)).select("doc_id", F.length("cut").alias("chars"), "truncated", F.md5("cut").alias("digest"))


def truncate(docs, limit: int = R.MAX_TEXT_CHARS):
    return docs.withColumns({"cut": F.substring("text", 1, limit), "truncated": F.length("text") > limit})


@query("min_text_gate", "SELECT doc_id, CAST(length(trim(text, chr(10) || ' ')) AS INT) AS chars FROM documents WHERE length(trim(text, chr(10) || ' ')) >= 50")
def min_text_gate(spark, sf):
    chars = F.length(X.strip(F.col("text")))
    return T.table(spark, sf, "documents").filter(chars >= R.MIN_TEXT_CHARS).select("doc_id", chars.alias("chars"))
