"""SQL building blocks of the check queries: the input tables as common table expressions."""

from __future__ import annotations

from ..sources import tables as T

AS_OF = "DATE '2024-06-01'"


def _columns(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns)


_LISTS = ", ".join(
    f"list_filter(string_split({text}, ';'), lambda x: x <> '') AS {name}" for name, text in T.CALL_LISTS.items()
)
COMPANIES = (
    "companies AS MATERIALIZED (SELECT " + _columns(T.COMPANY_COLUMNS) + " FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey "
    "LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS rev, count(*) AS n_orders, min(o_orderdate) AS first_order "
    "FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey)"
)
CALLS = (
    "calls AS MATERIALIZED (SELECT *, " + _LISTS + " FROM (SELECT " + _columns(T.CALL_COLUMNS) + " FROM part))"
)
DOCUMENTS = "docs AS MATERIALIZED (SELECT " + _columns(T.DOCUMENT_COLUMNS) + " FROM documents)"
RAW_CALLS = (
    "raw_calls AS MATERIALIZED (SELECT call_id, CAST(CASE WHEN json_type(payload, '$.bando') = 'OBJECT' "
    "THEN json_extract(payload, '$.bando') ELSE payload END AS JSON) AS j, payload FROM (SELECT "
    + _columns(T.RAW_CALL_COLUMNS) + " FROM part))"
)

# --- pair-level building blocks ---
from ..functions import refdata as R  # noqa: E402

SECTIONS = "sections(letter, lo, hi, label) AS (VALUES " + ", ".join(
    f"('{a}', {lo}, {hi}, '{label}')" for a, lo, hi, label in R.SECTIONS
) + ")"
FORMS = "forms(pos, form_key, category) AS (VALUES " + ", ".join(
    f"({i}, '{key}', '{cat}')"
    for i, (cat, key) in enumerate((c, k) for c, keys in R.LEGAL_FORM_KEYS.items() for k in keys)
) + ")"


def form_key(text: str) -> str:
    return f"lower(translate(regexp_replace(coalesce({text}, ''), '[\\s./\\-]', '', 'g'), '{R.LEGAL_FORM_ACCENTS[0]}', '{R.LEGAL_FORM_ACCENTS[1]}'))"


_PREFIX = "substr(split_part(replace(trim({c}), ' ', ''), '.', 1), 1, 2)"
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: length(w) >= 4))"
FIRMS = (
    "form_names AS MATERIALIZED (SELECT DISTINCT " + form_key("legal_form") + " AS fk FROM companies "
    "UNION SELECT DISTINCT " + form_key("f") + " FROM calls, unnest(legal_forms) u(f)), "
    "form_cats AS MATERIALIZED (SELECT fk, (SELECT category FROM forms WHERE fk <> '' AND contains(fk, form_key) "
    "ORDER BY (fk = form_key) DESC, length(form_key) DESC, pos LIMIT 1) AS category FROM form_names), "
    "firms AS MATERIALIZED (SELECT b.*, s.letter AS f_section, fc.category AS f_category FROM (SELECT *, lower(nullif(trim(region), '')) AS f_region, "
    "lower(nullif(trim(sector_code), '')) AS f_code, " + _PREFIX.format(c="nullif(trim(sector_code), '')") + " AS f_prefix, "
    + _TOKENS.format(t="nullif(trim(activity_description), '')") + " AS f_tokens, lower(nullif(trim(size_class), '')) AS f_size, "
    f"(year({AS_OF}) - year(founded_on)) * 12 + month({AS_OF}) - month(founded_on) AS f_months, "
    + form_key("legal_form") + " AS f_form FROM companies) b "
    "LEFT JOIN sections s ON regexp_full_match(f_prefix, '[0-9]+') AND TRY_CAST(f_prefix AS INT) BETWEEN s.lo AND s.hi "
    "LEFT JOIN form_cats fc ON fc.fk = b.f_form)"
)
FUNDS = (
    "funds AS MATERIALIZED (SELECT *, (len(k_codes) = 0 OR open_to_all) AND (len(k_activities) = 0 OR open_to_all) "
    "AND (len(k_regions) = 0 OR list_contains(k_regions, 'tutta italia')) AND coalesce(revenue_max, 0) = 0 "
    "AND len(k_sizes) NOT BETWEEN 1 AND 3 AND NOT open_to_all AS k_ambiguous, "
    "len(k_regions) = 0 OR list_has_any(k_regions, ['tutte', 'tutta italia']) AS k_free FROM (SELECT *, "
    "list_transform(regions, lambda r: lower(trim(r))) AS k_regions, list_transform(sector_codes, lambda c: lower(trim(c))) AS k_codes, "
    "list_transform(sector_codes, lambda c: " + _PREFIX.format(c="c") + ") AS k_prefixes, "
    "list_transform(activities, lambda a: " + _TOKENS.format(t="a") + ") AS k_activities, "
    "list_transform(sizes, lambda s: lower(trim(s))) AS k_sizes, "
    "list_filter(list_transform(excluded_sections, lambda e: regexp_extract(upper(trim(e)), '\\b([A-U])\\b', 1)), lambda x: x <> '') AS k_sections, "
    "list_transform(legal_forms, lambda f: " + form_key("f") + ") AS k_forms FROM calls) c "
    "LEFT JOIN (SELECT call_id AS cid, list(category) AS k_categories, list(fk) FILTER (category IS NULL) AS k_unknown "
    "FROM (SELECT call_id, unnest(legal_forms) AS f FROM calls) x JOIN form_cats ON fk = " + form_key("f") + " GROUP BY 1) cc ON cid = call_id)"
)
_EXCLUDED = "coalesce(list_contains(k_sections, f_section), false)"
OVERLAP = "coalesce(list_max(list_transform(k_activities, lambda a: len(list_intersect(a, f_tokens)))), 0)"
PAIRS = (
    "pairs AS MATERIALIZED (SELECT *, CAST(region_score + sector_score + size_score + revenue_score AS INT) AS score, "
    "CASE WHEN k_ambiguous THEN 'da_verificare' ELSE 'ok' END AS score_status FROM (SELECT f.*, c.*, "
    "CAST(CASE WHEN k_free OR list_contains(k_regions, f_region) THEN 30 ELSE 0 END AS INT) AS region_score, "
    f"CAST(CASE WHEN {_EXCLUDED} THEN 0 WHEN open_to_all THEN 40 "
    "WHEN len(k_codes) > 0 THEN CASE WHEN list_contains(k_codes, f_code) THEN 40 WHEN length(f_prefix) >= 2 AND list_contains(k_prefixes, f_prefix) THEN 20 ELSE 0 END "
    "WHEN len(k_activities) > 0 THEN CASE WHEN f_tokens IS NULL THEN 15 WHEN " + OVERLAP + " >= 2 THEN 30 WHEN " + OVERLAP + " = 1 THEN 15 ELSE 0 END "
    "ELSE 20 END AS INT) AS sector_score, "
    "CAST(CASE WHEN len(k_sizes) = 0 OR list_contains(k_sizes, f_size) THEN 20 ELSE 0 END AS INT) AS size_score, "
    "CAST(CASE WHEN revenue_max IS NULL OR coalesce(revenue, 0) <= revenue_max THEN 10 ELSE 0 END AS INT) AS revenue_score "
    "FROM {pair_source}))"
)
STORED = (
    "stored AS MATERIALIZED (SELECT " + _columns(T.STORED_COLUMNS) + " FROM (SELECT l_partkey, o_custkey, l_linenumber, min(l_shipdate) AS shipped "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL))"
)
FORMS_IN = "company_forms AS MATERIALIZED (SELECT " + _columns(T.COMPANY_FORM_COLUMNS) + " FROM supplier)"
UPLOADS = "uploads AS MATERIALIZED (SELECT " + _columns(T.UPLOAD_COLUMNS) + " FROM pages)"
STORED_PAIRS = PAIRS.replace("SELECT f.*, c.*,", "SELECT f.*, c.*, m.match_id, m.score AS stored_score, m.matched_on,").replace(
    "{pair_source}", "stored m JOIN funds c ON m.call_id = c.call_id AND c.review_status = 'validato' JOIN firms f ON m.company_id = f.company_id"
)
PAIRS = PAIRS.replace("{pair_source}", "funds c, firms f")
_O = {
    "min_age": "CASE WHEN min_age_months > 0 THEN CASE WHEN f_months IS NULL THEN 'unverifiable' WHEN f_months < min_age_months THEN 'fail' ELSE 'ok' END END",
    "max_age": "CASE WHEN max_age_months > 0 THEN CASE WHEN f_months IS NULL THEN 'unverifiable' WHEN f_months > max_age_months THEN 'fail' ELSE 'ok' END END",
    "section": f"CASE WHEN {_EXCLUDED} THEN 'fail' END",
    "legal_form": "CASE WHEN len(k_forms) > 0 THEN CASE WHEN f_form = '' THEN 'unverifiable' "
                  "WHEN len(list_filter(k_forms, lambda k: contains(k, 'registroimprese'))) > 0 THEN 'ok' "
                  "WHEN f_category IS NULL THEN CASE WHEN list_contains(k_unknown, f_form) THEN 'ok' ELSE 'unverifiable' END "
                  "WHEN list_contains(k_categories, f_category) THEN 'ok' ELSE 'fail' END END",
    "min_spend": "CASE WHEN min_spend > 0 THEN CASE WHEN coalesce(revenue, 0) = 0 THEN 'unverifiable' ELSE 'ok' END END",
    "size": "CASE WHEN len(k_sizes) > 0 THEN CASE WHEN f_size IS NULL THEN 'unverifiable' WHEN list_contains(k_sizes, f_size) THEN 'ok' ELSE 'fail' END END",
    "revenue_cap": "CASE WHEN revenue_max IS NOT NULL THEN CASE WHEN revenue IS NULL THEN 'unverifiable' WHEN revenue > revenue_max THEN 'fail' ELSE 'ok' END END",
    "employees": "CASE WHEN employees_min IS NOT NULL OR employees_max IS NOT NULL THEN CASE WHEN employees IS NULL THEN 'unverifiable' "
                 "WHEN employees < employees_min OR employees > employees_max THEN 'fail' ELSE 'ok' END END",
    "region": "CASE WHEN NOT k_free THEN CASE WHEN f_region IS NULL THEN 'unverifiable' WHEN list_contains(k_regions, f_region) THEN 'ok' ELSE 'fail' END END",
}
CRITERIA = list(_O)
CHECKS = (
    "checks AS MATERIALIZED (SELECT *, [" + ", ".join(f"o_{n}" for n in CRITERIA) + "] AS outcomes, "
    "NOT coalesce(list_contains([" + ", ".join(f"o_{n}" for n in CRITERIA) + "], 'fail'), false) AS eligible FROM (SELECT *, "
    + ", ".join(f"{e} AS o_{n}" for n, e in _O.items()) + " FROM pairs{where}))"
)


def with_pairs(body: str) -> str:
    return f"WITH {COMPANIES}, {CALLS}, {SECTIONS}, {FORMS}, {FIRMS}, {FUNDS}, {PAIRS} {body}"


def with_checks(body: str, where: str = "", extra: str = "") -> str:
    checks = CHECKS.replace("{where}", f" WHERE {where}" if where else "")
    return f"WITH {COMPANIES}, {CALLS}, {SECTIONS}, {FORMS}, {FIRMS}, {FUNDS}, {PAIRS}, {checks}{extra} {body}"


def with_calls(body: str) -> str:
    return f"WITH {COMPANIES}, {CALLS}, {SECTIONS}, {FORMS}, {FIRMS}, {FUNDS} {body}"


def with_stored(body: str, extra: str = "") -> str:
    """Stored matches of validated calls, enriched, as ``checks``."""
    checks = CHECKS.replace("{where}", "")
    return f"WITH {COMPANIES}, {CALLS}, {SECTIONS}, {FORMS}, {FIRMS}, {FUNDS}, {STORED}, {STORED_PAIRS}, {checks}{extra} {body}"


def parse_any(text: str) -> str:
    arms = " ".join(
        f"WHEN regexp_full_match(trim({text}), '{shape}') THEN TRY_CAST(try_strptime(trim({text}), '{fmt}') AS DATE)"
        for shape, fmt in ((r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"), (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"), (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"))
    )
    return f"(CASE {arms} END)"


def days_left(text: str) -> str:
    return f"CAST({parse_any(text)} - {AS_OF} AS INT)"


def urgency(text: str) -> str:
    d = f"CASE WHEN regexp_full_match(trim({text}), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(TRY_CAST(trim({text}) AS DATE) - {AS_OF} AS INT) END"
    return f"CASE WHEN {d} < 0 THEN 'scaduto' WHEN {d} < 30 THEN 'alta' WHEN {d} < 90 THEN 'media' WHEN {d} >= 90 THEN 'bassa' END"


def italian_long(text: str) -> str:
    months = "[" + ", ".join(f"'{m}'" for m in R.MONTHS) + "]"
    d = parse_any(text)
    return (f"CASE WHEN trim({text}) <> '' THEN coalesce(concat(CAST(day({d}) AS VARCHAR), ' ', {months}[month({d})], ' ', CAST(year({d}) AS VARCHAR)) "
            f"|| CASE WHEN {d} IS NULL THEN NULL ELSE '' END, trim({text})) END")


def grouped(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


FACES = (
    "faces AS MATERIALIZED (SELECT call_id, CASE WHEN title <> '' THEN title ELSE concat('Bando #', CAST(call_id AS VARCHAR)) END AS title, issuer, "
    f"CASE WHEN contribution_max IS NULL THEN 'N/D' ELSE concat('€ ', {grouped('contribution_max')}) END AS contribution_text, contribution_max, "
    f"coalesce({italian_long('deadline')}, 'N/D') AS deadline_text, {days_left('deadline')} AS days_left, {urgency('deadline')} AS urgency, "
    "NOT ((len(k_codes) = 0 OR open_to_all) AND (len(k_activities) = 0 OR open_to_all) AND (len(k_regions) = 0 OR list_contains(k_regions, 'tutta italia')) "
    "AND coalesce(revenue_max, 0) = 0 AND len(k_sizes) NOT BETWEEN 1 AND 3) AS has_constraints, "
    "has_original, review_status, null_percentage, nullif(trim(source_url), '') AS source_url FROM funds)"
)
CARDS = (
    ", " + FACES + ", grouping AS MATERIALIZED (SELECT call_id, max(call_id) OVER g AS card_id, count(*) OVER g AS copies FROM faces "
    "WINDOW g AS (PARTITION BY lower(trim(title)), coalesce(lower(trim(issuer)), ''))), "
    "call_best AS MATERIALIZED (SELECT call_id, max(stored_score) AS raw_best FROM checks GROUP BY 1), "
    "merged AS MATERIALIZED (SELECT * FROM (SELECT card_id, c.*, row_number() OVER (PARTITION BY card_id, CASE WHEN copies > 1 THEN legal_name ELSE CAST(match_id AS VARCHAR) END "
    "ORDER BY stored_score DESC, raw_best DESC, call_id DESC, match_id) AS rn FROM checks c JOIN grouping USING (call_id) JOIN call_best USING (call_id)) WHERE rn = 1), "
    "cards AS MATERIALIZED (SELECT f.*, coalesce(n, 0) AS n_matches, coalesce(ne, 0) AS n_eligible, coalesce(nn, 0) AS n_not_eligible, coalesce(nv, 0) AS n_to_verify, "
    "coalesce(best, 0) AS max_score, CAST(CASE WHEN review_status = 'validato' THEN coalesce(raw_best, 0) ELSE 0 END AS INT) AS raw_max_score, copies FROM faces f JOIN grouping g ON f.call_id = g.card_id AND g.call_id = g.card_id "
    "LEFT JOIN (SELECT card_id, count(*) AS n, count(*) FILTER (eligible AND score_status <> 'da_verificare') AS ne, count(*) FILTER (NOT eligible) AS nn, "
    "count(*) FILTER (score_status = 'da_verificare') AS nv, max(stored_score) FILTER (eligible AND score_status <> 'da_verificare') AS best FROM merged GROUP BY 1) s "
    "ON s.card_id = f.call_id AND f.review_status = 'validato' LEFT JOIN call_best b ON b.call_id = f.call_id), "
    "ranked AS MATERIALIZED (SELECT *, CASE WHEN review_status = 'da_revisionare' THEN 'da_verificare' WHEN days_left < 0 THEN 'scaduti' WHEN n_eligible > 0 THEN 'ammissibili' "
    "WHEN n_to_verify > 0 THEN 'da_verificare' ELSE 'non_ammissibili' END AS category FROM cards)"
)


def spans(name: str, pattern: str, source: str = "docs", key: str = "doc_id", text: str = "text") -> str:
    """CTE of all matches: key, pos (1-based number), start and stop (0-based), hit."""
    regex = "(?i)" + pattern.replace("'", "''")
    return (
        f"{name} AS MATERIALIZED (SELECT {key}, pos, CAST(start AS INT) AS start, CAST(start + length(hit) AS INT) AS stop, hit FROM (SELECT {key}, pos, hit, "
        f"sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start "
        f"FROM (SELECT {key}, generate_subscripts(hits, 1) AS pos, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM (SELECT {key}, regexp_extract_all({text}, '{regex}') AS hits, "
        f"string_split_regex({text}, '{regex}') AS gaps FROM {source}) WHERE len(hits) > 0) WINDOW w AS (PARTITION BY {key} ORDER BY pos)))"
    )
