"""Queries on table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import maintenance, matching as M, profiles as P, sizes, upkeep as U
from ..sources import tables as T
from . import oracle_base as B
from .match_queries import AS_OF, firms, funds
from .registry import query

_CALLS = f"WITH {B.CALLS}"


def _groups(title: str, issuer: str) -> str:
    return (f"{_CALLS} SELECT {title} AS title_key, {issuer} AS issuer_key, max(call_id) AS kept_id, CAST(count(*) AS BIGINT) AS copies FROM calls "
            f"WHERE {title} <> '' GROUP BY ALL HAVING count(*) > 1")


@query("duplicate_groups", _groups("lower(coalesce(title, ''))", "lower(coalesce(issuer, ''))"))
def duplicate_groups(spark, sf):
    return U.duplicate_groups(T.calls(spark, sf))


def _dedup(title: str, issuer: str) -> str:
    return (f"{_CALLS} SELECT call_id, title, issuer FROM (SELECT *, row_number() OVER (PARTITION BY {title}, {issuer}, CASE WHEN {title} = '' THEN call_id END ORDER BY call_id DESC) AS r FROM calls) WHERE r = 1")


@query("dedup_calls_strict", _dedup("lower(coalesce(title, ''))", "lower(coalesce(issuer, ''))"))
def dedup_calls_strict(spark, sf):
    return U.deduplicate(T.calls(spark, sf).select("call_id", "title", "issuer"))


@query("dedup_calls_loose", _dedup("lower(trim(coalesce(title, '')))", "''"))
def dedup_calls_loose(spark, sf):
    return U.deduplicate(T.calls(spark, sf).select("call_id", "title", "issuer"), strict=False)


_INCOMING = "incoming AS (SELECT p_partkey AS incoming_id, CASE WHEN p_partkey % 19 = 0 THEN '  ' ELSE upper(p_name) END AS title, lower(p_brand) AS issuer FROM part)"


def _incoming(spark, sf):
    return T.table(spark, sf, "part").selectExpr(
        "p_partkey AS incoming_id", "CASE WHEN p_partkey % 19 = 0 THEN '  ' ELSE upper(p_name) END AS title", "lower(p_brand) AS issuer")


@query("find_duplicate", f"{_CALLS}, {_INCOMING} SELECT incoming_id, s.id AS strict_id, l.id AS loose_id FROM incoming i "
       "LEFT JOIN (SELECT lower(coalesce(title, '')) AS t, lower(coalesce(issuer, '')) AS e, max(call_id) AS id FROM calls GROUP BY ALL) s ON trim(i.title) <> '' AND s.t = lower(i.title) AND s.e = lower(i.issuer) "
       "LEFT JOIN (SELECT lower(trim(coalesce(title, ''))) AS t, max(call_id) AS id FROM calls GROUP BY ALL) l ON trim(i.title) <> '' AND l.t = lower(trim(i.title))")
def find_duplicate(spark, sf):
    calls = T.calls(spark, sf).select("call_id", "title", "issuer")
    strict = U.find_duplicates(_incoming(spark, sf), calls).withColumnRenamed("duplicate_of", "strict_id")
    return U.find_duplicates(strict, calls, strict=False).select("incoming_id", "strict_id", F.col("duplicate_of").alias("loose_id"))


_HASH = "CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' THEN sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) END"


@query("content_hash", f"SELECT doc_id, {_HASH} AS document_hash FROM documents")
def content_hash(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("document_hash"))


@query("find_dup_hash", f"SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS newest_id FROM (SELECT doc_id, {_HASH} AS h FROM documents) WHERE h IS NOT NULL")
def find_dup_hash(spark, sf):
    hashed = content_hash(spark, sf)
    return hashed.join(U.newest_by_hash(hashed, "doc_id"), "document_hash").select("doc_id", "newest_id")


_FILES = "CAST(d.doc_id AS BIGINT)"


@query("hash_backfill", f"WITH {B.CALLS}, hashed AS MATERIALIZED (SELECT doc_id, {_HASH} AS h FROM documents), known AS (SELECT c.call_id, has_original, h FROM calls c LEFT JOIN hashed ON doc_id = call_id), "
       "target AS (SELECT max(call_id) AS call_id FROM known WHERE h IS NOT NULL AND h IN (SELECT h FROM hashed) GROUP BY h) "
       "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (has_original OR t.call_id IS NOT NULL) AS BIGINT) AS with_original, "
       "CAST(count(*) FILTER (NOT has_original AND t.call_id IS NOT NULL) AS BIGINT) AS attached FROM known k LEFT JOIN target t ON t.call_id = k.call_id")
def hash_backfill(spark, sf):
    """Local files join the calls by text hash; the newest call of a hash gets the file if it has none."""
    files = content_hash(spark, sf)
    calls = T.calls(spark, sf).select("call_id", "has_original")
    known = calls.join(files.withColumnRenamed("doc_id", "call_id"), "call_id", "left")
    targets = U.newest_by_hash(known, "call_id").join(files.select("document_hash"), "document_hash", "left_semi")
    offered = targets.select(F.col("newest_id").alias("call_id"), F.lit(True).alias("offered"))
    done = known.join(offered, "call_id", "left").withColumn("offered", F.coalesce("offered", F.lit(False)))
    return done.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("has_original") | F.col("offered")).alias("with_original"),
        F.count_if(~F.col("has_original") & F.col("offered")).alias("attached"))


@query("attach_if_missing", f"WITH {B.CALLS}, {B.UPLOADS} SELECT c.call_id, has_original OR u.call_id IS NOT NULL AS has_original, u.call_id IS NOT NULL AND NOT has_original AS attached, "
       "CASE WHEN u.call_id IS NOT NULL AND NOT has_original THEN coalesce(trim(file_name), concat('Bando_', CAST(c.call_id AS VARCHAR), '.pdf')) END AS file_name "
       "FROM calls c LEFT JOIN uploads u ON u.call_id = c.call_id AND starts_with(content_text, '%PDF')")
def attach_if_missing(spark, sf):
    return U.attach_missing(T.calls(spark, sf).select("call_id", "has_original"), T.uploads(spark, sf))


@query("purge_pending", f"WITH {B.CALLS}, {B.STORED} SELECT match_id, call_id, company_id FROM stored WHERE call_id NOT IN (SELECT call_id FROM calls WHERE review_status <> 'validato')")
def purge_pending(spark, sf):
    return U.purge_pending(T.stored_matches(spark, sf), T.calls(spark, sf)).select("match_id", "call_id", "company_id")


@query("cascade_delete", f"WITH {B.CALLS}, {B.STORED} SELECT match_id, call_id, company_id FROM stored WHERE call_id IN (SELECT call_id FROM calls WHERE coalesce(issuer, '') <> 'Brand#7') AND company_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE')")
def cascade_delete(spark, sf):
    """Matches left after one issuer's calls and one segment's companies are deleted."""
    calls = T.calls(spark, sf).select("call_id", "issuer")
    customer = T.table(spark, sf, "customer")
    companies = customer.select(F.col("c_custkey").alias("company_id"))
    gone_calls = calls.filter("issuer = 'Brand#7'").select("call_id")
    gone = customer.filter("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("company_id"))
    return U.cascade(calls, companies, T.stored_matches(spark, sf), gone_calls, gone)[2].select("match_id", "call_id", "company_id")


@query("match_upsert", B.with_pairs(
    "SELECT match_id, call_id, company_id, coalesce(f.score, s.score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY call_id, company_id ORDER BY match_id) AS r FROM stored) s "
    "FULL JOIN (SELECT call_id, company_id, score, 1 AS r FROM pairs WHERE score >= 85 AND review_status = 'validato') f USING (call_id, company_id, r)").replace(" SELECT match_id", f", {B.STORED} SELECT match_id", 1))
def match_upsert(spark, sf):
    stored = T.stored_matches(spark, sf)
    calls = funds(spark, sf).filter("review_status = 'validato'").withColumn("call_bit", U.map_bit())
    companies = firms(spark, sf).join(U.match_maps(stored), "company_id", "left")
    return U.merge_mapped(stored, M.scores(calls, companies, 85, of_call=("call_bit",), of_company=("match_map",)))


@query("revalidate_calls", B.with_pairs(
    "SELECT call_id, company_id, score FROM stored WHERE call_id IN (SELECT call_id FROM calls WHERE review_status = 'validato') "
    "UNION ALL SELECT call_id, company_id, score FROM pairs WHERE review_status <> 'validato'").replace(" SELECT call_id, company_id, score FROM stored", f", {B.STORED} SELECT call_id, company_id, score FROM stored", 1))
def revalidate_calls(spark, sf):
    """All pending calls are confirmed: their old matches go and they meet every company afresh."""
    calls = funds(spark, sf)
    kept = U.purge_pending(T.stored_matches(spark, sf), calls).select("call_id", "company_id", "score")
    fresh = M.scores(calls.filter("review_status <> 'validato'"), firms(spark, sf))
    return kept.unionByName(fresh)


_CLEAN = {
    "legal_name": "trim(legal_name)", "vat_number": "nullif(trim(vat_number), '')", "sector_code": "nullif(trim(sector_code), '')",
    "activity_description": "nullif(trim(activity_description), '')", "region": "trim(region)", "revenue": "revenue", "size_class": "size_class",
    "founded_on": "founded_on", "employees": "nullif(employees, 0)", "legal_form": "trim(legal_form)",
}
_CLEAN_SQL = "company_id, " + ", ".join(f"{e} AS {n}" for n, e in _CLEAN.items())
_COMPANY = "company_id, " + ", ".join(_CLEAN)


@query("company_upsert", f"WITH {B.COMPANIES}, {B.FORMS_IN} SELECT {_CLEAN_SQL} FROM company_forms UNION ALL SELECT {_COMPANY} FROM companies WHERE company_id NOT IN (SELECT company_id FROM company_forms)")
def company_upsert(spark, sf):
    return U.upsert(T.companies(spark, sf), U.clean_company(T.company_forms(spark, sf)), "company_id")


def _changes_sql() -> str:
    """All pairs of the tables before and after the forms, compared."""
    before = B.COMPANIES.replace("companies AS", "companies_before AS", 1)
    both = (f"companies AS MATERIALIZED (SELECT {_COMPANY}, FALSE AS after FROM companies_before UNION ALL SELECT {_COMPANY}, TRUE FROM companies_before WHERE company_id NOT IN (SELECT company_id FROM company_forms) "
            f"UNION ALL SELECT {_CLEAN_SQL}, TRUE FROM company_forms)")
    return (f"WITH {before}, {B.FORMS_IN}, {both}, {B.CALLS}, {B.SECTIONS}, {B.FORMS}, {B.FIRMS}, {B.FUNDS}, {B.PAIRS}, good AS MATERIALIZED (SELECT call_id, company_id, after, score FROM pairs WHERE score >= 75) "
            "SELECT CASE WHEN n.score IS NULL THEN 'delete' WHEN o.score IS NULL THEN 'insert' ELSE 'update' END AS change, call_id, company_id, n.score "
            "FROM (SELECT * FROM good WHERE NOT after) o FULL JOIN (SELECT * FROM good WHERE after) n USING (call_id, company_id) WHERE o.score IS DISTINCT FROM n.score")


@query("match_changes", _changes_sql())
def match_changes(spark, sf):
    """What stored matches at or above 75 need after companies were saved from their forms."""
    forms = P.prepare_companies(U.clean_company(T.company_forms(spark, sf)), AS_OF)
    calls, companies = funds(spark, sf), firms(spark, sf)
    # of the stored matches only those of saved companies are read, so no others are made
    stored = M.scores(calls, companies.join(forms.select("company_id"), "company_id", "left_semi"), 75)
    return maintenance.match_changes(stored, calls, companies, new_companies=forms, threshold=75)


def _size_errors_sql() -> str:
    arms = []
    for name, low, high, cap in (("micro", None, 9, 2000000), ("piccola", None, 49, 10000000), ("media", None, 249, 50000000), ("grande", 250, None, None)):
        cond = f"lower(trim(size_class)) = '{name}'"
        if high is not None:
            arms.append(f"CASE WHEN {cond} AND employees > {high} THEN concat('Un''impresa ''', size_class, ''' non può avere più di {high} dipendenti (inseriti: ', employees, ')') END")
        if low is not None:
            arms.append(f"CASE WHEN {cond} AND employees < {low} THEN concat('Un''impresa ''', size_class, ''' deve avere almeno {low} dipendenti (inseriti: ', employees, ')') END")
        if cap is not None:
            arms.append(f"CASE WHEN {cond} AND revenue > {cap} THEN concat('Un''impresa ''', size_class, ''' non può avere fatturato superiore a € {cap:,} (inserito: € ', {B.grouped('revenue')}, ')') END")
    return ", ".join(arms)


@query("size_coherence", f"WITH {B.COMPANIES}, {B.FORMS_IN} SELECT company_id, origin, array_to_string(list_filter([{_size_errors_sql()}], lambda e: e IS NOT NULL), '|') AS errors FROM "
       "(SELECT company_id, size_class, revenue, employees, 'stored' AS origin FROM companies UNION ALL SELECT company_id, size_class, revenue, employees, 'form' FROM company_forms)")
def size_coherence(spark, sf):
    columns = ["company_id", "size_class", "revenue", "employees"]
    both = T.companies(spark, sf).select(*columns, F.lit("stored").alias("origin")).unionByName(
        T.company_forms(spark, sf).select(*columns, F.lit("form").alias("origin")))
    return both.select("company_id", "origin", F.array_join(sizes.size_errors(), "|").alias("errors"))


@query("company_form_errors", f"WITH {B.FORMS_IN} SELECT company_id, array_to_string(list_filter(["
       "CASE WHEN trim(coalesce(legal_name, '')) = '' THEN 'La ragione sociale è obbligatoria.' END, "
       "CASE WHEN trim(coalesce(vat_number, '')) = '' THEN 'La Partita IVA è obbligatoria.' WHEN NOT regexp_full_match(trim(vat_number), '\\d{11}') THEN 'La Partita IVA non è valida. Deve contenere esattamente 11 numeri (niente lettere o spazi).' END, "
       "CASE WHEN trim(coalesce(sector_code, '')) = '' THEN 'Il Codice ATECO è obbligatorio.' WHEN NOT regexp_full_match(trim(sector_code), '\\d{2}\\.\\d{2}(\\.\\d{2})?') THEN 'Il Codice ATECO non è valido. Usa il formato corretto, es: 62.01 o 62.01.12' END, "
       "CASE WHEN trim(coalesce(legal_form, '')) = '' THEN 'La forma giuridica è obbligatoria.' END, "
       f"{_size_errors_sql()}], lambda e: e IS NOT NULL), '|') AS errors FROM company_forms")
def company_form_errors(spark, sf):
    return T.company_forms(spark, sf).select("company_id", F.array_join(sizes.form_errors(), "|").alias("errors"))


_JSON_LIST = "concat('[', array_to_string(list_transform({c}, lambda x: concat('\"', x, '\"')), ','), ']')"


@query("call_denormalised", f"{_CALLS} SELECT call_id, title, issuer, deadline, {_JSON_LIST.format(c='sector_codes')} AS sector_codes, {_JSON_LIST.format(c='regions')} AS regions, "
       "nullif(array_to_string(list_filter(['micro', 'piccola', 'media', 'grande'], lambda s: list_contains(sizes, s)), ','), '') AS sizes, contribution_max, review_status FROM calls")
def call_denormalised(spark, sf):
    order = F.array(*[F.lit(s) for s in ("micro", "piccola", "media", "grande")])
    flat = F.array_join(F.filter(order, lambda s: F.array_contains(F.col("sizes"), s)), ",")
    return T.calls(spark, sf).select(
        "call_id", "title", "issuer", "deadline", F.to_json("sector_codes").alias("sector_codes"), F.to_json("regions").alias("regions"),
        F.when(flat != "", flat).alias("sizes"), "contribution_max", "review_status")
