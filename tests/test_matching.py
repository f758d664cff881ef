import datetime

import pytest
from pyspark.sql import functions as F

from fundlens.operators import cards, eligibility as E, matching as M, profiles as P, upkeep
from fundlens.plans import match_queries as Q

DAY = datetime.date(2024, 6, 1)
CALL = dict(
    call_id=1, title="t", issuer="e", deadline=None, open_to_all=False, sector_codes=[], activities=[], regions=[], sizes=[], revenue_max=None,
    contribution_max=None, min_spend=None, excluded_sections=[], legal_forms=[], min_age_months=None, max_age_months=None, employees_min=None,
    employees_max=None, review_status="validato")
FIRM = dict(
    company_id=1, legal_name="Acme Srl", sector_code="62.01", activity_description="sviluppo software applicativo", region="Lombardia", revenue=100000.0,
    size_class="piccola", founded_on=datetime.date(2020, 1, 31), employees=20, legal_form="srl")
CALL_SCHEMA = (
    "call_id bigint, title string, issuer string, deadline string, open_to_all boolean, sector_codes array<string>, activities array<string>, regions array<string>, "
    "sizes array<string>, revenue_max double, contribution_max double, min_spend double, excluded_sections array<string>, legal_forms array<string>, min_age_months int, "
    "max_age_months int, employees_min int, employees_max int, review_status string")
FIRM_SCHEMA = (
    "company_id bigint, legal_name string, sector_code string, activity_description string, region string, revenue double, size_class string, founded_on date, employees int, legal_form string")


def frames(spark, calls, firms):
    c = [tuple({**CALL, "call_id": i, **x}.values()) for i, x in enumerate(calls)]
    f = [tuple({**FIRM, "company_id": i, **x}.values()) for i, x in enumerate(firms)]
    return (P.prepare_calls(spark.createDataFrame(c, CALL_SCHEMA)), P.prepare_companies(spark.createDataFrame(f, FIRM_SCHEMA), DAY))


CASES = [  # call, company, region, sector, size, revenue, status
    ({}, {}, 30, 20, 20, 10, "da_verificare"),
    ({"open_to_all": True}, {}, 30, 40, 20, 10, "ok"),
    ({"sector_codes": ["62.01"]}, {}, 30, 40, 20, 10, "ok"),
    ({"sector_codes": [" 62.02 "]}, {}, 30, 20, 20, 10, "ok"),
    ({"sector_codes": ["10.01"]}, {}, 30, 0, 20, 10, "ok"),
    ({"sector_codes": ["62.01"]}, {"sector_code": " "}, 30, 0, 20, 10, "ok"),
    ({"sector_codes": ["6.2"]}, {"sector_code": "6.1"}, 30, 0, 20, 10, "ok"),
    ({"activities": ["sviluppo software", "altro"]}, {}, 30, 30, 20, 10, "ok"),
    ({"activities": ["software gestionale"]}, {}, 30, 15, 20, 10, "ok"),
    ({"activities": ["agricoltura"]}, {}, 30, 0, 20, 10, "ok"),
    ({"activities": ["agricoltura"]}, {"activity_description": ""}, 30, 15, 20, 10, "ok"),
    ({"open_to_all": True, "excluded_sections": ["Sezione J"]}, {}, 30, 0, 20, 10, "ok"),
    ({"regions": ["Lazio"]}, {}, 0, 20, 20, 10, "ok"),
    ({"regions": ["LOMBARDIA "]}, {}, 30, 20, 20, 10, "ok"),
    ({"regions": ["Tutte"]}, {}, 30, 20, 20, 10, "ok"),
    ({"regions": ["Tutta Italia"]}, {}, 30, 20, 20, 10, "da_verificare"),
    ({"regions": ["Lazio"]}, {"region": None}, 0, 20, 20, 10, "ok"),
    ({"sizes": ["micro"]}, {}, 30, 20, 0, 10, "ok"),
    ({"sizes": ["micro", "piccola", "media", "grande"]}, {}, 30, 20, 20, 10, "da_verificare"),
    ({"revenue_max": 50000.0}, {}, 30, 20, 20, 0, "ok"),
    ({"revenue_max": 50000.0}, {"revenue": None}, 30, 20, 20, 10, "ok"),
    ({"revenue_max": 0.0}, {}, 30, 20, 20, 0, "da_verificare"),
]


def test_scores(spark):
    for blocks in (None, 3):
        calls, firms = frames(spark, [c[0] for c in CASES], [c[1] for c in CASES])
        rows = M.score_pairs(calls, firms, blocks=blocks).filter("call_id = company_id").collect()
        got = {r.call_id: (r.region_score, r.sector_score, r.size_score, r.revenue_score, r.score_status) for r in rows}
        assert [got[i] for i in range(len(CASES))] == [c[2:] for c in CASES]


FAIL, OK, UNKNOWN = E.FAIL, E.OK, E.UNKNOWN
RULES = [  # call, company, {criterion: outcome}, part of a message
    ({}, {}, {}, ""),
    ({"min_age_months": 60}, {}, {"min_age": FAIL}, "Azienda costituita da 53 mesi, richiesti almeno 60"),
    ({"min_age_months": 24}, {}, {"min_age": OK}, "OK (53 mesi su 24 richiesti)"),
    ({"min_age_months": 0}, {}, {}, ""),
    ({"max_age_months": 12}, {"founded_on": None}, {"max_age": UNKNOWN}, "non verificabile"),
    ({"max_age_months": 12}, {}, {"max_age": FAIL}, "limite massimo 12"),
    ({"excluded_sections": ["J"]}, {}, {"section": FAIL}, "Codice ATECO 62.01 (Sezione J) escluso dal bando"),
    ({"legal_forms": ["società di capitali"]}, {}, {"legal_form": OK}, "Forma giuridica: OK (srl)"),
    ({"legal_forms": ["cooperative"]}, {}, {"legal_form": FAIL}, "Forma giuridica 'srl' (società di capitali) non inclusa tra le ammesse: cooperative"),
    ({"legal_forms": ["cooperative"]}, {"legal_form": "trust"}, {"legal_form": UNKNOWN}, "'trust' non riconosciuta"),
    ({"legal_forms": ["Trust"]}, {"legal_form": "trust"}, {"legal_form": OK}, "OK (trust)"),
    ({"legal_forms": ["cooperative"]}, {"legal_form": None}, {"legal_form": UNKNOWN}, "non verificabile"),
    ({"legal_forms": ["iscritte al Registro Imprese"]}, {"legal_form": "trust"}, {"legal_form": OK}, "aperto a tutte le forme"),
    ({"min_spend": 200000.0}, {}, {"min_spend": OK}, "fatturato € 100,000 inferiore alla spesa minima di € 200,000"),
    ({"min_spend": 200000.0}, {"revenue": 0.0}, {"min_spend": UNKNOWN}, "Spesa minima: non verificabile"),
    ({"sizes": ["micro", "media"]}, {}, {"size": FAIL}, "Dimensione 'piccola' non ammessa dal bando (ammesse: micro, media)"),
    ({"sizes": ["micro"]}, {"size_class": None}, {"size": UNKNOWN}, "dato cliente assente"),
    ({"revenue_max": 50000.0}, {}, {"revenue_cap": FAIL}, "Fatturato € 100,000 supera il limite di € 50,000"),
    ({"revenue_max": 50000.0}, {"revenue": None}, {"revenue_cap": UNKNOWN}, "dato cliente assente"),
    ({"employees_min": 30}, {}, {"employees": FAIL}, "Numero dipendenti insufficiente: 20 (richiesti almeno 30)"),
    ({"employees_max": 10}, {}, {"employees": FAIL}, "Numero dipendenti troppo alto: 20 (massimo 10)"),
    ({"employees_max": 10}, {"employees": None}, {"employees": UNKNOWN}, "dato cliente assente"),
    ({"regions": ["Lazio"]}, {}, {"region": FAIL}, "Regione 'Lombardia' non ammessa dal bando (ammesse: Lazio)"),
    ({"regions": ["tutte"]}, {}, {}, ""),
    ({"regions": ["Lazio"]}, {"region": " "}, {"region": UNKNOWN}, "dato cliente assente"),
]


def test_eligibility(spark):
    calls, firms = frames(spark, [r[0] for r in RULES], [r[1] for r in RULES])
    pairs = M.candidates(calls, firms).filter("call_id = company_id")
    rows = E.check_rows(pairs, "call_id").collect()
    verdicts = {r.call_id: r.ok for r in pairs.select("call_id", E.is_eligible().alias("ok")).collect()}
    for i, (_, _, outcomes, message) in enumerate(RULES):
        mine = [r for r in rows if r.call_id == i]
        assert {r.criterion: r.outcome for r in mine} == outcomes, i
        assert message in " ".join(r.message for r in mine), i
        assert verdicts[i] == (FAIL not in outcomes.values()), i


@pytest.mark.parametrize("threshold", [0, 45, 61, 65, 71, 75, 85, 95, 100])
def test_pruned_join_finds_what_the_full_matrix_finds(spark, sf, threshold):
    """Pruned broadcast way and block way against a filter over all pairs."""
    calls, firms = Q.funds(spark, sf), Q.firms(spark, sf)
    everything = M.score_pairs(calls, firms).filter(F.col("score") >= threshold).select("call_id", "company_id", "score")
    for blocks in (None, 5):
        pruned = M.score_pairs(calls, firms, threshold, blocks).filter(F.col("score") >= threshold).select("call_id", "company_id", "score")
        assert pruned.count() == everything.count()
        assert pruned.exceptAll(everything).isEmpty()


def test_pruned_plans_are_equi_joins(spark, sf):
    for blocks in (None, 5):
        plan = M.score_pairs(Q.funds(spark, sf), Q.firms(spark, sf), 75, blocks)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert ("BroadcastHashJoin" in plan.split("pair_key")[0]) or blocks


def test_eligible_pairs_are_exactly_the_eligible_ones(spark, sf):
    calls, firms = Q.funds(spark, sf), Q.firms(spark, sf)
    everything = M.candidates(calls, firms).filter(E.is_eligible()).select("call_id", "company_id")
    for blocks in (None, 4):
        found = E.eligible_pairs(calls, firms, blocks).select("call_id", "company_id")
        assert found.count() == everything.count() and found.exceptAll(everything).isEmpty()


def test_hot_region_is_spread_over_all_tasks(spark):
    """Companies that all sit in one region still run on every task."""
    calls, firms = frames(spark, [{"regions": ["Lazio"]}], [{"region": "Lazio"}] * 400)
    tasks = M.score_pairs(calls, firms, 75).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 4


def test_ineligible_pairs_have_reasons(spark, sf):
    calls, firms = Q.funds(spark, sf), Q.firms(spark, sf)
    odd = M.candidates(calls, firms).select(E.is_eligible().alias("e"), E.count_outcomes(FAIL).alias("n")).filter("e != (n = 0)")
    assert odd.isEmpty()


def test_deduplication_is_idempotent(spark, sf):
    calls = Q.funds(spark, sf).select("call_id", "title", "issuer")
    once = upkeep.deduplicate(calls)
    assert once.count() < calls.count()
    assert upkeep.deduplicate(once).count() == once.count()


def test_cards_merge_by_company_name(spark):
    """The better score of a name wins, wherever it comes from, and its verdict counts."""
    schema = "call_id bigint, company_id bigint, legal_name string, match_id bigint, stored_score int, eligible boolean, score_status string"
    rows = spark.createDataFrame([
        (1, 1, "Alfa", 1, 90, False, "ok"), (2, 1, "Alfa", 2, 60, True, "ok"), (1, 2, "Beta", 3, 40, True, "ok"), (3, 1, "Alfa", 4, 55, True, "da_verificare"), (3, 9, "Alfa", 5, 50, True, "ok")], schema)
    faces = spark.createDataFrame([(1, " Bando Uno", "ENTE"), (2, "bando uno", "ente"), (3, "Altro", None)], "call_id bigint, title string, issuer string")
    merged = cards.merged_matches(rows, cards.group_cards(faces))
    assert {(r.card_id, r.legal_name, r.stored_score, r.eligible) for r in merged.collect()} == {
        (2, "Alfa", 90, False), (2, "Beta", 40, True), (3, "Alfa", 55, True), (3, "Alfa", 50, True)}
    best = {r.card_id: r.best_eligible for r in cards.summarise(merged, "card_id").collect()}
    assert best == {2: 40, 3: 50}


def test_cards_read_stored_matches_once(spark, sf):
    """Cards and their best matches take all they show from one pass over the enriched matches."""
    from fundlens.plans.catalog import QUERIES

    for name in ("category_counts", "sorted_cards", "best_match"):
        leaves = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().collectLeaves()
        found = [leaves.apply(i).toString() for i in range(leaves.size())]
        assert sum("l_linenumber" in leaf for leaf in found) == 1


def test_cards_send_on_only_what_they_show(spark, sf):
    """Stored matches come dealt out by company, and of a match a card takes its score and verdict."""
    from fundlens.plans.catalog import QUERIES
    from fundlens.sources import tables

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.stored_matches(spark, sf, by_company=True).groupBy("company_id").count()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3  # both sides by order, then by company
        card = QUERIES["sorted_cards"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "max_by(" not in card and "max(struct(stored_score" in card
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
