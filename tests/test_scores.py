from pyspark.sql import functions as F
from test_matching import CASES, frames

from fundlens.operators import matching as M, upkeep as U


def triples(df):
    return sorted(map(tuple, df.select("call_id", "company_id", "score").collect()))


def test_scores_by_kind_are_those_by_pair(spark):
    """Also where a part has more kinds of calls than are tabled, and where sides meet in blocks."""
    calls, firms = frames(spark, [c[0] for c in CASES], [c[1] for c in CASES])
    for threshold in (0, 75):
        expected = triples(M.score_pairs(calls, firms, threshold))
        assert expected
        for some in ({}, {"kinds": 2}, {"blocks": 3}):
            assert triples(M.scores(calls, firms, threshold, **some)) == expected
    assert M.scores(calls.limit(0), firms).count() == 0


def test_nested_lists_are_different_kinds(spark):
    """Words dealt to activities in another way are another kind: one word shared with each is less than two with one."""
    calls, firms = frames(spark, [{"activities": ["sviluppo software"]}, {"activities": ["sviluppo", "software"]}], [{}])
    assert triples(M.scores(calls, firms)) == triples(M.score_pairs(calls, firms)) == [(0, 0, 90), (1, 0, 75)]


def test_merge_by_map_is_the_merge(spark):
    """Stored pairs are updated in their oldest row; pairs outside the map are new. Before, every fresh pair was shuffled."""
    stored = spark.createDataFrame([(i, i % 7, i % 5, i) for i in range(60)], "match_id long, call_id long, company_id long, score int")
    fresh = spark.createDataFrame([(c, f, 100 + c) for c in range(9) for f in range(8)], "call_id long, company_id long, score int")
    mapped = fresh.withColumn("call_bit", U.map_bit()).join(U.match_maps(stored), "company_id", "left")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got, expected = (sorted(map(tuple, d.select("match_id", "call_id", "company_id", "score").collect()), key=key) for d in (U.merge_mapped(stored, mapped), U.merge_scores(stored, fresh)))
    assert got == expected
    known = stored.select("call_id", "company_id").distinct()
    assert mapped.join(known, ["call_id", "company_id"]).filter(~U.in_map()).count() == 0
    assert mapped.filter(~U.in_map()).count() > 0
