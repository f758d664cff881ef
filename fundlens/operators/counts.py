"""Pair counts without pairs: each side is counted by its attribute values first, and only values meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .eligibility import FAIL, OK, UNKNOWN

#: Value ranges in which running counts are made apart from each other.
RANGES = 4096


def ranks(values: DataFrame, limits: DataFrame) -> DataFrame:
    """x, below, at_most: for each distinct x of ``limits`` how many values (v, n) are smaller, and not larger.

    Both sides are cut into equal ranges between the smallest and the largest value; running counts are made inside a
    range, and over the totals of the ranges.
    """
    marks = values.select(F.col("v").cast("double").alias("x"), "n", F.lit(False).alias("asked")).unionByName(
        limits.select(F.col("x").cast("double").alias("x")).distinct().select("x", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked"))
    ).filter("x IS NOT NULL")
    points = marks.groupBy("x").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    ends = points.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.least(F.floor((F.col("x") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)) * RANGES), F.lit(RANGES))
    ranged = points.join(F.broadcast(ends)).withColumn("range", place)  # one row: smallest and largest value
    before = ranged.groupBy("range").agg(F.sum("n").alias("total")).select(
        F.col("range").alias("r"), (F.sum("total").over(W.orderBy("range")) - F.col("total")).alias("before")
    )
    inside = ranged.withColumn("upto", F.sum("n").over(W.partitionBy("range").orderBy("x")))
    return inside.join(before, F.col("range") == F.col("r")).filter("asked").select(
        "x", (F.col("before") + F.col("upto") - F.col("n")).alias("below"), (F.col("before") + F.col("upto")).alias("at_most")
    )


def _by(companies: DataFrame, column: str) -> DataFrame:
    return companies.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))


def _listed(calls: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Pairs whose company value is in the call's list."""
    asked = calls.select(F.explode(F.array_distinct(column)).alias("v")).groupBy("v").agg(F.count("*").alias("m"))
    return asked.join(values, "v").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("pairs"))


def funnel(calls: DataFrame, companies: DataFrame) -> DataFrame:
    """position, criterion, outcome, pairs over all calls and companies (prepared sides), pairs > 0 only."""
    everyone = companies.agg(
        F.count("*").alias("all"),
        *(F.count(c).alias(f"has_{c}") for c in ("f_months", "f_size", "f_revenue", "f_employees", "f_region")),
        F.count_if(F.coalesce(F.col("f_revenue"), F.lit(0.0)) != 0).alias("earning"),
        F.count_if(F.coalesce(F.col("f_form") != "", F.lit(False))).alias("has_form"),
        F.count_if(F.coalesce(F.col("f_form") != "", F.lit(False)) & F.col("f_category").isNotNull()).alias("has_category"),
    )
    rows = []

    def add(position: int, criterion: str, counts: DataFrame, **outcomes: Column) -> None:
        entries = F.array(*(F.struct(F.lit(o).alias("outcome"), c.cast("bigint").alias("pairs")) for o, c in outcomes.items()))
        listed = counts.join(F.broadcast(everyone)).select(F.explode(entries).alias("e"))  # both are single rows
        rows.append(listed.select(F.lit(position).alias("position"), F.lit(criterion).alias("criterion"), "e.outcome", "e.pairs"))

    def threshold(position: int, criterion: str, limit: str, active: Column, value: str, failing: Column) -> None:
        asked = calls.filter(active).groupBy(F.col(limit).cast("double").alias("x")).agg(F.count("*").alias("m"))
        found = asked.join(ranks(_by(companies, value), asked), "x", "left")
        counts = found.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("active"), F.coalesce(F.sum(F.col("m") * failing), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.col("m") * F.col("at_most")), F.lit(0)).alias("within"))
        known, active_calls = F.col(f"has_{value}"), F.col("active")
        failed = F.col("failed") if criterion == "min_age" else active_calls * known - F.col("within")
        add(position, criterion, counts, **{FAIL: failed, OK: active_calls * known - failed, UNKNOWN: active_calls * (F.col("all") - known)})

    def membership(position: int, criterion: str, some: DataFrame, column: str, value: str) -> None:
        counts = _listed(some, column, _by(companies, value)).join(F.broadcast(some.agg(F.count("*").alias("active"))))
        known = F.col(f"has_{value}")
        add(position, criterion, counts, **{FAIL: F.col("active") * known - F.col("pairs"), OK: F.col("pairs"), UNKNOWN: F.col("active") * (F.col("all") - known)})

    threshold(1, "min_age", "min_age_months", F.col("min_age_months") > 0, "f_months", F.col("below"))
    threshold(2, "max_age", "max_age_months", F.col("max_age_months") > 0, "f_months", F.lit(0))
    add(3, "section", _listed(calls, "k_sections", _by(companies, "f_section")), **{FAIL: F.col("pairs")})

    formed = calls.filter(F.size("k_forms") > 0)
    bound = formed.filter(~F.col("k_registry"))
    named = companies.filter(F.coalesce(F.col("f_form") != "", F.lit(False)))
    counts = (
        _listed(bound, "k_categories", _by(named.filter("f_category IS NOT NULL"), "f_category")).withColumnRenamed("pairs", "by_category")
        .join(F.broadcast(_listed(bound, "k_unknown_forms", _by(named.filter("f_category IS NULL"), "f_form")).withColumnRenamed("pairs", "by_text")))
        .join(F.broadcast(formed.agg(F.count("*").alias("active"), F.count_if("k_registry").alias("open"))))
    )
    strict = F.col("active") - F.col("open")
    add(4, "legal_form", counts, **{
        FAIL: strict * F.col("has_category") - F.col("by_category"),
        OK: F.col("open") * F.col("has_form") + F.col("by_category") + F.col("by_text"),
        UNKNOWN: F.col("active") * (F.col("all") - F.col("has_form")) + strict * (F.col("has_form") - F.col("has_category")) - F.col("by_text"),
    })

    spending = calls.filter("min_spend > 0").agg(F.count("*").alias("active"))
    add(5, "min_spend", spending, **{OK: F.col("active") * F.col("earning"), UNKNOWN: F.col("active") * (F.col("all") - F.col("earning"))})
    membership(6, "size", calls.filter(F.size("k_sizes") > 0), "k_sizes", "f_size")
    threshold(7, "revenue_cap", "k_cap", F.col("k_cap").isNotNull(), "f_revenue", F.lit(0))

    staffed = calls.filter("employees_min IS NOT NULL OR employees_max IS NOT NULL").groupBy("employees_min", "employees_max").agg(F.count("*").alias("m"))
    limits = staffed.select(F.explode(F.array("employees_min", "employees_max")).alias("x"))
    placed = ranks(_by(companies, "f_employees"), limits)
    few = placed.select(F.col("x").alias("x_min"), F.col("below").alias("few"))
    within = placed.select(F.col("x").alias("x_max"), F.col("at_most").alias("within"))
    joined = staffed.join(few, F.col("employees_min").cast("double") == F.col("x_min"), "left").join(within, F.col("employees_max").cast("double") == F.col("x_max"), "left")
    # companies within both limits: at most the larger one, less those under the smaller one
    fitting = F.greatest(F.coalesce("within", F.col("has_f_employees")) - F.coalesce("few", F.lit(0)), F.lit(0))
    counts = joined.join(F.broadcast(everyone.select("has_f_employees"))).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("active"), F.coalesce(F.sum(F.col("m") * fitting), F.lit(0)).alias("fitting"))
    known = F.col("has_f_employees")
    add(8, "employees", counts, **{FAIL: F.col("active") * known - F.col("fitting"), OK: F.col("fitting"), UNKNOWN: F.col("active") * (F.col("all") - known)})
    membership(9, "region", calls.filter(~F.col("k_region_free")), "k_regions", "f_region")

    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.filter("pairs > 0")


# -- words shared by activities and descriptions ------------------------------------------------------------------

#: Descriptions that hold one word and meet an activity in one task; words of more are split.
SPREAD = 65_536


def _excluded(calls: DataFrame, companies: DataFrame) -> DataFrame:
    """call_id, gone, gone_silent: companies of sections that a call excludes, and those of them without description."""
    by_section = companies.where("f_section is not null").groupBy(F.col("f_section").alias("section")).agg(F.count("*").alias("n"), F.count_if(F.col("f_tokens").isNull()).alias("silent"))
    named = calls.select("call_id", F.explode(F.array_distinct("k_sections")).alias("section"))
    return named.join(by_section, "section").groupBy("call_id").agg(F.sum("n").alias("gone"), F.sum("silent").alias("gone_silent"))


def overlaps(calls: DataFrame, companies: DataFrame) -> DataFrame:
    """call_id, good, partial: companies whose description shares two or more words, or one, with an admitted activity.

    calls: call_id, k_activities, k_sections; companies of excluded sections do not count. Words are postings on both
    sides: equal activities of all calls and equal descriptions of all companies meet once a shared word, and never
    otherwise. A word of very many descriptions is dealt out over several tasks.
    """
    signs = calls.where(F.size("k_activities") > 0).withColumn("sign", F.xxhash64("k_activities", F.array_sort(F.array_distinct("k_sections"))))
    each = signs.groupBy("sign").agg(F.first("k_activities").alias("k_activities"), F.first("k_sections").alias("k_sections"))
    texts = companies.where("f_tokens is not null").groupBy("f_tokens", "f_section").agg(F.count("*").alias("n"))
    told = texts.select(F.xxhash64("f_tokens", "f_section", F.col("f_section").isNull()).alias("text"), "f_section", "n", F.explode(F.array_distinct("f_tokens")).alias("word"))
    admitted = each.select("sign", "k_sections", F.posexplode("k_activities").alias("activity", "words")).select("sign", "k_sections", "activity", F.explode(F.array_distinct("words")).alias("word"))
    busy = told.groupBy("word").count().where(F.col("count") > SPREAD).select(F.col("word").alias("_w"), F.ceil(F.col("count") / SPREAD).cast("int").alias("parts"))
    left = admitted.join(busy, F.col("word") == F.col("_w"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("_w", "parts")
    right = told.join(busy, F.col("word") == F.col("_w"), "left").withColumn("part", F.pmod("text", F.coalesce("parts", F.lit(1))).cast("int")).drop("_w", "parts")
    met = left.join(right, ["word", "part"]).where(~F.coalesce(F.array_contains("k_sections", F.col("f_section")), F.lit(False)))
    shared = met.groupBy("sign", "text", "activity").agg(F.count("*").alias("words"), F.first("n").alias("n"))
    best = shared.groupBy("sign", "text").agg(F.max("words").alias("words"), F.first("n").alias("n"))
    counted = best.groupBy("sign").agg(F.sum(F.when(F.col("words") >= 2, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("words") == 1, F.col("n")).otherwise(0)).alias("partial"))
    return signs.select("call_id", "sign").join(counted, "sign").drop("sign")


def activity_counts(calls: DataFrame, companies: DataFrame) -> DataFrame:
    """call_id, everyone, gone, good, partial, silent: all companies, those of excluded sections, and of the others those
    that share two words or more, one word, or have no description; the rest shares none. One row a call."""
    everyone = companies.agg(F.count("*").alias("everyone"), F.count_if(F.col("f_tokens").isNull()).alias("all_silent"))
    zero = F.lit(0).cast("long")
    return (
        calls.join(F.broadcast(everyone))  # one row
        .join(overlaps(calls, companies), "call_id", "left")
        .join(_excluded(calls, companies), "call_id", "left")
        .withColumns({n: F.coalesce(n, zero) for n in ("gone", "good", "partial", "gone_silent")})
        .withColumn("silent", F.col("all_silent") - F.col("gone_silent"))
        .drop("all_silent", "gone_silent")
    )


def code_counts(calls: DataFrame, companies: DataFrame) -> DataFrame:
    """call_id, same_code, same_prefix: companies outside the excluded sections whose code, or else prefix, a call names."""
    values = companies.groupBy("f_code", "f_prefix", "f_section").agg(F.count("*").alias("n"))
    gone = F.coalesce(F.array_contains("k_sections", F.col("f_section")), F.lit(False))
    sides = calls.select("call_id", "k_codes", "k_prefixes", "k_sections")
    by_code = sides.withColumn("f_code", F.explode(F.array_distinct("k_codes"))).join(values, "f_code").where(~gone).groupBy("call_id").agg(F.sum("n").alias("same_code"))
    named = F.coalesce(F.array_contains("k_codes", F.col("f_code")), F.lit(False))
    by_prefix = sides.withColumn("f_prefix", F.explode(F.array_distinct("k_prefixes"))).where(F.length("f_prefix") >= 2).join(values, "f_prefix").where(~gone & ~named).groupBy("call_id").agg(F.sum("n").alias("same_prefix"))
    return calls.select("call_id").join(by_code, "call_id", "left").join(by_prefix, "call_id", "left").select("call_id", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("same_code", "same_prefix")))
