"""Dashboard operators: stored matches enriched, summarised per call, merged over duplicate calls.

Matches stay a flat table. A card never carries its matches as an array, because one call may be
matched with millions of companies; everything a card shows is a partial aggregate instead.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, numbers as N, refdata as R, text as X
from . import eligibility as E, matching as M
from .profiles import has_constraints

CATEGORIES = ("ammissibili", "da_verificare", "non_ammissibili", "scaduti")


def enrich(matches: DataFrame, calls: DataFrame, companies: DataFrame) -> DataFrame:
    """Stored matches of validated calls with recomputed parts, status and eligibility (prepared sides)."""
    valid = calls.filter(F.col("review_status") == R.VALIDATED)
    stored = matches.withColumnRenamed("score", "stored_score")
    # calls carry lists, companies do not: calls come last, so their lists are not shuffled once per match
    rows = stored.join(companies, "company_id").join(valid, "call_id")
    parts = {name: make().cast("int") for name, make in M.PARTS.items()}
    return rows.withColumns(parts).withColumns(
        {
            "score": F.greatest(F.lit(0), F.least(F.lit(100), sum(F.col(p) for p in parts))).cast("int"),
            "score_status": M.score_status(),
            "eligible": E.is_eligible(),
        }
    )


def shown_title() -> Column:
    return F.when(F.col("title") != "", F.col("title")).otherwise(
        F.concat(F.lit("Bando #"), F.col("call_id").cast("string"))
    )


def color_class(score: Column) -> Column:
    return F.when(score > 70, "circle-green").when(score >= 40, "circle-yellow").otherwise("circle-red")


def counts_as_eligible() -> Column:
    return F.col("eligible") & (F.col("score_status") != "da_verificare")


def summarise(rows: DataFrame, *keys: str, raw: str = "stored_score") -> DataFrame:
    """Best eligible score, best score and eligibility counts per key; map-side combined."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_matches"),
        F.count_if(counts_as_eligible()).alias("n_eligible"),
        F.count_if(~F.col("eligible")).alias("n_not_eligible"),
        F.count_if(F.col("score_status") == "da_verificare").alias("n_to_verify"),
        F.max(F.when(counts_as_eligible(), F.col("stored_score"))).alias("best_eligible"),
        F.max(raw).alias("raw_best"),
    )


def with_summary(cards: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Cards with the shown scores; a pending card shows none."""
    pending = F.col("review_status") == R.PENDING
    joined = cards.join(summary, key, "left")
    shown = F.when(pending, 0).otherwise(F.coalesce("best_eligible", F.lit(0))).cast("int")
    counts = {
        c: F.when(pending, 0).otherwise(F.coalesce(c, F.lit(0))).cast("bigint")
        for c in ("n_matches", "n_eligible", "n_not_eligible", "n_to_verify")
    }
    nobody = (F.col("n_matches") > 0) & (F.col("n_matches") == F.col("n_not_eligible"))
    return joined.withColumns({"max_score": shown, **counts}).withColumns(
        {"nobody_eligible": nobody, "color_class": color_class(F.col("max_score"))}
    )


def card_faces(calls: DataFrame, as_of: datetime.date) -> DataFrame:
    """The descriptive part of a card, from prepared calls."""
    amount = F.when(
        F.col("contribution_max").isNotNull(), F.concat(F.lit("€ "), N.grouped(F.col("contribution_max")))
    ).otherwise(F.lit("N/D"))
    when = dates.italian_long(F.col("deadline"))
    no_date = when.isNull() | F.lower(when).isin("none", "null")
    return calls.select(
        "call_id",
        shown_title().alias("title"),
        "issuer",
        amount.alias("contribution_text"),
        "contribution_max",
        F.when(no_date, F.lit("N/D")).otherwise(when).alias("deadline_text"),
        dates.days_left(F.col("deadline"), as_of).alias("days_left"),
        dates.urgency(F.col("deadline"), as_of).alias("urgency"),
        has_constraints().alias("has_constraints"),
        "has_original",
        "review_status",
        "null_percentage",
        X.blank_to_null(F.col("source_url")).alias("source_url"),
    )


def group_cards(faces: DataFrame) -> DataFrame:
    """Call → card it is shown under: same title and issuer share the card of the newest call."""
    keyed = faces.select(
        "call_id",
        F.lower(F.trim("title")).alias("title_key"),
        F.coalesce(F.lower(F.trim("issuer")), F.lit("")).alias("issuer_key"),
    )
    groups = keyed.groupBy("title_key", "issuer_key").agg(
        F.max("call_id").alias("card_id"), F.count("*").alias("copies")
    )
    return keyed.join(groups, ["title_key", "issuer_key"]).select("call_id", "card_id", "copies")


def merged_matches(rows: DataFrame, grouping: DataFrame, shown: tuple[str, ...] = ("company_id", "legal_name", "eligible", "score_status")) -> DataFrame:
    """Matches per card. Within merged cards the best score per company name stays.

    Equal scores are settled by the order of the calls (best raw score, then newest). ``own_best`` is the best score that
    a row's group has from the card's own call. The enriched rows come by call, so neither asks for a second pass over them.
    What is ``shown`` of a match beside its score and id travels behind the rank, which no two matches share.
    """
    best_of_call = F.max("stored_score").over(Window.partitionBy("call_id"))
    placed = rows.withColumn("call_best", best_of_call).join(grouping, "call_id")
    merge_key = F.when(F.col("copies") > 1, F.concat(F.lit("n:"), "legal_name")).otherwise(
        F.concat(F.lit("m:"), F.col("match_id").cast("string"))
    )
    kept = F.struct("stored_score", "call_best", "call_id", (-F.col("match_id")).alias("first"), *shown)
    own = F.when(F.col("call_id") == F.col("card_id"), F.col("stored_score"))
    best = placed.groupBy("card_id", merge_key.alias("merge_key")).agg(F.max(kept).alias("m"), F.max(own).alias("own_best"))
    return best.select("card_id", *(f"m.{c}" for c in shown), "m.stored_score", (-F.col("m.first")).alias("match_id"), "own_best")


def deduplicated_cards(rows: DataFrame, calls: DataFrame, as_of: datetime.date) -> DataFrame:
    faces = card_faces(calls, as_of)
    grouping = group_cards(faces)
    summary = summarise(merged_matches(rows, grouping, ("eligible", "score_status")), "card_id", raw="own_best")
    primary = faces.join(grouping.filter(F.col("call_id") == F.col("card_id")), "call_id")
    pending = F.col("review_status") == R.PENDING
    raw_shown = F.when(pending, 0).otherwise(F.greatest(F.coalesce("raw_best", F.lit(0)), F.lit(0))).cast("int")
    return with_summary(primary, summary, "card_id").withColumn("raw_max_score", raw_shown).drop("raw_best", "best_eligible")


def category() -> Column:
    return (
        F.when(F.col("review_status") == R.PENDING, "da_verificare")
        .when(F.col("days_left") < 0, "scaduti")
        .when(F.col("n_eligible") > 0, "ammissibili")
        .when(F.col("n_to_verify") > 0, "da_verificare")
        .otherwise("non_ammissibili")
    )


def view_rank() -> Column:
    """Order of the combined view: eligible, pending, to verify, not eligible, expired."""
    return (
        F.when(F.col("category") == "ammissibili", 0)
        .when(F.col("review_status") == R.PENDING, 1)
        .when(F.col("category") == "da_verificare", 2)
        .when(F.col("category") == "non_ammissibili", 3)
        .otherwise(4)
    )


def best_match(merged: DataFrame) -> DataFrame:
    """Best eligible match of each card, or the best one when none is eligible."""
    order = F.struct(counts_as_eligible().alias("fit"), "stored_score", (-F.col("match_id")).alias("first"))
    return merged.groupBy("card_id").agg(F.max_by(F.struct("company_id", "stored_score"), order).alias("b")).select(
        "card_id", F.col("b.company_id").alias("company_id"), F.col("b.stored_score").alias("score")
    )
