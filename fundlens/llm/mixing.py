"""Mixing sources to target weights by weighted sampling without replacement, in whole epochs and one partial one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import kit

#: Key ranges per source; rows are only ordered within the one range where a source's budget ends.
RANGES = 4096
SOURCE_WEIGHTS = (1, 2, 3)
EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight: the smallest keys are a weighted sample without replacement. u comes from the id and the seed alone."""
    digits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, 13), 16, 10).cast("double")
    return -F.log((digits + 1.0) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> target too. One row a source: by code point, nulls last, sources weigh as `weights` repeat.

    All targets sum to all sizes. A target stops at `epochs` times its source; the water level of the rest is found from
    running sums over the sources ordered by how soon they are full.
    """
    whole, by_name = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumns(
        {
            "weight": F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")),
            "full": F.col("source_size") * epochs,
        }
    )
    by_level = W.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    levelled = weighed.withColumns(
        {
            "all": F.sum("source_size").over(whole),
            "full_before": F.coalesce(F.sum("full").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "weight_left": F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("all") - F.col("full_before")) / F.col("weight_left"))
    is_full = F.col("level") > F.col("full") / F.col("weight")
    rest = levelled.withColumn("level", F.max(F.when(~is_full, F.col("level"))).over(whole))
    target = F.least(F.col("full").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("full").cast("double")))
    return rest.select("source", "source_size", target.alias("target"))


def keyed(rows: DataFrame, qualities: DataFrame | None, seed: int = 42) -> DataFrame:
    """rows (doc_id, _size, any others) with _key and _range. qualities: doc_id, weight > 0; other documents weigh 1."""
    if qualities is None:
        weighed = rows.withColumn("_weight", F.lit(1.0))
    else:
        one = qualities.where(F.col("weight") > 0).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("weight").cast("double")).alias("_weight"))
        # both sides grow with the corpus: sorted and merged at any size
        weighed = rows.join(one.hint("merge"), rows["doc_id"] == one["_id"], "left").drop("_id").withColumn("_weight", F.coalesce("_weight", F.lit(1.0)))
    out = weighed.withColumn("_key", sampling_key(F.col("doc_id"), F.col("_weight"), seed)).drop("_weight")
    return out.withColumn("_range", F.least(F.floor((1 - F.exp(-F.col("_key"))) * RANGES), F.lit(RANGES - 1)).cast("int"))


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Where each source's budget ends: one row a source. rows: doc_id, source, _size, _key, _range.

    Sizes are summed per source and key range first, so a source that holds most rows is spread over all tasks; only the
    rows of the range where the budget ends are put in order. Rows that share id and key stand or fall together.
    """
    ranges = rows.groupBy("source", "_range").agg(F.sum("_size").alias("n"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("int")
    budgets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # "source" may be null: the joins compare null-safely
    b = budgets.select(F.col("source").alias("_s"), "source_size", "target", "whole", "rest")
    running = ranges.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("_range")))
    last = (
        running.join(b, F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        .select(F.col("_s").alias("_ls"), F.col("_range").alias("end_range"), (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"))
    )
    edge = rows.join(last, F.col("source").eqNullSafe(F.col("_ls")) & (F.col("_range") == F.col("end_range")))
    units = edge.groupBy("_ls", "end_range", "left", "_key", "doc_id").agg(F.sum("_size").alias("n"))
    in_order = W.partitionBy("_ls").orderBy("_key", F.col("doc_id").asc_nulls_first())
    taken = units.withColumn("upto", F.sum("n").over(in_order)).where(F.col("upto") - F.col("n") / 2 <= F.col("left"))
    ends = taken.groupBy(F.col("_ls").alias("_es")).agg(F.max(F.struct(F.col("_key").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))).alias("end"))
    return (
        b.join(last.select("_ls", "end_range"), F.col("_s").eqNullSafe(F.col("_ls")), "left")
        .join(ends, F.col("_s").eqNullSafe(F.col("_es")), "left")
        # a source that is taken as often as it may be has no partial epoch, not for empty documents either
        .select("_s", "source_size", "target", "whole", F.when(F.col("whole") < epochs, F.col("end_range")).alias("end_range"), "end")
    )


#: Most sources whose plan is sent to all tasks; with more, the plan is joined by source, and skewed sources are split at run time.
SENT_SOURCES = 100_000


def planned(rows: DataFrame) -> DataFrame:
    """The plan of all sources, ready to be joined with rows of any number a source."""
    plan = kit.stored(plan_mix(rows), "mix-plan")
    return F.broadcast(plan) if plan.count() <= SENT_SOURCES else plan


def copies() -> Column:
    """How often the mix takes a document whole: the complete epochs, and once more inside the partial one."""
    me = F.struct(F.col("_key").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    inside = F.col("end_range").isNotNull() & ((F.col("_range") < F.col("end_range")) | ((F.col("_range") == F.col("end_range")) & F.coalesce(me <= F.col("end"), F.lit(False))))
    return F.col("whole") + inside.cast("int")


def mix_plan(docs: DataFrame, qualities: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies, one row for each row of docs.

    docs: doc_id, text, source; others are left alone. Sizes are words of whole texts (null: 0). Null is a source of its
    own, after all others. A document is taken whole: its source's complete epochs, then by sampling key while its
    middle lies within what is left of the target. Ids and the seed decide, so reruns agree; repeated rows of an id are
    taken alike. Only sizes and keys are shuffled, never texts. An empty table gives no rows.
    """
    rows = kit.stored(keyed(docs.select("doc_id", "source", word_count(F.col("text")).alias("_size")), qualities, seed), "mix-rows")
    plan = planned(rows)
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", copies())
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, qualities: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """The rows of docs as the mix takes them, repeats included, with the columns of docs."""
    names = docs.columns
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row"))
    plan = planned(kit.stored(keyed(sized.drop("_row"), qualities, seed), "mix-rows"))
    chosen = keyed(sized, qualities, seed).join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_n", copies())
    repeated = chosen.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return repeated.select(*(F.col("_row").getField(n).alias(n) for n in names))
