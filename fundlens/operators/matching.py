"""Scoring of calls against companies, and the joins that pair them.

Scores are sums of four parts with fixed maxima, so a threshold makes some parts necessary. Those turn
the pairing into an equi-join on region and/or sector prefix; only calls that leave both free meet
every company, and those are spread over a grid of blocks so that no task holds a whole side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import refdata as R

_ANY = "*"


#: Largest measured size of the call side that is broadcast.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def _tasks(df: DataFrame) -> int:
    session = df.sparkSession
    planned = int(session.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(planned, session.sparkContext.defaultParallelism, 1)


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame's rows as JSON text, measured by one aggregation over it."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    return df.agg(size.alias("n")).first()["n"] or 0


def meet(calls: DataFrame, companies: DataFrame, blocks: int | None = None) -> DataFrame:
    """Pairs that share a key: equi-join on ``call_keys``/``company_keys`` (array<string> columns).

    A pair may share at most one key, so no pair repeats. The companies are spread evenly by their id,
    whatever their keys, so a key held by a third of them still runs on all tasks. The calls, one row
    per key, are broadcast when the measured size of those rows allows it. Otherwise both sides are cut
    into blocks by id, about the square root of ``blocks`` each, and joined on key and both blocks: hot
    keys and the free key become a grid, each side is repeated once per block of the other only, and
    the sort-merge join spills what does not fit. ``blocks`` forces that way.
    """
    tasks = _tasks(companies)
    left = calls.withColumn("pair_key", F.explode(F.array_distinct("call_keys"))).drop("call_keys")
    keyed = F.explode(F.array_distinct("company_keys"))
    if blocks is None and measured_bytes(left) <= BROADCAST_LIMIT_BYTES:
        right = companies.repartition(tasks, "company_id").withColumn("pair_key", keyed).drop("company_keys")
        return right.join(F.broadcast(left), "pair_key").drop("pair_key")
    n = blocks or tasks
    down = max(1, round(n**0.5))
    across = -(-n // down)
    call_block, company_block = F.pmod(F.xxhash64("call_id"), F.lit(down)), F.pmod(F.xxhash64("company_id"), F.lit(across))
    left = left.withColumns({"pair_row": call_block.cast("int"), "pair_column": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    right = companies.withColumns({"pair_key": keyed, "pair_column": company_block.cast("int")}).drop("company_keys")
    right = right.withColumn("pair_row", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    return left.hint("merge").join(right, ["pair_key", "pair_row", "pair_column"]).drop("pair_key", "pair_row", "pair_column")


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def keyed(calls: DataFrame, companies: DataFrame, threshold: int = 0) -> tuple[DataFrame, DataFrame]:
    """Prepared sides with the keys under which all pairs that can reach ``threshold`` meet."""
    by_region = threshold > 100 - R.WEIGHT_REGION
    by_sector = threshold > 100 - R.WEIGHT_SECTOR
    free = F.array(F.lit(_ANY))
    region_keys = F.when(F.col("k_region_free"), free).otherwise(F.col("k_regions")) if by_region else free
    bound_by_codes = ~F.col("k_open") & (F.size("k_codes") > 0)
    prefix_keys = F.array_distinct(F.transform("k_prefixes", lambda p: F.lower(p)))
    sector_keys = F.when(bound_by_codes, prefix_keys).otherwise(free) if by_sector else free
    call_keys = F.flatten(F.transform(region_keys, lambda r: F.transform(sector_keys, lambda s: _key(r, s))))

    own_region = [F.lit(_ANY)] + ([F.col("f_region")] if by_region else [])
    own_sector = [F.lit(_ANY)] + ([F.lower("f_prefix")] if by_sector else [])
    own = F.array(*[F.when(r.isNotNull() & s.isNotNull(), _key(r, s)) for r in own_region for s in own_sector])
    return calls.withColumn("call_keys", call_keys), companies.withColumn("company_keys", F.array_compact(own))


def candidates(calls: DataFrame, companies: DataFrame, threshold: int = 0, blocks: int | None = None) -> DataFrame:
    """All pairs that can reach ``threshold``, from prepared sides."""
    return meet(*keyed(calls, companies, threshold), blocks)


def region_score() -> Column:
    hit = F.coalesce(F.array_contains("k_regions", F.col("f_region")), F.lit(False))
    return F.when(F.col("k_region_free") | hit, R.WEIGHT_REGION).otherwise(0)


def section_excluded() -> Column:
    return F.coalesce(F.array_contains("k_sections", F.col("f_section")), F.lit(False))


def activity_overlap() -> Column:
    """Largest number of words the company's description shares with one admitted activity."""
    shared = F.transform("k_activities", lambda words: F.size(F.array_intersect(words, F.col("f_tokens"))))
    return F.when(F.col("f_tokens").isNotNull(), F.coalesce(F.array_max(shared), F.lit(0)))


def activity_score() -> Column:
    overlap = activity_overlap()
    return (
        F.when(F.size("k_activities") == 0, 0)
        .when(F.col("f_tokens").isNull(), R.ACTIVITY_UNCERTAIN)
        .when(overlap >= 2, R.ACTIVITY_GOOD)
        .when(overlap == 1, R.ACTIVITY_PARTIAL)
        .otherwise(0)
    )


def sector_score() -> Column:
    same_code = F.array_contains("k_codes", F.col("f_code"))
    same_prefix = (F.length("f_prefix") >= 2) & F.array_contains("k_prefixes", F.col("f_prefix"))
    by_code = F.when(same_code, R.WEIGHT_SECTOR).when(same_prefix, R.WEIGHT_SECTOR // 2).otherwise(0)
    return (
        F.when(section_excluded(), 0)
        .when(F.col("k_open"), R.WEIGHT_SECTOR)
        .when(F.size("k_codes") > 0, by_code)
        .when(F.size("k_activities") > 0, activity_score())
        .otherwise(R.WEIGHT_SECTOR // 2)
    )


def size_score() -> Column:
    hit = F.coalesce(F.array_contains("k_sizes", F.col("f_size")), F.lit(False))
    return F.when((F.size("k_sizes") == 0) | hit, R.WEIGHT_SIZE).otherwise(0)


def revenue_score() -> Column:
    """A missing revenue counts as zero here, unlike in the eligibility check."""
    within = F.coalesce(F.col("f_revenue"), F.lit(0.0)) <= F.col("k_cap")
    return F.when(F.col("k_cap").isNull() | within, R.WEIGHT_REVENUE).otherwise(0)


PARTS = {
    "region_score": region_score,
    "sector_score": sector_score,
    "size_score": size_score,
    "revenue_score": revenue_score,
}


def total_score() -> Column:
    total = sum((make() for make in PARTS.values()), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def score_status() -> Column:
    return F.when(F.col("k_ambiguous"), "da_verificare").otherwise("ok")


def score_pairs(calls: DataFrame, companies: DataFrame, threshold: int = 0, blocks: int | None = None) -> DataFrame:
    """Prepared sides paired, with the four parts, the total and the status; pairs under the threshold go.

    A call whose record could not be read scores with nobody.
    """
    pairs = candidates(calls.filter("k_usable"), companies, threshold, blocks)
    scored = pairs.withColumns({name: make().cast("int") for name, make in PARTS.items()}).withColumns(
        {
            "score": F.greatest(F.lit(0), F.least(F.lit(100), sum(F.col(p) for p in PARTS))).cast("int"),
            "score_status": score_status(),
        }
    )
    return scored.filter(F.col("score") >= threshold) if threshold > 0 else scored


#: Columns of calls and of companies that a part reads. The revenue part is a comparison and needs no table.
PART_COLUMNS = {
    "region_score": (["k_regions", "k_region_free"], ["f_region"]),
    "sector_score": (["k_open", "k_codes", "k_prefixes", "k_activities", "k_sections"], ["f_code", "f_prefix", "f_section", "f_tokens"]),
    "size_score": (["k_sizes"], ["f_size"]),
}
#: Kinds of calls, alike in all that a part reads, up to which a company carries its part for each kind.
KINDS = 2048


def _alike(names: list[str]) -> Column:
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def call_kinds(calls: DataFrame, most: int) -> dict[str, list[str] | None]:
    """For each part what its kinds of calls read, as texts in order; None if there are more than ``most``."""

    def of(parts):
        entries = F.array(*(F.struct(F.lit(p).alias("part"), _alike(PART_COLUMNS[p][0]).alias("t")) for p in parts))
        return calls.select(F.inline(entries)).distinct().limit(len(parts) * most + 1).collect()

    found = of(list(PART_COLUMNS))
    if len(found) > len(PART_COLUMNS) * most:
        found = [r for p in PART_COLUMNS for r in of([p])]
    texts = {p: sorted(r["t"] for r in found if r["part"] == p) for p in PART_COLUMNS}
    return {p: t if len(t) <= most else None for p, t in texts.items()}


def tabled(calls: DataFrame, companies: DataFrame, part: str, texts: list[str] | None) -> tuple[DataFrame, DataFrame, Column, list[str], list[str]]:
    """Sides with what a pair needs for a part, its expression, and the columns that it reads of calls and of companies.

    Calls alike in what the part reads are one kind, and so are companies; the part is worked out once for each two kinds,
    and a company gets an array of its part by kind of call. Without ``texts``, the kinds of calls, the part stays an
    expression on the columns of the pair.
    """
    mine, theirs = PART_COLUMNS[part]
    number, table = f"kind_{part}", f"table_{part}"
    if texts is None:
        return calls, companies, PARTS[part](), mine, theirs
    numbers = F.broadcast(calls.sparkSession.createDataFrame(list(enumerate(texts)), f"{number} int, _alike string"))
    kinds = calls.groupBy(_alike(mine).alias("_alike")).agg(F.first(F.struct(*mine)).alias("k")).join(numbers, "_alike").select(number, "k.*")
    own = companies.groupBy(_alike(theirs).alias("_own")).agg(F.first(F.struct(*theirs)).alias("f")).select("_own", "f.*")
    met = own.join(F.broadcast(kinds)).select("_own", F.struct(number, PARTS[part]().cast("tinyint").alias("s")).alias("x"))
    tables = met.groupBy("_own").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias(table))
    numbered = calls.withColumn("_alike", _alike(mine)).join(numbers, "_alike").drop("_alike")
    tabular = companies.withColumn("_own", _alike(theirs)).join(tables, "_own").drop("_own")
    return numbered, tabular, F.get(table, F.col(number)), [number], [table]


def scores(calls: DataFrame, companies: DataFrame, threshold: int = 0, blocks: int | None = None, kinds: int = KINDS, of_call: tuple[str, ...] = (), of_company: tuple[str, ...] = ()) -> DataFrame:
    """call_id, company_id and score of the pairs that ``score_pairs`` gives, and the columns named of each side.

    The parts are looked up by kind (``tabled``), so a pair costs three reads and a comparison, and only ids, kinds and
    limits of calls are sent to where the pairs are built.
    """
    calls, companies = keyed(calls.filter("k_usable"), companies, threshold)
    total, mine, theirs = revenue_score(), ["call_id", "call_keys", "k_cap", *of_call], ["company_id", "company_keys", "f_revenue", *of_company]
    for part, texts in call_kinds(calls, kinds).items():
        calls, companies, expression, left, right = tabled(calls, companies, part, texts)
        total, mine, theirs = total + expression, mine + left, theirs + right
    pairs = meet(calls.select(*mine), companies.select(*theirs), blocks)
    scored = pairs.select("call_id", "company_id", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int").alias("score"), *of_call, *of_company)
    return scored.filter(F.col("score") >= threshold) if threshold > 0 else scored


def sector_to_verify() -> Column:
    """Only textual activities are admitted and the company's description shares fewer than two words."""
    only_activities = ~F.col("k_open") & (F.size("k_codes") == 0) & (F.size("k_activities") > 0)
    return only_activities & (F.col("f_tokens").isNull() | (activity_overlap() < 2))


def score_band(score: Column) -> Column:
    return F.when(score > 70, "high").when(score >= 40, "mid").otherwise("low")


def explanation() -> Column:
    """One line per pair: four parts with ✅, ⚠️ or ❌."""
    region_name = F.trim("region")
    region = (
        F.when(F.col("k_region_free"), F.lit("✅ Regione: nessun vincolo"))
        .when(F.col("region_score") == R.WEIGHT_REGION, F.concat(F.lit("✅ Regione compatibile ("), region_name, F.lit(")")))
        .otherwise(F.concat(F.lit("❌ Regione non compatibile ("), _or_nd(region_name), F.lit(")")))
    )
    code = F.trim("sector_code")
    shown_code = F.coalesce(code, F.lit(""))
    sector = (
        F.when(F.col("k_open"), F.lit("✅ Settore: aperto a tutti"))
        .when(F.col("sector_score") == R.WEIGHT_SECTOR, F.concat(F.lit("✅ Settore ammesso ("), shown_code, F.lit(")")))
        .when(F.col("sector_score") > 0, F.concat(F.lit("⚠️ Settore parzialmente compatibile ("), shown_code, F.lit(")")))
        .otherwise(F.concat(F.lit("❌ Settore non ammesso ("), _or_nd(code), F.lit(")")))
    )
    size_name = F.trim("size_class")
    size = (
        F.when(F.size("k_sizes") == 0, F.lit("✅ Dimensione: nessun vincolo"))
        .when(F.col("size_score") == R.WEIGHT_SIZE, F.concat(F.lit("✅ Dimensione compatibile ("), size_name, F.lit(")")))
        .otherwise(F.concat(F.lit("❌ Dimensione non compatibile ("), _or_nd(size_name), F.lit(")")))
    )
    revenue = (
        F.when(F.col("k_cap").isNull(), F.lit("✅ Fatturato: nessun vincolo"))
        .when(F.col("revenue_score") == R.WEIGHT_REVENUE, F.lit("✅ Fatturato entro i limiti"))
        .otherwise(F.lit("❌ Fatturato fuori dai limiti"))
    )
    return F.concat_ws(" · ", region, sector, size, revenue)


def _or_nd(text: Column) -> Column:
    return F.when(text != "", text).otherwise(F.lit("N/D"))
