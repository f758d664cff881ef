"""The operators as named queries over whole tables, and their check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, decontaminate, fim, kit, langid, lm, mixing, packing, quality, repeats, simhash, tokens, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualities(labels: DataFrame) -> DataFrame:
    """Sampling weights from quality labels: good documents weigh 2, poor ones 1/2, others 1."""
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = kit.scratch_path(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens.token_index(tokens.read_tokens(spark, path))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"), qualities(table(spark, sf_dir, "labels"))).drop("copies")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.audited(conversations.damaged(turns), turns.select("conv_id"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op1_language_id, op2_quality_resampling, op3_toxicity, op4_repeated_strings, op5_language_model, op6_exact_top_k, op7_token_output, op8_simhash_groups, op9_decontamination, op10_mixing, op11_packing, op12_conversation_repair, op13_fill_in_middle)}

CHECK_SQL["op6_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CHECK_SQL["op9_decontamination"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item, len(x) AS n, x FROM (
    SELECT CAST(item_id AS VARCHAR) AS item, w[p:p + 12] AS x FROM i, unnest(range(1, greatest(len(w) - 11, 2))) t(p) WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, w[p:p + n - 1] AS x FROM d, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(w) - n + 2)) t(p)),
h AS MATERIALIZED (SELECT doc_id, p, dw.n, item FROM dw JOIN win ON win.n = dw.n AND win.x = dw.x),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h),
g AS (SELECT doc_id, max(m) AS longest, sum(m) AS n_hit FROM (
  SELECT doc_id, count(*) AS m FROM (SELECT doc_id, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS k FROM c) GROUP BY doc_id, k) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

CHECK_SQL["op10_mixing"] = """
WITH q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY 1),
r AS MATERIALIZED (
  SELECT d.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(concat(coalesce(CAST(d.doc_id AS VARCHAR), ''), '/42')), 1, 13) AS BIGINT) + 1.0) / 4503599627370496.0) / CAST(coalesce(weight, 1.0) AS DOUBLE) AS key
  FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY 1),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS filled FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(filled) OVER (ORDER BY filled / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY filled / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole FROM (
    SELECT *, least(CAST(filled AS DOUBLE), coalesce(max(level) FILTER (WHERE level <= filled / weight) OVER () * weight, CAST(filled AS DOUBLE))) AS target FROM l)),
u AS (
  SELECT r.*, source_size, target, whole, target - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY r.source ORDER BY key, r.doc_id) AS upto, sum(size) OVER (PARTITION BY r.source, key, r.doc_id) AS n
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN upto - n / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM u
"""

CHECK_SQL["op13_fill_in_middle"] = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS x FROM documents),
g AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def _repair_sql() -> str:
    """The cheapest edits turn by turn: a state is its cost in nine digits followed by its edits, so that least() compares both."""

    def then(value: str, cost: str, edit: str) -> str:
        return f"lpad(CAST(CAST(substr({value}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{edit}'"

    user = f"least(c2, {then('c0', '5', 'I')}, {then('c1', '5', 'I')}, {then('c3', '5', 'I')})"
    put_in = lambda source: f"SELECT s.* REPLACE (least(c3, {then('c2', '5', 'I')}) AS c3) FROM (SELECT {source}.* REPLACE ({user} AS c2) FROM {source}) s"
    role = lambda r: f"CASE WHEN r.x = '{r}' THEN 0 ELSE 1 END + r.cut"
    letter = lambda r: f"CASE WHEN r.x = '{r}' THEN 'K' ELSE 'R' END"

    def turned(value: str, r: str) -> str:
        return f"lpad(CAST(CAST(substr({value}, 1, 9) AS INT) + {role(r)} AS VARCHAR), 9, '0') || substr({value}, 10) || {letter(r)}"

    gone = [then(f"c{k}", "2", "D") for k in range(4)]
    kept = lambda *values: f"CASE WHEN r.own THEN least({', '.join(values)}) END"
    return f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(CASE WHEN k = 3 THEN 2 ELSE 1 END) WHERE k <> 0),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS previous FROM hurt),
faults AS MATERIALIZED (
  SELECT conv_id, turn, i, role, text, previous, role[1] AS x, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated
  FROM (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM placed)),
counted AS (
  SELECT conv_id, max(i) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE previous IS NOT NULL AND previous || x NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
ready AS MATERIALIZED (SELECT conv_id, i, x, NOT blank AND NOT duplicate AS own, CASE WHEN truncated THEN 5 ELSE 0 END AS cut FROM faults),
dp(conv_id, i, c0, c1, c2, c3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM counted
  UNION ALL
  SELECT d.conv_id, r.i, {gone[0]}, least({gone[1]}, CASE WHEN r.own AND r.x = 's' THEN {turned('c0', 's')} END),
    least({gone[2]}, {kept(turned('c0', 'u'), turned('c1', 'u'), turned('c3', 'u'))}), least({gone[3]}, {kept(turned('c2', 'a'))})
  FROM ({put_in('dp')}) d JOIN ready r ON r.conv_id = d.conv_id AND r.i = d.i + 1),
ended AS (SELECT e.conv_id, least(c0, c3) AS best FROM ({put_in('dp')}) e JOIN counted c ON c.conv_id = e.conv_id AND c.m = e.i),
plans AS MATERIALIZED (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ended),
edits AS (SELECT conv_id, p, audit[p] AS e, p - (length(audit[:p]) - length(replace(audit[:p], 'I', ''))) AS i, p - (length(audit[:p]) - length(replace(audit[:p], 'D', ''))) AS o FROM plans, range(1, length(audit) + 1) t(p)),
turned AS (SELECT e.conv_id, p, e, o, f.role, CASE WHEN e = 'I' THEN '' ELSE f.text END AS text, max(CASE WHEN o = 1 AND e = 'K' AND f.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN faults f ON f.conv_id = e.conv_id AND f.i = e.i WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(concat(CASE WHEN e = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', text), chr(10) ORDER BY p) AS t FROM turned GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c USING (conv_id) LEFT JOIN plans p USING (conv_id) LEFT JOIN texts x USING (conv_id)
"""


CHECK_SQL["op12_conversation_repair"] = _repair_sql()
