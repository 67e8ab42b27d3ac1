"""The training-data queries: thin wrappers that derive digest columns from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, host_quality, langid, licenses, nbest, secrets, sharding, simhash_dedup, toxicity
from tessera.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the three best segmentations of every document, and whether the best decodes to its text."""
    found = nbest.encode_nbest(table(spark, sf_dir, "documents"), n=3, digest=True)
    return found.select("doc_id", "n_pieces", F.col("ids").alias("ids_sha256"), "scores", F.col("nbest").alias("nbest_sha256"), "round_trip")


@_query
def op2_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op3_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def _spans_sql(rule: secrets.Rule, order: int) -> str:
    """A list of (a, o, b, kind, w) as DuckDB SQL over the parts g, matches m and weighed groups w of a rule."""
    g, m, w = f"g{order}", f"m{order}", f"w{order}"
    upto = "coalesce(list_sum(list_transform({}[1:{}], lambda x: length(x))), 0)"
    return f"""
    list_filter(list_transform(range(1, len({m}) + 1), lambda i: struct_pack(
        a := CAST({upto.format(g, "i")} + {upto.format(m, "i-1")} AS BIGINT), o := {order},
        b := CAST({upto.format(g, "i")} + {upto.format(m, "i")} AS BIGINT), kind := '{rule.kind}',
        w := length({w}[i]))), lambda x: x.w >= {rule.least})"""


def _parts_sql(rule: secrets.Rule, order: int) -> str:
    pattern = (secrets.re_least(rule.pattern, rule.least) if rule.group == 0 else rule.pattern).replace("'", "''")
    return f"""string_split_regex(t, '{pattern}') AS g{order}, regexp_extract_all(t, '{pattern}') AS m{order},
    regexp_extract_all(t, '{pattern}', {rule.group}) AS w{order}"""


def _listed_sql(spans: str) -> str:
    return f"array_to_string(list_transform({spans}, lambda z: concat_ws(':', z.kind, z.a, z.b)), ',')"


ORACLES["op3_trigram_secret_scan"] = f"""
WITH d AS (SELECT doc_id, {", ".join(_parts_sql(r, k) for k, r in enumerate(secrets.RULES))}
           FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
f AS (SELECT doc_id, list_sort({" || ".join(_spans_sql(r, k) for k, r in enumerate(secrets.RULES))}) AS s FROM d)
SELECT doc_id,
       {", ".join(f"CAST(len(list_filter(s, lambda x: x.o = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(secrets.BASE))},
       sha256({_listed_sql(f"list_filter(s, lambda x: x.o < {len(secrets.BASE)})")}) AS base_sha256,
       {_listed_sql("s")} AS spans
FROM f
"""


@_query
def op4_perspective_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its participants, a row per turn."""
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


ORACLES["op4_perspective_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
         regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1| >', 'g') AS body
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
h AS (
  SELECT t.*, perspective, role = perspective AS mine,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(role, '[^\p{L}\p{N}_-]', '_', 'g') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, length(head) + length(body) + 11 AS size FROM h),
w AS (SELECT *, row_number() OVER o - 1 AS seq, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
      FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, body))
SELECT conv_id, perspective, turn, CAST(seq AS BIGINT) AS seq, head || body || '<|im_end|>' || chr(10) AS segment,
       CAST(upto - size AS BIGINT) AS a, CAST(upto AS BIGINT) AS b,
       CAST(CASE WHEN mine THEN upto - size + length(head) ELSE upto - size END AS BIGINT) AS mask_a,
       CAST(CASE WHEN mine THEN upto - 1 ELSE upto - size END AS BIGINT) AS mask_b
FROM w
""".replace("\\\\", "\\")


@_query
def op5_segmentation_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the rows."""
    return langid.language_of_documents(table(spark, sf_dir, "documents"))


@_query
def op6_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


ORACLES["op6_extendible_hash_shards"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         array_to_string(list_transform(string_split(md5(coalesce(CAST(doc_id AS VARCHAR), '')), ''),
           lambda c: substr(right(bin(CAST('0x' || c AS INTEGER) + 16), 4), 1, 4)), '') AS bits
  FROM documents),
b AS (
  SELECT bits, n_bytes, doc_id, 0 AS depth, sum(n_bytes) OVER () AS held, count(*) OVER () AS n FROM d
  UNION ALL
  SELECT bits, n_bytes, doc_id, depth + 1, sum(n_bytes) OVER (PARTITION BY substr(bits, 1, depth + 1)),
         count(*) OVER (PARTITION BY substr(bits, 1, depth + 1))
  FROM b WHERE held > {sharding.SHARD_BYTES} AND n > 1 AND depth < 128)
SELECT doc_id, n_bytes, substr(bits, 1, depth) AS shard, depth, CAST(held AS BIGINT) AS shard_bytes
FROM b WHERE held <= {sharding.SHARD_BYTES} OR n = 1
"""


@_query
def op7_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures of every document, and verdicts with those of its host."""
    return host_quality.quality_report(table(spark, sf_dir, "documents"))


ORACLES["op7_host_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
k AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS k FROM g),
m AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
c AS (SELECT r, sum(least(8, coalesce(n - i, 8))) AS covered FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS n FROM m) GROUP BY r),
f AS (
  SELECT d.doc_id, lower(source) AS host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             (100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines) AS more_failed FROM f),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed OR more_failed THEN 1 ELSE 0 END) AS bad FROM b GROUP BY host),
p0 AS (SELECT least(greatest(avg(bad / n), 1e-6), 1 - 1e-6) AS mu, var_samp(bad / n) AS v, count(*) AS c FROM h),
p AS (SELECT mu, CASE WHEN c < 2 THEN 2.0 WHEN coalesce(v, 0) = 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, mu * (1 - mu) / v - 1)) END AS wt FROM p0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (bad + mu * wt) / (n + wt) <= 0.5 AS kept
FROM b JOIN h USING (host), p
"""


@_query
def op8_simhash_vantage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_dedup.near_duplicate_components(table(spark, sf_dir, "documents"))


@_query
def op9_license_paragraph_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License families that each document's paragraphs grant."""
    return licenses.license_report(table(spark, sf_dir, "documents"))


@_query
def op10_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
