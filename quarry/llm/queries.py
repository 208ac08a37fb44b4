"""The registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import ann, bpe, licenses, media, mixing, neardup, quality, sharding, substring, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def rank_file(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN, digests=True, lists=False)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height", "bits"]
    return media.media_columns(table(spark, sf_dir, "documents")).select(*cols)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_near_duplicates, op3_bpe, op4_substring, op5_sharding, op6_mixing, op7_media, op8_quality, op9_ann, op10_licenses)}

def _licenses_sql() -> str:
    """The same tables of sentences and rules, as SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    clean = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '\.+([^0-9.]|$)', ' \1', 'g'), '\s+', ' ', 'g'))"
    known = "CASE " + " ".join(f"WHEN regexp_full_match(n, {quote(pattern)}) THEN {quote(name)}" for pattern, name in licenses.SENTENCES) + " END"
    steps, left = [], "r0"
    for i, (rule, name) in enumerate(licenses.RULES, 1):
        sequence = quote("," + ",".join(rule) + ",")
        steps.append(f"r{i} AS (SELECT *, CASE WHEN contains(left{i - 1}, {sequence}) THEN {quote(name)} END AS n{i}, replace(left{i - 1}, {sequence}, ',|,') AS left{i} FROM {left})")
        left = f"r{i}"
    names = ", ".join(f"n{i}" for i in range(1, len(licenses.RULES) + 1))
    return f"""
WITH lines AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), {quote(licenses.LINES)}), lambda x: regexp_matches(x, {quote(licenses.HINT)})) AS lines FROM documents),
sentences AS (
  SELECT doc_id, list_transform(flatten(list_transform(lines, lambda x: string_split_regex(x, {quote(licenses.ENDS)}))), lambda s: {clean}) AS sentences FROM lines),
found AS (SELECT doc_id, list_filter(list_transform(sentences, lambda n: {known}), lambda x: x IS NOT NULL) AS ids FROM sentences),
r0 AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS left0 FROM found),
{", ".join(steps)},
m AS (SELECT doc_id, ids, list_filter([{names}], lambda x: x IS NOT NULL) AS names FROM {left})
SELECT doc_id, len(ids)::INT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       CASE WHEN len(names) > 0 THEN array_to_string(list_transform(list_filter(names, lambda x, i: list_position(names, x) = i), lambda x: x), ',')
            WHEN len(ids) > 0 THEN 'UNKNOWN' ELSE 'NONE' END AS licenses
FROM m
"""


ORACLE_SQL = {
    "op10_licenses": _licenses_sql(),
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS pos
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
o AS (
  SELECT *, 2.0::DOUBLE * source_size AS room,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
           - coalesce(sum(2.0::DOUBLE * source_size) OVER p, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS remaining
  FROM w
  WINDOW p AS (ORDER BY 2 * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, room * remaining <= rest * weight AS is_full FROM o),
t AS (
  SELECT src, source_size, CASE WHEN is_full THEN room ELSE
         (max_by(rest, remaining) FILTER (WHERE NOT is_full) OVER ()) * weight
         / (max(remaining) FILTER (WHERE NOT is_full) OVER ()) END AS target
  FROM f),
m AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.*, m.source_size, m.target, m.whole, m.target - m.whole * m.source_size AS budget,
         sum(size) OVER (PARTITION BY d.src ORDER BY pos) AS upto,
         sum(size) OVER (PARTITION BY d.src, pos) AS here
  FROM d JOIN m ON d.src = m.src),
g AS (
  SELECT *, whole + CASE WHEN budget > 0 AND (source_size > budget)
         AND (upto <= budget OR (upto - here <= budget AND upto - budget <= budget - (upto - here)))
         THEN 1 ELSE 0 END AS times
  FROM c)
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken, times::BIGINT AS times FROM g
""",
}
