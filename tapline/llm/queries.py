"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.llm import conversation_trie, decontaminate, fingerprint, jaccard_join, language, oracle, passage_dedup, periodic_runs, pieces, pii, quality, sharding, simhash_join, suffix_dedup
from tapline.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op6_ngram_jaccard_join": oracle.OP6, "op10_benchmark_decontamination": oracle.OP10}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (removed > 0).alias("repeated"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")))


@query
def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


@query
def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir).select("doc_id", "text")).drop("row")


@query
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(documents(spark, sf_dir))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_passages(documents(spark, sf_dir))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query
def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.near_duplicates(documents(spark, sf_dir))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.collapsed(periodic_runs.with_repeated_tails(documents(spark, sf_dir))))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = conversation_trie.with_shared_openings(conversation_trie.numbered(documents(spark, sf_dir, "conversations")))
    return conversation_trie.prefix_trie(turns, convs)


#: CRC-32 of the decimal digits of an id, bit by bit (the polynomial is a fixed value).
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""

ORACLE["op13_conversation_trie"] = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC} % 4 AS cut, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM turns)),
opened AS (SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.cut),
taken AS (SELECT conv_id, count(*) AS n FROM opened GROUP BY conv_id),
rebuilt AS (
  SELECT * FROM opened UNION ALL
  SELECT t.conv_id, t.place - c.cut + coalesce(k.n, 0), t.role, t.text FROM turns t JOIN convs c USING (conv_id) LEFT JOIN taken k USING (conv_id) WHERE t.place >= c.cut),
prefixes AS (
  SELECT conv_id, place + 1 AS depth, text, sha256(string_agg(sha256(length(role)::varchar || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY place)) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', '' FROM convs),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node, max(depth) OVER (PARTITION BY conv_id) AS last FROM prefixes),
nodes AS (
  SELECT node AS conv_id, depth, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS own,
         sha256(coalesce(string_agg(CASE WHEN depth = last THEN named.conv_id::varchar END, ',' ORDER BY named.conv_id), '')) AS ends_sha256
  FROM named GROUP BY node, depth),
parents AS (SELECT n.conv_id, n.depth, p.node AS parent_conv_id FROM nodes n JOIN named p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM parents GROUP BY ALL),
whole AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (conv_id, depth)),
above AS (SELECT a.node AS conv_id, a.depth, n.own, n.n_children FROM whole n JOIN named a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
totals AS (SELECT conv_id, depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM above GROUP BY ALL)
SELECT w.conv_id, w.depth, p.parent_conv_id, w.n_convs, w.n_children, t.n_leaves, t.saved_tokens::bigint AS saved_tokens, w.ends_sha256
FROM whole w JOIN totals t USING (conv_id, depth) LEFT JOIN parents p USING (conv_id, depth)
"""
