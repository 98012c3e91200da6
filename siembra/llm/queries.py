"""Queries opN_<name> of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from siembra.llm.bit_sliced_search import top_k
from siembra.llm.conversation_repair import repair_damaged
from siembra.llm.exact_dedup import exact_dedup
from siembra.llm.feature_digest import compare_with_next, corpus_ranks
from siembra.llm.filter_audit import audit_filters
from siembra.llm.license_scan import scan_licenses
from siembra.llm.ngram_join import near_classes
from siembra.llm.pii_surrogates import pseudonymise
from siembra.llm.quality_classifier import fit_quality, score_quality
from siembra.llm.repeated_passages import repeated_passages
from siembra.llm.sentencepiece_codec import encode_pieces
from siembra.llm.source_mix import mix_sources
from siembra.llm.url_filters import filter_urls, parse_rules

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

#: Rules of op5, as the contract states them.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = parse_rules(spark.sql("VALUES " + ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES)).toDF("rule", "verdict"))
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP5_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM p),
r(rule, verdict, rhost, rpath) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
         ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
m AS (
  SELECT page_id, host, path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM s LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_documents(spark, sf_dir))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir).select("doc_id", "source"))


#: The model file of op4 and of the pipeline.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_documents(spark, sf_dir), PIECES)


def op10_feature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return compare_with_next(docs, corpus_ranks(docs))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_documents(spark, sf_dir))


#: A fixed key, so that the query can be repeated; a user gives a secret one.
PII_KEY = "siembra-example-key"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_documents(spark, sf_dir), PII_KEY)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op11_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(words) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(e, FALSE) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT v.x || w.x || y.x || z.x || u.x AS filter_order FROM f v, f w, f y, f z, f u
  WHERE v.x <> w.x AND v.x <> y.x AND v.x <> z.x AND v.x <> u.x AND w.x <> y.x AND w.x <> z.x AND w.x <> u.x AND y.x <> z.x AND y.x <> u.x AND z.x <> u.x),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, 1 << (position(substr(filter_order, step, 1) IN 'ABCDE') - 1) AS bit,
    CAST(coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (position(substr(filter_order, CAST(k AS INTEGER), 1) IN 'ABCDE') - 1))), 0) AS INTEGER) AS prior
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
r AS (
  SELECT part, filter_order, step, letter, CAST(sum(CASE WHEN mask & (prior | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & prior <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_QUERIES: dict[str, Query] = {
    "op6_license_scan": op6_license_scan,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op10_feature_digest": op10_feature_digest,
    "pipeline": corpus_pipeline.run,
    "op4_sentencepiece": op4_sentencepiece,
    "op1_source_mix": op1_source_mix,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_quality_classifier": op8_quality_classifier,
    "op5_url_filters": op5_url_filters,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_bit_sliced_topk": op11_bit_sliced_topk,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}
_ORACLES: dict[str, str] = {"op5_url_filters": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op11_bit_sliced_topk": OP11_SQL, "op12_filter_audit": OP12_SQL}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
