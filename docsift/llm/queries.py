"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_stream, hard_negatives, lattice, minhash, packing, pii, prefix_counts, quality, substrings, token_files, topk, urls
from .common import table
from .tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def register(function):
        QUERIES[name] = function
        return function

    return register


@query("op1_quality_rules")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents"))


@query("op3_best_fit_packing")
def _packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op4_minhash_near_dedup")
def _near(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), percent=85)


@query("op9_token_counts")
def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op7_substring_dedup")
def _substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_report(table(spark, folder, "documents"))


@query("op6_pii")
def _pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_report(table(spark, folder, "documents"))


@query("op5_exact_topk")
def _topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op2_sentencepiece_sampling")
def _sampled(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.encode(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"), seed=2024)


@query("op8_token_output")
def _files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.through_files(table(spark, folder, "documents"))


@query("op11_cross_tokenizer_alignment")
def _aligned(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op12_bpe_round_trip")
def _round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_stream.round_trip(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op13_hard_negatives")
def _negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


_SOUND = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"
_WHOLE = "[floor({} * x::DOUBLE)::BIGINT FOR x IN embedding]"
_INNER = "list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)])::BIGINT"

SQL["op5_exact_topk"] = f"""
WITH rows AS (SELECT vec_id, {_WHOLE.format(64)} AS v FROM embeddings WHERE {_SOUND}),
scores AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_INNER} AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SQL["op13_hard_negatives"] = f"""
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE.format(256)} AS v
    FROM embeddings WHERE label IS NOT NULL AND {_SOUND}),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, {_INNER} AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scores WHERE same),
ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.same
    WHERE p.place <= 5 AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

URL_RULES = (
    urls.UrlRule("net", "/", "block"),
    urls.UrlRule("example.net", "/en/", "allow"),
    urls.UrlRule("example.com", "/de/", "block"),
    urls.UrlRule("org", "/fr/", "allow"),
)


@query("op10_url_filters")
def _urls(spark: SparkSession, folder: str) -> DataFrame:
    """Labels go by number: a page is bad if the label of its number says poor or toxic."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labelled = pages.select(F.col("page_id").alias("doc_id"), "url").join(labels.select("doc_id", bad.alias("bad")), "doc_id")
    return urls.judge(pages, labelled.select("url", "bad"), URL_RULES)


def _posterior_sql(level: str, units: str, key: str, above: str, on: str) -> str:
    mean = f"(u.bad - u.n * m.a / (m.a + m.b)) * (u.bad - u.n * m.a / (m.a + m.b))"
    noise = "u.n * (m.a / (m.a + m.b)) * (1 - m.a / (m.a + m.b))"
    return f"""
    {level}_rho AS (SELECT sum({mean} - {noise}) AS excess, sum({noise} * (u.n - 1)) AS room FROM {units} u JOIN {above} m ON {on}),
    {level}_s AS (SELECT least(greatest(CASE WHEN room IS NULL OR room <= 0 OR excess <= 0 THEN 200.0
        WHEN excess >= room THEN 2.0 ELSE room / excess - 1 END, 2.0), 200.0) AS s FROM {level}_rho),
    {level}_p AS (SELECT u.{key} AS k, m.a / (m.a + m.b) * s + u.bad AS a, (1 - m.a / (m.a + m.b)) * s + u.n - u.bad AS b
        FROM {units} u JOIN {above} m ON {on} CROSS JOIN {level}_s)"""


_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DOMAIN = "CASE WHEN len(p) < 2 THEN host WHEN {two} AND len(p) > 2 THEN p[-3] || '.' || p[-2] || '.' || p[-1] ELSE p[-2] || '.' || p[-1] END"
_TWO = "(len(p) >= 2 AND p[-2] || '.' || p[-1] IN (" + ", ".join(f"'{x}'" for x in urls.TWO_LABELS) + "))"

SQL["op10_url_filters"] = f"""
WITH own AS (
    SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM own),
named AS (SELECT host, {_DOMAIN.format(two=_TWO)} AS domain, CASE WHEN {_TWO} THEN p[-2] || '.' || p[-1] ELSE p[-1] END AS suffix FROM parts),
hosts AS (
    SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n,
        sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1.0 ELSE 0.0 END) AS bad
    FROM own JOIN labels ON page_id = doc_id JOIN named USING (host) GROUP BY host),
domains AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
whole AS (SELECT coalesce(sum(bad), 0) + 0.5 AS a, coalesce(sum(n) - sum(bad), 0) + 0.5 AS b FROM suffixes),
{_posterior_sql("suffix", "suffixes", "suffix", "whole", "true").strip()},
{_posterior_sql("domain", "domains", "domain", "suffix_p", "u.suffix = m.k").strip()},
{_posterior_sql("host", "hosts", "host", "domain_p", "u.domain = m.k").strip()},
known AS (
    SELECT named.host, coalesce(h.a, d.a, s.a, w.a) AS a, coalesce(h.b, d.b, s.b, w.b) AS b
    FROM named LEFT JOIN host_p h ON named.host = h.k LEFT JOIN domain_p d ON named.domain = d.k
        LEFT JOIN suffix_p s ON named.suffix = s.k CROSS JOIN whole w),
ruled AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
    FROM own)
SELECT page_id, ruled.host AS host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN known ON ruled.host = known.host
"""
