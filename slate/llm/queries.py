"""Queries of the training-data operators over the driver's tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.llm import ann_graph, bpe, cdc, kd_shards, langid, license_scan, metric_join, minhash_forest, mixing, url_rules

URL_RULES = [
    url_rules.Rule("com/en/", "block"),
    url_rules.Rule("example.com/en/7", "allow"),
    url_rules.Rule("net/de/", "allow"),
    url_rules.Rule("example.net/de/8", "block"),
    url_rules.Rule("org/es/", "block"),
]

#: Shares of all tokens by quality and toxicity label.
MIX_TARGETS = {"good": 0.8, "plain": 0.15, "toxic": 0.05}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return _table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op1_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_graph.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), domains(spark, sf_dir), MIX_TARGETS)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeated_spans(_table(spark, sf_dir, "documents"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(_table(spark, sf_dir, "documents"), shards=8)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op9_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.9)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


URL_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule, verdict, h, p) AS (
  VALUES ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'), ('net/de/', 'allow', 'net', '/de/'),
    ('example.net/de/8', 'block', 'example.net', '/de/8'), ('org/es/', 'block', 'org', '/es/')
), fits AS (
  SELECT n.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM named n JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p) GROUP BY n.page_id
), own AS (
  SELECT *, nullif(regexp_extract(host || path, '(?:^|[./])(spam-farm|ads-track|casino|malware|phishing|warez)(?:[./]|$)', 1), '') AS hit FROM named
)
SELECT o.page_id, o.host, o.path, f.rule, coalesce(f.verdict, CASE WHEN o.hit IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN f.rule IS NULL THEN o.hit END AS own_rule
FROM own o LEFT JOIN fits f USING (page_id)
"""

VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""


GRAPH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
), sized AS (
  SELECT vec_id, x, sqrt(list_reduce(list_transform(x, lambda a: a * a), lambda a, b: a + b)) AS size FROM v
), scored AS (
  SELECT q.vec_id AS query_id, o.vec_id, list_reduce(list_transform(list_zip(o.x, q.x), lambda p: p[1] * p[2]), lambda a, b: a + b) / (o.size * q.size) AS score
  FROM sized q JOIN sized o ON q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""

FOREST_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE list_distinct(w) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets
), ranked AS (
  SELECT i.*, row_number() OVER (PARTITION BY doc_id ORDER BY d, s) AS r FROM items i JOIN (SELECT s, count(*) AS d FROM items GROUP BY 1) USING (s)
), rare AS (
  SELECT * FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1
), pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn FROM rare a JOIN rare b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM pairs JOIN items x ON x.doc_id = a JOIN items y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, an, bn HAVING 100 * count(*) >= 80 * (an + bn - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ann_graph": GRAPH_SQL, "op4_url_rules": URL_SQL, "op8_minhash_forest": FOREST_SQL, "op9_metric_join": VECTOR_SQL}
