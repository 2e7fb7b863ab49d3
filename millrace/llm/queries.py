"""Queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.embedding_dedup import dedup_embeddings
from millrace.llm.fingerprints import fingerprint_documents
from millrace.llm.html_extract import extract_pages
from millrace.llm.language import identify
from millrace.llm.mixing import mixed_share
from millrace.llm.near_dup import near_duplicates
from millrace.llm.packing import pack
from millrace.llm.pii import find_personal_data
from millrace.llm.quality import score_quality
from millrace.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_share(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(_table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # beside __spark_entry__.py

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_document_fingerprints, op2_source_mixing, op3_html_extraction, op4_embedding_dedup, op5_warc, op6_quality, op7_language, op8_personal_data, op9_minhash_near_dup, op10_packing, pipeline)
}

#: Where SQL can say it. Every other query is tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || md5(concat_ws(':', '17', doc_id, text))[1:15])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS most,
      ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
      coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
      sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM s),
l AS (SELECT *, (total - below) / rest_w AS level FROM o),
f AS (SELECT (SELECT level FROM l WHERE most > level * w ORDER BY most / w, level LIMIT 1) AS free),
t AS (SELECT source, source_size, coalesce(least(most, free * w), most) AS target FROM l, f),
a AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - size AS ahead FROM d)
SELECT doc_id, size, source_size, target,
       list_sum(list_transform([0, 1, 2], lambda c: greatest(0, least(size, round(target)::BIGINT - ahead - c * source_size))))::BIGINT AS taken
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source
""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
      WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept
FROM v JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id
""",
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
""",
    "op9_minhash_near_dup": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [' ' || t] ELSE list_sort(list_distinct(
      list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
g AS (SELECT s, min(doc_id) AS node FROM s GROUP BY s),
e AS (SELECT node, len(s) AS n, unnest(s) AS s FROM g),
p AS (SELECT a.node AS x, b.node AS y, a.n AS n, b.n AS m, count(*) AS c FROM e AS a JOIN e AS b ON a.s = b.s AND a.node <> b.node GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p WHERE c >= 0.8::DOUBLE * (n + m - c)),
r AS (SELECT node AS x, node AS y FROM g UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS class_id FROM r GROUP BY x)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM s JOIN g USING (s) JOIN c ON c.x = node
""",
}
