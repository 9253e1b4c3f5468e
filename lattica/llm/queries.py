"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embeddings, exact_dedup, licenses, mixing, pii, resampling, simhash, suffixes, toxicity, warc, word_bpe
from .common import scratch_path, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("content_hash").alias("text_sha256"))


ORACLE_OP1 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM r
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    last = F.try_element_at("positions", F.lit(-1))
    return mixing.in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"), F.round(last, 6).alias("last_position"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP3 = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Stands in for a key that a deployment keeps to itself.
PII_KEY = "lattica demonstration key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, unnest(range(0, length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400),
w AS (SELECT s.r, s.i, md5(substr(d.x, CAST(2 * s.i + 1 AS INTEGER), 400)) AS h FROM s JOIN d ON d.r = s.r),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
run AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit),
num AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM run),
span AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM num GROUP BY r, k),
keep AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS lo, a AS hi FROM span UNION ALL SELECT r, max(b), NULL FROM span GROUP BY r),
part AS (SELECT keep.r, lo, substr(d.x, CAST(2 * lo + 1 AS INTEGER), CAST(2 * (coalesce(hi, length(d.x) // 2) - lo) AS INTEGER)) AS x FROM keep JOIN d ON d.r = keep.r),
rest AS (SELECT r, string_agg(x, '' ORDER BY lo) AS x FROM part GROUP BY r),
n AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest.x, d.x))) AS kept_sha256
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN rest ON rest.r = d.r
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), *bpe.default_vocabulary())


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.withColumn("licenses", F.array_join("licenses", ",")).drop("passages")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_dups(table(spark, sf_dir, "embeddings"))


ORACLE_OP10 = r"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (WITH RECURSIVE t(v, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, t.c FROM t JOIN l ON l.a = t.v WHERE t.c < l.b) SELECT v, min(c) AS c FROM t GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN reach ON v.vec_id = reach.v LEFT JOIN n ON n.a = v.vec_id
"""


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode(table(spark, sf_dir, "documents"), word_bpe.default_vocabulary())


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_repeats": op7_repeats,
    "op8_bpe": op8_bpe,
    "op9_licenses": op9_licenses,
    "op10_embeddings": op10_embeddings,
    "op11_word_bpe": op11_word_bpe,
    "op12_divergence": op12_divergence,
    "op13_resampling": op13_resampling,
}
ORACLE_SQL = {
    "op1_exact_dedup": ORACLE_OP1,
    "op2_mix_sources": mixing.ORACLE_OP2,
    "op3_warc": ORACLE_OP3,
    "op7_repeats": ORACLE_OP7,
    "op10_embeddings": ORACLE_OP10,
    "op12_divergence": divergence.ORACLE_OP12,
    "op13_resampling": resampling.ORACLE_OP13,
}
