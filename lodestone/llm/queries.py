"""The registered queries of the training-data operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), BPE)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), BPE)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.templates import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), contents=False).drop("kept")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.cover_tree import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_minhash": op3_minhash,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_top_k": op6_top_k,
    "op7_html": op7_html,
    "op8_toxicity": op8_toxicity,
    "op9_repeats": op9_repeats,
    "op10_token_counts": op10_token_counts,
}

_OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS x FROM p),
f AS (SELECT page_id, n, x, min(page_id) OVER (PARTITION BY x) AS f FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5)) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM f
"""

_OP6 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, max(CAST(list_sum(list_transform(range(len(q.v)), lambda i: q.v[i + 1] * d.v[i + 1])) AS BIGINT)) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id AND len(d.v) = len(q.v) WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op2_warc": _OP2, "op6_top_k": _OP6}
