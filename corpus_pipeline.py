"""A training corpus from raw documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, and works on all
documents that the stage before kept. All but the last return the columns of documents:

1. toxicity: documents that score 0.5 or more go.
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the document with
   the smallest id stays. Documents without an id are in no group and stay; rows that share an id and differ in text
   are documents of their own.
3. decontamination: documents that hold a benchmark item, re-parameterised ones included, go.
4. secrets: found spans are replaced by a mark; no document goes, n_chars follows the text.
5. packing: what is left becomes pieces in sequences of 2048 tokens.

Every stage has Arrow batches dealt out by bytes (common.small_batches); the setting stays with the session, as what a
stage returns runs later.

run() writes every stage to the shared folder and reads it back, so a lost executor costs one stage at most; a stage's
rows are removed when the next stage's are written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, drop, small_batches
from lodestone.llm.minhash import near_duplicates
from lodestone.llm.packing import pack_documents
from lodestone.llm.secrets import redact
from lodestone.llm.templates import contaminated
from lodestone.llm.toxicity import fit, keep_civil


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Each row by itself: null texts, repeated or null ids, further columns and
    empty tables change nothing about the others."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_civil(docs, fit(docs, labels, folds_left_out=False))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Null, empty and wordless texts are in
    no group and stay, as do rows without an id; of rows that share id and text one stays; rows that share an id
    and differ in text are documents of their own."""
    small_batches(spark)
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(digest).alias("a"), F.max(digest).alias("b")).where("n > 1")
    twice = cut(several.select("doc_id", (F.col("a") != F.col("b")).alias("differ")))
    if twice.where("differ").isEmpty():
        found = near_duplicates(docs, width=5, percent=80)
        left = docs.join(cut(found.where("not kept").select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
        if twice.isEmpty():
            return left
        once, more = left.join(twice, "doc_id", "left_anti"), left.join(twice, "doc_id", "left_semi")
    else:  # documents are told apart by id and text
        key = f"key_{uuid.uuid4().hex}"
        keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))))
        found = near_duplicates(keyed.select(F.col(key).alias("id"), "text"), width=5, percent=80, id_col="id").where("id is not null").select("id", "component_id").distinct()
        ids = cut(keyed.where("doc_id is not null").select(F.col(key).alias("id"), "doc_id").distinct().join(found, "id"))
        least = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "id")).alias("least"))
        gone = ids.join(least, "component_id").where("id <> least.id").select(F.col("id").alias(key))
        left = keyed.join(cut(gone), key, "left_anti").select(*docs.columns)
        once, more = left.join(twice, "doc_id", "left_anti"), left.join(twice, "doc_id", "left_semi")
    return once.select(*docs.columns).unionByName(more.select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their id is, null included: they are known by a hash of their
    text. Null and empty texts, and empty tables, lose nothing."""
    small_batches(spark)
    key = f"key_{uuid.uuid4().hex}"
    keyed = docs.withColumn(key, F.xxhash64("text"))
    linked = contaminated(keyed.select(F.col(key).alias("id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="id")
    return keyed.join(cut(linked.select(F.col("id").alias(key)).distinct()), key, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are replaced by a mark; no row goes. Null texts stay null; n_chars follows the text where there is one."""
    small_batches(spark)
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a null text is an empty one, each row is a document."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        written: list[str] = []
        docs = cut(stage(spark, docs, sf_dir), written)
        drop(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
