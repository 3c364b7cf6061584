"""A training-data pipeline over ``documents``: each stage is one of the operators of linkcatalog.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcatalog.llm import bpe, mixing, ngram_join, pii, quality_rules
from linkcatalog.llm.common import materialize


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade rejects go."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicate documents the one with the smallest doc_id stays (rows without an
    id after those with one). Rows are told apart by id and text; of rows that agree in both one stays.
    Documents without words link with nothing and stay.
    """
    found = ngram_join.classify(docs, "doc_id", "text").where("component is not null")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    rows = materialize(found.groupBy("component", "id", "h").agg(F.count("*").alias("times")).withColumn("place", place), "kept")
    best = rows.groupBy("component").agg(F.min("place").alias("best"))
    rows = rows.join(best, "component").withColumn("stays", F.col("place") == F.col("best"))
    lone = F.col("stays") & (F.col("times") == 1)
    own = docs.alias("d")
    h = F.xxhash64(F.col("d.text").cast("string"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.id")) & (h == F.col("k.h"))
    out = own.join(rows.where(~lone).select("id", "h").alias("k"), same, "left_anti")
    again = rows.where("stays and times > 1").select("id", "h").alias("k")
    if not again.isEmpty():
        more = own.join(again, same, "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("d.doc_id").alias("id"), h.alias("h"))
        out = out.union(more.dropDuplicates(["id", "h"]).select("row.*"))
    return out.select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts with digests of the ids and of the decoded text."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: Exact BPE merging and the shuffled mix cannot be told in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
