"""Stages of the corpus pipeline: an operator each, whose decision takes effect on the documents.

Stages but the last keep the columns of their input, whatever further ones it has; internal
columns begin with two underscores. Rows that share a doc_id are told apart by their text. Rows
without a doc_id pass the near-duplicate stage. Null texts count as empty. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchsmith.llm import near_join, packing, quality, secret_scans
from matchsmith.llm.common import Scratch


def _row_key() -> Column:
    """A document row's name: its id and its text's hash."""
    return F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(F.coalesce("text", F.lit(""))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed = docs.withColumn("__row", _row_key())
    verdict = quality.quality(keyed, key="__row")
    return keyed.join(verdict.filter("kept").select("__row").distinct(), "__row", "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of least id. A document is an id and a text:
    texts that share an id are documents of their own, and rows that repeat both are one."""
    keyed = docs.filter("doc_id is not null").withColumn("__row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = near_join.near_join(keyed, key="__row")
    names = keyed.groupBy("__row").agg(F.min("doc_id").alias("__id"))
    kept = (found.join(names, "__row").groupBy("class_id").agg(F.min(F.struct("__id", "__row")).alias("__least"))
            .select(F.col("__least.__row").alias("__row")))
    same = Window.partitionBy("__row", "doc_id").orderBy("__hash")
    one = (keyed.join(kept, "__row", "left_semi").withColumn("__hash", F.xxhash64(*docs.columns))
           .withColumn("__nth", F.row_number().over(same)).filter("__nth = 1").select(*docs.columns))
    return one.unionByName(docs.filter("doc_id is null"))


def secret_scans_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    scratch = Scratch(spark, "secret-stage")
    verdicts = scratch.table(secret_scans.scan(docs).select("doc_id", "text_hash", "nth", "is_secret"), "verdicts")
    out = secret_scans.redact(docs, verdicts)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences of 4096 tokens."""
    table = Scratch(spark, "packing").table(packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    return packing.pack(table.drop("ids"))
