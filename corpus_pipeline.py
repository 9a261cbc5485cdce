"""Corpus pipeline: quality rules, near duplicates, secret scans, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and
reread as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchsmith.llm import stages
from matchsmith.llm.common import Scratch

STAGES = [
    ("quality rules", stages.quality_rules),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("secret scans", stages.secret_scans_stage),
    ("best-fit packing", stages.best_fit_packing),
]

# Tokenisers, hashing and a forest aren't expressible in SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
