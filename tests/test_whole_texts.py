"""Offers carry whole documents; random ranks don't depend on the chunk; names are kept by rule."""
import pytest
from pyspark.sql import functions as F

from matchsmith.operators import shape
from matchsmith.operators.keys import random_ranks
from matchsmith.sources import fixtures


def test_offer_words_equal_document_words(spark):
    sf = "/root/testdata/sf0.001"
    words = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    offers = fixtures.offers(spark, sf).select("id", (words(F.col("title")) + words(F.col("description"))).alias("n"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), words(F.col("text")).alias("m"))
    rows = offers.join(docs, "id").collect()
    assert len(rows) == 200 and all(r["n"] == r["m"] for r in rows)


@pytest.mark.parametrize("chunk", [7, 50, 300])
def test_random_ranks_same_at_any_chunk(spark, chunk):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    want = {(r["g"], r["id"]): r["rank"] for r in random_ranks(df, "id", 5, ["g"]).collect()}
    got = {(r["g"], r["id"]): r["rank"] for r in random_ranks(df, "id", 5, ["g"], chunk=chunk).collect()}
    assert got == want
    alone = random_ranks(df, "id", 5, chunk=chunk).orderBy("rank").collect()
    assert [r["rank"] for r in alone] == list(range(1000))


def frame(spark, *columns):
    return spark.createDataFrame([tuple(range(len(columns)))], ", ".join(f"`{c}` int" for c in columns))


def test_keep_name_only_rules(spark):
    kept = shape.keep_name_only(frame(spark, "k", "y", "left_title", "left_name", "right_brand", "right_Name", "right_title"))
    assert kept.columns == ["id", "label", "left_Name", "right_Name"] and kept.head() == (0, 1, 2, 5)
    words = shape.keep_name_only(frame(spark, "k", "y", "left_name", "left_mtname", "left_mtname2", "right_title", "RIGHT_MTNAME"))
    assert words.columns == ["id", "label", "left_Name", "left_mtname", "right_Name", "right_mtname"]
    assert words.head() == (0, 1, 2, 4, 5, 6)
    with pytest.raises(ValueError):
        shape.keep_name_only(frame(spark, "k", "y", "left_name", "right_brand"))
