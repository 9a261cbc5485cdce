import gzip
import json
import os
import tempfile

from pyspark.sql import functions as F

from matchsmith.functions.labels import match_label_map
from matchsmith.operators import shape as SH
from matchsmith.sources import io as IO
from matchsmith.streaming.offers import clean_offer_stream


def test_read_json_lines_gzip_with_schema(spark):
    d = tempfile.mkdtemp(prefix="ms-json-")
    with gzip.open(os.path.join(d, "offers.json.gz"), "wt") as f:
        for r in [{"id": 1, "cluster_id": 5, "title": "A b", "extra": 1},
                  {"id": 2, "cluster_id": 5, "description": "x"}]:
            f.write(json.dumps(r) + "\n")
    df = IO.read_json_lines(spark, os.path.join(d, "*.json.gz"), partitions=4)
    rows = {r.id: r for r in df.collect()}
    assert rows[2].title == "" and rows[1].description == "" and df.columns == \
        ["id", "cluster_id", "title", "description", "brand"]


def test_feature_store_and_append(spark):
    d = tempfile.mkdtemp(prefix="ms-store-")
    df = spark.createDataFrame([("t", "w", 0)], "combo string, word string, idx long")
    IO.write_table(df, os.path.join(d, "vocab"), partition_by=["combo"])
    assert IO.read_feature_table(spark, os.path.join(d, "vocab")).count() == 1
    for _ in range(2):
        IO.append_result_row(spark.createDataFrame([("lr", 0.5)], "m string, f1 double"),
                             os.path.join(d, "results"))
    assert IO.read_csv(spark, os.path.join(d, "results")).count() == 2


def test_table_prefix_and_match_map(spark):
    df = spark.createDataFrame([(1, "a", "b", 0)], "pair_id long, title_left string, title_right string, label int")
    assert SH.suffix_to_table_prefix(df).columns == ["pair_id", "ltable_title", "rtable_title", "label"]
    m = spark.createDataFrame([("0",), ("1",), ("x",)], "y string").select(match_label_map(F.col("y")))
    assert [r[0] for r in m.collect()] == [0, 1, 2]


def test_offer_stream_cleaning(spark):
    d = tempfile.mkdtemp(prefix="ms-stream-")
    src = os.path.join(d, "in")
    spark.createDataFrame([(1, "The Red Shoe!", "very nice shoe for you")],
                          "id long, title string, description string").write.parquet(src)
    schema = "id long, title string, description string"
    stream = spark.readStream.schema(schema).parquet(src)
    q = clean_offer_stream(stream).writeStream.format("memory").queryName("clean_offers_t") \
        .option("checkpointLocation", os.path.join(d, "ck")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM clean_offers_t").first()
    assert r.title == "red shoe" and r.words == 7


def test_null_to_empty(spark):
    from matchsmith.functions.text import null_to_empty
    df = spark.createDataFrame([(None, 1, None)], "a string, n int, b string")
    r = null_to_empty(df).first()
    assert r.a == "" and r.b == "" and r.n == 1


def test_insert_after_and_seeded_shuffle(spark):
    from matchsmith.operators.splits import seeded_shuffle
    df = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string")
    assert SH.insert_after(df, "z", F.lit(0), "x").columns == ["id", "x", "z", "y"]
    r = spark.range(50).withColumnRenamed("id", "k")
    a = [x.k for x in seeded_shuffle(r, "k", 3).collect()]
    b = [x.k for x in seeded_shuffle(r.repartition(7), "k", 3).collect()]
    assert a == b and sorted(a) == list(range(50)) and a != list(range(50))
