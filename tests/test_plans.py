"""Physical-plan properties the scale design relies on."""
from pyspark.sql import functions as F

from matchsmith.operators.joins import bounded_broadcast
from matchsmith.operators.keys import random_ranks


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_random_ranks_window_buckets_not_groups(spark):
    df = spark.range(100).withColumn("g", F.lit(1))
    windows = [x for x in _plan(random_ranks(df, "id", 1, ["g"], chunk=10)).splitlines() if "row_number" in x]
    assert windows and all("_b#" in x for x in windows)


def test_bounded_broadcast_only_under_the_bound(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    small = spark.range(10).withColumnRenamed("id", "k")
    j_small = big.join(bounded_broadcast(small, max_rows=100), "k")
    j_big = small.join(bounded_broadcast(big, max_rows=100), "k")
    assert "broadcast" in j_small._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in j_big._jdf.queryExecution().analyzed().toString().lower()
    assert j_small.count() == 10 and j_big.count() == 10
