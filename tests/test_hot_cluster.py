"""A cluster with most of the offers: the sample is exact and reads only a bounded prefix."""
from pyspark.sql import functions as F

from matchsmith.operators.sampling import draws
from matchsmith.plans import training_sets as TS


def test_hot_cluster_sample_is_bounded(spark):
    words = ["red", "blue", "green", "shoe", "boot", "lace", "sole", "heel", "size", "pack"]
    rows = []
    for i in range(4000):
        c = "hot" if i < 3000 else f"c{i % 10}"
        title = " ".join(words[(i // 10 ** k) % 10] for k in range(4)) + f" item{i}"
        rows.append((i, c, title, "long description with enough words here", "b"))
    offers = spark.createDataFrame(rows, "id long, cluster_id string, title string, "
                                         "description string, brand string")
    gold = spark.createDataFrame([(0, 1), (5, 7), (3001, 3011), (2999, 3500)],
                                 "id_left long, id_right long")
    cfg = TS.SamplingConfig(positives=15)
    parts = TS.prepare(offers, gold, cfg)
    m = parts.ranked.where("cluster_id = 'hot'").count()
    assert m == 3000                          # 4.5 million candidate pairs, never listed
    pos = TS.positives(parts, cfg).where("cluster_id = 'hot'").collect()
    assert len(pos) == 15
    keys = {(r.id_left, r.id_right) for r in pos}
    assert len(keys) == 15 and all(a < b < 3000 for a, b in keys)
    assert not keys & {(0, 1), (5, 7), (2999, 3500)}
    # at most S clean and S/2 bad pairs are drawn of a cluster
    plan = TS.positive_plan(parts.ranked, parts.gold_norm, 15).where("cluster_id = 'hot'").withColumns(
        {"n_clean": F.col("good_total"), "n_bad": F.col("total") - F.col("good_total")})
    assert draws(plan, 42, ["cluster_id"]).count() <= 22
