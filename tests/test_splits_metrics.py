import math

import pytest
from pyspark.sql import functions as F

from matchsmith.operators import metrics as M
from matchsmith.operators import splits as SP


def labelled(spark, n_pos=97, n_neg=203):
    rows = [(f"p{i}", 1) for i in range(n_pos)] + [(f"n{i}", 0) for i in range(n_neg)]
    return spark.createDataFrame(rows, "pair_id string, label int")


def test_label_noise_flips_exact_counts(spark):
    df = labelled(spark)
    for rate, steps in [(0.1, 1), (0.03, 1), (0.1, 3)]:
        out = SP.add_label_noise(df, "pair_id", "label", rate, rate, steps, steps)
        c = {(r.label, r.flipped): r.n for r in
             out.groupBy("label", "flipped").agg(F.count("*").alias("n")).collect()}
        assert c.get((0, True), 0) == steps * math.floor(97 * rate)
        assert c.get((1, True), 0) == steps * math.floor(203 * rate)
    a = {tuple(r) for r in SP.add_label_noise(df, seed=5).collect()}
    b = {tuple(r) for r in SP.add_label_noise(df.repartition(7), seed=5).collect()}
    assert a == b


def test_noise_grid_equals_single_settings(spark):
    df = labelled(spark, 40, 60)
    grid = SP.label_noise_grid(df)
    assert grid.count() == 100 * len(SP.NOISE_GRID)
    one = SP.add_label_noise(df, pos_rate=0.1, neg_rate=0.1, pos_steps=2, neg_steps=2)
    g = grid.where(F.col("setting") == SP.noise_setting_name(0.1, 2)).select("pair_id", "label")
    assert {tuple(r) for r in g.collect()} == {tuple(r) for r in one.select("pair_id", "label").collect()}


def test_stratified_folds_balanced_and_ntile_like(spark):
    df = labelled(spark)
    f = SP.stratified_folds(df, "label", ["pair_id"], 5)
    sizes = {}
    for r in f.groupBy("label", "fold").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r.label, []).append((r.fold, r.n))
    for lab, fs in sizes.items():
        ns = [n for _, n in sorted(fs)]
        assert max(ns) - min(ns) <= 1 and ns == sorted(ns, reverse=True)
        assert sum(ns) == (97 if lab == 1 else 203)


def test_split_by_ids_disjoint_and_complete(spark):
    df = labelled(spark)
    ids = df.where(F.col("pair_id").endswith("3")).select("pair_id")
    tr, va = SP.split_by_ids(df, ids)
    a, b = {r[0] for r in tr.collect()}, {r[0] for r in va.collect()}
    assert not (a & {x[0] for x in b}) and len(a) + len(b) == 300


def test_metrics_by_hand(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "t int, p int")
    pc = {r["class"]: r for r in M.per_class_metrics(df, "t", "p").collect()}
    assert pc[1].precision == pytest.approx(3 / 5) and pc[1].recall == pytest.approx(3 / 4)
    assert pc[1].f1 == pytest.approx(2 * 0.6 * 0.75 / 1.35)
    assert pc[0].support == 6
    avg = M.averaged_metrics(M.per_class_metrics(df, "t", "p")).first()
    assert avg.accuracy == pytest.approx(0.7)
    assert avg.macro_f1 == pytest.approx((pc[0].f1 + pc[1].f1) / 2)
    zero = spark.createDataFrame([(1, 0), (1, 0)], "t int, p int")
    z = {r["class"]: r for r in M.per_class_metrics(zero, "t", "p").collect()}
    assert z[1].precision == 0.0 and z[1].f1 == 0.0


def test_class_ratio_half_even_and_null_profile(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 5, "label int")
    assert M.class_ratio(df).first().ratio == 2          # 2.5 -> 2
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 7, "label int")
    assert M.class_ratio(df).first().ratio == 4          # 3.5 -> 4
    n = spark.createDataFrame([(None, "a"), (1, None), (None, None)], "x int, y string")
    assert {r.column: r.nulls for r in M.null_profile(n).collect()} == {"x": 2, "y": 2}
