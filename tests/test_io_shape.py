import os
import tempfile

import pytest
from pyspark.sql import functions as F

from matchsmith.operators import shape as SH
from matchsmith.sources import io as IO


def _tmp():
    return tempfile.mkdtemp(prefix="ms-test-")


def test_pair_lines_roundtrip(spark):
    df = spark.createDataFrame([(1, 2, 1), (30, 4, 0)], "id_left long, id_right long, label int")
    d = os.path.join(_tmp(), "pairs")
    IO.write_pairs(df, d)
    back = IO.read_pairs(spark, d)
    assert {(r.line, r.id_left, r.id_right, r.label) for r in back.collect()} == \
        {("1#2#1", 1, 2, 1), ("30#4#0", 30, 4, 0)}


def test_csv_quotes_nulls_and_report_separator(spark):
    df = spark.createDataFrame([(1, 'say "hi", ok', None)], "id int, a string, b string")
    d = os.path.join(_tmp(), "csv")
    IO.write_csv(df, d, quote_all=True, compression="gzip")
    back = IO.read_csv(spark, d, multi_line=True).first()
    assert back.a == 'say "hi", ok' and back.b == ""
    r = os.path.join(_tmp(), "report")
    IO.write_report(spark.createDataFrame([("lr", 0.5)], "m string, f1 double"), r)
    text = [x.value for x in spark.read.text(r).collect()]
    assert text == ["lr#####0.5"]


def test_runs_are_added_once_and_side_by_side(spark):
    from multiprocessing.pool import ThreadPool
    path = os.path.join(_tmp(), "runs")
    assert IO.read_runs(spark, path, "n long").count() == 0
    with ThreadPool(4) as pool:  # five runs, each added three times
        added = pool.map(lambda i: IO.append_run(spark.range(i % 5, i % 5 + 3).toDF("n"), path, f"run/{i % 5} ="), range(15))
    assert sum(added) == 5
    got = sorted((r.run, r.n) for r in IO.read_runs(spark, path, "n long").collect())
    assert got == sorted((f"run/{i} =", n) for i in range(5) for n in range(i, i + 3))


def test_settings_prune_files(spark):
    base = _tmp()
    for name in ("shoes_train_small", "shoes_train_large.txt", "cameras_train_small"):
        spark.createDataFrame([("1#2#1",)], "value string").write.text(os.path.join(base, name))
    files = IO.with_settings(spark.read.text(os.path.join(base, "*_train_*/")))
    assert {(r.category, r.size) for r in files.collect()} == {("shoes", "small"), ("shoes", "large"), ("cameras", "small")}
    small = files.where("category = 'shoes' and size = 'small'")
    assert small.count() == 1
    few = small.select("value").collect()
    assert [r.value for r in few] == ["1#2#1"]


def test_numbered_lines_and_settings(spark):
    base = _tmp()
    with open(os.path.join(base, "computers_train_large.txt"), "w") as f:
        f.write("\n".join(f"line{i}" for i in range(2500)) + "\n")
    with open(os.path.join(base, "shoes_train_small.txt"), "w") as f:
        f.write("a\nb\n")
    lines = IO.numbered_lines(spark, os.path.join(base, "*.txt"))
    big = {r.line_no: r.value for r in lines.where(F.col("file").endswith("large.txt")).collect()}
    assert big == {i: f"line{i}" for i in range(2500)}
    s = {(r.category, r.size) for r in IO.discover_settings(spark, os.path.join(base, "*.txt")).collect()}
    assert s == {("computers", "large"), ("shoes", "small")}


def test_flatten_for_matcher(spark):
    df = spark.createDataFrame([("1#2", 1, 2, 1, "A-b c!", "x", "k1")],
                               "pair_id string, id_left long, id_right long, label int, "
                               "title_left string, title_right string, cluster_id string")
    out = SH.flatten_for_matcher(df.drop("cluster_id"))
    assert out.columns == ["id", "label", "left_title", "right_title"]
    assert out.first().left_title == "A b c"
    with pytest.raises(ValueError):
        SH.flatten_for_matcher(df.withColumnRenamed("title_right", "title_other"))


def test_pairs_from_tables_and_name_only(spark):
    a = spark.createDataFrame([(1, "n1", "t1", 0), (1, "n1b", "t1b", 1), (2, "n2", "t2", 2)],
                              "aid long, name string, type string, _row long")
    b = spark.createDataFrame([(7, "m7")], "bid long, title string")
    p = spark.createDataFrame([(1, 7, 1, 0), (2, 7, 0, 1)], "l long, r long, y int, o long")
    out = SH.pairs_from_tables(a, b, p, "aid", "bid", "l", "r", "y", ["o"])
    rows = {r.id: r for r in out.collect()}
    assert rows[1].left_name == "n1b" and rows[1].left_atype == "t1b"   # last duplicate wins
    assert rows[2].right_title == "m7"
    names = SH.keep_name_only(out)
    assert names.columns == ["id", "label", "left_Name", "right_Name"]
    bad = spark.createDataFrame([(3, 7, 1, 0)], "l long, r long, y int, o long")
    with pytest.raises(Exception, match="missing from an entity table"):  # when the rows are read
        SH.pairs_from_tables(a, b, bad, "aid", "bid", "l", "r", "y", ["o"]).collect()


def test_name_lookup_last_wins_and_unknown_fails(spark):
    names = spark.createDataFrame([("x", "null cat null", 1), ("x", "shoe", 2), ("y", "null z null", 3)],
                                  "name string, words string, line_no long")
    pairs = spark.createDataFrame([("x", "y")], "ln string, rn string")
    r = SH.name_lookup(pairs, names, "ln", "rn").first()
    assert r.ln_words == "shoe" and r.rn_words == ""
    with pytest.raises(Exception, match="no category words"):
        SH.name_lookup(spark.createDataFrame([("q", "y")], "ln string, rn string"), names, "ln", "rn").collect()


def test_entity_table_first_occurrence(spark):
    p = spark.createDataFrame([("b", 1, 2, "t1", "t2"), ("a", 2, 3, "T2", "t3")],
                              "pair_id string, id_left long, id_right long, title_left string, "
                              "title_right string")
    e = {r.id: r.title for r in SH.entity_table(p, ["title"]).collect()}
    assert e == {1: "t1", 2: "T2", 3: "t3"}
