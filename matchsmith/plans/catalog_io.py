"""Registered queries of sources, sinks and small operators: tables through files and back."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import functions as F
from pyspark.sql import types as TY
from pyspark.util import inheritable_thread_target

from matchsmith.functions import labels as LB
from matchsmith.functions import similarity as S
from matchsmith.functions import text as T
from matchsmith.operators import shape as SH
from matchsmith.plans import logs as LG
from matchsmith.plans import oracle as O
from matchsmith.plans.catalog import register
from matchsmith.session import read_table, scratch_path
from matchsmith.sources import fixtures as FX
from matchsmith.sources import io as IO

_OFFERS = TY.StructType([TY.StructField("id", TY.LongType()), TY.StructField("cluster_id", TY.StringType()),
                         TY.StructField("title", TY.StringType()), TY.StructField("description", TY.StringType())])


@register("json_lines_roundtrip", O.with_fixtures() + "\nSELECT id, cluster_id, title, description FROM offers_v")
def json_lines_roundtrip(spark, sf):
    path = scratch_path(spark, "offers")
    FX.offers(spark, sf).select(*_OFFERS.names).write.option("compression", "gzip").json(path)
    return IO.read_json_lines(spark, path, _OFFERS)


@register("csv_roundtrip", """SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE
'a "quoted", ' || c_mktsegment END AS note FROM customer""")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    note = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit('a "quoted", '), "c_mktsegment"))
    df = read_table(spark, sf, "customer").select("c_custkey", "c_name", note.alias("note"))
    IO.write_csv(df, path, quote_all=True, compression="gzip")
    return IO.read_csv(spark, path, schema=df.schema)


@register("feature_store", "SELECT p_partkey, p_type, p_brand FROM part")
def feature_store(spark, sf):
    path = scratch_path(spark, "features")
    IO.write_table(read_table(spark, sf, "part").select("p_partkey", "p_type", "p_brand"), path, partition_by=["p_brand"])
    return IO.read_feature_table(spark, path)


@register("report_lines", """SELECT o_orderpriority || '#####' || CAST(count(*) AS VARCHAR) AS line
FROM orders GROUP BY o_orderpriority""")
def report_lines(spark, sf):
    """Report lines of several runs that are added side by side, each of them twice: every line once."""
    path = scratch_path(spark, "report")
    rows = read_table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    part = lambda i: rows.where(F.pmod(F.xxhash64("o_orderpriority"), F.lit(3)) == i)
    pool = ThreadPool(3)
    pool.map(inheritable_thread_target(lambda i: IO.write_report(part(i % 3), path, f"run {i % 3}")), range(6))
    pool.close()
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("settings_scan", O.with_fixtures() + """
SELECT 'pairs' AS category, size, label, count(*) AS n FROM (
  SELECT 'large' AS size, label FROM pairs_v UNION ALL
  SELECT 'small', label FROM pairs_v WHERE substr(md5('small|' || pair_id), 1, 1) IN ('0', '1', '2', '3')) t GROUP BY ALL""")
def settings_scan(spark, sf):
    """Pair files of two categories and three sizes, read by one glob: settings come from the names, and a
    filter on them leaves the other files unread."""
    base, pairs = scratch_path(spark, "settings"), FX.pair_labels(spark, sf).select("id_left", "id_right", "label", "pair_id")
    small = F.substring(F.md5(F.concat(F.lit("small|"), "pair_id")), 1, 1).isin("0", "1", "2", "3")
    for name, rows in (("pairs_train_large", pairs), ("pairs_train_small", pairs.where(small)), ("pairs_train_xlarge", pairs),
                       ("other_train_small", pairs.where("label = 1"))):
        IO.write_pairs(rows, f"{base}/{name}.txt")
    files = IO.with_settings(spark.read.text(f"{base}/*_train_*/")).where("category = 'pairs' and size in ('small', 'large')")
    found = IO.parse_pair_lines(files.withColumnRenamed("value", "line"), ["category", "size"])
    return found.groupBy("category", "size", "label").agg(F.count(F.lit(1)).alias("n"))


@register("numbered_lines", """SELECT p_brand AS brand, p_name AS value,
row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS line_no FROM part""")
def numbered_lines(spark, sf):
    path = scratch_path(spark, "lines")  # one file a brand
    (read_table(spark, sf, "part").repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey")
     .select("p_brand", F.col("p_name").alias("value")).write.partitionBy("p_brand").text(path))
    rows = IO.numbered_lines(spark, f"{path}/*/")
    brand = F.url_decode(F.url_decode(F.regexp_extract("file", r"p_brand=([^/]*)/", 1)))  # escaped as a folder and as a URI
    return rows.select(brand.alias("brand"), "value", F.col("line_no").cast("long").alias("line_no"))


@register("appended_results", """SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT o_orderpriority AS status, count(*) AS n FROM orders GROUP BY ALL""")
def appended_results(spark, sf):
    path = scratch_path(spark, "results")
    for c in ("o_orderstatus", "o_orderpriority"):
        IO.append_result_row(read_table(spark, sf, "orders").groupBy(F.col(c).alias("status")).agg(F.count(F.lit(1)).alias("n")), path)
    return IO.read_runs(spark, path, "status string, n long", "csv", header=True).drop("run")


@register("null_to_empty", "SELECT doc_id, coalesce(nullif(lang, 'en'), '') AS lang, source FROM documents")
def null_to_empty(spark, sf):
    return T.null_to_empty(read_table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"), "source"))


@register("match_label_map", """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER)
AS label FROM orders""")
def match_label_map(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", LB.match_label_map(F.col("o_orderstatus"), "F", "O").alias("label"))


@register("table_prefix", O.with_fixtures() + """
SELECT pair_id, label, title_left AS ltable_title, title_right AS rtable_title, brand_left AS ltable_brand,
       brand_right AS rtable_brand FROM pairs_v""")
def table_prefix(spark, sf):
    return SH.suffix_to_table_prefix(FX.pair_rows(spark, sf).select(
        "pair_id", "label", "title_left", "title_right", "brand_left", "brand_right"))


@register("inserted_column", """SELECT s_suppkey, s_name, upper(s_name) AS words, s_nationkey FROM supplier""")
def inserted_column(spark, sf):
    df = read_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    out = SH.insert_after(df, "words", F.upper("s_name"), "s_name")
    assert out.columns == ["s_suppkey", "s_name", "words", "s_nationkey"]
    return out


@register("run_log_results", """SELECT CAST(o_orderkey AS VARCHAR) AS file, 'mtcat run' AS setting,
CAST(o_orderkey % 97 AS DOUBLE) AS precision, CAST(o_custkey % 89 AS DOUBLE) AS recall,
CAST(o_orderkey % 83 AS DOUBLE) AS f1 FROM orders""")
def run_log_results(spark, sf):
    """A run log rendered from each order: a header, an epoch too early, the end of training, two epochs."""
    epoch = lambda f1, p, r: F.concat(F.lit("===>  Finished Epoch 1 | Run | a: 1 | b: 2 | c: 3 | F1: "), f1, F.lit(" | Prec: "), p,
                                      F.lit(" | Rec: "), r, F.lit(" | Ex/s: 9"))
    text = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("string")
    good = epoch(text("o_orderkey", 83), text("o_orderkey", 97), text("o_custkey", 89))
    other = epoch(F.lit("1"), F.lit("1"), F.lit("1"))
    lines = F.array(F.lit("mtcat run"), other, F.lit("Training done."), good, other)
    rows = read_table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.posexplode(lines).alias("line_no", "value"))
    return LG.parse_run_log(rows)


@register("numeric_similarity", """SELECT l_orderkey, l_linenumber, round(CASE WHEN greatest(abs(l_quantity), abs(l_tax * 100)) = 0 THEN 1.0
ELSE 1 - abs(l_quantity - l_tax * 100) / greatest(abs(l_quantity), abs(l_tax * 100)) END, 6) AS sim FROM lineitem""")
def numeric_similarity(spark, sf):
    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(
        S.abs_norm(F.col("l_quantity"), F.col("l_tax") * 100), 6).alias("sim"))


_SETS = f"""{O.with_fixtures()},
sets AS (SELECT pair_id, list_distinct({O.split_ws_sql('title_left')}) AS a, list_distinct({O.split_ws_sql('title_right')}) AS b FROM pairs_v),
sized AS (SELECT pair_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS n FROM sets)"""


@register("set_measures", _SETS + """
SELECT pair_id, round(2.0 * n / (na + nb), 6) AS dice, round(n / least(na, nb), 6) AS overlap FROM sized WHERE na > 0 AND nb > 0""")
def set_measures(spark, sf):
    a, b = (F.array_distinct(T.split_ws(F.coalesce(F.col(f"title_{s}"), F.lit("")))) for s in ("left", "right"))
    p = FX.pair_rows(spark, sf).select("pair_id", a.alias("a"), b.alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    return p.select("pair_id", F.round(S.set_dice(F.col("a"), F.col("b")), 6).alias("dice"),
                    F.round(S.set_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))
