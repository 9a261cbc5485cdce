"""Result tables from training logs: a section header is carried forward over line order and
metrics are read from fixed positions of the result lines.

Input is ``file, line_no, value`` (``sources.io.numbered_lines``). Windows are per log file
(one run each), ordered by line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Section headers of a run log and the metric rows of a score log.
RUN_HEADERS = ["original", "mtcat", "mt_added"]
TRAINING_DONE = "Training done"
EPOCH_LINE = "Finished Epoch"
SCORE_KINDS = ["1,", "mac avg", "macro avg w", "micro avg"]


def _running(col, w):
    return F.last(col, ignorenulls=True).over(w)


def parse_run_log(lines: DataFrame) -> DataFrame:
    """``file, setting, precision, recall, f1``: per header section, the first
    ``Finished Epoch`` line after ``Training done`` (fields 6, 7 and 5 of ``|``)."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    wp = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("value")
    is_hdr = F.lit(False)
    for h in RUN_HEADERS:
        is_hdr = is_hdr | v.startswith(h)
    is_fe = v.contains(EPOCH_LINE)
    x = (lines
         .withColumn("hdr", _running(F.when(is_hdr, F.trim(v)), w))
         .withColumn("hdr_line", _running(F.when(is_hdr, F.col("line_no")), w))
         .withColumn("td_line", _running(F.when(v.contains(TRAINING_DONE), F.col("line_no")), w))
         .withColumn("prev_fe", _running(F.when(is_fe, F.col("line_no")), wp)))
    keep = (is_fe & F.col("td_line").isNotNull()
            & (F.col("hdr_line").isNull() | (F.col("td_line") > F.col("hdr_line")))
            & (F.col("prev_fe").isNull() | (F.col("prev_fe") < F.col("td_line"))))
    parts = F.split(v, r"\|")

    def field(i):
        return F.trim(F.split(parts.getItem(i), ":").getItem(1)).cast("double")
    return x.where(keep).select("file", F.col("hdr").alias("setting"),
                                field(6).alias("precision"), field(7).alias("recall"),
                                field(5).alias("f1"))


def parse_score_log(lines: DataFrame) -> DataFrame:
    """``file, setting, <kind>_precision/_recall/_f1 ..., accuracy`` per ``...results`` section
    (the setting is the header text plus its line number, so repeated headers stay apart)."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    v = F.trim(F.col("value"))
    start = F.when(v.contains("results"),
                   F.concat(v, F.lit("_row"), (F.col("line_no") + 1).cast("string")))
    kind = (F.when(v.contains("mac avg"), "macro").when(v.contains("macro avg w"), "weighted")
            .when(v.contains("micro avg"), "micro").when(v.contains("accuracy"), "accuracy")
            .when(v.startswith("1,"), "class1"))
    x = lines.withColumn("setting", _running(start, w)).withColumn("kind", kind) \
        .where(F.col("kind").isNotNull() & F.col("setting").isNotNull())
    f = F.split(v, ",")
    x = x.select("file", "setting", "kind",
                 f.getItem(1).cast("double").alias("p"), f.getItem(2).cast("double").alias("r"),
                 f.getItem(3).cast("double").alias("f1"),
                 F.regexp_extract(v, r"=\s*([0-9.eE+-]+)", 1).cast("double").alias("acc"))
    kinds = ["class1", "macro", "weighted", "micro"]
    wide = (x.where(F.col("kind") != "accuracy").groupBy("file", "setting").pivot("kind", kinds)
            .agg(F.last("p").alias("precision"), F.last("r").alias("recall"),
                 F.last("f1").alias("f1")))
    acc = x.where(F.col("kind") == "accuracy").groupBy("file", "setting") \
        .agg(F.last("acc").alias("accuracy"))
    return wide.join(acc, ["file", "setting"], "left")
