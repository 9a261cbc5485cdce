"""Sources and sinks: JSON lines, CSV, parquet feature tables, pair text files, numbered text
lines, result reports. All are DataFrame readers / writers; nothing passes through the driver.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from matchsmith.operators.keys import dense_positions

# Offer corpus and pair files: only the columns the pipelines touch are declared.
OFFER_SCHEMA = TY.StructType([
    TY.StructField("id", TY.LongType()),
    TY.StructField("cluster_id", TY.LongType()),
    TY.StructField("title", TY.StringType()),
    TY.StructField("description", TY.StringType()),
    TY.StructField("brand", TY.StringType()),
])
GOLD_SCHEMA = TY.StructType([
    TY.StructField("pair_id", TY.StringType()),
    TY.StructField("label", TY.IntegerType()),
])
REPORT_SEPARATOR = "#####"


def read_json_lines(spark: SparkSession, path: str, schema: TY.StructType | None = None,
                    partitions: int | None = None) -> DataFrame:
    """JSON lines (gzip or plain) with a declared schema. A gzip file is one task, so the
    result is spread over ``partitions`` before any heavy work."""
    df = spark.read.schema(schema or OFFER_SCHEMA).json(path)
    if partitions:
        df = df.repartition(partitions)
    string_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, TY.StringType)]
    return df.na.fill("", subset=string_cols)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",",
             schema: TY.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header row and double-quote escaping; missing values become ''. Values with
    line breaks need ``multi_line``, for which Spark reads a file in one task."""
    r = (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
         .option("sep", delimiter))
    df = r.schema(schema).csv(path) if schema is not None else r.csv(path)
    string_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, TY.StringType)]
    return df.na.fill("", subset=string_cols)


def write_csv(df: DataFrame, path: str, quote_all: bool = False, compression: str | None = None,
              sep: str = ",", mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
    if quote_all:
        w = w.option("quoteAll", True)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Feature-table / vocabulary store between steps (parquet)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ------------------------------------------------------------------------------ pair files

def format_pair_lines(pairs: DataFrame) -> DataFrame:
    """``left#right#label`` lines (column ``line``)."""
    return pairs.select(F.concat_ws("#", F.col("id_left").cast("string"),
                                    F.col("id_right").cast("string"),
                                    F.col("label").cast("string")).alias("line"))


def parse_pair_lines(lines: DataFrame, keep: list[str] | None = None, col: str = "line") -> DataFrame:
    parts = F.split(F.col(col), "#")
    return lines.select(*(keep or []), F.col(col).alias("line"),
                        parts.getItem(0).cast("long").alias("id_left"),
                        parts.getItem(1).cast("long").alias("id_right"),
                        parts.getItem(2).cast("int").alias("label"))


def write_pairs(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    format_pair_lines(pairs).write.mode(mode).text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_pair_lines(spark.read.text(path).withColumnRenamed("value", "line"))


# ------------------------------------------------------------------------------ text lines

def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` with 0-based line numbers per file, computed across tasks
    (file block start, then scan order inside the block), never by reading a file whole."""
    raw = (spark.read.text(path)
           .select(F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("_blk"),
                   F.monotonically_increasing_id().alias("_mid"), "value"))
    return dense_positions(raw, ["_blk", "_mid"], ["file"], "line_no").drop("_blk", "_mid")


# A training file's settings stand in its name, or its folder's: ``<category>_train_<size>...``.
SETTING_NAME = r"([^/_]+)_train_([^/_.]+)[^/]*(?:/[^/]*)?$"


def with_settings(files: DataFrame) -> DataFrame:
    """A file read with the columns ``file, category, size`` parsed from each file's path. A filter
    on them leaves other files unread: Spark applies it to the file list, before any scan."""
    path = F.col("_metadata.file_path")
    return files.select("*", path.alias("file"), F.regexp_extract(path, SETTING_NAME, 1).alias("category"),
                        F.regexp_extract(path, SETTING_NAME, 2).alias("size"))


def discover_settings(spark: SparkSession, path_glob: str) -> DataFrame:
    """``file, category, size`` of all training files: one listing, no rows are read for it but to
    name the files that hold any."""
    return with_settings(spark.read.text(path_glob)).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "category", "size").distinct()


# ------------------------------------------------------------------------------ reports

def append_run(df: DataFrame, path: str, run: str, format: str = "parquet", **options) -> bool:
    """Add one run's rows to a report folder, as many tasks write them. They are staged aside and appear by
    one rename under the run's name, so readers see all of a run or nothing, runs may be added side
    by side, and a run that is added again (a retry) changes nothing. True if this call added it."""
    spark = df.sparkSession
    staged, target = f"{path}/_staging/{uuid.uuid4().hex}", f"{path}/run={quote(run, safe='')}"
    df.write.format(format).options(**options).save(staged)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    src, dst = hadoop.Path(staged), hadoop.Path(target)
    fs = dst.getFileSystem(conf)
    try:  # a rename that fails if the run is there
        files = hadoop.FileContext.getFileContext(fs.getUri(), conf)
        files.rename(fs.makeQualified(src), fs.makeQualified(dst), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        return True
    except Py4JJavaError:
        if not fs.exists(dst):
            raise
        return False
    finally:
        fs.delete(src, True)


def read_runs(spark: SparkSession, path: str, schema: str, format: str = "parquet", **options) -> DataFrame:
    """Rows of all runs of a report folder, with ``run``; no rows if nothing was ever added."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.read.format(format).schema(f"{schema}, run string").options(**options).load(path)


def append_result_row(df: DataFrame, path: str, run: str | None = None) -> None:
    append_run(df, path, run or uuid.uuid4().hex, "csv", header=True)


def write_report(df: DataFrame, path: str, run: str | None = None) -> None:
    """One line per row, fields separated by ``#####``, added under the run's name (by default a new one)."""
    append_run(df, path, run or uuid.uuid4().hex, "csv", sep=REPORT_SEPARATOR)
