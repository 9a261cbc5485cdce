"""Spark session, checkpoint folder and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CHECKPOINT_FALLBACK: dict[int, str] = {}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "matchsmith", extra_conf: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster use the session you already have."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder for cutting lineage.

    Uses the shared folder the cluster names in ``spark.checkpoint.dir``. Only when that is
    unset and Spark runs in local mode (tests, bench) is a scratch folder made under /tmp; on a
    cluster without the setting this raises, since a machine-local folder would not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store)")
    key = id(sc)
    if key not in _LOCAL_CHECKPOINT_FALLBACK:
        _LOCAL_CHECKPOINT_FALLBACK[key] = tempfile.mkdtemp(prefix="matchsmith-ckpt-")
    sc.setCheckpointDir(_LOCAL_CHECKPOINT_FALLBACK[key])
    return sc.getCheckpointDir() or _LOCAL_CHECKPOINT_FALLBACK[key]


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, sort_within: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Like ``checkpoint`` this cuts the lineage and survives executor loss, and the read-back
    table supports column pruning and filter pushdown; ``sort_within`` orders rows inside each
    file so row-group statistics let range filters skip most of it."""
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/matchsmith-tables/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    w = df.sortWithinPartitions(*sort_within) if sort_within else df
    w.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def release_materialized(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote in this application, and forget the stages
    that ``session_memo`` keeps over them. Call it when no DataFrame over them is read any more."""
    app = spark.sparkContext.applicationId
    for k in [k for k in _MEMO if k[0] == app]:
        del _MEMO[k]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/matchsmith-tables/{app}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder, for files that a query writes and rereads."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/matchsmith-files/{label}-{uuid.uuid4().hex}"


_MEMO: dict[tuple, object] = {}


def session_memo(spark: SparkSession, key: tuple, build):
    """Reuse a derived (checkpointed) table within one Spark application: several queries read
    the same fixture pairs or sampling stages, which are computed and written once."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table. A scan with fewer splits than the cluster has cores (a small file, or one
    large row group that only one task can read) is spread round-robin over twice the default
    parallelism; a large table keeps its scan splits and no shuffle is added."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    try:
        par = spark.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except (AttributeError, NotImplementedError):  # no RDD access: keep the scan as it is
        return df
    if splits < par:
        df = df.repartition(2 * par)
    return df
